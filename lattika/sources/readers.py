"""Reading and writing records in the formats of datasets and trajectories."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.operators.ordered import numbered


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local one if driver and executors are one process; else an error."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="lattika-")


def parse_slice(path: str) -> tuple[str, int | None, int | None]:
    """path@[a:b] as path, a, b; bounds must not be negative."""
    found = re.fullmatch(r"(?P<path>.*)@\[(?P<a>-?\d*):(?P<b>-?\d*)\]", path)
    if not found:
        return path, None, None
    a, b = (int(found[k]) if found[k] else None for k in "ab")
    if min(a or 0, b or 0) < 0:
        raise ValueError("bounds of a slice must not be negative")
    return found["path"], a, b


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of .jsonl or .parquet, or a slice of them in the order of a key. Lines that are no JSON are dropped; other endings raise."""
    path, a, b = parse_slice(path)
    if path.endswith(".jsonl"):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file: {path}")
    if a is None and b is None:
        return df
    if not order:
        raise ValueError("a slice needs an order: files have none in Spark")
    df = numbered(df, [F.col(c) for c in order], "__k").filter(F.col("__k") >= (a or 0))
    return (df.filter(F.col("__k") < b) if b is not None else df).drop("__k")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines or JSON arrays, each file by its first sign. Lines are read in splits; an array is parsed as a stream, item by item, by the task of its file."""
    first = F.substring(F.trim("value"), 1, 1)
    heads = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), first.alias("c"))
    kinds = {r["file"]: r["c"] for r in heads.groupBy("file").agg(F.min_by("c", "at").alias("c")).collect()}  # a row for each file
    arrays, lines = [f for f, c in kinds.items() if c == "["], [f for f, c in kinds.items() if c != "["]
    parts = [spark.read.schema(schema).option("multiLine", many).json(files) for files, many in ((arrays, True), (lines, False)) if files]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else spark.createDataFrame([], spark.read.schema(schema).json(path).schema)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, written by the executors."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON array in each part file, written row by row: the first line opens it, each further one begins with a comma, the last closes it."""
    rows = df.select(F.to_json(F.struct("*")).alias("j"))

    def lines(batches):
        opened = False
        for batch in batches:
            text = batch.column(0).to_pylist()
            if text:
                out = [("," if opened or k else "[") + x for k, x in enumerate(text)]
                opened = True
                yield pa.RecordBatch.from_pydict({"value": out})
        yield pa.RecordBatch.from_pydict({"value": ["]" if opened else "[]"]})

    rows.mapInArrow(lines, "value string").write.mode(mode).text(path)


def trajectory_name(prompt_id, question):
    """File name of a trajectory: the cleaned id, else the start of the question's digest."""
    clean = F.regexp_replace(prompt_id.cast("string"), r"[^\w\-]", "_")
    return F.coalesce(F.nullif(clean, F.lit("")), F.substring(F.md5(question), 1, 12))


def write_trajectories(df: DataFrame, path: str, prompt_id: str, question: str, every: int = 1, order: str | None = None) -> None:
    """One folder for each prompt; every n-th sample of a prompt in an order."""
    out = df.withColumn("name", trajectory_name(F.col(prompt_id), F.col(question)))
    if every > 1:
        out = out.withColumn("__k", F.row_number().over(W.partitionBy("name").orderBy(order or prompt_id)) - 1).filter(F.col("__k") % every == 0).drop("__k")
    out.write.mode("append").partitionBy("name").json(path)


def convert_splits(spark: SparkSession, splits: dict[str, list[str]], path: str) -> None:
    """Parquet shards of each split as JSON lines."""
    for split, shards in splits.items():
        spark.read.parquet(*shards).write.mode("overwrite").json(f"{path}/{split}")


def save_rows(df: DataFrame, folder: str, rollout: int) -> None:
    """Rows of a rollout for a later look: a folder for each rollout, written once."""
    df.write.mode("overwrite").parquet(f"{folder}/rollout={rollout}")


def load_rows(spark: SparkSession, folder: str, rollout: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/rollout={rollout}")


def prompt_text(df: DataFrame, prompt: str = "prompt", label: str | None = None) -> DataFrame:
    """Adds the text of the first message of a list of messages as `text`, and the ground truth of a struct as `label`."""
    out = df.withColumn("text", F.get(F.col(prompt), 0)["content"])
    return out.withColumn("label", F.col(label)["ground_truth"]) if label else out


def reshape_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Raises on roles other than system, user, assistant and tool."""
    bad = F.exists(messages, lambda m: ~m["role"].isin("system", "user", "assistant", "tool"))
    return df.filter(F.when(bad, F.raise_error(F.lit("unknown role"))).otherwise(F.lit(True)))
