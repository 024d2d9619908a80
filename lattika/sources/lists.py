"""Lists of predicates and names, corpora, and the state of a data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.operators.curation import NS

#: The whitelist file of each data set, the one of all, and the data set that stands in for unknown ones (fixed values).
WHITELISTS = {"cwq": "filtered_cwq_white_list.json", "webqsp": "filtered_webqsp_white_list.json", "grailqa": "filtered_grailqa_white_list.json", "simpleqa": "filtered_cwq_white_list.json"}
FULL_WHITELIST, FALLBACK = "filtered_full_white_list.json", "cwq"


def list_items(text: Column) -> Column:
    """The items of a JSON list of strings, which may stand between fences; null if it is none."""
    inside = F.when(F.trim(text).startswith("```"), F.get(F.split(text, "```"), 1)).otherwise(text)
    return F.from_json(F.regexp_replace(inside, r"^\s*(?:json)?\s*(?=\[)", ""), "array<string>")


def dotted(iri: Column) -> Column:
    """The dotted id of an IRI of the name space; null for others."""
    return F.when(iri.startswith(NS), F.translate(F.regexp_replace(iri, f"^{NS}", ""), "/", "."))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """item: the strings of a file that holds one JSON list, fenced or not. A file that holds no list raises."""
    items = list_items(F.col("value"))
    sound = F.when(items.isNull(), F.raise_error(F.lit("no JSON list of strings"))).otherwise(items)
    return spark.read.text(path, wholetext=True).select(F.explode(sound).alias("item"))


def load_whitelist(spark: SparkSession, folder: str, dataset: str = FALLBACK, full: bool = False) -> list[str] | None:
    """Dotted relations of a data set's whitelist, or of the one of all; an unknown data set takes the fallback's; None, no filtering, without the file.

    A whitelist is a list of a few thousand names that goes into a filter.
    """
    name = FULL_WHITELIST if full else WHITELISTS.get(dataset.lower(), WHITELISTS[FALLBACK])
    path = f"{folder}/{name}"
    if not _exists(spark, path):
        return None
    rows = read_list(spark, path).select(dotted(F.col("item")).alias("item")).filter("item is not null").distinct()
    return sorted(r[0] for r in rows.collect())


def load_predicates(spark: SparkSession, path: str) -> list[str]:
    """Predicates of a blacklist, as they are."""
    return sorted({r[0] for r in read_list(spark, path).collect()})


def load_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a blacklist, trimmed and in lower case."""
    return sorted({r[0] for r in read_list(spark, path).select(F.lower(F.trim("item"))).collect()})


def load_corpus(spark: SparkSession, path: str, schema: str = "id string, contents string") -> DataFrame:
    """Documents of JSON lines."""
    return spark.read.schema(schema).json(path)


def docs_at(corpus: DataFrame, wanted: DataFrame, doc: str = "doc") -> DataFrame:
    """The rows of wanted with the documents that they name, by an equi-join."""
    return wanted.join(corpus, doc)


STATE = "sample_offset long, epoch_id int, sample_group_index long, sample_index long, metadata map<string, string>"


def save_state(spark: SparkSession, folder: str, rollout: int, **state) -> None:
    """Offset, epoch and counters of a data source after a rollout."""
    row = tuple(state.get(f.split()[0], {} if f.startswith("metadata") else 0) for f in ("sample_offset", "epoch_id", "sample_group_index", "sample_index", "metadata"))
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").json(f"{folder}/state-{rollout}")


def load_state(spark: SparkSession, folder: str, rollout: int) -> dict | None:
    """What save_state wrote; None if there is nothing."""
    path = f"{folder}/state-{rollout}"
    if not _exists(spark, path):
        return None
    row = spark.read.schema(STATE).json(path).first().asDict()
    return row | {"metadata": row["metadata"] or {}}
