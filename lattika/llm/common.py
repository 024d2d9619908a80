"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Spark puts into one Arrow batch for the Python stages (at least a row); texts may be long.
ARROW_ROWS, ARROW_BYTES = 1000, 8_000_000
#: Bytes of a row group of intermediate tables.
ROW_GROUP = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch for the session; smaller bounds that are already set stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local one if driver and executors are one process; else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string or binary column; null counts as empty.

    The bytes start at offset 0 and hold nothing between the values.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, off - off[0]


def text_slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes each, or a single longer row."""
    ends = np.cumsum(lengths)
    i, n = 0, len(lengths)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = []


def powers(n: int, base: int = 0x9E3779B97F4A7C15 | 1) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, n at least: sums of such terms hash any range of a sequence."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for b in (base, pow(base, -1, 2**64)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS.append(out)
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def by_position(docs: DataFrame, run: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """Rows that run keeps, with all columns of docs. run sees them under names that clash with none of its own: c0, c1 and so on."""
    names = docs.columns
    out = run(docs.toDF(*[f"c{k}" for k in range(len(names))]), lambda name: f"c{names.index(name)}")
    return out.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(names)])


def durable_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it back: columns can be read alone, and nothing is computed again."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    # small row groups: writers of wide columns hold one in memory
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of durable_table that nothing depends on any longer."""
    for df in tables:
        store, path = file_system(df.sparkSession, df.table_path)
        store.delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any longer. Spark's event queue holds on to the last query, so a tiny one goes first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
