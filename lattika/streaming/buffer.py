"""Grouped buffers and windowed counts over streams."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattika.sources.readers import shared_folder


def read_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(_folder_of(spark, folder, table))


def _folder_of(spark: SparkSession, folder: str, table: str) -> str:
    """A stream reads folders: the table's own, or a pattern that only its file fits."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return f"{folder}/{table}.parquet" if fs.getFileStatus(path).isDirectory() else f"{folder}/{table}.parquet*"


def emit_groups(items: DataFrame, key: str, item: str, size: int, timeout_ms: int | None = None) -> DataFrame:
    """key, items, n: groups of `size` items at least, sent on and forgotten once they are complete; others wait.

    timeout_ms: a group that waits longer is sent on as it is; off by default.
    """
    kind = items.schema[key].dataType.simpleString()

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "items": [held], "n": [len(held)]})
            return
        for pdf in frames:
            held += pdf[item].tolist()
        if len(held) >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [keys[0]], "items": [sorted(held)], "n": [len(held)]})
        else:
            state.update((held,))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    element = items.schema[item].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return items.select(key, item).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, items array<{element}>, n int", f"items array<{element}>", "append", timeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote; for complete mode the last state."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/out/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def windowed(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """start, keys, n: counts of event-time windows; items later than `late` are dropped."""
    stream = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stream.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def interval_statistics(stream: DataFrame, group: str, value: str) -> DataFrame:
    """interval, total, groups, size, mean: what came in with each trigger alone; the next one starts from nothing."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/intervals-{uuid.uuid4().hex}"

    def save(df: DataFrame, batch: int) -> None:
        each = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
        total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("groups"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("size"), F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("mean"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{place}/out/interval={batch}")

    stream.writeStream.option("checkpointLocation", f"{place}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


class GroupBuffer:
    """Items that several writers append and a reader takes out by complete groups, each group once.

    Both sides are tables in a folder that all share: a write appends files whole, and
    a read notes the groups it hands out before it returns them, so that neither waits
    for the other. transform: what is made of the items of complete groups.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str, size: int, transform=None):
        self.spark, self.folder, self.group, self.size, self.transform = spark, folder, group, size, transform
        self.schema = None

    def write(self, items: DataFrame) -> None:
        self.schema = items.schema
        items.write.mode("append").parquet(f"{self.folder}/items")

    def _waiting(self) -> DataFrame:
        items = self.spark.read.schema(self.schema).parquet(f"{self.folder}/items")
        taken = self.spark.read.schema(f"`{self.group}` {self.schema[self.group].dataType.simpleString()}, reading long").parquet(f"{self.folder}/taken")
        return items.join(taken.select(self.group).distinct(), self.group, "left_anti")

    def ready(self) -> DataFrame:
        """group, n: the complete groups that nobody has taken."""
        if self.schema is None:
            raise ValueError("nothing was written yet")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/taken")
        fs_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(fs_path)
        return self._waiting().groupBy(self.group).agg(F.count("*").alias("n")).filter(F.col("n") >= self.size)

    def read(self) -> DataFrame:
        """The items of the groups that are complete by now, transformed; they are not handed out again."""
        reading = uuid.uuid4().int >> 65
        self.ready().select(self.group, F.lit(reading).alias("reading")).write.mode("append").parquet(f"{self.folder}/taken")
        mine = self.spark.read.parquet(f"{self.folder}/taken").filter(F.col("reading") == reading).select(self.group)
        out = self.spark.read.schema(self.schema).parquet(f"{self.folder}/items").join(mine, self.group, "left_semi")
        return self.transform(out) if self.transform else out

    def poll(self, least: int, tries: int = -1, wait: float = 1.0) -> DataFrame:
        """What can be read once at least so many items are in complete groups; tries: looks before it gives up with an error, -1 for no end."""
        while (self.ready().agg(F.sum("n")).first()[0] or 0) < least:
            tries -= 1
            if tries == 0:
                raise TimeoutError("too few items in complete groups")
            time.sleep(wait)
        return self.read()
