"""Sharding by minimax contiguous partition, in DataFrame operations only.

Documents of equal text are one atomic group. The groups stand in the order of
their smallest doc_id; the smallest capacity with which a greedy pass needs no
more than the wanted shards is searched, and the order is cut there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import durable, table
from lattika.llm.ordered import running

#: Capacities tried in one pass of the search.
TRIED = 64
#: Groups of more than this share of all rows go to their documents by broadcast: fewer than SHARE of them can exist.
SHARE = 2000


def _jump(groups: DataFrame, starts: list[int], capacities: list[int], largest: int) -> list[int]:
    """For each start, the last end of a group that its capacity reaches."""
    targets = [s + c for s, c in zip(starts, capacities, strict=True)]
    wanted = sorted(set(targets))
    near = groups.filter((F.col("upto") <= wanted[-1]) & (F.col("upto") > wanted[0] - largest))
    # the number of targets below an end tells which stretch between two targets it lies in
    below = F.size(F.filter(F.lit(wanted), lambda t: t < F.col("upto")))
    found = dict(near.groupBy(below.alias("k")).agg(F.max("upto")).collect())  # at most a row for each target
    reach, last = {}, -1
    for k, t in enumerate(wanted):
        last = max(last, found.get(k, -1))
        reach[t] = last
    return [max(s, reach[t]) for s, t in zip(starts, targets, strict=True)]


def greedy_cuts(groups: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """The ends of the shards that a greedy pass fills up to each capacity."""
    ends: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        at = _jump(groups, at, capacities, largest)
        for e, x in zip(ends, at, strict=True):
            e.append(x)
    return ends


def smallest_capacity(groups: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible shard capacity and its cuts. The answer lies between the mean and the mean plus the largest group."""
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best: list[int] = []
    while True:
        tried = sorted({low + (high - low) * k // TRIED for k in range(TRIED + 1)})
        for capacity, ends in zip(tried, greedy_cuts(groups, tried, shards, largest), strict=True):
            if ends[-1] >= total:
                high, best = capacity, ends
                break
            low = capacity + 1
        if low >= high:
            return high, best


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    size: UTF-8 bytes and 1. A null text has size 1, crc32 0 and a group of its
    own, apart from the empty text. Null doc_ids stand first; repeated doc_ids are
    separate rows, by size and crc32 of their texts, beyond which they are equal. Shards can stay empty when there are few groups. An
    empty table gives no rows. Other columns of docs are left out.
    """
    content = F.col(f"`{text}`").cast("string")
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(content, F.lit(""))).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(content, 256)), F.lit(b"")).alias("key"),
    )
    base = durable(base)
    groups = durable(base.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n")))
    rows, n_groups, total, largest = groups.agg(F.sum("n"), F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    order = [F.col("first").asc_nulls_first(), F.col("key").asc()]
    if not rows:
        placed = base.withColumn("shard", F.lit(0))
        rows = 0
    else:
        ends = durable(running(groups, order, {"before": F.col("bytes")}, n_groups).withColumn("upto", F.col("before") + F.col("bytes")))
        _, cuts = smallest_capacity(ends, total, largest, shards)
        shard = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
        where = ends.select("key", "n", shard.cast("int").alias("shard"))
        hot = F.broadcast(where.filter(F.col("n") > rows // SHARE).select("key", "shard"))
        cold = where.filter(F.col("n") <= rows // SHARE).select("key", "shard")
        placed = base.join(hot, "key").unionByName(base.join(hot, "key", "left_anti").join(cold, "key"))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    slotted = running(placed, [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()], {"slot": F.lit(1)}, rows, within=["shard"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes; equal texts share a shard."""
    return shard_documents(table(spark, sf_dir, "documents"))
