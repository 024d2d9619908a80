"""Groups of samples: normalising, filtering, counting, balancing and packing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.operators.ordered import numbered, row_hash

# -- rewards of groups -----------------------------------------------------------------------------------------------------


def normalize_rewards(rows: DataFrame, group: str, reward: str, by_deviation: bool = True) -> DataFrame:
    """Adds normalized: the reward less the group's mean, over its sample deviation and 1e-6. One sample alone is 0."""
    w = W.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    return rows.withColumn("normalized", centred / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-6) if by_deviation else centred)


def normalize_valid(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-8) -> DataFrame:
    """Adds normalized by the population deviation of the group's rewards from 0 to 1. Others stay, so do groups whose valid rewards are all 0; without deviation all are 0."""
    w, r = W.partitionBy(group), F.col(reward)
    valid = F.when((r >= 0) & (r <= 1), r)
    mean, dev, top = F.avg(valid).over(w), F.stddev_pop(valid).over(w), F.max(valid).over(w)
    out = F.when(valid.isNull() | (top == 0), r).when(dev < epsilon, 0.0).otherwise((r - mean) / (dev + epsilon))
    return rows.withColumn("normalized", out)


def deviation_verdict(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """group, keep, reason: groups without any spread of rewards are dropped."""
    g = rows.groupBy(group).agg(F.stddev_samp(reward).alias("dev"), F.min(F.struct(reward)).getField(reward).alias("first"))
    keep = F.coalesce(F.col("dev") > 0, F.lit(False))
    return g.select(group, keep.alias("keep"), F.when(~keep, F.concat(F.lit("zero_std_"), F.bround("first", 1).cast("string"))).alias("reason"))


def fill_batch(rows: DataFrame, group: str, reward: str, target: int) -> DataFrame:
    """group, keep, reason, position, taken: groups in order, those that pass the filter until the target is reached."""
    v = deviation_verdict(rows, group, reward)
    first = v.filter("keep").select(group).orderBy(group).limit(target)  # a batch
    passed = numbered(first, [F.col(group)], "position").withColumn("position", F.col("position") + 1)
    return v.join(passed, group, "left").select(group, "keep", "reason", "position", F.col("position").isNotNull().alias("taken"))


def pass_at(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda s, i: s * (1 - k / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - product)


def pass_rates(rows: DataFrame, group: str, reward: str, ks: list[int]) -> DataFrame:
    """k, rate: the mean over groups of k samples at least; success is a reward of 1."""
    g = rows.groupBy(group).agg(F.count("*").cast("int").alias("n"), F.sum((F.col(reward) == 1).cast("int")).cast("int").alias("c"))
    long = g.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at(F.col("n"), F.col("c"), k).alias("p")) for k in ks])).alias("x"))
    return long.filter(F.col("n") >= F.col("x.k")).groupBy(F.col("x.k").alias("k")).agg(F.round(F.avg("x.p"), 6).alias("rate"))


def spread_free_groups(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """reward (to one digit), groups: how many groups have one reward only."""
    g = rows.groupBy(group).agg(F.min(reward).alias("a"), F.max(reward).alias("b")).filter("a = b")
    return g.groupBy(F.bround("a", 1).alias("reward")).agg(F.count("*").alias("groups"))


def statistics(values: Column) -> list[Column]:
    return [F.round(F.avg(values), 6).alias("mean"), F.round(F.median(values), 6).alias("median"), F.max(values).alias("max"), F.min(values).alias("min")]


def merge_means(parts: DataFrame, mean: str, n: str) -> Column:
    """Mean of means that count as often as their samples."""
    return F.sum(F.col(mean) * F.col(n)) / F.sum(n)


# -- order, batches, bins --------------------------------------------------------------------------------------------------


def fan_out(prompts: DataFrame, n: int, order: str) -> DataFrame:
    """Adds group_index, sample and index: n samples of every prompt, in the order of a key."""
    out = numbered(prompts, [F.col(order)], "group_index").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("index", F.col("group_index") * n + F.col("sample"))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds position: a permutation of the rows that only the seed, the epoch and the key decide."""
    return numbered(rows, [F.xxhash64(F.lit(seed + epoch), F.col(key)), F.col(key)], "position")


def trim(rows: DataFrame, order: str, batch: int) -> DataFrame:
    """The first rows of the order, a multiple of batch of them."""
    n = rows.count()
    return numbered(rows, [F.col(order)], "__k").filter(F.col("__k") < n - n % batch).drop("__k")


def halves(rows: DataFrame, order: str, ratio: float) -> DataFrame:
    """A share of the rows: half of it from the front, the rest from the back."""
    n = rows.count()
    k = int(n * ratio)
    return numbered(rows, [F.col(order)], "__k").filter((F.col("__k") < k // 2) | (F.col("__k") >= n - (k - k // 2))).drop("__k")


def first_fit(lengths: list[int], most: int) -> list[int]:
    """Bin of each length: the first that has room, else a new one."""
    room: list[int] = []
    out = []
    for x in lengths:
        at = next((i for i, r in enumerate(room) if x <= r), None)
        if at is None:
            at = len(room)
            room.append(most)
        room[at] -= x
        out.append(at)
    return out


def chunk_by_size(sizes: list[int], most: int) -> list[int]:
    """Bucket of each item; a bucket closes once it would reach the most."""
    out, at, held = [], 0, 0
    for k, x in enumerate(sizes):
        if k and held + x >= most:
            at, held = at + 1, 0
        held += x
        out.append(at)
    return out


def balance(lengths: list[int], parts: int, equal: bool = False) -> list[int]:
    """Part of each item so that sums are close, by largest differencing: the two states of widest spread are merged, heaviest part with lightest.

    equal: parts of the same number of items. Ties go by the number of items in a part, then by the items.
    """
    if len(lengths) < parts or (equal and len(lengths) % parts):
        raise ValueError("too few items, or no multiple of the parts")
    ranked = sorted((x, i) for i, x in enumerate(lengths))
    size = parts if equal else 1

    class Weight:
        """Sorts before others if its spread is wider, or its heaviest part heavier."""

        def __init__(self, bins):
            self.bins = sorted(bins, key=lambda b: (b[0], len(b[1]), b[1]), reverse=True)

        def __lt__(self, other):
            mine, theirs = ((s.bins[0][0] - s.bins[-1][0], (s.bins[0][0], len(s.bins[0][1]), s.bins[0][1])) for s in (self, other))
            return mine > theirs

    heap: list[Weight] = []
    for a in range(0, len(ranked), size):
        own = [(x, [(i, x)]) for x, i in ranked[a : a + size]]
        heapq.heappush(heap, Weight(own + [(0, [])] * (parts - len(own))))
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, Weight([(a[0] + b[0], a[1] + b[1]) for a, b in zip(one.bins, reversed(two.bins), strict=True)]))
    out = [0] * len(lengths)
    for part, (_, items) in enumerate(heap[0].bins):
        for i, _ in items:
            out[i] = part
    return out


def assign(rows: DataFrame, by: str, item: str, length: str, how: Callable[[list[int]], list[int]]) -> DataFrame:
    """by, item, length, part: a rule over the ordered lengths of one bounded step; every step is a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        return pdf.assign(part=how(pdf["length"].astype(int).tolist()))

    slim = rows.select(F.col(by).alias("by"), F.col(item).alias("item"), F.col(length).cast("long").alias("length"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.groupBy("by").applyInPandas(run, f"{kinds}, part long")


def running_offsets(rows: DataFrame, by: str, order: str, length: str) -> DataFrame:
    """Adds start and stop of each sequence within its pack."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("stop", F.sum(length).over(w)).withColumn("start", F.col("stop") - F.col(length))


def pack(rows: DataFrame, by: str, order: str, tokens: str) -> DataFrame:
    """by, tokens, offsets: sequences one after the other, and n + 1 limits."""
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t")))).alias("x"))
    sizes = F.transform("x", lambda x: F.size(x["t"]))
    limits = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
    return g.select(by, F.flatten(F.transform("x", lambda x: x["t"])).alias("tokens"), limits.alias("offsets"))


def unpack(packs: DataFrame, by: str) -> DataFrame:
    """by, place, tokens: the inverse of pack."""
    cut = packs.select(by, "tokens", "offsets", F.posexplode(F.slice("offsets", 1, F.size("offsets") - 1)).alias("place", "start"))
    return cut.select(by, "place", F.slice("tokens", F.col("start") + 1, F.get("offsets", F.col("place") + 1) - F.col("start")).alias("tokens"))


# -- samples ---------------------------------------------------------------------------------------------------------------


#: Parts that the rows of a key are numbered in.
SALTS = 64


@F.pandas_udf(T.BooleanType())
def repeats_itself(texts: pd.Series) -> pd.Series:
    """Whether the last 10,000 characters of a longer text shrink more than tenfold."""

    def one(t: str | None) -> bool:
        if t is None or len(t) <= 10_000:
            return False
        raw = t[-10_000:].encode()
        return len(raw) / len(zlib.compress(raw, 9)) > 10

    return texts.map(one).astype(bool)


def skip_finished(rows: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows less finished ones, as bags: each finished row takes out one row of its key.

    Rows of a key are numbered over ranges of it, so that a hot key is no single
    task's; of the finished rows only their number by key is joined.
    """
    done = finished.groupBy(key).agg(F.count("*").alias("__done"))
    ranged = rows.withColumn("__salt", F.pmod(row_hash(rows), F.lit(SALTS)).cast("int"))
    counts = ranged.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    before = counts.select(key, "__salt", F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # SALTS rows for a key
    number = F.row_number().over(W.partitionBy(key, "__salt").orderBy(key))
    out = ranged.withColumn("__k", number).join(before, [key, "__salt"]).join(done, key, "left")
    return out.filter(F.col("__k") + F.col("__before") > F.coalesce("__done", F.lit(0))).select(*rows.columns)


def valid_groups(items: DataFrame, group: str, size: int, filled: Column | None = None) -> DataFrame:
    """Items of groups that are complete: size items at least (with content, if filled says what that is)."""
    w = W.partitionBy(group)
    enough = F.count("*").over(w) >= size
    if filled is not None:
        enough = enough & (F.sum(filled.cast("int")).over(w) >= size)
    return items.withColumn("__ok", enough).filter("__ok").drop("__ok")


def newest_groups(items: DataFrame, group: str, ts: str, n: int) -> DataFrame:
    """group, newest: the n groups with the latest item."""
    return items.groupBy(group).agg(F.max(ts).alias("newest")).orderBy(F.col("newest").desc(), group).limit(n)


def require_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    """Raises on rows in which a needed column is null."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return items.filter(F.when(missing, F.raise_error(F.lit("a needed key is missing"))).otherwise(F.lit(True)))
