"""Near-duplicate documents by ProbMinHash over word shingles.

A signature register holds the shingle whose exponential arrivals, at the rate
of its weight, reach the register first; two documents agree in a register with
the probability Jaccard similarity of their shingle weights. Shingles stop
sending arrivals once all registers are earlier. Each text is signed with weight
1 for every distinct shingle, where that is the Jaccard similarity of the sets,
and a text with repeated shingles also with their counts. Bands of registers make
buckets. In each bucket the documents are compared with its leader, and those
that are still in other groups with each other; a pair is linked if the Jaccard
similarity of the shingle sets, taken in full, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.llm.common import by_position, drop_tables, durable, durable_table, mix64, release, table
from lattika.llm.components import components
from lattika.llm.repeats import make_packs, text_keys, unpack
from lattika.llm.suffix_automata import as_words

#: Words of a shingle, and the similarity of near-duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and their registers: a pair at the threshold shares no bucket of weight 1 in (1 - 0.8**5)**24, or 1 of 14,000 cases.
BANDS, REGISTERS = 24, 5
#: Texts of a bucket, and their shingles, that one task compares with as many others; more are compared chunk by chunk.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000
#: Buckets of more than this share of all rows get their columns by broadcast: fewer than SHARE of them can exist.
SHARE = 1000
#: Cells of the table of texts and shingles that a task holds at once.
CELLS = 32_000_000


def shingles(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, sorted within it, and offsets. A text of fewer words, but not none, is one shingle."""
    words, at = as_words(data, ends)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    rank = np.arange(len(words)) - at[owner]
    left = size[owner] - rank
    out = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(words)], np.uint64(0)))
    keep = (left >= n) | ((size[owner] < n) & (rank == 0))
    out, owner = out[keep], owner[keep]
    order = np.lexsort((out, owner))
    return out[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def uniform(h: np.ndarray, draw: int) -> np.ndarray:
    return (mix64(h + np.uint64((2 * draw + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash of each document: the element that first reaches each register. Documents without elements have zeros."""
    first = np.full(docs * registers, np.inf)
    sign = np.zeros(docs * registers, np.uint64)
    time = np.zeros(len(element))
    draw = 0
    while len(element):
        time = time - np.log1p(-uniform(element, 2 * draw)) / weight
        at = owner * registers + (uniform(element, 2 * draw + 1) * registers).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        sign[at[won]] = element[won]
        # later arrivals of an element come later still
        going = time < first.reshape(docs, registers).max(axis=1)[owner]
        element, weight, owner, time = element[going], weight[going], owner[going], time[going]
        draw += 1
    return sign.reshape(docs, registers)


def bucket_numbers(sign: np.ndarray) -> np.ndarray:
    """A bucket number for each band of each signature."""
    bands = np.zeros((len(sign), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(REGISTERS):
        bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + sign[:, r::REGISTERS])
    return bands


def text_buckets(element: np.ndarray, count: np.ndarray, owner: np.ndarray, docs: int) -> list[np.ndarray]:
    """The buckets of each text: by its set of shingles, and by their counts where these are not all 1 (else both are the same)."""
    out = list(bucket_numbers(signatures(element, np.ones(len(element)), owner, docs, BANDS * REGISTERS)))
    several = np.unique(owner[count > 1])
    own = np.isin(owner, several)
    weighted = signatures(element[own], count[own].astype(float), np.searchsorted(several, owner[own]), len(several), BANDS * REGISTERS)
    for k, more in zip(several.tolist(), bucket_numbers(weighted), strict=True):
        out[k] = np.union1d(out[k], more)
    return out


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, first, key, n (shingles), bands (bucket numbers) of each distinct text."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            firsts, ends, data = unpack(row)
            every, at = shingles(data, ends)
            owner = np.repeat(np.arange(len(firsts)), np.diff(at))
            edge = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])]) if len(every) else np.zeros(0, np.int64)
            bands = text_buckets(every[edge], np.diff(np.r_[edge, len(every)]), owner[edge], len(firsts))
            n = np.bincount(owner[edge], minlength=len(firsts))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array((row["pack"] << 20) + np.arange(len(firsts)), pa.int64()), "first": pa.array(firsts), "key": pa.array(text_keys(ends, data), pa.binary()), "n": pa.array(n, pa.int64()),
                "bands": pa.array([x.view(np.int64) if m else [] for x, m in zip(bands, n.tolist(), strict=True)], pa.list_(pa.int64())),
            })


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and set (sorted distinct shingle hashes) of the wanted texts of each pack."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            firsts, ends, data = unpack(row)
            every, at = shingles(data, ends)
            for node in row["nodes"]:
                i = node & ((1 << 20) - 1)
                yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "set": pa.array([np.unique(every[at[i] : at[i + 1]]).tobytes()], pa.binary())})


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of two sets of sorted unsigned 64-bit integers."""
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out[k] = common / (len(both) - common) if len(both) else 0.0
    return pd.Series(out)


def link_groups(key: tuple, rows: pa.Table) -> pa.Table:
    """Links that join groups of texts: each text outside the largest group against all texts of other groups."""
    node, group = rows["node"].to_numpy(), rows["component"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # only shingles of two texts or more can be in common
    rank = np.cumsum(n > 1) - 1
    shared = n[code] > 1
    code, owner = rank[code[shared]], owner[shared]
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))
    names, label, members = np.unique(group, return_inverse=True, return_counts=True)
    few = np.flatnonzero(label != members.argmax())
    width = int((n > 1).sum())
    step = max(1, CELLS // max(1, width))
    a_out, b_out = [], []
    for start in range(0, len(sets), step):
        stop = min(start + step, len(sets))
        held = np.zeros((stop - start, width), bool)
        held[owner[begin[start] : begin[stop]] - start, code[begin[start] : begin[stop]]] = True
        for a in few.tolist():
            common = held[:, code[begin[a] : begin[a + 1]]].sum(axis=1)
            near = common >= SIMILAR * (size[a] + size[start:stop] - common)
            near &= (label[start:stop] != label[a]) & (common > 0)
            for b in (np.flatnonzero(near) + start).tolist():
                if label[a] != label[b]:
                    a_out.append(node[a]), b_out.append(node[b])
                    label[label == label[b]] = label[a]
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(jaccard("left", "right") >= SIMILAR).select("a", "b")


def joined_groups(group: DataFrame, links: DataFrame) -> DataFrame:
    """Groups after further links: only the groups that a link touches are united."""
    of = lambda c: F.coalesce(F.col(f"c_{c}"), F.col(c)).alias(c)
    known = [group.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab"]
    between = durable(links.join(known[0], "a", "left").join(known[1], "b", "left").select(of("a"), of("b")).filter("a <> b").distinct())
    if not between.limit(1).count():
        return group
    merged = components(between).select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = group.join(merged, group["component"] == merged["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    # texts that were alone until now
    new = merged.join(group, merged["was"] == group["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return durable(old.unionByName(new))


def with_bucket(rows: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their bucket (m: its rows, of total rows in all), if it is among buckets.

    Rows of hot buckets stay where they are; only the others go to a task by bucket.
    """
    hot = buckets.filter(F.col("m") > total // SHARE)
    few = rows.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(buckets.filter(F.col("m") <= total // SHARE), "bucket")
    return few.unionByName(rows.join(F.broadcast(hot), "bucket"))


def wanted_sets(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    by_pack = nodes.groupBy(F.shiftright("node", 20).alias("pack")).agg(F.collect_list("node").alias("nodes"))
    return packs.join(by_pack, "pack").mapInArrow(shingle_rows, "node long, set binary")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: key (sha256), node, component, group_id (smallest doc_id of its group), size-1 groups included.

    Texts of fewer than five words are one shingle; texts without words are alone.
    Null texts and null doc_ids take no part. Links between different texts of a
    bucket are all found, as far as they join groups: with the leader of the bucket
    first, then between texts of a bucket that are in several groups by then.
    """
    spark = docs.sparkSession
    packs = make_packs(docs, doc_id, text)
    signed = durable(packs.mapInArrow(band_rows, "node long, first long, key binary, n long, bands array<long>"))
    member = signed.select("node", "n", F.explode("bands").alias("bucket"))
    total = signed.agg(F.sum(F.size("bands"))).first()[0] or 0
    size = member.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("lead")).filter("m > 1")
    in_bucket = durable(with_bucket(member, size.select("bucket", "m", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), total))
    fits = F.least("n", "lead_n") >= SIMILAR * F.greatest("n", "lead_n")
    pairs = durable(in_bucket.filter(fits & (F.col("node") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    # whoever shares a bucket may be compared later
    sets = durable_table(wanted_sets(packs, in_bucket.select("node").distinct()))
    group = components(verify(pairs, sets))
    release(spark)
    # what is left to compare: texts of a bucket, besides its leader, in several groups
    state = in_bucket.filter("m > 2").join(group, "node", "left").filter("node <> lead").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    open_ = state.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y"), chunks).filter("x <> y")
    state = durable(with_bucket(state, open_.select("bucket", "m", "chunks"), total))
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    dealt = state.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "component")
    found = dealt.join(sets, "node").groupBy("bucket", "x", "y").applyInArrow(link_groups, "a long, b long")
    group = joined_groups(group, durable(found.distinct()))
    drop_tables(packs, sets)
    release(spark)
    placed = signed.select("node", "first", "key").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("group_id"))
    return placed.join(least, "component").select("key", "node", "component", "group_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns of keep), group_id, kept: one row for each document.

    A group holds copies and whatever verified links reach; its smallest doc_id is
    group_id, and that document is kept. Of rows of the group with that doc_id one
    is kept; rows of one doc_id whose texts are in different groups are each judged
    in their own. A document without a text or a doc_id is its own group and is kept.
    """
    groups = near_duplicate_groups(docs, doc_id, text).select("key", F.col("component").alias("__component"), F.col("group_id").alias("__group"))
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, *keep])], F.unhex(F.sha2(F.col(f"`{text}`").cast("string"), 256)).alias("key"))
    row = rows.join(groups, "key", "left")
    number = F.row_number().over(W.partitionBy(doc_id, "__component").orderBy("key"))
    group = F.coalesce("__group", F.col(f"`{doc_id}`").cast("long"))
    alone = F.col("__group").isNull() | F.col(f"`{doc_id}`").isNull()
    first = (F.col(f"`{doc_id}`") == F.col("__group")) & (number == 1)
    return row.select(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, *keep])], F.when(F.col(f"`{doc_id}`").isNotNull(), group).alias("group_id"), (alone | F.coalesce(first, F.lit(False))).alias("kept"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, of which no smaller doc_id is a copy or near copy."""
    return by_position(docs, lambda rows, at: near_duplicates(rows, at(doc_id), at(text), keep=tuple(rows.columns)).filter("kept"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {SIMILAR}
      UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS group_id, min(b) = a AS kept FROM r GROUP BY a
"""
