"""Suffix-array dedup: repeated byte strings, by blockwise suffix sorting with a difference cover.

A block is a text: distinct passages of a task, one after the other, all with an
anchor together, so that equal windows are in one block. A
difference cover modulo seven picks three of seven positions as a sample; the
suffixes that start there are ranked once, by prefix doubling, to the depth of a
window. The suffixes at the starts of windows are then sorted one bucket at a time,
a bucket being a range of first bytes: by their first seven bytes, and where these
tie by ranks. For any two suffixes some distance below seven leads both to sample
positions, and the ranks there tell their order. Neighbours in the order with
50 bytes in common are equal windows. Memory holds the passages of the task, the ranks
of a block and one bucket; blocks are small, so that most of a sort stays in the caches.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import by_position, table
from lattika.llm.merge_rounds import expand
from lattika.llm.repeats import FAR_DOC, Shape, find_repeats

#: Bytes of a string that must not start in two documents.
WINDOW = 50
#: Modulus and residues of the cover: each difference modulo seven is one of two of them.
MODULUS, COVER = 7, (0, 1, 3)
#: Suffixes of a bucket, unless more of them start with the same two bytes.
BUCKET = 262_144
#: Symbols of a block, unless passages of one hash have more.
BLOCK = 524_288
SHAPE = Shape(window=WINDOW, gram=18, symbol="u1", near=8)


def as_bytes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, ends


def sort_with(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below 2**bits) in order, and their order. Where an integer holds a key and its number, plain integers are sorted: that takes a third of the time."""
    room = len(key).bit_length()
    if bits + room > 63:
        order = np.argsort(key)
        return key[order], order
    both = (key << room) | np.arange(len(key))
    both.sort()
    return both >> room, both & ((1 << room) - 1)


def opens_group(key: np.ndarray) -> np.ndarray:
    """Of keys in order, those that differ from the one before."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new


def sort_sevens(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers of seven bytes, and which of them, in order, differ from the one before: by five bytes, then by all."""
    high, order = sort_with(key >> 16, 40)
    group = np.cumsum(opens_group(high)) - 1
    value, again = sort_with((group << 16) | (key[order] & 0xFFFF), len(key).bit_length() + 16)
    return order[again], opens_group(value)


def group_starts(new: np.ndarray) -> np.ndarray:
    """For each place in an order, the first place of its group."""
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def in_groups(new: np.ndarray) -> np.ndarray:
    """The places in an order that belong to groups of several."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


class CoverSorter:
    """Sorts suffixes of a text of bytes by their first `depth` bytes at least."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        self.text = np.zeros(n + 8 + 2 * depth + 8 * MODULUS, np.uint8)
        self.text[:n] = text
        self.words = np.ndarray((len(self.text) - 7,), ">u8", self.text.data, 0, (1,))
        cover = np.array(COVER)
        #: the distance that leads two residues into the cover
        self.shift = np.array([[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)])
        blocks = -(-n // MODULUS) + 1
        #: the place of each sample position in rank: by residue, then by block, so that position + 7 comes next; zeros follow the last block
        self.column = np.full(MODULUS, -1)
        self.column[cover] = np.arange(len(cover))
        self.width = blocks + -(-depth // MODULUS)
        slot = (np.arange(len(cover))[:, None] * self.width + np.arange(blocks)).ravel()
        order, new = sort_sevens(self._seven((cover[:, None] + MODULUS * np.arange(blocks)).ravel()))
        order, reach = slot[order], 1
        self.rank_bits = len(slot).bit_length()
        self.rank = np.zeros(len(cover) * self.width, np.int64)
        self.rank[order] = group_starts(new) + 1
        # ranks to a depth of 7, 14, 28, 56 bytes; a position that has its rank alone keeps it
        while MODULUS * reach < depth and len(tied := in_groups(new)):
            some = order[tied]
            value, again = sort_with((self.rank[some] << self.rank_bits) | self.rank[some + reach], 2 * self.rank_bits)
            order[tied] = some = some[again]
            new[tied] = opens_group(value)
            self.rank[some] = tied[group_starts(new[tied])] + 1
            reach *= 2

    def _seven(self, at: np.ndarray) -> np.ndarray:
        """The seven bytes from each position on, as a number that sorts as they do."""
        return (self.words[at].astype(np.uint64) >> np.uint64(8)).astype(np.int64)

    def _rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.rank[self.column[at % MODULUS] * self.width + at // MODULUS]

    def buckets(self, at: np.ndarray):
        """Numbers of the suffixes (of those that start at the positions) of one bucket after the other."""
        if 0 < len(at) <= BUCKET:
            yield np.arange(len(at))
            return
        lead = self.text[at].astype(np.int64) * 256 + self.text[at + 1]
        size = np.bincount(lead, minlength=65536)
        part = np.cumsum(size) - size
        part //= BUCKET
        part = part[lead]
        for k in np.unique(part).tolist():
            yield np.flatnonzero(part == k)

    def order(self, at: np.ndarray) -> np.ndarray:
        """The order of the suffixes of a bucket. Suffixes with the same first `depth` bytes stand together."""
        order, new = sort_sevens(self._seven(at))
        tied = in_groups(new)
        some, group = order[tied], group_starts(new)[tied]
        start, bits = at[some], len(at).bit_length()
        residue = start % MODULUS
        kinds = [np.flatnonzero(residue == r) for r in range(MODULUS)]
        # how many suffixes of the group come before
        place = np.zeros(len(some), np.int64)
        before = [np.r_[0, np.cumsum(np.bincount(group[kind], minlength=len(at)))] for kind in kinds]

        @cache
        def ranked(r: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind = kinds[r]
            value, again = sort_with((group[kind] << self.rank_bits) | self._rank_at(start[kind] + d), bits + self.rank_bits)
            return value, kind[again], value >> self.rank_bits

        for a in range(MODULUS):
            for b in range(MODULUS):
                if len(kinds[a]) and len(kinds[b]):
                    d = int(self.shift[a, b])
                    # of one residue, equal in seven bytes, before each of the other
                    value, right, own = ranked(b, d)
                    place[right] += np.searchsorted(ranked(a, d)[0], value) - before[a][own]
        order[tied] = some[sort_with(group + place, bits)[1]]
        return order

    def opens(self, at: np.ndarray) -> np.ndarray:
        """Of suffixes in order, those that do not share their first `depth` bytes with the one before."""
        same = np.ones(len(at), bool)
        same[:1] = False
        for k in [*range(0, self.depth - 8, 8), self.depth - 8]:
            maybe = np.flatnonzero(same)
            same[maybe] = self.words[at[maybe] + k] == self.words[at[maybe - 1] + k]
        return ~same


def blocks_of(size: np.ndarray, deal: np.ndarray) -> list[np.ndarray]:
    """Numbers of the passages of one block after the other: about BLOCK symbols, or the passages of a single hash."""
    order = np.argsort(deal, kind="stable")
    new = opens_group(deal[order])
    begin = np.cumsum(size[order]) - size[order]
    # a hash goes to the block in which its first passage starts
    part = begin[group_starts(new)] // BLOCK
    return np.split(order, np.flatnonzero(np.diff(part)) + 1)


def smallest_documents(shape: Shape, symbols: np.ndarray, offsets: np.ndarray, doc: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """For each window of each passage, the smallest document that has it."""
    size = np.diff(offsets)
    n = size - shape.window + 1
    begin = np.cumsum(n) - n
    out = np.full(n.sum(), FAR_DOC)
    for mine in blocks_of(size, deal):
        windows, start = n[mine], np.cumsum(size[mine]) - size[mine]
        at, own, to = expand(start, windows), np.repeat(doc[mine], windows), expand(begin[mine], windows)
        sorter = CoverSorter(symbols[expand(offsets[mine], size[mine])], shape.window)
        for bucket in sorter.buckets(at):
            bucket = bucket[sorter.order(at[bucket])]
            new = sorter.opens(at[bucket])
            least = np.minimum.reduceat(own[bucket], np.flatnonzero(new))
            out[to[bucket]] = least[np.cumsum(new) - 1]
    return out


def removed_runs(data: np.ndarray, ends: np.ndarray, at: np.ndarray, marked: np.ndarray) -> dict[str, pa.Array]:
    """Maximal removed runs of each text (start and length in bytes), their bytes, and the sha256 of the rest."""
    edge = np.zeros(len(marked) + 1, np.int8)
    edge[:-1] += marked
    edge[1:] -= marked
    # a run ends with its document
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(marked))]
    split = inner[marked[inner - 1] & marked[inner]]
    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
    stop = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
    owner = np.searchsorted(ends, begin, side="right") - 1
    runs = np.searchsorted(owner, np.arange(len(ends)))
    total = np.r_[0, np.cumsum(marked)]
    raw, rest, spans = data.tobytes(), data[~marked].tobytes(), []
    digests = []
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        mine = slice(runs[k], runs[k + 1])
        spans.append(np.stack([begin[mine] - a, stop[mine] - begin[mine]], axis=1).ravel().astype(np.int64))
        digests.append(hashlib.sha256(rest[a - total[a] : b - total[b]] if runs[k + 1] > runs[k] else raw[a:b]).hexdigest())
    return {"spans": pa.array(spans, pa.list_(pa.int64())), "n_removed": pa.array(np.diff(total[ends]).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}


SPAN_SCHEMA = "spans array<long>, n_removed long, kept_sha256 string"


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: first, key, spans (start and length in bytes of each maximal run to remove, flat), n_removed, kept_sha256.

    A byte goes if it lies in a 50-byte string that also starts in a document with
    a smaller doc_id. Null texts and documents without a doc_id take no part; texts
    below 50 bytes keep all; repeated rows (same doc_id and text) count once.
    """
    return find_repeats(docs, SHAPE, as_bytes, smallest_documents, removed_runs, SPAN_SCHEMA, doc_id, text)


def attach(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs with __found: its row of repeated_spans, null for a later copy of a text (and without doc_id or text)."""
    key = F.unhex(F.sha2(F.col(f"`{text}`").cast("string"), 256))
    found = found.select(F.col("first").alias("__first"), F.col("key").alias("__key"), F.struct(*[c for c in found.columns if c not in ("first", "key")]).alias("__found"))
    left = docs.withColumn("__sha", key)
    return left.join(found, (F.col(f"`{doc_id}`").cast("long") == found["__first"]) & (left["__sha"] == found["__key"]), "left").drop("__first", "__key")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, without the bytes of repeated strings.

    Where a cut goes through a character, its remaining bytes are dropped too. A
    document of which nothing is left stays, with an empty text.
    """
    return by_position(docs, lambda rows, at: _drop_repeats(rows, at(doc_id), at(text)))


def _drop_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    attached = attach(docs, repeated_spans(docs, doc_id, text), doc_id, text)

    @F.pandas_udf("string")
    def without(texts, spans):
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is not None and len(s):
                raw = np.frombuffer(t.encode(), np.uint8)
                keep = np.ones(len(raw), bool)
                for a, n in np.asarray(s).reshape(-1, 2):
                    keep[a : a + n] = False
                t = raw[keep].tobytes().decode(errors="ignore")
            out.append(t)
        return pd.Series(out)

    col = F.col(f"`{text}`")
    copy = F.col("__found").isNull() & F.col(f"`{doc_id}`").isNotNull() & (F.octet_length(col) >= WINDOW)
    kept = F.when(copy, F.lit("")).when(F.coalesce(F.col("__found.n_removed"), F.lit(0)) > 0, without(col, F.col("__found.spans"))).otherwise(col)
    return attached.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 50-byte strings leave of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs)
    light = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    row = light.join(found, (F.col("doc_id") == F.col("first")) & (F.col("sha") == F.col("key")), "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW)
    empty = hashlib.sha256(b"").hexdigest()
    return row.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce(F.size("spans") / 2, F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")), F.lit(empty))).alias("kept_sha256"),
    )


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, {2 * WINDOW}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW} + 1)) AS k FROM d)),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {WINDOW} THEN 0 ELSE 1 END AS opens FROM f),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + {WINDOW} AS b FROM (SELECT doc_id, k, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
