"""Substring dedup: repeated word windows, by suffix automata of reference shards.

A shard of the reference is the set of distinct passages that one task is dealt (see
repeats), a bounded number of words; its automaton is built over word symbols, every
state with the smallest document that its strings occur in. Passages of documents
are streamed through it for matching statistics: at each word the longest suffix
that the reference holds, cut to the length of a window, gives the smallest
document with that window; maximal spans of such windows are removed.

The reference of a self-dedup is the corpus: its shards grow in number with it, and
to broadcast each and stream all documents through all of them would take time in
the square of the corpus. So a shard's automaton stays in the task that its passages
are dealt to, and only passages with an anchor of the shard are streamed through it.
For a given reference of bounded size, remove_reference() broadcasts the automata.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.llm.common import by_position, mix64, small_batches, table
from lattika.llm.merge_rounds import expand
from lattika.llm.repeats import FAR_DOC, Shape, find_repeats
from lattika.llm.suffix_blocks import attach

#: Words of a window that must not start in two documents.
WINDOW = 13
SHAPE = Shape(window=WINDOW, gram=5, symbol="<u8", near=3)
#: Bytes that part words: space and 0x09 to 0x0D.
PARTS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words of the reference in one automaton.
SHARD_WORDS = 100_000


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word, and n + 1 offsets of the documents into the words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    word = ~PARTS[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, ends)


def as_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the offsets of the documents into them.

    A word is taken eight bytes at a time; each such number is mixed with its place
    before they are added up, so that no pattern of words makes collisions likelier
    than chance (1 in 2**64 for two words).
    """
    start, stop, at = word_bounds(data, ends)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    size = stop - start
    out = mix64(size.astype(np.uint64))
    todo, k = np.arange(len(start)), 0
    while len(todo):
        left = np.minimum(size[todo] - 8 * k, 8)
        some = eight[start[todo] + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
        out[todo] += mix64(mix64(some + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) + np.uint64(k))
        todo, k = todo[left == 8], k + 1
        todo = todo[size[todo] > 8 * k]
    return mix64(out), at


class SuffixAutomaton:
    """States of all substrings of some sequences of symbols; doc: the smallest document in which a state's strings occur."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [int(FAR_DOC)]

    def add(self, symbols: list[int], doc: int) -> None:
        """Extends the automaton by one sequence of a document."""
        next_, link, size, docs = self.next, self.link, self.size, self.doc
        last = 0
        for c in symbols:
            q = next_[last].get(c)
            if q is not None:
                # the sequence so far is known: take its state, parted from longer strings if need be
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = self._part(last, c, q)
                if doc < docs[last]:
                    docs[last] = doc
                continue
            new = len(size)
            next_.append({}), link.append(0), size.append(size[last] + 1), docs.append(doc)
            p = last
            while p >= 0 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._part(p, c, q)
            last = new

    def _part(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of q that are no longer than those of p and one symbol."""
        next_, link, size = self.next, self.link, self.size
        new = len(size)
        next_.append(dict(next_[q])), link.append(link[q]), size.append(size[p] + 1), self.doc.append(self.doc[q])
        link[q] = new
        while p >= 0 and next_[p].get(c) == q:
            next_[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """Passes the smallest document of each state on to its suffixes."""
        doc, link = self.doc, self.link
        for s in np.argsort(np.array(self.size), kind="stable")[::-1].tolist():
            if s and doc[s] < doc[link[s]]:
                doc[link[s]] = doc[s]

    def matches(self, symbols: list[int], window: int) -> list[int]:
        """For each symbol, the smallest document with the window that ends there, or FAR_DOC."""
        next_, link, size, doc = self.next, self.link, self.size, self.doc
        state, n, out = 0, 0, []
        for c in symbols:
            while state and c not in next_[state]:
                state = link[state]
                n = size[state]
            got = next_[state].get(c)
            if got is None:
                n = 0
            else:
                state, n = got, n + 1
                while state and size[link[state]] >= window:
                    state = link[state]
                n = min(n, size[state])
            out.append(doc[state] if n >= window else int(FAR_DOC))
        return out


def reference_shards(size: np.ndarray, deal: np.ndarray) -> list[np.ndarray]:
    """Passages by the hash that dealt them, in shards of SHARD_WORDS words (or of one hash)."""
    order = np.argsort(deal, kind="stable")
    words = np.cumsum(size[order])
    new = np.r_[True, deal[order][1:] != deal[order][:-1]] if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    part = (words - size[order])[start] // SHARD_WORDS
    return np.split(order, start[1:][np.diff(part) > 0]) if len(order) else []


def smallest_documents(shape: Shape, symbols: np.ndarray, offsets: np.ndarray, doc: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """For each window of each passage, the smallest document that has it: the passages of a shard are its reference, and are streamed through its automaton."""
    begin = np.r_[0, np.cumsum(np.diff(offsets) - shape.window + 1)]
    out = np.full(begin[-1], FAR_DOC)
    for members in reference_shards(np.diff(offsets), deal):
        at = expand(offsets[members], np.diff(offsets)[members])
        flat = np.unique(symbols[at], return_inverse=True)[1].tolist()  # small numbers for the symbols of the shard
        cuts = np.r_[0, np.cumsum(np.diff(offsets)[members])].tolist()
        rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        automaton = SuffixAutomaton()
        for row, d in zip(rows, doc[members].tolist(), strict=True):
            automaton.add(row, d)
        automaton.finish()
        for k, row in zip(members.tolist(), rows, strict=True):
            out[begin[k] : begin[k + 1]] = automaton.matches(row, shape.window)[shape.window - 1 :]
    return out


def removed_words(data: np.ndarray, ends: np.ndarray, at: np.ndarray, marked: np.ndarray) -> dict[str, pa.Array]:
    """Runs of removed words (start and length in words, flat), their number, and the sha256 of the kept words joined by one space."""
    start, stop, _ = word_bounds(data, ends)
    raw = data.tobytes()
    start, stop, cuts = start.tolist(), stop.tolist(), at.tolist()
    spans, removed, digests = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mark = marked[a:b]
        edge = np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0])).reshape(-1, 2)
        spans.append(np.stack([edge[:, 0], edge[:, 1] - edge[:, 0]], axis=1).ravel().astype(np.int64))
        removed.append(int(mark.sum()))
        keep = (np.flatnonzero(~mark) + a).tolist()
        digests.append(hashlib.sha256(b" ".join([raw[start[k] : stop[k]] for k in keep])).hexdigest())
    return {"spans": pa.array(spans, pa.list_(pa.int64())), "n_words": pa.array(np.diff(at)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}


def repeated_word_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: first, key, spans (start and length in words of each run to remove, flat), n_words, n_removed, kept_sha256.

    A word goes if it is covered by a window of 13 words that also starts in a
    document with a smaller doc_id. Null texts and documents without a doc_id take
    no part; shorter texts keep all; repeated rows (same doc_id and text) count once.
    """
    return find_repeats(docs, SHAPE, as_words, smallest_documents, removed_words, "spans array<long>, n_words long, n_removed long, kept_sha256 string", doc_id, text)


@F.pandas_udf(T.StringType())
def _without_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is None or s is None:
            out.append(t)
            continue
        data = np.frombuffer(t.encode(), np.uint8)
        start, stop, _ = word_bounds(data, np.array([0, len(data)]))
        keep = np.ones(len(start), bool)
        for a, n in np.asarray(s).reshape(-1, 2).astype(np.int64):
            keep[a : a + n] = False
        raw = data.tobytes()
        out.append(b" ".join(raw[start[k] : stop[k]] for k in np.flatnonzero(keep)).decode())
    return pd.Series(out)


def drop_repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, without the words of repeated windows; what is left is joined by one space.

    A text from which nothing goes stays as it is, so do null texts.
    """
    return by_position(docs, lambda rows, at: _drop_repeated_words(rows, at(doc_id), at(text)))


def _drop_repeated_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    attached = attach(docs, repeated_word_spans(docs, doc_id, text), doc_id, text)
    col = F.col(f"`{text}`")
    copy = F.col("__found").isNull() & F.col(f"`{doc_id}`").isNotNull() & (word_count(col) >= WINDOW)
    kept = F.when(copy, F.lit("")).when(F.col("__found.n_removed") > 0, _without_words(col, F.col("__found.spans"))).otherwise(col)
    return attached.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def word_count(col):
    return F.size(F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def remove_reference(docs: DataFrame, reference: DataFrame, text: str = "text", reference_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without the words of windows that a given reference holds.

    The reference goes through the driver, SHARD_WORDS words at a time: each shard
    becomes one automaton, which is broadcast (its size is bounded by the shard)
    and through which all documents are streamed. Meant for references far smaller
    than the corpus, such as licences or templates. Null texts stay null.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext

    def symbols_of(t: str) -> list[int]:
        data = np.frombuffer(t.encode(), np.uint8)
        return as_words(data, np.array([0, len(data)]))[0].tolist()

    def marks(shared):
        @F.pandas_udf("array<boolean>")
        def mark(texts: pd.Series, before: pd.Series) -> pd.Series:
            out = []
            for t, old in zip(texts, before, strict=True):
                if t is None:
                    out.append(None)
                    continue
                ends = np.array(shared.value.matches(symbols_of(t), window), np.int64)
                hit = np.zeros(len(ends) + 1, np.int64)
                last = np.flatnonzero(ends < FAR_DOC)
                np.add.at(hit, last - window + 1, 1)
                np.add.at(hit, last + 1, -1)
                new = np.cumsum(hit[:-1]) > 0
                out.append((new if old is None else new | np.asarray(old, bool)).tolist())
            return pd.Series(out)

        return mark

    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(None).cast("array<boolean>").alias("__marks"))
    automaton, words = SuffixAutomaton(), 0

    def apply(df: DataFrame) -> DataFrame:
        automaton.finish()
        return df.withColumn("__marks", marks(sc.broadcast(automaton))(F.col(f"`{text}`"), F.col("__marks")))

    for row in reference.select(F.col(f"`{reference_text}`").cast("string")).filter(F.col(f"`{reference_text}`").isNotNull()).toLocalIterator():
        symbols = symbols_of(row[0])
        for k in range(0, max(1, len(symbols) - window + 1), SHARD_WORDS):
            piece = symbols[k : k + SHARD_WORDS + window - 1]
            if words and words + len(piece) > SHARD_WORDS + window:
                marked = apply(marked)
                automaton, words = SuffixAutomaton(), 0
            automaton.add(piece, 0)
            words += len(piece)
    marked = apply(marked)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, mark: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, mark, strict=True):
            if t is not None and m is not None and any(m):
                data = np.frombuffer(t.encode(), np.uint8)
                start, stop, _ = word_bounds(data, np.array([0, len(data)]))
                t = b" ".join(data[a:b].tobytes() for a, b, gone in zip(start, stop, m, strict=True) if not gone).decode()
            out.append(t)
        return pd.Series(out)

    return marked.select(*[kept(F.col(f"`{c}`"), F.col("__marks")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of 13 words leave of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_word_spans(docs)
    content = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(content, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # texts that take no part, or too short a part, keep all their words
    plain = F.when((F.size(words) < WINDOW) | F.col("doc_id").isNull(), F.sha2(F.array_join(words, " "), 256))
    light = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), word_count(content).alias("words"), plain.alias("plain"))
    row = light.join(found, (F.col("doc_id") == F.col("first")) & (F.col("sha") == F.col("key")), "left")
    copy = F.col("first").isNull() & F.col("plain").isNull()
    return row.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.when(copy, F.col("words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "plain")).alias("kept_sha256"),
    )


OP4_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS k FROM d)),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM s) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + {WINDOW})) AS j FROM f),
a AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY a.j) AS kept FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
