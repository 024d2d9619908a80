"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items that would make the automaton too large go through a filter first: a Bloom
filter of the hashes of their windows, of bounded size, is broadcast, one pass over
the documents finds the hashes that occur, and only windows with one of these enter
the automaton, which decides. What is held and broadcast grows with the windows that
occur in documents, not with the benchmarks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import by_position, durable, small_batches, string_buffers, table
from lattika.llm.repeats import gram_hashes
from lattika.llm.suffix_automata import as_words

#: Words of a window.
WINDOW = 10
#: An item of fewer words can stand in a clean document; it contaminates one of whose words it makes up this share at least.
SHORT, SHARE = 8, 0.5
#: Bytes of items in one automaton; it has up to WINDOW times as many nodes. Of more items only windows that occur count, and more of these take further passes.
AUTOMATON_BYTES = 256_000
#: Bits of the filter at most, bits for each window, reads for each look-up, and bytes of a block in which it is put together.
FILTER_BITS, BITS, READS, BLOCK = 1 << 28, 16, 4, 1 << 16
#: Lower-cases A-Z, keeps digits, a-z and the bytes of other characters, and makes all else a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; fewer words, but not none, are one window."""
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))] if words else []


def window_hashes(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of some texts, and the number of the text of each."""
    words, at = as_words(np.frombuffer(NORMAL, np.uint8)[data], ends)
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.arange(len(words) - window + 1)
    owner = np.searchsorted(at, start, side="right") - 1
    inside = start + window <= at[owner + 1]
    return gram_hashes(words, window)[inside], owner[inside]


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """name, n (words), pattern (as scanned), hash (null for a window of fewer words) of all windows of the items."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                wins = windows_of(words, window)
                if not wins:
                    continue
                line = np.frombuffer(b" ".join(words), np.uint8)
                hashes = window_hashes(line, np.array([0, len(line)]), window)[0].view(np.int64).tolist() if len(words) >= window else [None]
                yield pa.RecordBatch.from_pydict({"name": [name or ""] * len(wins), "n": pa.array([len(w) for w in wins], pa.int32()), "pattern": pa.array([b" " + b" ".join(w) + b" " for w in wins], pa.binary()), "hash": pa.array(hashes, pa.int64())})

    return items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, "name string, n int, pattern binary, hash long")


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(READS)]


def occurring(windows: DataFrame, docs: DataFrame, text: str, window: int) -> DataFrame:
    """The windows whose hash occurs in a document, and those of fewer words."""
    spark = docs.sparkSession
    windows = durable(windows)
    bits = min(FILTER_BITS, 1 << max(20, (BITS * windows.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(own, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        for k in range(0, len(own), BLOCK):
            if own[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "bits": pa.array([own[k : k + BLOCK].tobytes()], pa.binary())})

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        every = [np.frombuffer(x, np.uint8) for x in rows["bits"].to_pylist()]
        return pa.table({"block": rows["block"].slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(every).tobytes()], pa.binary())})

    blocks = windows.filter("hash is not null").select("hash").mapInArrow(fill, "block long, bits binary").groupBy("block").applyInArrow(unite, "block long, bits binary")
    table_ = np.zeros(bits // 8, np.uint8)
    for block in blocks.toLocalIterator():  # FILTER_BITS at most
        table_[block["block"] : block["block"] + len(block["bits"])] = np.frombuffer(block["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table_)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.unique(window_hashes(*string_buffers(batch.column(0)), window)[0])
            hit = np.ones(len(hashes), bool)
            for at in places(hashes, bits):
                hit &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes[hit].view(np.int64))})

    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(find, "hash long").distinct()
    return windows.filter("hash is null").unionByName(windows.join(found, "hash", "left_semi").select(*windows.columns))


def item_passes(windows: DataFrame) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """Windows (as scanned text) with their length and items, a part that fits one automaton after the other."""
    out: dict = {}
    room = AUTOMATON_BYTES * WINDOW
    grouped = windows.groupBy("pattern").agg(F.max("n").alias("n"), F.collect_set("name").alias("names"))
    for row in grouped.toLocalIterator(prefetchPartitions=False):
        if out and room < len(row["pattern"]):
            yield out
            out, room = {}, AUTOMATON_BYTES * WINDOW
        out[bytes(row["pattern"]).decode("latin-1")] = (row["n"], row["names"])
        room -= len(row["pattern"])
    yield out


_BUILT: dict = {}


def automaton_of(stamp: str, windows) -> ahocorasick.Automaton | None:
    """Built once for each worker and broadcast."""
    if stamp not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, found in windows.value.items():
            built.add_word(pattern, found)
        if len(built):
            built.make_automaton()
        _BUILT[stamp] = built if len(built) else None
    return _BUILT[stamp]


def word_offsets(text: str) -> np.ndarray:
    """Start and end of each word, in characters of the text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = np.r_[False, np.frombuffer(NORMAL, np.uint8)[raw] != 32, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return chars[edges].reshape(-1, 2)


def scan(text: str | None, automaton, least: int = SHORT) -> tuple[int, np.ndarray, list[str], bool]:
    """Words, the numbers of the hit ones, the items found, and whether a window of `least` words or a large enough share of an item is among them."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), np.zeros(0, np.int64), [], False
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    found = list(automaton.iter(line))
    if not found:
        return len(words), np.zeros(0, np.int64), [], False
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    change = np.zeros(len(words) + 1, np.int64)
    long, short = False, {}
    for end, (n, names) in found:
        last = int(np.searchsorted(spaces, end))
        change[last - n] += 1
        change[last] -= 1
        if n >= least:
            long = True
        elif not long:
            # a short window is one whole item; it is known by the list of its names
            short.setdefault(id(names), []).append(np.arange(last - n, last))
    share = long or any(len(np.unique(np.concatenate(x))) >= SHARE * len(words) for x in short.values())
    return len(words), np.flatnonzero(np.cumsum(change)[:-1] > 0), list({x for _, (_, names) in found for x in names}), share


def hit_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of the runs of hit words."""
    at = word_offsets(text)
    first = np.r_[True, np.diff(hit) > 1]
    last = np.r_[first[1:], True]
    return [{"start": int(a), "end": int(b)} for a, b in zip(at[hit[first], 0], at[hit[last], 1], strict=True)]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """Columns of keep, then n_words, n_hit, items (array of ids as strings, sorted), spans (character ranges of hit runs) and telling.

    telling is true if a window of SHORT words or more occurs, or a shorter item makes
    up SHARE of the words: any other hit is of words that clean texts have as well.

    A text is scanned once for each automaton. Items of up to AUTOMATON_BYTES share
    one; of more items only the windows that occur in docs are put into automata of
    that size. Null
    texts have no words; null item ids count under the empty name; items without
    words match nothing; an empty item table leaves all documents clean. Rows are
    neither dropped nor merged. Other columns of docs are left out.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    state = kept.withColumns({"__hit": F.lit(None).cast("array<long>"), "__items": F.lit(None).cast("array<string>"), "__telling": F.lit(False)})

    def one_pass(windows, last: bool):
        stamp = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(stamp, windows)
            for batch in batches:
                texts, hits, names, telling = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__text", "__hit", "__items", "__telling"))
                n = []
                for k, t in enumerate(texts):
                    count, hit, found, tells = scan(t, automaton, min(SHORT, window))
                    n.append(count)
                    telling[k] = telling[k] or tells
                    if len(hit):
                        hits[k] = np.union1d(hits[k] or [], hit).astype(np.int64)
                        names[k] = sorted({*(names[k] or ()), *found})
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(telling, pa.bool_())], names=batch.schema.names)
                    continue
                spans = [[] if h is None else hit_spans(t, np.asarray(h)) for t, h in zip(texts, hits, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-4], pa.array(n, pa.int64()), pa.array([0 if h is None else len(h) for h in hits], pa.int64()), pa.array([x or [] for x in names], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(telling, pa.bool_())],
                    names=[*batch.schema.names[:-4], "n_words", "n_hit", "items", "spans", "telling"],
                )

        return run

    windows = item_windows(items, item_id, item_text, window)
    if (items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0) > AUTOMATON_BYTES:
        windows = occurring(windows, kept, "__text", window)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(part) for part in item_passes(windows)]
    for k, part in enumerate(shared):
        last = k == len(shared) - 1
        schema = f"{head}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, telling boolean" if last else state.schema
        state = state.mapInArrow(one_pass(part, last), schema)
    return state


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with all their columns, without a telling hit: no window of an item, and no shorter item that makes up much of them."""
    return by_position(docs, lambda rows, at: find_contamination(rows, items, text=at(text), keep=tuple(rows.columns)).filter(~F.col("telling")))


def digest(found: DataFrame) -> DataFrame:
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every whole text of documents lie in a window of a benchmark item."""
    return digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k : k + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
