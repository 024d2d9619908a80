"""Training-order materialisation of token ids.

Texts, in the order of doc_id and text, are encoded, closed with the end-of-text
token and put one after the other: one stream of tokens, whatever the layout of
the input. The stream is cut into sequences of a fixed length. A keyed Feistel
network over the smallest even power of two that holds all sequences, walked along
its cycles until it lands below their number, is a permutation of their numbers:
it gives each sequence its global slot. Sequences are partitioned by slot range;
every shard is a flat file of records of one stride, so that slot, shard and byte
offset follow from each other and reading can be taken up anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattika.llm.common import drop_tables, durable_table, file_system, mix64, release, shared_path, small_batches, table
from lattika.llm.token_counts import load_vocabulary, vocabulary_file

#: Tokens of a sequence, sequences of a shard, rounds of the Feistel network.
LENGTH, SHARD_ROWS, ROUNDS = 1024, 8192, 6
KEY = 20240229
#: Parts in which shards are written, and the first shard of its part and the number of a file.
PARTS = 3
FILE = r"/first=(\d+)/part-(\d+)[^/]*$"


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % 2**64) * np.uint64(ROUNDS + 1))

    def _network(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        bits = np.uint64(self.half)
        a, b = x >> bits, x & self.mask
        for key in keys:
            if back:
                a, b = b ^ (mix64(a + key) & self.mask), a
            else:
                a, b = b, a ^ (mix64(b + key) & self.mask)
        return (a << bits) | b

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(x).astype(np.uint64), keys, back)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._network(out[outside], keys, back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def token_type(vocabulary_size: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def token_stream(docs: DataFrame, vocabulary_path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """range, place, doc_id, n, ids: the texts by (doc_id, text) in pieces of at most `length` tokens (little-endian, 2 or 4 bytes each).

    Ranges of the order are numbered; place counts the tokens of a range before a
    piece. A text is closed by the end-of-text token; a null text counts as empty.
    Null doc_ids stand first. Rows that tie are equal, so that their order has no effect.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # the hash parts the texts of a hot doc_id
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    vocabulary = load_vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind, end = token_type(vocabulary.size), max(vocabulary.special.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            doc, at, n, cut = [], [], [], []
            for k, last, ids, _ in shared.value.encode_all(x.as_py() for x in batch.column(1)):
                flat = np.append(ids, end).astype(kind) if last else ids.astype(kind)
                for a in range(0, len(flat), length):
                    piece = flat[a : a + length]
                    doc.append(names[k]), at.append(place), n.append(len(piece)), cut.append(piece.tobytes())
                    place += len(piece)
            yield pa.RecordBatch.from_pydict({"range": pa.array([part] * len(doc), pa.int32()), "place": pa.array(at, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "n": pa.array(n, pa.int32()), "ids": pa.array(cut, pa.binary())})

    return rows.mapInArrow(run, "range int, place long, doc_id long, n int, ids binary")


@dataclass
class Stream:
    """The token stream of some documents in a table of pieces: tokens before each range, number of sequences, type and end-of-text token."""

    pieces: DataFrame
    offsets: DataFrame
    sequences: int
    kind: np.dtype
    pad: int


def stored_stream(docs: DataFrame, vocabulary_path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> Stream:
    vocabulary = load_vocabulary(vocabulary_path)
    pieces = durable_table(token_stream(docs, vocabulary_path, length, doc_id, text), compression="zstd")
    release(docs.sparkSession)
    counts = pieces.groupBy("range").agg(F.sum("n").alias("n"))  # a row for each range
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return Stream(pieces, offsets, -(-(counts.agg(F.sum("n")).first()[0] or 0) // length), token_type(vocabulary.size), max(vocabulary.special.values()))


def records(stream: Stream, first: int, stop: int, key: int, length: int, shard_rows: int) -> DataFrame:
    """The records of the shards from first to before stop, one partition for each."""
    wide, pad = stream.kind.itemsize, stream.pad
    stride = (length + 1) * wide
    order = Permutation(max(stream.sequences, 1), key)

    @F.pandas_udf(T.LongType())
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(order.slot(number.to_numpy()))

    # a piece lies in one sequence or in two
    at = F.col("place") + F.col("before")
    head = F.least("n", F.lit(length) - F.pmod(at, F.lit(length))).cast("int")
    one = F.struct(F.floor(at / length).cast("long").alias("sequence"), F.pmod(at, F.lit(length)).cast("int").alias("at"), F.lit(0).alias("start"), head.alias("n"))
    two = F.struct((F.floor(at / length) + 1).cast("long").alias("sequence"), F.lit(0).alias("at"), head.alias("start"), (F.col("n") - head).alias("n"))
    cut = stream.pieces.join(F.broadcast(stream.offsets), "range").select("doc_id", "ids", F.explode(F.when(F.col("n") > head, F.array(one, two)).otherwise(F.array(one))).alias("x"))
    cut = cut.withColumn("slot", slot("x.sequence")).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int")).filter(F.col("shard").between(first, stop - 1))
    cut = cut.select("slot", "shard", "doc_id", "x.sequence", "x.at", "x.n", F.substring(F.col("ids"), F.col("x.start") * wide + 1, F.col("x.n") * wide).alias("ids"))
    dealt = cut.repartitionById(max(1, stop - first), F.col("shard") - first).sortWithinPartitions("slot", "at")
    filler = np.full(length, pad, stream.kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, sorted by slot and place, to records."""
        now, docs, held = None, [], []

        def out() -> dict:
            size = sum(map(len, held)) // wide
            return {"slot": now[0], "shard": now[1], "byte_offset": now[0] % shard_rows * stride, "sequence": now[2], "n_tokens": size, "docs": docs, "record": b"".join(held) + filler[size * wide :]}

        for batch in batches:
            done = []
            for s, shard, doc, sequence, place, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != s:
                    if now is not None:
                        done.append(out())
                    now, docs, held = (s, shard, sequence), [], []
                docs.append({"doc_id": doc, "at": place, "n": n}), held.append(ids)
            if done:
                yield pa.RecordBatch.from_pylist(done, RECORD)
        if now is not None:
            yield pa.RecordBatch.from_pylist([out()], RECORD)

    return dealt.mapInArrow(run, "slot long, shard int, byte_offset long, sequence long, n_tokens int, docs array<struct<doc_id: long, at: int, n: int>>, record binary")


def training_order(docs: DataFrame, vocabulary_path: str, key: int = KEY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """slot, shard, byte_offset, sequence, n_tokens, docs (doc_id, at, n of each piece in the record), record (`length` tokens).

    Each partition holds one shard, sorted by slot; slots are gapless from 0. Only
    the record of the last sequence can be short; it is padded with end-of-text
    tokens. The slots depend on the rows and the key alone, not on files or
    partitions. Empty tables give no rows; repeated rows and null doc_ids are part
    of the stream like others. Other columns of docs are left out.
    """
    stream = stored_stream(docs, vocabulary_path, length, doc_id, text)
    return records(stream, 0, -(-stream.sequences // shard_rows), key, length, shard_rows)


RECORD = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("sequence", pa.int64()), ("n_tokens", pa.int32()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))), ("record", pa.binary())])


def write_shards(docs: DataFrame, folder: str, vocabulary_path: str, key: int = KEY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes training_order into folder/shards, one flat file for each shard, and folder/index, what is needed to read them.

    A record is followed by one end-of-text token. The files come from Spark's own
    writer of plain files, through Hadoop's file systems: a file appears whole or not
    at all, whatever executors are lost. The shards are written in PARTS parts, so that
    only one part at a time is on its way between executors; the number of a file
    counts from the first shard of its part.
    """
    spark = docs.sparkSession
    stream = stored_stream(docs, vocabulary_path, length, doc_id, text)
    after = np.array([stream.pad], stream.kind).tobytes().decode("latin-1")
    shards = -(-stream.sequences // shard_rows)
    step = max(1, -(-shards // PARTS))
    for first in range(0, max(1, shards), step):
        ordered = records(stream, first, min(shards, first + step), key, length, shard_rows)
        ordered.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", after).text(f"{folder}/shards/first={first}")
        del ordered
        release(spark)
    spark.createDataFrame([(length, shard_rows, stream.kind.str)], "length int, shard_rows int, type string").coalesce(1).write.json(f"{folder}/index")
    drop_tables(stream.pieces)


def read_index(spark: SparkSession, folder: str) -> tuple[int, int, np.dtype]:
    row = spark.read.schema("length int, shard_rows int, type string").json(f"{folder}/index").first()
    return row["length"], row["shard_rows"], np.dtype(row["type"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """slot, shard, byte_offset, record of all shards of a folder, cut by the stride alone."""
    length, shard_rows, kind = read_index(spark, folder)
    size, stride = length * kind.itemsize, (length + 1) * kind.itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{folder}/shards")
    shard = (F.regexp_extract("path", FILE, 1).cast("int") + F.regexp_extract("path", FILE, 2).cast("int")).alias("shard")
    rows = files.filter("length > 0").select(shard, "content", F.explode(F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)).alias("k"))
    return rows.select((F.col("shard").cast("long") * shard_rows + F.col("k")).alias("slot"), "shard", (F.col("k").cast("long") * stride).alias("byte_offset"), F.substring(F.col("content"), F.col("k") * stride + 1, F.lit(size)).alias("record"))


def read_slots(spark: SparkSession, folder: str, start: int, count: int) -> np.ndarray:
    """The sequences of the slots from start on, read by offset alone from any file system that Hadoop opens."""
    length, shard_rows, kind = read_index(spark, folder)
    stride, out = (length + 1) * kind.itemsize, []
    store, at = file_system(spark, f"{folder}/shards")
    files = {int(m[1]) + int(m[2]): x for part in store.listStatus(at) for x in store.listStatus(part.getPath()) if (m := re.search(FILE, x.getPath().toString()))}
    while count > 0 and (start // shard_rows) in files:
        shard, k = divmod(start, shard_rows)
        n = min(count, files[shard].getLen() // stride - k)
        if n <= 0:
            break
        stream = store.open(files[shard].getPath())
        try:
            stream.seek(k * stride)
            raw = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * stride)
        finally:
            stream.close()
        out.append(np.frombuffer(bytes(raw), kind).reshape(n, length + 1)[:, :length])
        start, count = start + n, count - n
    return np.concatenate(out) if out else np.zeros((0, length), kind)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat shards of token records in training order, and what is read back from them: slot, shard, byte_offset, record."""
    folder = shared_path(spark, "training-order")
    write_shards(table(spark, sf_dir, "documents"), folder, vocabulary_file())
    return read_shards(spark, folder)
