"""Language identification with bit-sliced Bloom filters over letter n-grams.

One table of slots serves all languages: bit l of a slot belongs to the filter of
language l, so that a few reads return all languages that contain an n-gram.
Counting the bits over the n-grams of a text, less those expected from false
positives, decides.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattika.llm.common import by_position, durable, mix64, small_batches, table, text_slices
from lattika.llm.merge_rounds import code_points

#: Letters and word limits of an n-gram.
GRAM = 4
#: Documents of each language that the filters are learned from at most; chosen by a hash of doc_id, read whole.
SAMPLE = 3000
#: An n-gram enters the filter of a language that has it at this share at least of its highest rate in any language.
SHARE = 0.25
#: N-grams seen less often in a language of the sample are taken for noise there, but only while those seen as often
#: make up this share of its sample: a language with little text is learned from n-grams seen once.
LEAST, ENOUGH = 3, 0.5
#: Slots for each n-gram and reads for each look-up.
SLOTS, READS = 8, 3
SLICE = 1_000_000


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Lower-case code point of each letter (and mark); a space for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if unicodedata.category(s)[0] in "LM":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n points in a row."""
    size = max(0, len(points) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(31) + points[k : k + size].astype(np.uint64)) if k == n - 1 else out * np.uint64(0x10001B3) + points[k : k + size].astype(np.uint64)
    return out


def grams(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of each text, and n + 1 offsets. Runs of other characters are one word limit; a text starts and ends with one."""
    points, ends = code_points([f" {t} " if t else "" for t in texts])
    points = folding()[points]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[ends[:-1][ends[:-1] < len(points)]] = True
    points, ends = points[keep], np.r_[0, np.cumsum(keep)][ends]
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    out = gram_hashes(points, n)
    # only those that end in the text they start in
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    own = owner[:size] == owner[n - 1 :]
    return out[own], np.r_[0, np.cumsum(np.bincount(owner[:size][own], minlength=len(texts)))]


def gram_parts(text: str, n: int = GRAM) -> Iterator[np.ndarray]:
    """The same hashes of one long text, SLICE characters at a time; the last letters of a part are carried over to the next."""
    carry = np.array([32], np.uint32)
    for a in range(0, len(text), SLICE):
        points = folding()[code_points([text[a : a + SLICE]])[0]]
        if a + SLICE >= len(text):
            points = np.append(points, np.uint32(32))
        every = np.concatenate([carry, points])
        keep = np.ones(len(every), bool)
        keep[len(carry) :] = (every[len(carry) :] != 32) | (every[len(carry) - 1 : -1] != 32)
        every = every[keep]
        yield gram_hashes(every, n)
        carry = every[-(n - 1) :] if n > 1 else every[-1:]


@dataclass
class LanguageFilters:
    """languages by bit; slots (one unsigned 64-bit word for each 64 languages); the false-positive rate of each language; those learned from too little text to tell what is foreign."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    thin: tuple[str, ...] = ()

    @staticmethod
    def build(languages: list[str], gram: np.ndarray, owner: np.ndarray) -> LanguageFilters:
        """gram[i] goes into the filter of languages[owner[i]]."""
        size = 1 << max(10, math.ceil(math.log2(SLOTS * max(1, len(gram)))))
        slots = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
        for at in LanguageFilters._places(gram, size):
            for w in range(len(slots)):
                here = owner // 64 == w
                np.bitwise_or.at(slots[w], at[here], np.uint64(1) << (owner[here] % 64).astype(np.uint64))
        fill = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return LanguageFilters(languages, slots, fill**READS)

    @staticmethod
    def _places(gram: np.ndarray, size: int) -> list[np.ndarray]:
        step = (gram >> np.uint64(32)) | np.uint64(1)
        return [((gram + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(READS)]

    def _count(self, gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many of the n-grams of each text are in the filter of each language."""
        counts = np.zeros((len(self.languages), len(offsets) - 1))
        places = self._places(gram, self.slots.shape[1])
        for w, words in enumerate(self.slots):
            mask = words[places[0]]
            for at in places[1:]:
                mask = mask & words[at]
            for k in range(64 * w, min(len(self.languages), 64 * w + 64)):
                bit = ((mask >> np.uint64(k - 64 * w)) & np.uint64(1)).astype(np.int64)
                counts[k] = np.diff(np.r_[0, np.cumsum(bit)][offsets])
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, the share of its n-grams that are known in it, corrected for false positives, and their number.

        A text of more than SLICE characters is counted part by part.
        """
        long = [k for k, t in enumerate(texts) if t and len(t) > SLICE]
        gram, offsets = grams([None if k in long else t for k, t in enumerate(texts)] if long else texts)
        n, counts = np.diff(offsets), self._count(gram, offsets)
        for k in long:
            for part in gram_parts(texts[k]):
                n[k] += len(part)
                counts[:, k] += self._count(part, np.array([0, len(part)]))[:, 0]
        rates = self.rates[:, None]
        counts = np.clip((counts - n * rates) / np.maximum(1 - rates, 1e-9), 0, n)
        letters = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), n
        best = counts.argmax(axis=0)
        score = np.where(letters, counts.max(axis=0) / np.maximum(n, 1), 0.0)
        return [self.languages[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)], score, n


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageFilters:
    """Filters from rows with a non-null text and lang.

    At most `sample` documents of each language are read, whole; the bound keeps
    the learned table small whatever the corpus. A language is thin if under half of
    its sample are n-grams seen twice, so that of a new text about as much is known.
    """
    rows = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilters.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    # a hash keeps little more than the sample before the exact cut
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 1.5 * sample / counts[x]))) for x in languages])
    draw = F.xxhash64("id", F.lit(5))
    near = rows.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 30)) <= part * (1 << 30))
    chosen = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw", "id"))).filter(F.col("k") <= sample).select("lang", "text")
    small_batches(labelled.sparkSession)
    index = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = (batch.column(k).to_pylist() for k in (0, 1))
            for name in set(names):
                own = [t for t, x in zip(texts, names, strict=True) if x == name]
                short = grams([t for t in own if len(t) <= SLICE])[0]
                for part in [short, *(g for t in own if len(t) > SLICE for g in gram_parts(t))]:
                    gram, n = np.unique(part, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), index[name]), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["owner", "gram", "n"])

    seen = durable(chosen.mapInArrow(count, "owner int, gram long, n long").groupBy("owner", "gram").agg(F.sum("n").alias("n")))
    often = [F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)) for k in range(2, LEAST + 1)]
    least = F.lit(1)
    for k, enough in enumerate(often, 2):
        least = F.when(enough >= ENOUGH * F.sum("n"), k).otherwise(least)
    # a row for each language
    seen = seen.join(F.broadcast(seen.groupBy("owner").agg(F.sum("n").alias("all"), least.alias("least"))), "owner").withColumn("rate", F.col("n") / F.col("all"))
    known = seen.withColumn("most", F.max("rate").over(W.partitionBy("gram"))).filter((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") >= F.col("least")))
    found = known.select("owner", "gram", "least").toArrow()
    owner = found["owner"].to_numpy()
    filters = LanguageFilters.build(languages, found["gram"].to_numpy().view(np.uint64), owner)
    filters.thin = tuple(languages[k] for k in np.unique(owner[found["least"].to_numpy() == 1]).tolist())
    return filters


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, then lang_pred, score and n_grams (n-grams judged) of each whole text.

    A null text, or one without a letter, is `und` with score 0; so is any text if
    nothing was learned. On ties the language with more learned documents wins.
    Rows are neither dropped nor merged; other columns of docs are left out.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", lang_pred string, score double, n_grams long"
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lens = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in text_slices(lens, SLICE):
                part = batch.slice(i, j - i)
                names, score, n = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(n)], names=[*part.schema.names[:-1], "lang_pred", "score", "n_grams"])

    return kept.mapInArrow(run, schema)


#: A text of at least so many n-grams of which a smaller share is known is in none of the learned languages, unless the best of these is thin.
FOREIGN_GRAMS, FOREIGN_SCORE = 20, 0.2


def drop_foreign(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that are in a learned language. Texts too short to judge, and those next to a thin language, stay; those without a letter go."""
    unsure = (F.col("n_grams") < FOREIGN_GRAMS) | (F.col("lang_pred").isin(*filters.thin) & (F.col("score") > 0))
    known = (F.col("lang_pred") != "und") & ((F.col("score") >= FOREIGN_SCORE) | unsure)
    return by_position(docs, lambda rows, at: identify(rows, filters, text=at(text), keep=tuple(rows.columns)).filter(known))


def held_out() -> object:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return identify(docs, filters).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
