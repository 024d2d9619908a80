"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

When the vocabulary is loaded, the merges are run over each of its strings: those
that come out as one token are proved to be whole tokens. Pre-tokens of a text
that equal such a string are taken directly; only the distinct rest is merged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import small_batches, table
from lattika.llm.merge_rounds import HashTable, MergeTable, WordHasher, WordMemo, code_points, expand, same_words

#: Code points whose pre-tokens are handled together; a longer text is cut between pre-tokens.
SLICE = 500_000
#: Code points that are looked at together for such a cut.
NEAR = 65_536
LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that follow an apostrophe as a pre-token of their own (fixed values).
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else counted up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def point_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    out[WHITE_SPACE] = WHITE
    return out


class ByteVocabulary:
    """A tokenizers file: byte-level BPE with the usual pattern, without normaliser, prefix space or post-processing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # of strings that start at one place the longest counts
        self.mark = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        vocab, letters = model["vocab"], byte_letters()
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs], range(len(pairs)), self.size)
        self.kind = point_classes()
        self.in_mark = np.zeros(0x110000, bool)
        self.in_mark[[ord(c) for t in self.special for c in t]] = True
        self.hasher, self.memo = WordHasher(), WordMemo()
        self._prove({t: i for t, i in vocab.items() if t not in self.special and all(c in letters for c in t)}, letters)

    def _prove(self, vocab: dict[str, int], letters: dict[str, int]) -> None:
        strings, ids = [], []
        for t, i in vocab.items():
            try:
                strings.append(bytes(letters[c] for c in t).decode())
                ids.append(i)
            except UnicodeDecodeError:
                continue
        sym, seg = self.merge(strings)
        alone = np.bincount(seg, minlength=len(strings)) == 1
        token = np.full(len(strings), -1)
        token[seg] = sym
        keep = np.flatnonzero(alone & (token == np.array(ids)))
        self.whole_ids = np.array(ids, np.int32)[keep]
        self.whole_points, ends = code_points([strings[k] for k in keep])
        self.whole_starts, self.whole_lens = ends[:-1], np.diff(ends)
        self.whole = HashTable(self.hasher(self.whole_points, self.whole_starts, self.whole_lens))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word, and the word of each id."""
        raw = [w.encode("utf-8", "replace") for w in words]
        seg = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) for x in raw])
        return self.merges.run(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], seg)

    def pre_tokens(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. Runs of letters, of numbers and of other signs take one space in front; of other white space
        the last character stands alone before a run; a lone apostrophe takes its ending."""
        n = len(points)
        kind = self.kind[points]
        edge = np.zeros(n + 1, bool)  # text starts
        edge[ends] = True
        run = edge[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        white = kind == WHITE
        ends_run = np.ones(n, bool)
        ends_run[:-1] = run[1:]
        # the last white character of a run before something else of the same text
        last = white & ends_run & ~edge[1:]
        start = run.copy()
        start[last] = True
        led = np.flatnonzero(last & (points == 0x20)) + 1
        start[led] = False
        # apostrophes that are a run of their own, without a space in front
        quote = np.flatnonzero((points == 0x27) & run & ends_run & ~edge[1:])
        quote = quote[start[quote]]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            taken = np.zeros(len(quote), bool)
            text_end = ends[np.searchsorted(ends, quote, side="right")]
            for ending in ENDINGS:
                fits = ~taken & (quote + len(ending) < text_end)
                for k, c in enumerate(ending):
                    fits[fits] = points[quote[fits] + 1 + k] == ord(c)
                start[quote[fits] + 1] = False
                after = quote[fits] + 1 + len(ending)
                after = after[after < n]
                start[after[~white[after]]] = True
                taken |= fits
        return np.flatnonzero(start)

    def encode(self, texts: list[str | None], count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none if count_only) and n + 1 offsets; special strings become their tokens."""
        parts, owner, special = [], [], []
        for k, text in enumerate(texts):
            for piece, token in self._split(text or ""):
                parts.append(piece), owner.append(k), special.append(token)
        ids, offsets = self._encode_plain(parts, count_only)
        n = np.diff(offsets)
        special = np.array(special, np.int64)
        mark = special >= 0
        counts = np.bincount(np.array(owner, np.int64), n + mark, len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)
        if mark.any() and not count_only:
            ids = np.insert(ids, offsets[1:][mark], special[mark])
        return ids, np.r_[0, np.cumsum(counts)]

    def _split(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of text, each with the special token behind it or -1."""
        at = 0
        for found in self.mark.finditer(text):
            yield text[at : found.start()], self.special[found[0]]
            at = found.end()
        yield text[at:] if at else text, -1

    def cut(self, text: str, most: int = SLICE) -> Iterator[str]:
        """Parts of a text that are encoded alike alone: each ends at the first proven border after so many code points.

        White space after something else opens a pre-token, and so does whatever
        follows a run of letters or of numbers; no special string may reach across.
        A text without such a place stays whole.
        """
        start = 0
        while len(text) - start > most:
            at = self._border(text, start + most)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def _border(self, text: str, at: int) -> int:
        for a in range(at, len(text), NEAR):
            points = np.frombuffer(text[a - 1 : a + NEAR].encode("utf-32-le", "surrogatepass"), np.uint32)
            kind, inside = self.kind[points], self.in_mark[points]
            before, after = kind[:-1], kind[1:]
            opens = (before != after) & (((after == WHITE) | (before == LETTER) | (before == NUMBER)) & ~(inside[:-1] & inside[1:]))
            if opens.any():
                return a + int(opens.argmax())
        return -1

    def encode_all(self, texts: Iterator[str | None], count_only: bool = False) -> Iterator[tuple[int, bool, np.ndarray, int]]:
        """For each text in turn its parts: number of the text, whether it is the last part, ids (none if count_only), number of tokens.

        Memory holds the parts of SLICE code points at a time, whatever the length of the texts.
        """
        held, room = [], SLICE

        def flush():
            ids, at = self.encode([part for _, _, part in held], count_only)
            for (k, last, _), a, b in zip(held, at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield k, last, ids[a:b], b - a

        for k, text in enumerate(texts):
            parts = self.cut(text or "")
            part = next(parts)
            while part is not None:
                after = next(parts, None)
                held.append((k, after is None, part))
                room -= len(part)
                if room <= 0:
                    yield from flush()
                    held, room = [], SLICE
                part = after
        if held:
            yield from flush()

    def _encode_plain(self, texts: list[str], count_only: bool) -> tuple[np.ndarray, np.ndarray]:
        points, ends = code_points(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.pre_tokens(points, ends)
        lens = np.diff(np.r_[starts, len(points)])
        hashes = self.hasher(points, starts, lens)
        whole = self.whole.find(hashes)
        # equal hashes are compared in full
        at = np.flatnonzero(whole >= 0)
        right = self.whole_lens[whole[at]] == lens[at]
        whole[at[~right]] = -1
        at = at[right]
        differs = points[expand(starts[at], lens[at])] != self.whole_points[expand(self.whole_starts[whole[at]], lens[at])]
        if differs.any():
            whole[np.repeat(at, lens[at])[differs]] = -1
        rest = np.flatnonzero(whole < 0)
        n = np.ones(len(starts), np.int64)
        if len(rest):
            first, group = same_words(points, starts[rest], lens[rest], hashes[rest])
            own = rest[first]
            letters = points[expand(starts[own], lens[own])]
            words = letters.tobytes().decode("utf-32-le", "surrogatepass")
            cuts = np.r_[0, np.cumsum(lens[own])].tolist()
            sym, bound = self.memo(hashes[own], letters, lens[own], lambda todo: self.merge([words[cuts[k] : cuts[k + 1]] for k in todo.tolist()]))
            n[rest] = np.diff(bound)[group]
        total = np.r_[0, np.cumsum(n)]
        offsets = total[np.searchsorted(starts, ends)]
        if count_only:
            return np.zeros(0, np.int32), offsets
        ids = np.zeros(total[-1], np.int32)
        direct = whole >= 0
        ids[total[:-1][direct]] = self.whole_ids[whole[direct]]
        if len(rest):
            ids[expand(total[:-1][rest], n[rest])] = sym[expand(bound[:-1][group], n[rest])]
        return ids, offsets


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, then n_bytes and n_tokens of each whole text; null counts as empty, rows are neither dropped nor merged.

    Special strings of the vocabulary inside a text count as their token. Very long
    texts are encoded part by part. Other columns of docs, whatever their names, are
    left out. The vocabulary, a table of fixed size, is read by the driver and broadcast.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_bytes long, n_tokens long"

    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens = np.zeros(len(column), np.int64)
            for k, _, _, n in shared.value.encode_all((x.as_py() for x in column), count_only=True):
                n_tokens[k] += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(n_tokens)], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text of documents, and whether they exceed the limit."""
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary_file())
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
