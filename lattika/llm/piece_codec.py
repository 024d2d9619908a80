"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is escaped as the model asks (a space becomes U+2581, one is put in
front) and cut into words: no piece of the vocabulary crosses a cut, which is
proved when the model is loaded. The distinct words of a batch are then merged
together: flat symbol arrays, the least pair rank of each word, all leftmost
non-overlapping occurrences of it at once, compaction of the arrays, until no
pair is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import small_batches, table
from lattika.llm.merge_rounds import MergeTable, WordHasher, code_points, expand, same_words

SPACE = "▁"
#: Characters whose new words are merged together; a longer text is cut between words.
SLICE = 500_000
#: Characters that are looked at together for such a cut, and ids that are decoded together.
NEAR, IDS = 65_536, 1_000_000


class PieceModel:
    """A BPE model file: identity normalisation, byte fallback, a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models without normalisation are supported")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int64)
        self.is_byte = np.zeros(len(proto.pieces), bool)
        self.ids: dict[str, int] = {}
        scores = {}
        for i, p in enumerate(proto.pieces):
            out = b""
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.is_byte[i], out = i, True, bytes([value])
            elif p.type == kinds.NORMAL:
                self.ids[p.piece], scores[p.piece] = i, p.score
                out = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.UNKNOWN:
                out = train.unk_surface.encode()
            self.bytes_of.append(out)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.size = len(proto.pieces)
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: order[s] for p, s in scores.items()}
        self._pairs(rank)
        self._cuts()

    def _pairs(self, rank: dict[str, int]) -> None:
        """The merges: each way to split a piece into two."""
        left, right, made, ranks = [], [], [], []
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                ia, ib = self.ids.get(a), self.ids.get(b)
                if ia is not None and ib is not None:
                    left.append(ia), right.append(ib), made.append(self.ids[piece]), ranks.append(r)
        self.merges = MergeTable(left, right, made, ranks, self.size)

    def _cuts(self) -> None:
        """Words end between two characters that stand side by side in no piece: no merge can cross that place."""
        long = [p for p in self.ids if len(p) > 1]
        inner = sorted({c for p in long for c in p})
        index = {c: k + 1 for k, c in enumerate(inner)}
        self.char = np.zeros(0x110000, np.uint16)  # 0: stands in no longer piece
        self.char[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.adjacent = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in long:
            for a, b in zip(p, p[1:], strict=False):
                self.adjacent[index[a], index[b]] = True
        self.plain = self.char.copy()  # of a text that is not escaped yet
        self.plain[0x20] = self.char[ord(SPACE)]
        # a character outside the vocabulary gets a number above all ids; it takes part in no pair
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.hasher = WordHasher()

    def _spell(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte fallback of the characters outside the vocabulary."""
        odd = sym >= self.size
        if not odd.any():
            return sym, seg
        spelled = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in (sym[odd] - self.size).tolist()]
        n = np.ones(len(sym), np.int64)
        n[odd] = [len(x) for x in spelled]
        out = np.repeat(sym, n)
        out[np.repeat(odd, n)] = np.concatenate(spelled)
        return out, np.repeat(seg, n)

    def cut(self, text: str, most: int = SLICE) -> Iterator[str]:
        """Parts of a text that end between two words, each the first such place after so many characters. A text without one stays whole."""
        start = 0
        while len(text) - start > most:
            at = -1
            for a in range(start + most, len(text), NEAR):
                index = self.plain[np.frombuffer(text[a - 1 : a + NEAR].encode("utf-32-le", "surrogatepass"), np.uint32)]
                free = ~self.adjacent[index[:-1], index[1:]]
                if free.any():
                    at = a + int(free.argmax())
                    break
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def encode_all(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn, with begin and end, as little-endian unsigned 32-bit integers; SLICE characters are merged at a time."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        held, room, own = [], SLICE, [begin]

        def flush():
            nonlocal own
            for ids, (_, _, last) in zip(self.encode([x for x, _, _ in held], [f for _, f, _ in held]), held, strict=True):
                own.append(ids)
                if last:
                    yield b"".join([*own, end])
                    own = [begin]

        for text in texts:
            parts = self.cut(text or "")
            part, front = next(parts), True
            while part is not None:
                after = next(parts, None)
                held.append((part, front, after is None))
                room, front, part = room - len(part), False, after
                if room <= 0:
                    yield from flush()
                    held, room = [], SLICE
        yield from flush()

    def encode(self, texts: list[str | None], fronts: list[bool] | None = None) -> list[bytes]:
        """Ids of each text without begin and end, as little-endian unsigned 32-bit integers. fronts: whether it is the start of a text."""
        front = SPACE if self.prefix else ""
        points, ends = code_points([(front if first else "") + t.replace(" ", SPACE) if t else "" for t, first in zip(texts, fronts or [True] * len(texts), strict=True)])
        if not len(points):
            return [b""] * len(texts)
        index = self.char[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.adjacent[index[:-1], index[1:]]
        cut[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        lens = np.diff(np.r_[starts, len(points)])
        first, group = same_words(points, starts, lens, self.hasher(points, starts, lens))
        n = lens[first]
        seg = np.repeat(np.arange(len(first), dtype=np.int32), n)
        sym, seg = self._spell(*self.merges.run(self.symbol[points[expand(starts[first], n)]], seg))
        bound = np.searchsorted(seg, np.arange(len(first) + 1))
        n = np.diff(bound)[group]
        ids = sym[expand(bound[:-1][group], n)].astype("<u4")
        at = np.r_[0, np.cumsum(n)][np.searchsorted(starts, ends)]
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; begin, end and other control ids have none."""
        ids = np.asarray(ids, np.int64)
        raw = b"".join([b"".join(map(self.bytes_of.__getitem__, ids[a : a + IDS].tolist())) for a in range(0, len(ids), IDS)])
        first = next((i for i in ids[:8].tolist() if self.bytes_of[i]), None)
        if self.prefix and first not in (None, self.unk) and not self.is_byte[first] and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._mend(raw)

    @staticmethod
    def _mend(raw: bytes) -> str:
        """Each byte that belongs to no whole character becomes U+FFFD."""
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, then ids (binary: little-endian unsigned 32-bit, with begin and end), n_tokens and decoded.

    A null text counts as empty: begin and end only. Rows are neither dropped nor
    merged, whatever their id. Very long texts are encoded part by part. Other columns
    of docs, whatever their names, are left out. The model, a table of fixed size, is
    read by the driver and broadcast.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", ids binary, n_tokens long, decoded string"

    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = list(model.encode_all(x.as_py() for x in batch.column(batch.num_columns - 1)))
            back = [model.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.string())],
                names=[*batch.schema.names[:-1], "ids", "n_tokens", "decoded"],
            )

    return kept.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of a binary column of little-endian unsigned 32-bit ids; null ids give a null text."""

    shared = rows.sparkSession.sparkContext.broadcast(load_model(model_path))

    @F.pandas_udf("string")
    def decoded(column):
        model = shared.value
        return column.map(lambda x: None if x is None else model.decode(np.frombuffer(x, "<u4")))

    return rows.withColumn(into, decoded(F.col(ids)))


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(encoded: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded with begin and end ids, then decoded."""
    return digest(encode_documents(table(spark, sf_dir, "documents"), model_file()))
