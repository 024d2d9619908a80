"""Windows of symbols that occur in several documents: where they can be, and bookkeeping.

Shared by the two operators that remove repeated passages; what decides whether
windows are equal is theirs. Distinct texts are put together in packs. In each
window of `window` symbols the k-gram of least hash is its anchor; two equal windows
have the same anchor at the same place. First only hashes of anchors are compared:
an anchor of a single document, as most are, needs no more. Then the passages
(windows in a row that share such an anchor) go to the task of the anchor's hash,
equal passages of a pack only once. A resolver finds there, for each window of each
passage, the smallest document that holds it; the answers go back to the packs,
where each document marks what it has to drop.

Anchors of very many packs are split: their windows are dealt by all symbols that
windows at nearby distances from the anchor have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import drop_tables, durable_table, mix64, powers, release, small_batches
from lattika.llm.merge_rounds import expand

#: Bytes of text in a pack, symbols that are looked at together, and bytes (of hashes, of passages) that one task should get.
PACK_BYTES, SEGMENT, TASK_BYTES = 2_000_000, 1_000_000, 8_000_000
#: An anchor of more packs is split.
HOT = 64
LOW = np.uint64(2**32 - 1)
FAR_DOC = np.int64(2**63 - 1)
ALONE, SHARED, SPLIT = 0, 1, 2


@dataclass(frozen=True)
class Shape:
    """window: symbols that must agree. gram: symbols of an anchor. symbol: numpy type of a symbol. near: distances from a split anchor that are dealt together."""

    window: int
    gram: int
    symbol: str
    near: int

    @property
    def side(self) -> int:
        return self.window - self.gram

    @property
    def starts(self) -> int:
        """Places that an anchor can have in a window."""
        return self.side + 1


#: (shape, symbols, n + 1 offsets of distinct passages, smallest document of each, hash that dealt each) -> smallest document of each window,
#: passage by passage. Passages that share a window were dealt by the same hash.
Resolver = Callable[[Shape, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k symbols in a row."""
    n = len(symbols)
    power, back = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    noise = mix64(np.arange(1, 257, dtype=np.uint64))[symbols] if symbols.dtype == np.uint8 else mix64(symbols)
    noise *= power[:n]
    np.cumsum(noise, out=sums[1:])
    grams = sums[k:] - sums[:-k]
    grams *= back[: len(grams)]
    return mix64(grams)


@dataclass
class Runs:
    """Windows in a row that share their anchor: first and stop (window starts), place and hash of the anchor."""

    first: np.ndarray
    stop: np.ndarray
    place: np.ndarray
    hash: np.ndarray


def anchored_runs(shape: Shape, symbols: np.ndarray, ends: np.ndarray) -> Runs:
    """All windows that lie in one document, SEGMENT symbols at a time. ends: n + 1 offsets of the documents."""
    parts = []
    for a in range(0, len(symbols) - shape.window + 1, SEGMENT):
        part = symbols[a : a + SEGMENT + shape.window - 1]
        grams = gram_hashes(part, shape.gram)
        # the least hash, of equals the one in front
        least = slide_min((grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), shape.starts)
        at = (least & LOW).astype(np.int64)
        edge = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(part))] - a
        change = np.zeros(len(at) + 1, np.int32)
        np.add.at(change, np.clip(edge - shape.window + 1, 0, len(at)), 1)
        np.add.at(change, np.clip(edge, 0, len(at)), -1)
        start = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1)])
        first = start[new]
        parts.append((first + a, start[np.r_[new[1:] - 1, len(start) - 1]] + 1 + a, at[first] + a, grams[at[first]]))
    if not parts:
        return Runs(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    return Runs(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def hash_groups(runs: Runs, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by task and value, their tasks, and the number of each run's hash among them."""
    every, group = np.unique(runs.hash, return_inverse=True)
    task = ((every & LOW) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return every[order], task[order], rank[group]


def same_ranges(symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and group of equal ranges of symbols; those of equal hash are compared in full."""
    hashes = size.astype(np.uint64)
    noise = mix64(np.arange(1, 257, dtype=np.uint64)) if symbols.dtype == np.uint8 else None
    for k in range(int(size.max(initial=0))):
        some = symbols[np.minimum(start + k, len(symbols) - 1)]
        some = np.where(size > k, noise[some] if noise is not None else some, np.uint64(0))
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + some
    _, first, group = np.unique(mix64(hashes), return_index=True, return_inverse=True)
    like = first[group]
    odd = np.flatnonzero(like != np.arange(len(start)))
    if (size[like] != size).any() or (symbols[expand(start[odd], size[odd])] != symbols[expand(start[like[odd]], size[odd])]).any():
        names: dict[bytes, int] = {}
        like = np.array([names.setdefault(symbols[a : a + n].tobytes(), k) for k, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))], np.int64)
        first, group = np.unique(like, return_inverse=True)
    return first, group


@dataclass
class Passages:
    """Passages of a pack: window starts (first, stop), document, hash that deals them; which are distinct (numbers of the first of each) and the group of each."""

    first: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    deal: np.ndarray
    distinct: np.ndarray
    group: np.ndarray


def passages(shape: Shape, symbols: np.ndarray, ends: np.ndarray, runs: Runs, kind: np.ndarray) -> Passages:
    """kind: ALONE, SHARED or SPLIT for each run."""
    one = kind == SHARED
    first, stop, deal = [runs.first[one]], [runs.stop[one]], [runs.hash[one]]
    if (hot := kind == SPLIT).any():
        base, a, b = runs.place[hot] - shape.side, runs.first[hot], runs.stop[hot]
        low, n = (a - base) // shape.near, (b - 1 - base) // shape.near - (a - base) // shape.near + 1
        run = np.repeat(np.arange(len(n)), n)
        part = expand(low, n)
        from_ = base[run] + part * shape.near
        # what all windows at these distances from the anchor have in common
        common = mix64(part.astype(np.uint64) + np.uint64(1))
        for k in range(shape.near - 1, shape.window):
            common = mix64(common * np.uint64(0x9E3779B97F4A7C15) + symbols[from_ + k].astype(np.uint64))
        first.append(np.maximum(a[run], from_)), stop.append(np.minimum(b[run], from_ + shape.near)), deal.append(common)
    first, stop, deal = np.concatenate(first), np.concatenate(stop), np.concatenate(deal)
    distinct, group = same_ranges(symbols, first, stop - first + shape.window - 1)
    return Passages(first, stop, np.searchsorted(ends, first, side="right") - 1, deal, distinct, group)


# -- packs ----------------------------------------------------------------------------------------------------------------


def make_packs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """pack, firsts (int64), ends (int64), data: the distinct non-null texts with the smallest doc_id of each, in packs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("first"), F.col(f"`{text}`").cast("string").alias("text")).filter("first is not null and text is not null")
    distinct = rows.groupBy("text").agg(F.min("first").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        firsts, texts, room = [], [], PACK_BYTES

        def out():
            nonlocal firsts, texts, room, count
            ends = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in texts], out=ends[1:])
            row = pa.RecordBatch.from_pydict({"pack": pa.array([(part << 24) + count], pa.int64()), "firsts": pa.array([np.array(firsts, np.int64).tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()), "data": pa.array([b"".join(texts)], pa.binary())})
            firsts, texts, room, count = [], [], PACK_BYTES, count + 1
            return row

        for batch in batches:
            for t, d in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and room < len(t):
                    yield out()
                firsts.append(d), texts.append(t)
                room -= len(t)
        if texts:
            yield out()

    return durable_table(distinct.mapInArrow(run, "pack long, firsts binary, ends binary, data binary"), compression="zstd")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["firsts"], np.int64), np.frombuffer(row["ends"], np.int64), np.frombuffer(row["data"], np.uint8)


# -- hashes and passages out, answers back ----------------------------------------------------------------------------------

HEAD = np.dtype([("number", "<i4"), ("size", "<u2"), ("more", "u1"), ("doc", "<i8"), ("deal", "<u8")])
ANSWER = np.dtype([("number", "<i4"), ("a", "<u2"), ("b", "<u2"), ("doc", "<i8")])


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def split_by(key: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal values in a row."""
    cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)].tolist() if len(key) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def least_and_most(doc: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, FAR_DOC), np.full(n, -FAR_DOC)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    return low, high


def send_hashes(shape: Shape, to_symbols, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_row(batches):
            firsts, ends, data = unpack(pack)
            symbols, ends = to_symbols(data, ends)
            runs = anchored_runs(shape, symbols, ends)
            hashes, task, group = hash_groups(runs, tasks)
            low, high = least_and_most(firsts[np.searchsorted(ends, runs.first, side="right") - 1], group, len(hashes))
            more, parts = (high > low).astype(np.uint8), split_by(task)
            if parts:
                yield pa.RecordBatch.from_pydict({"task": pa.array([task[a] for a, _ in parts], pa.int32()), "pack": pa.array([pack["pack"]] * len(parts), pa.int64()), "hashes": pa.array([hashes[a:b].tobytes() for a, b in parts], pa.binary()), "more": pa.array([more[a:b].tobytes() for a, b in parts], pa.binary())})

    return run


def judge_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack what its hashes are: ALONE (of one document), SHARED, or SPLIT (of more than HOT packs)."""
    rows = [(row["task"], row["pack"], np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["more"], np.uint8)) for row in each_row(batches)]
    if not rows:
        return
    every, group = np.unique(np.concatenate([x[2] for x in rows]), return_inverse=True)
    packs = np.bincount(group)
    more = np.bincount(group, np.concatenate([x[3] for x in rows])) > 0
    kind = np.where(packs > HOT, SPLIT, np.where((packs > 1) | more, SHARED, ALONE)).astype(np.uint8)[group]
    at = 0
    for task, pack, hashes, _ in rows:
        own = kind[at : at + len(hashes)]
        at += len(hashes)
        yield pa.RecordBatch.from_pydict({"pack": pa.array([pack], pa.int64()), "task": pa.array([task], pa.int32()), "kinds": pa.array([own.tobytes()], pa.binary()), "shared": pa.array([int((own > 0).sum())], pa.int64())})


def passages_of(shape: Shape, to_symbols, row: dict, hash_tasks: int) -> tuple:
    """Documents, symbols and passages of a pack that knows what its hashes are."""
    firsts, ends, data = unpack(row)
    symbols, at = to_symbols(data, ends)
    runs = anchored_runs(shape, symbols, at)
    _, _, group = hash_groups(runs, hash_tasks)
    kinds = np.frombuffer(b"".join(x["kinds"] for x in sorted(row["kinds"] or (), key=lambda x: x["task"])), np.uint8)
    return firsts, ends, data, symbols, at, passages(shape, symbols, at, runs, kinds[group] if len(group) else np.zeros(0, np.uint8))


def send_passages(shape: Shape, to_symbols, hash_tasks: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_row(batches):
            firsts, _, _, symbols, _, found = passages_of(shape, to_symbols, pack, hash_tasks)
            if not len(found.first):
                continue
            one = found.distinct
            head = np.empty(len(one), HEAD)
            low, high = least_and_most(firsts[found.owner], found.group, len(one))
            size = found.stop[one] - found.first[one] + shape.window - 1
            head["number"], head["size"], head["doc"], head["more"], head["deal"] = np.arange(len(one)), size, low, high > low, found.deal[one]
            task = ((found.deal[one] >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            task, head, one, size = task[order], head[order], one[order], size[order]
            flat, parts = symbols[expand(found.first[one], size)], split_by(task)
            at = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_pydict({
                "task": pa.array([task[a] for a, _ in parts], pa.int32()),
                "pack": pa.array([pack["pack"]] * len(parts), pa.int64()),
                "head": pa.array([head[a:b].tobytes() for a, b in parts], pa.binary()),
                "symbols": pa.array([flat[at[a] : at[b]].tobytes() for a, b in parts], pa.binary()),
            })

    return run


def answer_task(shape: Shape, resolver: Resolver):
    """Of all passages of a task: the smallest document of each window, as runs of window starts, to the packs that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, heads, parts = [], [], []
        for row in each_row(batches):
            heads.append(np.frombuffer(row["head"], HEAD)), parts.append(np.frombuffer(row["symbols"], shape.symbol)), packs.append(np.full(len(heads[-1]), row["pack"]))
        if not heads:
            return
        pack, head, symbols = np.concatenate(packs), np.concatenate(heads), np.concatenate(parts)
        del packs, heads, parts
        size = head["size"].astype(np.int64)
        start = np.cumsum(size) - size
        first, group = same_ranges(symbols, start, size)
        least, _ = least_and_most(head["doc"], group, len(first))
        flat = symbols[expand(start[first], size[first])]
        del symbols
        offsets = np.r_[0, np.cumsum(size[first])]
        docs = resolver(shape, flat, offsets, least, head["deal"][first])
        # runs of windows with the same document
        n = size[first] - shape.window + 1
        begin = np.r_[0, np.cumsum(n)]
        new = np.ones(len(docs), bool)
        new[1:] = docs[1:] != docs[:-1]
        new[begin[:-1]] = True
        a = np.flatnonzero(new)
        b = np.r_[a[1:], len(docs)]
        runs = np.searchsorted(a, begin)
        passage = np.repeat(np.arange(len(first)), np.diff(runs))
        a, b, doc = a - begin[passage], b - begin[passage], docs[a]
        # to each pack that has the passage, unless it holds the smallest document and no other
        n = np.diff(runs)[group]
        at, row = expand(runs[:-1][group], n), np.repeat(np.arange(len(group)), n)
        need = (doc[at] < head["doc"][row]) | (head["more"][row] > 0)
        at, row = at[need], row[need]
        answer = np.empty(len(at), ANSWER)
        answer["number"], answer["a"], answer["b"], answer["doc"] = head["number"][row], a[at], b[at], doc[at]
        order = np.argsort(pack[row], kind="stable")
        answer, to = answer[order], pack[row][order]
        if cuts := split_by(to):
            yield pa.RecordBatch.from_pydict({"pack": pa.array([to[x] for x, _ in cuts], pa.int64()), "answer": pa.array([answer[x:y].tobytes() for x, y in cuts], pa.binary())})

    return run


def covered(shape: Shape, n: int, firsts: np.ndarray, found: Passages, answers: list[bytes]) -> np.ndarray:
    """Which of the n symbols of a pack lie in a window that a smaller document has too."""
    change = np.zeros(n + 1, np.int32)
    if answers:
        answer = np.concatenate([np.frombuffer(x, ANSWER) for x in answers])
        order = np.argsort(found.group, kind="stable")
        begin = np.searchsorted(found.group[order], np.arange(len(found.distinct) + 1))
        count = np.diff(begin)[answer["number"]]
        at, row = order[expand(begin[:-1][answer["number"]], count)], np.repeat(np.arange(len(answer)), count)
        hit = answer["doc"][row] < firsts[found.owner[at]]
        at, row = at[hit], row[hit]
        np.add.at(change, found.first[at] + answer["a"][row], 1)
        np.add.at(change, found.first[at] + answer["b"][row] - 1 + shape.window, -1)
    return np.cumsum(change[:-1]) > 0


def text_keys(ends: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def find_repeats(docs: DataFrame, shape: Shape, to_symbols, resolver: Resolver, finish, schema: str, doc_id: str, text: str) -> DataFrame:
    """One row for each distinct text: first (its smallest doc_id), key (sha256 of the text) and what finish makes of the covered symbols."""
    spark = docs.sparkSession
    packs = make_packs(docs, doc_id, text)
    release(spark)
    size = packs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # hashes take about half of the text
    hash_tasks = max(8, int(size / 2 / TASK_BYTES))
    sent = packs.mapInArrow(send_hashes(shape, to_symbols, hash_tasks), "task int, pack long, hashes binary, more binary")
    judged = durable_table(sent.repartitionById(hash_tasks, F.col("task")).mapInArrow(judge_hashes, "pack long, task int, kinds binary, shared long"))
    del sent
    release(spark)
    # a hash of a pack stands for one passage, seldom more, of the window and some further symbols
    passage_bytes = np.dtype(shape.symbol).itemsize * (shape.window + shape.starts / 2)
    tasks = max(8, int((judged.agg(F.sum("shared")).first()[0] or 0) * passage_bytes / TASK_BYTES))
    kinds = judged.groupBy("pack").agg(F.collect_list(F.struct("task", "kinds")).alias("kinds"))
    known = packs.join(kinds, "pack", "left")
    sent = known.mapInArrow(send_passages(shape, to_symbols, hash_tasks, tasks), "task int, pack long, head binary, symbols binary")
    answers = durable_table(sent.repartitionById(tasks, F.col("task")).mapInArrow(answer_task(shape, resolver), "pack long, answer binary"))
    del sent, known
    release(spark)
    joined = packs.join(kinds, "pack", "left").join(answers.groupBy("pack").agg(F.collect_list("answer").alias("answers")), "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            firsts, ends, data, symbols, at, passage = passages_of(shape, to_symbols, row, hash_tasks)
            columns = finish(data, ends, at, covered(shape, len(symbols), firsts, passage, row["answers"] or []))
            yield pa.RecordBatch.from_pydict({"first": pa.array(firsts), "key": pa.array(text_keys(ends, data), pa.binary())} | columns)

    found = durable_table(joined.mapInArrow(run, f"first long, key binary, {schema}"))
    drop_tables(packs, judged, answers)
    release(spark)
    return found
