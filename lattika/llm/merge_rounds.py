"""Byte-pair merges over flat arrays, shared by the tokenizer operators."""

from __future__ import annotations

import numpy as np

from lattika.llm.common import mix64, powers

NONE = np.int32(2**31 - 1)
#: Words that a memo keeps, and the code points of the longest.
MEMO_WORDS, MEMO_LONGEST = 200_000, 64


class HashTable:
    """Open addressing from unsigned 64-bit keys to positions, built once, read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.probes = np.uint64(64 - bits), 1
        self.keys = np.zeros(2**bits + 256, np.uint64)
        self.at = np.full(2**bits + 256, -1, np.int32)
        for i, (key, slot) in enumerate(zip(keys, self._slot(keys).tolist(), strict=True)):
            step = 0
            while self.at[slot + step] >= 0:
                step += 1
            self.probes = max(self.probes, step + 1)
            self.keys[slot + step], self.at[slot + step] = key, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key among those given at first, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        at = self.at[slot]
        out = np.where(self.keys[slot] == keys, at, -1)
        todo = np.flatnonzero((out < 0) & (at >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            slot_now = slot[todo] + step
            at = self.at[slot_now]
            same = (self.keys[slot_now] == keys[todo]) & (at >= 0)
            out[todo[same]] = at[same]
            todo = todo[~same & (at >= 0)]
        return out


class MergeTable:
    """Merges (left, right) -> made by rank, over symbols below size; symbols from size on take part in none.

    wary: symbols that may, once made, form a pair of no higher rank. All others
    can be made at several places of a word at once: what comes of the first
    merge never takes precedence over the next.
    """

    def __init__(self, left, right, made, rank, size: int):
        left, right, self.made, self.rank = (np.array(x, np.int32) for x in (left, right, made, rank))
        self.size = size
        self.table = HashTable(left.astype(np.uint64) * np.uint64(size) + right.astype(np.uint64))
        born = np.full(size, -1, np.int64)  # the highest rank that makes a symbol
        np.maximum.at(born, self.made, self.rank)
        self.wary = np.zeros(size, bool)
        for side in (left, right):
            self.wary[side[born[side] >= self.rank]] = True

    def run(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of words seg (ascending), until no pair is left: symbols and their words."""
        done_sym, done_seg = [sym[:0]], [seg[:0]]
        rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        todo = np.arange(len(sym))
        while len(sym):
            # only pairs beside the last merges are new
            todo = todo[todo < len(sym) - 1]
            a, b = sym[todo], sym[todo + 1]
            found = np.full(len(todo), -1, np.int32)
            ok = np.flatnonzero((seg[todo] == seg[todo + 1]) & (a < self.size) & (b < self.size))
            found[ok] = self.table.find(a[ok].astype(np.uint64) * np.uint64(self.size) + b[ok].astype(np.uint64))
            rank[todo], made[todo] = np.where(found < 0, NONE, self.rank[found]), self.made[found]
            rank[-1] = NONE
            first = np.r_[0, np.flatnonzero(seg[1:] != seg[:-1]) + 1]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            where = np.flatnonzero((rank == least) & (least < NONE))
            if len(where):
                # of pairs that overlap, every second one from the left
                runs = np.r_[True, np.diff(where) != 1]
                start = where[np.flatnonzero(runs)][np.cumsum(runs) - 1]
                where = where[(where - start) % 2 == 0]
                where = where[~self.wary[made[where]] | np.r_[True, seg[where][1:] != seg[where][:-1]]]
            sym[where] = made[where]
            keep = least < NONE
            done_sym.append(sym[~keep]), done_seg.append(seg[~keep])
            fresh = np.zeros(len(sym), bool)
            fresh[where] = True
            fresh[where[where > 0] - 1] = True
            fresh[where[where > 1] - 2] = True  # where - 1 may be the second half of a merge
            keep[where + 1] = False
            sym, seg, rank, made, todo = sym[keep], seg[keep], rank[keep], made[keep], np.flatnonzero(fresh[keep])
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of the ranges, one range after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


class WordHasher:
    """Hashes of words of code points."""

    def __init__(self):
        self.noise = mix64(np.arange(1, 0x110001, dtype=np.uint64))

    def __reduce__(self):
        return WordHasher, ()

    def __call__(self, points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        power, back = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.noise[points] * power[: len(points)], out=sums[1:])
        return (sums[starts + lens] - sums[starts]) * back[starts]


def same_words(points: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal words, and the group of each word. Words of equal hash are compared in full."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    rep = first[group]
    odd = np.flatnonzero(rep != np.arange(len(starts)))
    if (lens[rep] != lens).any() or (points[expand(starts[odd], lens[odd])] != points[expand(starts[rep[odd]], lens[odd])]).any():
        words = [points[a : a + n].tobytes() for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]
        index = {w: k for k, w in reversed(list(enumerate(words)))}
        first, group = np.unique([index[w] for w in words], return_inverse=True)
    return first, group


class WordMemo:
    """Merged words of earlier slices, up to MEMO_WORDS of them; found by hash and compared in full."""

    def __init__(self):
        self.clear()

    def __reduce__(self):
        return WordMemo, ()

    def clear(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.points, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, hashes: np.ndarray, points: np.ndarray, lens: np.ndarray, merge) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and n + 1 offsets. points: their code points in a row. merge: ids and words of those not known."""
        starts = np.cumsum(lens) - lens
        known = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            maybe = np.flatnonzero(self.hashes[at] == hashes)
            word = self.order[at[maybe]]
            same = self.ends[word + 1] - self.ends[word] == lens[maybe]
            maybe, word = maybe[same], word[same]
            differs = points[expand(starts[maybe], lens[maybe])] != self.points[expand(self.ends[word], lens[maybe])]
            right = np.bincount(np.repeat(np.arange(len(maybe)), lens[maybe])[differs], minlength=len(maybe)) == 0
            known[maybe[right]] = word[right]
        todo = np.flatnonzero(known < 0)
        sym, seg = merge(todo) if len(todo) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        bound = np.searchsorted(seg, np.arange(len(todo) + 1))
        n = np.zeros(len(hashes), np.int64)
        n[todo] = np.diff(bound)
        old = np.flatnonzero(known >= 0)
        n[old] = self.bounds[known[old] + 1] - self.bounds[known[old]]
        total = np.r_[0, np.cumsum(n)]
        ids = np.zeros(total[-1], np.int32)
        ids[expand(total[todo], n[todo])] = sym
        ids[expand(total[old], n[old])] = self.ids[expand(self.bounds[known[old]], n[old])]
        if len(self.hashes) + len(todo) > MEMO_WORDS:
            self.clear()
        keep = todo[lens[todo] <= MEMO_LONGEST][:MEMO_WORDS]
        if len(keep):
            every = np.concatenate([self.hashes[np.argsort(self.order)], hashes[keep]])
            self.order = np.argsort(every, kind="stable")
            self.hashes = every[self.order]
            self.points = np.concatenate([self.points, points[expand(starts[keep], lens[keep])]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens[keep])])
            self.ids = np.concatenate([self.ids, ids[expand(total[keep], n[keep])]])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n[keep])])
        return ids, total


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and n + 1 offsets."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends
