"""Embedding near-dedup with hierarchical navigable small-world graphs.

Equal vectors of a label are one node. The nodes of a label are dealt into shards
of bounded size, each with a graph of its own. Every shard is searched with the
nodes of all shards of its label: a beam search through the layers, then along
the links found until no linked node is new; two shards are searched both ways.
A shard stays in its task while the others pass by. In each search queries are
checked against all nodes of the shard until enough of them have links, or all are
checked and no search is needed; a query's hit on itself is no link. While too few
of the links of a query are found, the beam is widened, at last to the whole shard.
Links are verified in double precision and held as one bit for each pair of nodes
of two shards, which bounds memory whatever their number; they are counted and
united to components block by block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import durable, durable_table, mix64, small_batches, table
from lattika.llm.components import components

SIMILAR = 0.98
#: Nodes of a shard at most (about), neighbours kept in the upper layers (twice as many in the lowest), and the first beam.
SHARD, NEIGHBOURS, BEAM = 20_000, 16, 48
#: Queries searched in step; queries with links audited in each search, of those with more links than the beam holds and of the others each; and the share of their links that must be found, on average over queries.
STEP, AUDITED, RECALL = 256, 64, 0.99
#: Single-precision similarities this near to the threshold are looked at in double precision, so many pairs at a time.
SLACK, PAIRS = 1e-4, 100_000
#: Frontier nodes that a search expands at a time, and the share of a shard that a query has to be linked to for a search of all nodes to be the cheaper way.
FRONTIER, DENSE = 100_000, 1 / 64


class Graph:
    """vectors: rows of unit length. layers[l][i]: neighbours of node i in layer l, padded with -1."""

    def __init__(self, vectors: np.ndarray, seed: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        u = ((mix64(seed.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        self.level = np.minimum((-np.log(u) / np.log(NEIGHBOURS)).astype(np.int64), 8)
        self.layers = [np.full((n, 2 * NEIGHBOURS if l == 0 else NEIGHBOURS), -1, np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            # a batch is searched in the graph of those before it, and compared within itself
            batch = order[done : done + min(STEP, done)]
            self._insert(batch)
            done += len(batch)
        if n > 1:
            self._mend()

    def _insert(self, batch: np.ndarray) -> None:
        queries = self.vectors[batch]
        start = np.full(len(batch), self.entry)
        for l in range(len(self.layers) - 1, -1, -1):
            inside = self.level[batch] >= l
            width = BEAM if inside.any() else 1
            ids, sims = self._beam(queries, start[:, None], l, width)
            start = ids[:, 0]
            if not inside.any():
                continue
            own = batch[inside]
            near, close = ids[inside], sims[inside]
            among = queries[inside] @ queries[inside].T
            np.fill_diagonal(among, -2)
            near = np.concatenate([near, np.broadcast_to(own, (len(own), len(own)))], axis=1)
            close = np.concatenate([close, among], axis=1)
            top = np.argsort(-close, axis=1)[:, : 2 * BEAM]
            near, close = np.take_along_axis(near, top, 1), np.take_along_axis(close, top, 1)
            near = np.where(close > -1.5, near, -1)
            self.layers[l][own] = self._choose(near, close, self.layers[l].shape[1])
            self._link_back(own, l)

    def _choose(self, near: np.ndarray, close: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by closeness, those closer to the node than to any chosen before; then the closest of the rest."""
        out = np.full((len(near), most), -1, np.int32)
        for a in range(0, len(near), 128):
            ids, sims = near[a : a + 128], close[a : a + 128]
            some = int((ids >= 0).sum(axis=1).max(initial=1))
            ids, sims = ids[:, :some], sims[:, :some]
            vec = self.vectors.take(np.maximum(ids, 0), axis=0)
            pair = vec @ vec.transpose(0, 2, 1)
            picked = np.zeros(ids.shape, bool)
            rival, left = np.full(ids.shape, -2, np.float32), np.full(len(ids), most)
            for c in range(ids.shape[1]):
                take = np.flatnonzero((ids[:, c] >= 0) & (sims[:, c] > rival[:, c]) & (left > 0))
                picked[take, c] = True
                rival[take] = np.maximum(rival[take], pair[take, c])
                left[take] -= 1
            rank = np.where(picked, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
            top = np.argsort(rank, axis=1)[:, :most]
            chosen = np.take_along_axis(ids, top, 1)
            out[a : a + 128, : chosen.shape[1]] = chosen
        return out

    def _link_back(self, own: np.ndarray, l: int) -> None:
        links = self.layers[l]
        to = links[own].ravel()
        frm = np.repeat(own, links.shape[1])
        real = to >= 0
        to, frm = to[real], frm[real]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, begin, n = np.unique(to, return_index=True, return_counts=True)
        wide = min(int(n.max(initial=0)), STEP)
        new = np.full((len(nodes), wide), -1, np.int64)
        at = np.arange(len(to)) - np.repeat(begin, n)
        fits = at < wide
        new[np.repeat(np.arange(len(nodes)), n)[fits], at[fits]] = frm[fits]
        # those with as many new links together: tables of candidates are as wide as their widest row
        by = np.argsort(n, kind="stable")
        for a in range(0, len(nodes), STEP):
            part = nodes[by[a : a + STEP]]
            every = np.concatenate([links[part], new[by[a : a + STEP], : n[by[a : a + STEP]].max()]], axis=1)
            every = np.sort(every, axis=1)[:, ::-1]
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            sims = np.where(every >= 0, np.einsum("bid,bd->bi", self.vectors.take(np.maximum(every, 0), axis=0), self.vectors[part]), -2)
            top = np.argsort(-sims, axis=1)[:, : 2 * BEAM]
            every, sims = np.take_along_axis(every, top, 1), np.take_along_axis(sims, top, 1)
            links[part] = self._choose(every, sims, links.shape[1])

    def _mend(self) -> None:
        """Links that thinning has cut come back in more columns of layer 0: to each node from its nearest neighbour, and to nodes that no path leads to.

        A node takes the nearest of its neighbours that has room.
        """
        links, n = self.layers[0], len(self.vectors)
        extra, used = np.full((n, NEIGHBOURS), -1, np.int32), np.zeros(n, np.int64)
        todo, free = np.flatnonzero((links[:, 0] >= 0) & ~(links[links[:, 0]] == np.arange(n)[:, None]).any(axis=1)), np.ones(n, bool)
        while len(todo):
            near = links[todo]
            for a in range(0, len(todo), STEP):
                part = near[a : a + STEP]
                sims = np.where(part >= 0, np.einsum("bid,bd->bi", self.vectors[np.maximum(part, 0)], self.vectors[todo[a : a + STEP]]), -2)
                near[a : a + STEP] = np.take_along_axis(part, np.argsort(-sims, axis=1), 1)
            row = np.arange(len(todo))
            for c in range(near.shape[1]):
                row = row[np.argsort(near[row, c], kind="stable")]
                row = row[~(free[near[row, c]] & (links[near[row, c]] == todo[row][:, None]).any(axis=1))]
                rest, to = todo[row], near[row, c]
                at = used[to] + np.arange(len(to)) - np.searchsorted(to, to)
                fits = (to >= 0) & free[to] & (at < extra.shape[1])
                extra[to[fits], at[fits]] = rest[fits]
                used += np.bincount(to[fits], minlength=n)
                row = row[~fits]
            if len(row) == len(todo):
                # no neighbour is reached or has room: a link from the entry leads to the first of them
                extra = np.concatenate([extra, np.full((n, NEIGHBOURS), -1, np.int32)], axis=1)
                extra[self.entry, used[self.entry]] = todo[0]
                used[self.entry] += 1
            self.layers[0] = np.concatenate([links, extra[:, : used.max()]], axis=1)
            free = self._reached()
            todo = np.flatnonzero(~free)

    def _reached(self) -> np.ndarray:
        """Which nodes a path in layer 0 leads to from the entry."""
        seen = np.arange(len(self.vectors)) == self.entry
        new = np.array([self.entry])
        while len(new):
            near = np.unique(self.layers[0][new])
            new = near[near >= 0]
            new = new[~seen[new]]
            seen[new] = True
        return seen

    def _beam(self, queries: np.ndarray, start: np.ndarray, l: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The width best nodes that a beam finds in a layer for each query, best first; -1 with similarity -2 where there are fewer."""
        q = len(queries)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -2, np.float32)
        ids[:, : start.shape[1]] = start[:, :width]
        sims[:, : start.shape[1]] = np.where(start[:, :width] >= 0, np.einsum("bid,bd->bi", self.vectors[np.maximum(start[:, :width], 0)], queries), -2)
        seen = np.zeros(q * len(self.vectors), bool)
        rows, cols = np.nonzero(ids >= 0)
        seen[rows * len(self.vectors) + ids[rows, cols]] = True
        spent = ids < 0
        links = self.layers[l]
        while True:
            free = np.where(spent, -3, sims)
            best = free.argmax(axis=1)
            live = np.flatnonzero(free[np.arange(q), best] > -2)
            if not len(live):
                break
            at = ids[live, best[live]]
            spent[live, best[live]] = True
            near = links.take(at, axis=0).ravel()
            new = np.flatnonzero(near >= 0)
            r, near = new // links.shape[1], near.take(new).astype(np.int64)
            key = live.take(r) * len(self.vectors) + near
            new = np.flatnonzero(~seen.take(key))
            r, near = r.take(new), near.take(new)
            seen[key.take(new)] = True
            close = np.einsum("id,id->i", self.vectors.take(near, axis=0), queries.take(live.take(r), axis=0))
            # neighbours that lie in no lower beam place are left out
            new = np.flatnonzero(close > sims[live].min(axis=1).take(r))
            r, near, close = r.take(new), near.take(new), close.take(new)
            if not len(r):
                continue
            n = np.bincount(r, minlength=len(live))
            some = np.flatnonzero(n)
            n = n[some]
            row, col = np.repeat(np.arange(len(some)), n), np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            some = live[some]
            all_ids, all_sims, all_spent = (np.concatenate([x[some], np.full((len(some), n.max()), y, x.dtype)], axis=1) for x, y in ((ids, -1), (sims, -2), (spent, True)))
            all_ids[row, width + col], all_sims[row, width + col], all_spent[row, width + col] = near, close, False
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[some], sims[some], spent[some] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_spent))
        top = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)

    def blocks(self, queries: np.ndarray, width: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs of similarity least or more, those of the beam and those along their links: for each STEP queries the number of the first and a table of queries and nodes."""
        n = len(self.vectors)
        width = min(width, n)
        for a in range(0, len(queries), STEP):
            part = queries[a : a + STEP]
            start = np.full((len(part), 1), self.entry)
            for l in range(len(self.layers) - 1, 0, -1):
                start = self._beam(part, start, l, 1)[0]
            ids, sims = self._beam(part, start, 0, width)
            q, c = np.nonzero((sims >= least) & (ids >= 0))
            node = ids[q, c]
            seen, hit = np.zeros((len(part), n), bool), np.zeros((len(part), n), bool)
            seen[q, node] = hit[q, node] = True
            todo = [(q, node)]
            while todo:
                q, node = todo.pop()
                if len(q) > FRONTIER:
                    todo += [(q[:FRONTIER], node[:FRONTIER]), (q[FRONTIER:], node[FRONTIER:])]
                    continue
                near = self.layers[0][node]
                q = np.repeat(q, near.shape[1])
                near = near.ravel()
                new = near >= 0
                q, near = q[new], near[new]
                new = ~seen[q, near]
                key = np.unique(q[new] * n + near[new])
                q, node = key // n, key % n
                seen[q, node] = True
                linked = np.concatenate([np.einsum("id,id->i", self.vectors[node[x : x + FRONTIER]], part[q[x : x + FRONTIER]]) for x in range(0, len(q), FRONTIER)] or [np.zeros(0)]) >= least
                q, node = q[linked], node[linked]
                hit[q, node] = True
                if len(q):
                    todo.append((q, node))
            yield a, hit


def exact_blocks(vectors: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    for a in range(0, len(queries), STEP):
        yield a, queries[a : a + STEP] @ vectors.T >= least


def audited_search(graph: Graph, queries: np.ndarray, same: bool = False) -> tuple[Iterator[tuple[int, np.ndarray]], dict]:
    """Tables of queries and nodes found, with the beam widened until enough links of the audited queries are found, and the audit.

    same: the queries are the nodes, and a node's pair with itself is no link. The
    audit has the beam's width, the recall on the audited queries that have links
    (their number is in it too), and whether the search was a full one.
    """
    least, n = SIMILAR - SLACK, len(graph.vectors)
    full = lambda seen: (exact_blocks(graph.vectors, queries, least), {"width": n, "recall": 1.0, "audited": seen, "exact": True})
    if BEAM >= n:
        return full(0)
    order = np.argsort(mix64(np.arange(len(queries), dtype=np.uint64)), kind="stable")
    links = np.zeros(len(queries), np.int64)
    done, more, few, hot = 0, AUDITED, order[:0], order[:0]
    while done < len(queries) and len(few) < AUDITED:
        part = order[done : done + more]
        for a, hit in exact_blocks(graph.vectors, queries[part], least):
            own = part[a : a + len(hit)]
            if same:
                hit[np.arange(len(own)), own] = False
            links[own] = hit.sum(axis=1)
        done += len(part)
        few, hot = (order[:done][x[order[:done]]] for x in ((links > 0) & (links <= BEAM), links > BEAM))
        more = done
    kinds = [x[:AUDITED] for x in (few, hot) if len(x)]
    seen = sum(map(len, kinds))
    if done == len(queries) or links[order[:done]].mean() > DENSE * n:
        return full(seen)
    chosen = np.concatenate(kinds)
    part = queries[chosen]
    want = np.concatenate([hit for _, hit in exact_blocks(graph.vectors, part, least)])
    if same:
        want[np.arange(len(chosen)), chosen] = False
    width = BEAM
    # a beam wide enough to look at as many nodes as there are costs more than the full search
    while width == BEAM or width * 2 * NEIGHBOURS < n:
        # the audit comes first: it costs little
        got = np.concatenate([hit for _, hit in graph.blocks(part, width, least)])
        share = (got & want).sum(axis=1) / want.sum(axis=1)
        recall = min(float(share[a : a + len(x)].mean()) for a, x in zip(np.cumsum([0, *map(len, kinds)]), kinds, strict=False))
        if recall >= RECALL:
            return graph.blocks(queries, width, least), {"width": width, "recall": recall, "audited": seen, "exact": False}
        width *= 2
    return full(seen)


class Links:
    """A bit for each pair of nodes of two shards (unit vectors a and b) that are linked."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.bits = np.zeros((len(a), -(-len(b) // 8)), np.uint8)

    def verified(self, row: int, hit: np.ndarray, back: bool) -> np.ndarray:
        """Of the pairs found for rows of a (back: of b) those whose cosine in double precision reaches the threshold."""
        left, right = (self.b, self.a) if back else (self.a, self.b)
        q, s = np.nonzero(hit)
        if len(q) > hit.size / 16:
            return hit & (left[row : row + len(hit)] @ right.T >= SIMILAR)
        out = np.zeros(hit.shape, bool)
        for x in range(0, len(q), PAIRS):
            i, j = q[x : x + PAIRS], s[x : x + PAIRS]
            real = np.einsum("id,id->i", left[i + row], right[j]) >= SIMILAR
            out[i[real], j[real]] = True
        return out

    def add(self, row: int, hit: np.ndarray) -> None:
        self.bits[row : row + len(hit)] |= np.packbits(self.verified(row, hit, False), axis=1)

    def add_back(self, row: int, hit: np.ndarray) -> None:
        """hit: rows from `row` of b against all of a. row is a multiple of eight, as STEP is."""
        packed = np.packbits(self.verified(row, hit, True).T, axis=1)
        self.bits[:, row // 8 : row // 8 + packed.shape[1]] |= packed

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for row in range(0, len(self.a), STEP):
            yield row, np.unpackbits(self.bits[row : row + STEP], axis=1, count=len(self.b)).astype(bool)


def local_roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """A representative of the component of each node, after links between a and b. root: the representatives before."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def build_shard(key: tuple, group: pa.Table) -> pa.Table:
    """One row for a shard: its nodes, copies, exact vectors and graph."""
    node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
    order = np.argsort(node)
    flat = group["vector"].combine_chunks()
    exact = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)[order]
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    blob = pickle.dumps((node[order], copies[order], unit, Graph(unit, node[order])), protocol=5)
    return pa.table({"label": group["label"].slice(0, 1), "dim": group["dim"].slice(0, 1), "shard": group["shard"].slice(0, 1), "blob": pa.array([blob], pa.binary())})


def search_pair(own: tuple, other: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Nodes with links, their number of linked vectors, a node of their component, and the audits. own, other: what build_shard has pickled; no other: own in itself."""
    node_a, copies_a, unit_a, graph_a = own
    same = other is None
    node_b, copies_b, unit_b, graph_b = own if same else other
    links = Links(unit_a, unit_b)
    found, audit = audited_search(graph_b, unit_a.astype(np.float32), same)
    audits = [audit]
    for row, hit in found:
        links.add(row, hit)
        if same:
            # a link counts for both ends, whichever search found it
            links.add_back(row, hit)
    if not same and not audit["exact"]:
        # a node that no beam reaches in its own graph still finds its links as a query
        found, audit = audited_search(graph_a, unit_b.astype(np.float32))
        audits.append(audit)
        for row, hit in found:
            links.add_back(row, hit)
    shift = 0 if same else len(node_a)
    n_a, n_b, root = np.zeros(len(node_a), np.int64), np.zeros(len(node_b), np.int64), np.arange(len(node_a) if same else len(node_a) + len(node_b))
    for row, hit in links.blocks():
        if same:
            hit[np.arange(len(hit)), np.arange(row, row + len(hit))] = False
        n_a[row : row + len(hit)] = hit @ copies_b
        n_b += copies_a[row : row + len(hit)] @ hit
        a, b = np.nonzero(hit)
        pair = np.unique(root[a + row] * len(root) + root[b + shift])
        root = local_roots(pair // len(root), pair % len(root), root)
    node, count = (node_a, n_a) if same else (np.r_[node_a, node_b], np.r_[n_a, n_b])
    some = count > 0
    return node[some], count[some], node[root[some]], audits


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, links (vectors linked in the other shard of the pair), root (a node of its component in these shards); and a row for each audit.

    Rows come by shard: first the shard that stays, then those that are searched along with it.
    """
    own = name = None
    for batch in batches:
        for k in range(batch.num_rows):
            key, blob = [batch.column(c)[k].as_py() for c in range(3)], pickle.loads(batch.column(4)[k].as_py())
            if key != name:
                own, name = blob, key
            node, links, root, audits = search_pair(own, None if own is blob else blob)
            n = len(audits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(links), pa.array(root), *[pa.nulls(len(node), t) for t in (pa.float64(), pa.int64(), pa.int64())]], schema=FOUND
            )
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 3, pa.array([x["recall"] for x in audits], pa.float64()), pa.array([x["audited"] for x in audits], pa.int64()), pa.array([x["width"] for x in audits], pa.int64())], schema=FOUND)


FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("recall", pa.float64()), ("audited", pa.int64()), ("width", pa.int64())])


def embedding_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Only vectors of equal, non-null label and equal length are compared. Vectors
    that are null, empty, all zero, or hold a null or non-finite component, and
    those without a label, link with nothing. Repeated rows are vectors of their
    own that link with each other; a null vec_id counts but names no component.
    Other columns are left out. Of the result, `audits` is a table with the recall
    measured in each search (recall, audited queries that have links, width of the beam).
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    distinct = rows.filter(sound).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = durable_table(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    shards = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    dealt = nodes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
    built = dealt.select("label", "dim", "shard", "node", "copies", "vector").groupBy("label", "dim", "shard").applyInArrow(build_shard, f"label {nodes.schema['label'].dataType.simpleString()}, dim int, shard long, blob binary")
    built = durable_table(built)
    # each pair of shards meets once, in the task of one of the two, by turns; a shard's own row comes first
    other = built.join(shards, ["label", "dim"]).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    lower, higher = F.least("shard", "at"), F.greatest("shard", "at")
    meets = F.when(F.pmod(lower + higher, F.lit(2)) == 1, lower).otherwise(higher)
    visits = other.filter((F.col("at") == F.col("shard")) | (meets == F.col("at"))).select("label", "dim", "at", (F.col("at") != F.col("shard")).alias("guest"), "blob")
    dealt = visits.repartition(max(8, built.count()), *[F.col(c) for c in ("label", "dim", "at")]).sortWithinPartitions("label", "dim", "at", "guest")
    found = durable(dealt.mapInArrow(search_shards, "node long, links long, root long, recall double, audited long, width long"))
    audits = found.filter("node is null").select("recall", "audited", "width")
    found = found.filter("node is not null").select("node", "links", "root")
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "first", "copies", "label", "vector").join(group, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select(F.col("label").alias("__label"), F.col("vector").alias("__vector"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = rows.withColumn("__ok", sound).join(named, F.col("__ok") & (F.col("label") == F.col("__label")) & (F.col("vector") == F.col("__vector")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = placed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    out.audits = audits
    return out


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of embeddings."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {SIMILAR}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
