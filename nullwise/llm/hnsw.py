"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors collapse to one class first, so a group of exact copies is one
node.  Classes are dealt over shards; each shard builds a graph (levels
drawn from a hash, neighbours chosen for diversity, points inserted in
batches).  Every class queries every shard: blocks of queries meet copies of
the shards' graphs in a cogrouped join.  A beam that fills up with matches
is widened, and each task audits a sample of its queries against brute
force over the shard and widens all beams until the recall asked for is
met.  Candidates are confirmed by cosine in double precision.  A task
returns the number of links of each query and a spanning forest of its
links, both linear in its input however large a group of near copies is;
components are united across tasks on Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored
from .graph import connected_components

MIN_COSINE = 0.95
#: Vectors in one shard's graph and queries in one block; least number of either.
SHARD, LEAST = 100_000, 4
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 48, 32
AUDITED, RECALL = 64, 0.99
#: Cells of the visited table (queries x nodes) that one search batch holds.
_CELLS = 32_000_000


class Graph:
    """Layers of one shard: per layer the nodes and a table of neighbours (-1: none); layer 0 holds all nodes."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        n = len(vectors)
        u = (mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed * 7919)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum((-np.log(u + 1e-18) / math.log(NEIGHBOURS)).astype(np.int64), 6)
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * NEIGHBOURS if k == 0 else NEIGHBOURS), -1, np.int32) for k in range(top + 1)]
        order = np.argsort(-self.level, kind="stable")  # the top layer first, so every search can start there
        self.entry = int(order[0]) if n else -1
        at = 0
        while at < n:
            step = min(n - at, max(1, min(at, 1024)))
            self._insert(order[at:at + step], first=at == 0)
            at += step

    def _insert(self, new: np.ndarray, first: bool) -> None:
        if first:
            return
        q = self.vectors[new]
        sims = q @ q.T
        np.fill_diagonal(sims, -2)
        start = np.full(len(new), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= layer
            # points above their level only descend
            start = self._descend(q, start, layer) if not here.any() else start
            if not here.any():
                continue
            ids, near = self._beam(q, start, layer, BUILD_BEAM)
            start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
            rows = np.flatnonzero(here)
            inner = sims[np.ix_(rows, rows)]
            k = min(BUILD_BEAM // 2, len(rows))
            nearest = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            cand = np.concatenate([ids[rows], new[rows][nearest]], axis=1)
            sim = np.concatenate([near[rows], np.take_along_axis(inner, nearest, 1)], axis=1)
            width = self.links[layer].shape[1]
            chosen = self._diverse(cand, sim, NEIGHBOURS)
            self.links[layer][new[rows], :chosen.shape[1]] = chosen
            self._back_links(new[rows], chosen, layer, width)

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
        """Up to width candidates of each row, each nearer to the row's point than to those chosen before it; then the nearest others."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, :3 * width]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        repeated = (cand[:, :, None] == cand[:, None, :]) & (np.arange(cand.shape[1])[:, None] > np.arange(cand.shape[1]))
        valid = (cand >= 0) & (sim > -1.5) & ~repeated.any(axis=2)
        out = np.full((len(cand), width), -1, np.int32)
        for a in range(0, len(cand), 512):
            c, s, ok = cand[a:a + 512], sim[a:a + 512], valid[a:a + 512]
            vec = self.vectors[np.maximum(c, 0)]
            between = vec @ vec.transpose(0, 2, 1)
            taken = np.zeros(c.shape, bool)
            count = np.zeros(len(c), np.int64)
            for j in range(c.shape[1]):
                crowded = (np.where(taken, between[:, j], -2).max(axis=1) > s[:, j])
                good = ok[:, j] & ~crowded & (count < width)
                taken[good, j] = True
                count += good
            rank = np.where(taken, 0, np.where(ok, 1, 2)) * 1000 + np.arange(c.shape[1])
            best = np.argsort(rank, axis=1)[:, :width]
            picked = np.where(np.take_along_axis(ok, best, 1), np.take_along_axis(c, best, 1), -1)
            out[a:a + 512, :picked.shape[1]] = picked
        return out

    def _back_links(self, new: np.ndarray, chosen: np.ndarray, layer: int, width: int) -> None:
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        touched, place = np.unique(target, return_inverse=True)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=len(touched))
        room = int(counts.max())
        more = np.full((len(touched), room), -1, np.int64)
        more[place[order], np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)] = source[order]
        cand = np.concatenate([self.links[layer][touched], more], axis=1)
        free = (cand >= 0).sum(axis=1) <= width
        for rows in (np.flatnonzero(free), np.flatnonzero(~free)):
            for a in range(0, len(rows), 256):
                r = rows[a:a + 256]
                c = cand[r]
                s = np.where(c >= 0, np.einsum("rcd,rd->rc", self.vectors[np.maximum(c, 0)], self.vectors[touched[r]]), -2)
                if free[r[0]]:
                    best = np.argsort(-s, axis=1, kind="stable")[:, :width]
                    kept = np.where(np.take_along_axis(s, best, 1) > -1.5, np.take_along_axis(c, best, 1), -1)
                else:
                    kept = self._diverse(c, s, width)
                self.links[layer][touched[r]] = -1
                self.links[layer][touched[r], :kept.shape[1]] = kept

    def _descend(self, q: np.ndarray, start: np.ndarray, layer: int) -> np.ndarray:
        at, best = start.copy(), np.einsum("qd,qd->q", q, self.vectors[start])
        active = np.arange(len(q))
        while len(active):
            near = self.links[layer][at[active]]
            sims = np.where(near >= 0, np.einsum("qcd,qd->qc", self.vectors[np.maximum(near, 0)], q[active]), -2)
            j = sims.argmax(axis=1)
            top = sims[np.arange(len(active)), j]
            better = top > best[active]
            moved = active[better]
            at[moved], best[moved] = near[better, j[better]], top[better]
            active = moved
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the width best nodes found for each query, best first (-1: none)."""
        n, d = self.vectors.shape
        batch = max(1, min(1024, _CELLS // max(1, n)))
        if len(q) > batch:
            parts = [self._beam(q[a:a + batch], start[a:a + batch], layer, width) for a in range(0, len(q), batch)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -2.0, np.float32)
        open_ = np.zeros((len(q), width), bool)
        ids[:, 0], open_[:, 0] = start, True
        sims[:, 0] = np.einsum("qd,qd->q", q, self.vectors[start])
        seen = np.zeros((len(q), n), bool)
        seen[np.arange(len(q)), start] = True
        active, several = np.arange(len(q)), 4
        table = self.links[layer]
        while len(active):
            ready = np.where(open_[active], sims[active], -3)
            pick = np.argsort(-ready, axis=1)[:, :several]
            usable = np.take_along_axis(ready, pick, 1) > -1.5
            rows = active[:, None]
            open_[rows, pick] = False
            near = np.where(usable[:, :, None], table[np.maximum(ids[rows, pick], 0)], -1).reshape(len(active), -1)
            known = (near < 0) | seen[rows, np.maximum(near, 0)]
            r, c = np.nonzero(~known)
            node = near[r, c]
            key = np.unique(r.astype(np.int64) * n + node)  # a node reached twice counts once
            r, node = key // n, key % n
            seen[active[r], node] = True
            value = np.einsum("ed,ed->e", self.vectors[node], q[active[r]])
            counts = np.bincount(r, minlength=len(active))
            if counts.max(initial=0):
                fresh = np.full((len(active), counts.max()), -2.0, np.float32)
                fresh_id = np.full(fresh.shape, -1, np.int64)
                column = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
                fresh[r, column], fresh_id[r, column] = value, node
                all_s = np.concatenate([sims[active], fresh], axis=1)
                all_i = np.concatenate([ids[active], fresh_id], axis=1)
                all_o = np.concatenate([open_[active], fresh > -1.5], axis=1)
                best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
                sims[active] = np.take_along_axis(all_s, best, 1)
                ids[active] = np.take_along_axis(all_i, best, 1)
                open_[active] = np.take_along_axis(all_o, best, 1)
            active = active[open_[active].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self._descend(q, start, layer)
        return self._beam(q, start, 0, min(width, len(self.vectors)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matches(graph: Graph, exact: np.ndarray, queries: np.ndarray, min_cosine: float = MIN_COSINE, recall: float = RECALL,
            audited: int = AUDITED, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with cosine >= min_cosine; exact and queries are unit rows in double precision.

    Beams double until an audit of evenly spaced queries against brute force
    reaches the recall; a beam whose last place still matches is doubled too.
    """
    n, near = len(exact), np.float32(min_cosine - 1e-3)
    q32 = queries.astype(np.float32)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audited, len(queries))).astype(int))
    truth = queries[sample] @ exact.T >= min_cosine
    while True:
        ids, sims = graph.search(q32[sample], width)
        hit = np.zeros(truth.shape, bool)
        r, c = np.nonzero((ids >= 0) & (sims >= near))
        hit[r, ids[r, c]] = True
        full = (ids[:, -1] >= 0) & (sims[:, -1] >= near)  # widened below for its own sake
        want = truth[~full].sum()
        if width >= n or (hit & truth)[~full].sum() >= recall * want:
            break
        width *= 2
    todo, out_q, out_n = np.arange(len(queries)), [], []
    while len(todo):
        ids, sims = graph.search(q32[todo], width)
        full = (ids[:, -1] >= 0) & (sims[:, -1] >= near) & (ids.shape[1] < n)
        r, c = np.nonzero((ids >= 0) & (sims >= near) & ~full[:, None])
        found_q, found_n = todo[r], ids[r, c]
        good = np.zeros(len(r), bool)
        for a in range(0, len(r), 200_000):
            good[a:a + 200_000] = np.einsum("ed,ed->e", queries[found_q[a:a + 200_000]], exact[found_n[a:a + 200_000]]) >= min_cosine
        out_q.append(found_q[good])
        out_n.append(found_n[good])
        todo, width = todo[full], width * 4
    return np.concatenate(out_q) if out_q else np.zeros(0, np.int64), np.concatenate(out_n) if out_n else np.zeros(0, np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links (a, b) connect, at most one per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            edges.append((x, y))
    return edges


def _rows_of(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).reshape(-1, d)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
                    shard: int = SHARD, least: int = LEAST, recall: float = RECALL) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    A vector that is null, empty, zero or holds a null or non-finite number
    links with nothing, and neither does a row without an id (component_id
    null, kept true); vectors of different lengths never link.  Repeated
    rows count as other vectors with the same id; an empty table gives an
    empty table; other columns are neither read nor returned.
    """
    numbers = F.col("v")
    usable = (F.col("id").isNotNull() & numbers.isNotNull() & (F.size(numbers) > 0)
              & F.coalesce(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
              & F.coalesce(F.exists(numbers, lambda x: x != 0), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(rows.withColumn("print", F.when(usable, F.sha2(F.to_json("v").cast("binary"), 256))), "vectors")
    classes = rows.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("d", F.size("v")), "classes")
    per_length = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(
        "d", F.greatest(F.lit(least), F.ceil(F.col("n") / shard)).cast("int").alias("parts"))
    dealt = stored(classes.join(F.broadcast(per_length) if per_length.count() <= 10_000 else per_length, "d")
                   .withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")), "dealt")

    def build(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        exact = unit(_rows_of(table["v"], d))
        graph = Graph(exact.astype(np.float32))
        links = np.stack([graph.level.astype(np.int32), np.full(len(exact), graph.entry, np.int32)], axis=1)
        blob = np.concatenate([links, *graph.links], axis=1).astype("<i4").tobytes()
        return pa.table({"d": table["d"][:1], "shard": table["part"][:1], "parts": table["parts"][:1], "n": pa.array([len(exact)], pa.int32()),
                         "layers": pa.array([len(graph.links)], pa.int32()), "links": pa.array([blob], pa.binary()),
                         "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "copies": pa.array([table["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "exact": pa.array([exact.astype("<f8").tobytes()], pa.binary())})

    graphs = stored(dealt.groupBy("d", "part").applyInArrow(
        build, "d int, shard int, parts int, n int, layers int, links binary, ids binary, copies binary, exact binary"), "graphs")
    each = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = dealt.select("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), F.col("part").alias("block"), "id", "v")

    def query(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, counts, u, w = [], [], [], []
        if left.num_rows and right.num_rows:
            g = {c: left[c][0].as_py() for c in left.column_names}
            n, d = g["n"], g["d"]
            exact = np.frombuffer(g["exact"], "<f8").reshape(n, d)
            graph = Graph.__new__(Graph)
            table = np.frombuffer(g["links"], "<i4").reshape(n, -1)
            widths = [2 * NEIGHBOURS] + [NEIGHBOURS] * (g["layers"] - 1)
            at = 2 + np.cumsum([0, *widths])
            graph.vectors, graph.entry = exact.astype(np.float32), int(table[0, 1])
            graph.links = [np.ascontiguousarray(table[:, a:b]) for a, b in zip(at[:-1], at[1:])]
            node_id, copies = np.frombuffer(g["ids"], "<i8"), np.frombuffer(g["copies"], "<i8")
            query_id = right["id"].to_numpy()
            q, node = matches(graph, exact, unit(_rows_of(right["v"], d)), min_cosine, recall)
            other = query_id[q] != node_id[node]
            q, node = q[other], node[other]
            number = np.bincount(q, weights=copies[node], minlength=len(query_id)).astype(np.int64)
            linked = np.flatnonzero(number)
            ids, counts = query_id[linked].tolist(), number[linked].tolist()
            edges = _forest(query_id[q], node_id[node])
            u, w = [e[0] for e in edges], [e[1] for e in edges]
        pad = [None] * len(u), [None] * len(ids)
        return pa.table({"id": pa.array(ids + pad[0], pa.int64()), "links": pa.array(counts + pad[0], pa.int64()),
                         "u": pa.array(pad[1] + u, pa.int64()), "w": pa.array(pad[1] + w, pa.int64())})

    found = stored(each.groupBy("d", "shard", "block").cogroup(queries.groupBy("d", "shard", "block")).applyInArrow(
        query, "id long, links long, u long, w long"), "links")
    component = connected_components(found.where(F.col("u").isNotNull()).select("u", F.col("w").alias("v")))
    links = found.where(F.col("id").isNotNull()).groupBy("id").agg(F.sum("links").alias("links"))
    named = (classes.select("print", "id", "copies").join(links, "id", "left").join(component, F.col("id") == F.col("node"), "left")
             .select("print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = rows.select("id", "print").join(named, "print", "left")
    whole = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      whole.alias("component_id"), F.coalesce(F.col("id") == whole, F.lit(True)).alias("kept"))
