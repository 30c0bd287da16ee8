"""Hard-negative mining over a multiway hyperplane tree with distance ranges (GNAT).

Scores are inner products of whole numbers, which are no distances.  A data
vector therefore gets one more coordinate, sqrt(M**2 - |x|**2) with M the
largest norm, and an anchor gets 0 there: distance(a, x)**2 is then
|a|**2 + M**2 - 2 a.x, and a window of scores is an annulus around the anchor.

The tree.  A node picks up to FANOUT split points, gives every vector to its
nearest one (the domains are bounded by hyperplanes), and stores for each
split point the least and greatest distance to the vectors of every sibling
subtree.  With the distance from the anchor to a split point known, the
triangle inequality bounds the distances that the anchor's annulus can have
from it; a sibling whose range misses them for any split point is eliminated
with all its vectors.  Leaves are scored exactly.

On the cluster.  The top level's split points come from a bounded sample of
SAMPLE rows; every row goes to its nearest one, and domains that hold more
than a shard are dealt by a hash of the id, so a third of all rows in one
place is many shards.  A shard is one task: its tree is built once and
stored, and a search keeps the tree resident while the queries stream past
in blocks from the shared folder.  The top level's ranges are kept with the
shard and eliminate it as a whole.  Sample rows also give each query a first
bound.  Nothing but the sample and the sizes of the domains reaches the driver.

Positives are searched first; each (anchor, positive) is then a query for
the best rows of other labels in its window.  Both keep the best few per
shard, and a window function ranks what the shards found.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored
from .files import filesystem
from .whitening import usable_vectors

SCALE, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 5, 5, 80
FANOUT, LEAF = 16, 256
#: Rows that the top level's split points and the first bounds are taken from, and the most split points there.
SAMPLE, TOP = 4096, 512
#: Bytes of vectors of a shard at most, and rows of one at least.
SHARD_BYTES, SHARD_LEAST = 64 << 20, 4096
#: Queries that pass a tree together, and leaf rows scored at a time.
BLOCK, STEP = 512, 512
_NONE = np.iinfo(np.int64).min


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact (an overflow of long raises)."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Space:
    """Distances that turn scores into a metric; ``top`` is the largest norm squared of the data."""

    def __init__(self, top: int):
        self.top = float(top)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)

    def slack(self, a: np.ndarray) -> np.ndarray:
        """More than rounding can do to a distance from the rows a."""
        return 1e-6 * (math.sqrt(self.top) + np.sqrt((a.astype(float) ** 2).sum(axis=1)) + 1.0)

    def radius(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which rows with this score lie from an anchor (norm squared); without a score (_NONE) infinite."""
        out = np.sqrt(np.maximum(norm2 + self.top - 2.0 * score.astype(float), 0.0))
        return np.where(score == _NONE, np.inf, out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def split_points(lifted: np.ndarray, m: int) -> np.ndarray:
    """Rows of up to m points far from each other: the first, then always the one farthest from those taken."""
    chosen, near = [0], distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < min(m, len(lifted)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(lifted, lifted[chosen[-1:]])[:, 0])
    return np.array(chosen)


def domains(lifted: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest point of each row, least distance, greatest distance), the last two by (point, domain); empty domains hold nothing."""
    m = len(points)
    nearest = np.empty(len(lifted), np.int64)
    low, high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    for at in range(0, len(lifted), 8192):
        d = distances(lifted[at:at + 8192], points)
        own = d.argmin(axis=1)
        nearest[at:at + 8192] = own
        for j in np.unique(own):
            low[:, j] = np.minimum(low[:, j], d[own == j].min(axis=0))
            high[:, j] = np.maximum(high[:, j], d[own == j].max(axis=0))
    return nearest, low, high


class Tree:
    """The tree of one shard: rows in leaf order, nodes in a list (leaf: its rows; else split points, children, ranges)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, space: Space):
        first = np.argsort(ids, kind="stable")
        order, lifted = first, space.lifted(x[first])
        rng = np.random.default_rng(13)
        self.nodes: list[tuple] = [()]
        open_ = [(0, 0, len(ids))]
        place = np.arange(len(ids))
        while open_:
            node, start, stop = open_.pop()
            inside = place[start:stop]
            some = inside[rng.permutation(len(inside))[:3 * FANOUT]] if stop - start > LEAF else inside[:0]
            points = some[split_points(lifted[some], FANOUT)] if len(some) else some
            if len(points) < 2:  # small, or the same vector throughout
                self.nodes[node] = (start, stop)
                continue
            nearest, low, high = domains(lifted[inside], lifted[points])
            by = np.argsort(nearest, kind="stable")
            place[start:stop] = inside[by]
            edge = start + np.searchsorted(nearest[by], np.arange(len(points) + 1))
            children = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                children.append(len(self.nodes) if b > a else -1)
                if b > a:
                    open_.append((len(self.nodes), a, b))
                    self.nodes.append(())
            self.nodes[node] = (lifted[points], children, low, high)
        order = order[place]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]


class Best:
    """The best ``k`` (score, id) of each query so far, by falling score, then id; equal pairs count once."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.low = k, low.copy()
        self.score = np.full((len(low), k), _NONE, np.int64)
        self.id = np.full((len(low), k), np.iinfo(np.int64).max, np.int64)

    def wanted(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the scores s (query, row) can still be among the best."""
        low, last = self.low[q][:, None], self.id[q, -1][:, None]
        full = (self.score[q, -1] != _NONE)[:, None]
        return (s > low) | ((s == low) & (~full | (self.score[q, -1][:, None] < low) | (ids[None, :] < last)))

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        old = self.score[rows] != _NONE
        q = np.concatenate([q, np.repeat(rows, old.sum(axis=1))])
        s = np.concatenate([s, self.score[rows][old]])
        ids = np.concatenate([ids, self.id[rows][old]])
        by = np.lexsort((ids, -s, q))
        q, s, ids = q[by], s[by], ids[by]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])])
        q, s, ids = q[new], s[new], ids[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.score[rows], self.id[rows] = _NONE, np.iinfo(np.int64).max
        self.score[q[top], rank[top]], self.id[q[top], rank[top]] = s[top], ids[top]
        self.low[rows] = np.maximum(self.low[rows], self.score[rows, -1])


def search(tree: Tree, space: Space, top: tuple, query: dict, same: bool, k: int) -> tuple[Best, int]:
    """(the best k rows of each query in its window of scores, scores computed).

    ``query``: id, label, x, low and high (scores; _NONE: open below, no
    bound above where ``same``).  ``same``: rows of the query's label, else
    of any other.  ``top``: points of the top level and their least and
    greatest distance to this shard's rows.
    """
    a, best = query["x"], Best(query["low"], k)
    lifted = np.concatenate([a.astype(float), np.zeros((len(a), 1))], axis=1)
    norm2, slack = (lifted * lifted).sum(axis=1), space.slack(a)
    inner = np.zeros(len(a)) if same else space.radius(norm2, query["high"])
    scored = 0

    def kept(active: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries whose annulus some vector in the ranges may touch; d: their distances from the split points."""
        outer = (space.radius(norm2[active], best.low[active]) + slack[active])[:, None]
        least = np.maximum(d - outer, (inner[active] - slack[active])[:, None] - d)
        return active[~((low > d + outer) | (high < least)).any(axis=1)]

    everyone = np.arange(len(a))
    stack = [(0, everyone, distances(lifted, top[0]), top[1], top[2])]
    while stack:
        node, active, d, low, high = stack.pop()
        active = kept(active, d[active], low, high)
        if not len(active):
            continue
        inside = tree.nodes[node]
        if len(inside) == 4:
            points, children, low, high = inside
            d = np.zeros((len(a), len(points)))
            d[active] = distances(lifted[active], points)
            for j in np.argsort(-d[active].mean(axis=0)):  # the nearest domain is popped first
                if children[j] >= 0:
                    stack.append((children[j], active, d, low[:, j], high[:, j]))
            continue
        for at in range(inside[0], inside[1], STEP):
            part = slice(at, min(at + STEP, inside[1]))
            s = scores(a[active], tree.x[part])
            scored += s.size
            fits = best.wanted(active, s, tree.ids[part]) & ((query["label"][active][:, None] == tree.labels[part][None, :]) == same)
            fits &= query["id"][active][:, None] != tree.ids[part][None, :]
            if not same:
                fits &= (s <= query["high"][active][:, None]) & (s >= query["low"][active][:, None])
            q, row = np.nonzero(fits)
            if len(q):
                best.add(active[q], s[q, row], tree.ids[part][row])
    return best, scored


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), -1)


def _first_bound(query: dict, sample: dict, same: bool, k: int) -> np.ndarray:
    """A score that k sample rows reach in the query's window, or its least."""
    s = scores(query["x"], sample["x"])
    fits = ((query["label"][:, None] == sample["label"][None, :]) == same) & (query["id"][:, None] != sample["id"][None, :])
    if not same:
        fits &= (s <= query["high"][:, None]) & (s >= query["low"][:, None])
    if s.shape[1] < k:
        return query["low"]
    return np.maximum(query["low"], -np.partition(-np.where(fits, s, _NONE + 1), k - 1, axis=1)[:, k - 1])


def _with_bounds(queries: DataFrame, sample: dict, same: bool, k: int) -> DataFrame:
    """queries (id, label, x, pid, low, high) with low raised to the first bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                query = _query(part)
                low = _first_bound(query, sample, same, k)
                yield part.set_column(part.schema.get_field_index("low"), "low", pa.array(np.where(low <= _NONE + 1, _NONE, low)))

    return queries.mapInArrow(run, queries.schema)


def _query(part: pa.RecordBatch) -> dict:
    column = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
    return {"x": _vectors(column["x"]), **{c: column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label", "pid", "low", "high")}}


def _streamed(path: str) -> Iterator[dict]:
    """Blocks of queries from a table in the shared folder."""
    system, inner = filesystem(path)
    for info in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=BLOCK):
                    yield _query(batch)


def _found(shards: DataFrame, queries: DataFrame, space: Space, points: np.ndarray, same: bool, k: int) -> DataFrame:
    """(anchor, pid, id, score): the best of each query over all shards, with ``place`` from 1."""
    path = shared_dir(queries.sparkSession, "queries")
    queries.write.parquet(path)

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        tree, low, high = pickle.loads(table["tree"][0].as_py())
        for query in _streamed(path):
            best, _ = search(tree, space, (points, low, high), query, same, k)
            q, place = np.nonzero(best.score != _NONE)
            out.append((query["id"][q], query["pid"][q], best.id[q, place], best.score[q, place]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor", "pid", "id", "score"), map(pa.array, columns))))

    found = shards.groupBy("cell", "block").applyInArrow(run, "anchor long, pid long, id long, score long").distinct()
    order = Window.partitionBy("anchor", "pid").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _shards(rows: DataFrame, space: Space, points: np.ndarray, shard_rows: int) -> DataFrame:
    """(cell, block, tree): one row per shard, the tree with the top level's ranges."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                own = distances(space.lifted(_vectors(part.column(2))), points).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32))], names=["id", "label", "x", "cell"])

    placed = stored(rows.select("id", "label", "x").mapInArrow(nearest, "id long, label long, x array<long>, cell int"), "placed")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row per split point of the top level
    blocks = F.array(*[F.lit(max(1, math.ceil(sizes.get(c, 0) / shard_rows))) for c in range(len(points))])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        x = _vectors(table["x"])
        low, high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
        for at in range(0, len(x), 8192):
            d = distances(space.lifted(x[at:at + 8192]), points)
            low, high = np.minimum(low, d.min(axis=0)), np.maximum(high, d.max(axis=0))
        tree = Tree(table["id"].to_numpy(), table["label"].to_numpy(), x, space)
        return pa.table({"cell": table["cell"][:1], "block": table["block"][:1],
                         "tree": pa.array([pickle.dumps((tree, low, high))], pa.binary())})

    return stored(dealt.groupBy("cell", "block").applyInArrow(build, "cell int, block int, tree binary"), "trees")


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
                   sample_rows: int = SAMPLE, shard_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): exact, for every anchor and positive the
    best negatives whose score is between ``least_percent`` % of the positive's and the positive's.

    ``anchor``: which rows are anchors, over the column ``id`` (long).
    Components count as floor(256 c), scores are their inner products, higher
    first, ties by smaller id.  Rows without id or label and rows whose
    vector is null, empty or holds a null or non-finite number take no part,
    nor does one of another length than most.  Equal rows that share an id
    count once; of different ones that share an anchor's id the least by
    (label, vector) is the anchor.  A positive with a negative score has no
    window.  An empty table gives an empty table; other columns are neither
    read nor returned.
    """
    spark = vectors.sparkSession
    labelled = vectors.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    kept = usable_vectors(labelled.select(F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"))
                                          .alias("row"), F.col(f"`{vector_col}`").alias("v")), "row", "v")
    whole = F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long"))
    rows = stored(kept.select("id.id", "id.label", whole.alias("x")), "rows")
    norm2 = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top"), F.max(F.size("x")).alias("d")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).dropDuplicates(["id"]).orderBy("id").collect()  # sample_rows at most
    sample = {"x": np.array([r["x"] for r in some], np.int64), **{c: np.array([r[c] for r in some], np.int64) for c in ("id", "label")}}
    space = Space(stats["top"])
    if shard_rows is None:
        by_tasks = math.ceil(stats["n"] / (4 * spark.sparkContext.defaultParallelism))
        shard_rows = min(max(SHARD_LEAST, by_tasks), max(SHARD_LEAST, SHARD_BYTES // (8 * stats["d"])))
    lifted = space.lifted(sample["x"])
    points = lifted[split_points(lifted, min(TOP, math.ceil(stats["n"] / shard_rows)))]
    shards = _shards(rows, space, points, shard_rows)

    none = F.lit(_NONE)
    anchors = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    anchors = stored(_with_bounds(anchors.select("id", "label", "x", F.col("id").alias("pid"), none.alias("low"), none.alias("high")),
                                  sample, True, positives), "anchors")
    pairs = stored(_found(shards, anchors, space, points, True, positives).select(
        "anchor", F.col("id").alias("pid"), F.col("score").alias("high")).where("high >= 0"), "positives")
    low = F.expr(f"(high * {least_percent} + 99) div 100")
    windows = anchors.select("id", "label", "x").join(pairs, F.col("id") == F.col("anchor")).select("id", "label", "x", "pid", low.alias("low"), "high")
    found = _found(shards, _with_bounds(windows, sample, False, negatives), space, points, False, negatives)
    return found.join(pairs, ["anchor", "pid"]).select(
        F.col("anchor").alias("anchor_id"), F.col("pid").alias("positive_id"), F.col("place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


#: The contract's rows in DuckDB, anchors against all rows.
SQL = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor({SCALE}::DOUBLE * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
anchors AS (SELECT * FROM usable WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM anchors a JOIN usable b ON a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
