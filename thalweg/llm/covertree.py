"""Exact top-k inner-product search with cover trees over the data and over the queries.

Rows are dealt to blocks by the nearest of a few sampled pivots, so that a
block is as compact as the data allow; pivots that draw more than a block's
worth are split by a hash. The tree of each block is built once and stored with
it. A query block first meets the data block of its own pivot, which gives each
query a real kth score; only then do all pairs of blocks meet, with these scores
as floors, and node pairs whose best possible score lies below the worst kth
score of the query node are dropped.

How much that spares is up to the data: a node of radius r can be dropped only
if a score of ``|query| * r`` more would still be too low. Directions that
spread evenly over 64 dimensions have no such nodes but for groups of near
copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import table

#: Rows of a block of data and of queries, rows below which a net cell is no node of its own, expected rows of the pivot sample, pivots at most.
DATA_BLOCK, QUERY_BLOCK, LEAST_NODE, SAMPLE, PIVOTS = 3072, 512, 12, 1024, 256


@dataclass
class CoverTree:
    """A cover tree over the rows of ``points``, which are put into the order of the tree.

    A node covers the rows ``start`` to ``stop`` within ``radius`` of row
    ``centre``. Its children's centres are a net: more than half the radius
    apart and, together, no farther than that from any row of the node, so
    radii halve at least at every level. Cells of fewer than LEAST_NODE rows
    become no nodes: their rows are the node's own, ``start`` to ``loose``.
    """

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    loose: np.ndarray
    stop: np.ndarray
    parent: np.ndarray

    def __post_init__(self) -> None:
        self.children: list[np.ndarray] = [np.flatnonzero(self.parent == k) for k in range(len(self.centre))]
        self.sizes = np.linalg.norm(self.points, axis=1)

    @classmethod
    def grown(cls, points: np.ndarray) -> CoverTree:
        order: list[np.ndarray] = []
        nodes: list[list] = []
        at = 0
        waiting = [(np.arange(len(points)), 0, -1)] if len(points) else []
        while waiting:
            rows, centre, parent = waiting.pop()
            gaps = np.linalg.norm(points[rows] - points[centre], axis=1)
            radius, me = float(gaps.max()), len(nodes)
            own, cells = rows, []
            if radius > 0 and len(rows) >= 2 * LEAST_NODE:
                cell = _net(points[rows], int(np.flatnonzero(rows == centre)[0]), radius / 2)
                centres, counts = np.unique(cell, return_counts=True)
                big = centres[counts >= LEAST_NODE]
                cells = [(rows[cell == c], int(rows[c])) for c in big]
                own = rows[~np.isin(cell, big)]
            nodes.append([centre, radius, len(own), len(rows), parent])
            order.append(own)
            waiting += [(r, c, me) for r, c in reversed(cells)]
        # Depth first, so the rows of a node and of all below it follow one another.
        starts, fills = np.zeros(len(nodes), np.int64), np.array([n[2] for n in nodes], np.int64)
        for k in range(len(nodes)):
            starts[k] = at
            at += fills[k]
        placed = np.concatenate([np.zeros(0, np.int64), *order])
        back = np.empty_like(placed)
        back[placed] = np.arange(len(placed))
        col = lambda k: np.array([n[k] for n in nodes])
        return cls(points[placed], placed, back[col(0).astype(np.int64)], col(1).astype(float), starts, starts + fills, starts + col(3).astype(np.int64), col(4).astype(np.int64))

    def packed(self, ids: np.ndarray) -> dict:
        exact = np.abs(self.points).max(initial=0) < 1 << 24
        nodes = np.stack([self.centre, self.radius, self.start, self.loose, self.stop, self.parent]).astype(float)
        return {"ids": ids[self.order].tobytes(), "narrow": bool(exact), "matrix": self.points.astype("<f4" if exact else "<f8").tobytes(), "nodes": nodes.tobytes()}

    @classmethod
    def unpacked(cls, ids: bytes, narrow: bool, matrix: bytes, nodes: bytes) -> tuple[np.ndarray, CoverTree]:
        names = np.frombuffer(ids, np.int64)
        centre, radius, start, loose, stop, parent = np.frombuffer(nodes).reshape(6, -1)
        points = np.frombuffer(matrix, "<f4" if narrow else "<f8").astype(float).reshape(len(names), -1)
        whole = lambda x: x.astype(np.int64)
        return names, cls(points, np.arange(len(names)), whole(centre), radius, whole(start), whole(loose), whole(stop), whole(parent))


def _net(points: np.ndarray, first: int, reach: float) -> np.ndarray:
    """For each point the centre it is given to: centres are more than ``reach`` apart and each point is within it of its own."""
    squares = (points * points).sum(axis=1)
    cell = np.full(len(points), -1, np.int64)
    limit = reach * reach
    products = points @ points.T if len(points) <= 1.5 * DATA_BLOCK else None  # at most 170 MB
    at, free, where = first, np.ones(len(points), bool), 0
    while True:
        gaps = squares + squares[at] - 2 * (points @ points[at] if products is None else products[at])
        mine = free & (gaps <= limit)
        mine[at] = True
        cell[mine] = at
        free &= ~mine
        while where < len(points) and not free[where]:
            where += 1
        if where == len(points):
            return cell
        at = where


class Search:
    """The best ``k`` of each query of a block so far, and the search of a data block for better ones."""

    def __init__(self, ids: np.ndarray, tree: CoverTree, k: int, floor: np.ndarray | None = None):
        self.ids, self.tree, self.k, self.scored, self.pairs = ids, tree, k, 0, 0
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        #: Scores below are of no use: the kth best, or what is known of it from elsewhere.
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()

    def run(self, ids: np.ndarray, data: CoverTree) -> Search:
        """Goes through the pairs of nodes, the most promising child first. Equal scores are still looked at, for the ties."""
        self.pairs += len(self.ids) * len(ids)
        if len(self.ids) and len(ids):
            waiting = [(0, True, 0)]
            while waiting:
                a, below, b = waiting.pop()
                q = self.tree
                stop = q.stop[a] if below else q.loose[a]
                rows = slice(q.start[a], stop)
                if stop == q.start[a] or self._bound(a, b, data) < self.floor[rows].min():
                    continue
                parts, cells = q.children[a] if below else (), data.children[b]
                if len(parts) and (q.radius[a] > data.radius[b] or not len(cells)):
                    waiting += [(int(c), True, b) for c in parts]
                    waiting.append((a, False, b))
                    continue
                self._score(rows, ids, data, b)
                if len(cells):
                    near = q.points[q.centre[a]] @ data.points[data.centre[cells]].T
                    waiting += [(a, below, int(c)) for c in cells[np.argsort(near)]]
        return self

    def _bound(self, a: int, b: int, data: CoverTree) -> float:
        q, i, j = self.tree, self.tree.centre[a], data.centre[b]
        most = float(q.points[i] @ data.points[j]) + q.sizes[i] * data.radius[b] + data.sizes[j] * q.radius[a] + q.radius[a] * data.radius[b]
        return most + 1e-9 * abs(most) + 1e-6

    def _score(self, rows: slice, ids: np.ndarray, data: CoverTree, b: int) -> None:
        others = slice(data.start[b], data.loose[b])
        names = ids[others]
        if not len(names):
            return
        j = data.centre[b]
        mine = self.tree.points[rows]
        most = mine @ data.points[j] + self.tree.sizes[rows] * data.radius[b]
        live = np.flatnonzero(most + 1e-9 * np.abs(most) + 1e-6 >= self.floor[rows]) + rows.start
        if not len(live):
            return
        self.scored += len(live) * len(names)
        scores = self.tree.points[live] @ data.points[others].T
        scores[self.ids[live, None] == names] = -np.inf
        hits = (scores >= self.floor[live, None]) & (scores > -np.inf)
        for r in np.flatnonzero(hits.any(axis=1)).tolist():
            i, at = live[r], np.flatnonzero(hits[r])
            if len(at) > 4 * self.k:  # most are out by their score alone
                at = at[scores[r, at] >= np.partition(scores[r, at], -self.k)[-self.k]]
            s, n = np.concatenate([self.best[i], scores[r, at]]), np.concatenate([self.who[i], names[at]])
            order = np.lexsort((n, -s))[: self.k]
            self.best[i], self.who[i] = s[order], n[order]
            self.floor[i] = max(self.floor[i], self.best[i, -1])


def _pivots(whole: DataFrame, rows: int, dims: int, count: int) -> np.ndarray:
    """Up to ``count`` vectors of a sample by hash, each the farthest from those before it. About SAMPLE rows reach the driver."""
    share = max(1, rows // SAMPLE)
    got = whole.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(share)) == 0).orderBy("vec_id").limit(4 * SAMPLE).select("v").collect()
    sample = _matrix([r["v"] for r in got], dims)
    if not len(sample):
        return np.zeros((1, dims))
    chosen, gaps = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def search(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each query against every other row.

    Queries are the rows whose ``vec_id`` is divisible by ``every``. A
    component x counts as floor(256 * x); the score is the inner product.
    Vectors that are null or hold a null, infinite or NaN component, and rows
    with a null id, take no part. Shorter vectors are filled up with zeros.
    Every row is a candidate, a repeated one as often as it is there, but not
    for a query of its own id; a query that is there twice is asked once, and
    rows that share a query's id but not its vector share one list. Fewer
    candidates than ``k`` give fewer rows, an empty table none. Other columns
    are ignored.

    Each data block meets each query block once, as rows of packed bytes, and
    gives at most ``k`` rows a query, which a window then merges.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ok = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"))
    state = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    dims = int(state["dims"])
    pivots = _pivots(whole, state["n"], dims, min(PIVOTS, max(1, -(-state["n"] // DATA_BLOCK))))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = (pivots * pivots).sum(axis=1)
        for part in batches:
            m = _matrix(part["v"].to_list(), dims)
            yield pd.DataFrame({"vec_id": part["vec_id"], "pivot": (squares - 2 * (m @ pivots.T)).argmin(axis=1), "v": part["v"]})

    placed = table(whole.mapInPandas(dealt, "vec_id long, pivot int, v array<double>"), "dealt")

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree.grown(_matrix(part["v"].to_list(), dims))
        return pd.DataFrame([{"block": key[0]} | tree.packed(part["vec_id"].to_numpy(np.int64))])

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, dict[int, int], int]:
        """Stored trees, the first block of each pivot, and how many blocks there are. A pivot's rows are split evenly."""
        first, at = {}, 0
        counts = {r["pivot"]: r["count"] for r in df.groupBy("pivot").count().collect()}
        cuts = {}
        for p, n in sorted(counts.items()):
            first[p], cuts[p] = at, -(-n // size)
            at += cuts[p]
        pairs = lambda d: F.create_map(*[F.lit(int(x)) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<int,int>")
        block = pairs(first)[F.col("pivot")] + F.pmod(F.xxhash64("vec_id", F.lit(2), "v"), pairs(cuts)[F.col("pivot")].cast("long"))
        made = df.select(block.alias("block"), "vec_id", "v").repartition(parts, "block").groupBy("block").applyInPandas(packed, f"block long, {PACKED}")
        return table(made, name), first, at

    data, homes, n_data = blocks(placed, DATA_BLOCK, "vectors")
    asked, starts, n_asked = blocks(placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), QUERY_BLOCK, "queries")
    starts = sorted((b, p) for p, b in starts.items())

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"block": "q_block", **{c: f"q_{c}" for c in ("ids", "narrow", "matrix", "nodes")}})

    def found(schema_only_floor: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for row in part.itertuples():
                    q_ids, q = CoverTree.unpacked(row.q_ids, row.q_narrow, row.q_matrix, row.q_nodes)
                    ids, d = CoverTree.unpacked(row.ids, row.narrow, row.matrix, row.nodes)
                    if schema_only_floor:
                        yield pd.DataFrame({"q_block": [row.q_block], "floor": [Search(q_ids, q, k).run(ids, d).floor.tobytes()]})
                        continue
                    got = Search(q_ids, q, k, np.frombuffer(row.floor)).run(ids, d)
                    r, c = np.nonzero(np.isfinite(got.best))
                    yield pd.DataFrame({"query_id": q_ids[r], "vec_id": got.who[r, c], "score": got.best[r, c].astype(np.int64)})

        return run

    # A query block's own pivot: the last whose blocks begin at or before it.
    own = F.lit(0).cast("long")
    for b, p in starts:
        own = F.when(F.col("q_block") >= b, F.lit(homes[p]).cast("long")).otherwise(own)
    met = lambda q: q.repartition(parts, "block").join(data.repartition(parts, "block"), "block")
    floors = table(met(named(asked).withColumn("block", own)).mapInPandas(found(True), "q_block long, floor binary"), "floors")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_data - 1, 0)).cast("long")))
    pairs = met(named(asked).join(floors, "q_block").withColumn("block", every_block))
    rows = pairs.mapInPandas(found(False), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


PACKED = "ids binary, narrow boolean, matrix binary, nodes binary"

#: The same result in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
