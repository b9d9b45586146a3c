"""Hard negatives by a pivot table: inner products bracketed by distances to a few pivots, survivors scored exactly.

Every vector x gets one more component, ``sqrt(M^2 - |x|^2)`` with M the
largest length, and an anchor gets a 0 there. Then the squared distance of
anchor q and row x is ``|q|^2 + M^2 - 2 q.x``: high scores are short distances,
and a range of scores is a range of distances. The distances of all rows to
PIVOTS pivots are stored once. For an anchor and a row they give, by the
triangle inequality, a least and a greatest distance, so a least and a greatest
score; rows whose bracket misses the range asked for are never scored.

Rows lie in blocks of one label, dealt by their nearest pivot, and each block
keeps the range of its pivot distances. Anchors come in blocks, too. An anchor
block first meets the one block whose ranges are most promising, which gives it
a floor; then the ranges of all blocks, which are a few numbers each, say which
blocks can still matter, and only these meet the anchors. Positives are found
that way in the anchor's label, and negatives, between the positive's score and
a share of it, in all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.common import table

#: Rows of a block, anchors of a block, pivots, expected rows of the sample they are chosen from, blocks whose ranges are looked at together, groups of rows that may be broadcast.
BLOCK, ASKED, PIVOTS, SAMPLE, TOGETHER, FEW = 3072, 256, 8, 1024, 2048, 1_000_000
#: What rounding may take from a distance.
SLACK = 1e-5


def matrix(vectors, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), dims))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def augmented(rows: np.ndarray, square: float) -> np.ndarray:
    """Rows of data with the component that makes all of them as long as the longest."""
    return np.hstack([rows, np.sqrt(np.maximum(square - (rows * rows).sum(axis=1), 0.0))[:, None]])


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows of the sample, each the farthest from those before it."""
    chosen, gaps = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def within(asked: np.ndarray, least: np.ndarray, most: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which rows or blocks (pivot distances from ``least`` to ``most``) may lie between ``near`` and ``far`` of each anchor (pivot distances ``asked``)."""
    open_ = np.ones((len(asked), len(least)), bool)
    for j in range(asked.shape[1]):
        a = asked[:, j, None]
        open_ &= np.maximum(a - most[None, :, j], least[None, :, j] - a) <= far[:, None]
        open_ &= a + most[None, :, j] >= near[:, None]
    return open_


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id."""
    if len(scores) > 8 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Rows of one block as stored: ids, components, squared lengths, distances to the pivots."""

    def __init__(self, ids: bytes, wide: bool, matrix: bytes, table: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(matrix, "<f8" if wide else "<f4").reshape(len(self.ids), -1).astype(float)
        self.table = np.frombuffer(table).reshape(len(self.ids), -1)
        self.lengths = (self.rows * self.rows).sum(axis=1)

    @staticmethod
    def packed(ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, square: float | None) -> dict:
        """``square``: the largest squared length, for rows of data; None for anchors."""
        table = distances(augmented(rows, square) if square is not None else np.hstack([rows, np.zeros((len(rows), 1))]), pivots)
        wide = bool(np.abs(rows).max(initial=0) >= 1 << 24)
        return {"ids": ids.tobytes(), "wide": wide, "matrix": rows.astype("<f8" if wide else "<f4").tobytes(), "table": table.tobytes(), "least": table.min(axis=0).tolist(), "most": table.max(axis=0).tolist()}


class Wanted:
    """The ranges of scores that a block of anchors looks for: per anchor some intervals, each from ``low`` (raised by what is known) to ``high``."""

    def __init__(self, block: Block, square: float, low: np.ndarray, high: np.ndarray):
        self.block, self.low, self.high = block, low, high
        with np.errstate(invalid="ignore"):
            reach = lambda score: np.sqrt(np.maximum(block.lengths + square - 2 * score, 0.0))
            far = reach(np.where(low <= high, low, np.inf).min(axis=1))
            self.far = far * (1 + SLACK) + SLACK
            self.near = reach(np.where(low <= high, high, -np.inf).max(axis=1)) * (1 - SLACK) - SLACK
        self.none = ~(low <= high).any(axis=1)
        self.far[self.none] = -np.inf

    def blocks(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which blocks of data any of the anchors needs."""
        return within(self.block.table, least, most, self.near, self.far).any(axis=0)

    def found(self, data: Block, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(anchor, interval, ids, scores)``: the best ``k`` rows of ``data`` in each interval, the anchor's own id left out."""
        open_ = within(self.block.table, data.table, data.table, self.near, self.far)
        columns = np.flatnonzero(open_.any(axis=0))
        if not len(columns):
            return
        ids, open_ = data.ids[columns], open_[:, columns]
        scores = self.block.rows @ data.rows[columns].T
        for a in np.flatnonzero(open_.any(axis=1)).tolist():
            live = np.flatnonzero(open_[a] & (ids != self.block.ids[a]))
            mine, names = scores[a, live], ids[live]
            for c in np.flatnonzero(self.low[a] <= self.high[a]).tolist():
                hit = np.flatnonzero((mine >= self.low[a, c]) & (mine <= self.high[a, c]))
                if len(hit):
                    top = hit[best(mine[hit], names[hit], k)]
                    yield a, c, names[top], mine[top]


def _ranges(row, square: float) -> Wanted:
    block = Block(row.q_ids, row.q_wide, row.q_matrix, row.q_table)
    shape = (len(block.ids), -1)
    return Wanted(block, square, np.frombuffer(row.low).reshape(shape), np.frombuffer(row.high).reshape(shape))


def _each(run: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A row at a time: what ``run`` gives for each row of packed blocks."""
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                yield run(row)

    return go


def _search(asked: DataFrame, data: DataFrame, ranges: DataFrame, groups: int, square: float, k: int, same: bool) -> DataFrame:
    """``(anchor_id, interval, vec_id, score)``: the best ``k`` of each block that meets the anchors' intervals, among rows of their label or of the others.

    ``asked`` holds ``q_block, q_label``, packed anchors and ``low, high``;
    ``ranges`` the labels and ranges of TOGETHER blocks a row.
    """
    def nearest(row) -> pd.DataFrame:
        """The block whose ranges lie closest to the anchors, of the right label."""
        table = np.frombuffer(row.q_table).reshape(len(np.frombuffer(row.q_ids, np.int64)), -1)
        ours = np.flatnonzero((np.array(row.labels) == row.q_label) == same)
        if not len(ours):
            return pd.DataFrame({"q_block": [], "block": [], "gap": []})
        least, most = np.stack(row.least)[ours], np.stack(row.most)[ours]
        gap = np.zeros(len(ours))
        for j in range(table.shape[1]):
            a = table[:, j].mean()
            gap = np.maximum(gap, np.maximum(a - most[:, j], least[:, j] - a))
        at = int(gap.argmin())
        return pd.DataFrame({"q_block": [row.q_block], "block": [row.blocks[ours[at]]], "gap": [gap[at]]})

    def needed(row) -> pd.DataFrame:
        ours = np.flatnonzero((np.array(row.labels) == row.q_label) == same)
        if len(ours):
            ours = ours[_ranges(row, square).blocks(np.stack(row.least)[ours], np.stack(row.most)[ours])]
        return pd.DataFrame({"q_block": row.q_block, "block": np.array(row.blocks, np.int64)[ours]})

    def floors(row) -> pd.DataFrame:
        wanted = _ranges(row, square)
        low = wanted.low.copy()
        for a, c, _, scores in wanted.found(Block(row.ids, row.wide, row.matrix, row.table), k):
            if len(scores) == k:
                low[a, c] = scores.min()
        return pd.DataFrame({"q_block": [row.q_block], "low": [low.tobytes()]})

    def hits(row) -> pd.DataFrame:
        wanted = _ranges(row, square)
        got = list(wanted.found(Block(row.ids, row.wide, row.matrix, row.table), k))
        sizes = [len(g[2]) for g in got]
        joined = lambda n, dtype: np.concatenate([g[n] for g in got]).astype(dtype) if got else np.zeros(0, dtype)
        return pd.DataFrame({
            "anchor_id": np.repeat([wanted.block.ids[g[0]] for g in got], sizes).astype(np.int64), "interval": np.repeat([g[1] for g in got], sizes).astype(np.int32),
            "vec_id": joined(2, np.int64), "score": joined(3, np.int64),
        })

    met = lambda pairs, rows: pairs.join(rows, "q_block").join(data, "block")
    # The anchors are held against all blocks by their ranges, TOGETHER blocks at a time.
    with_ranges = lambda rows: rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).join(ranges, "group")
    home = with_ranges(asked).mapInPandas(_each(nearest), "q_block long, block long, gap double").groupBy("q_block").agg(F.min_by("block", F.struct("gap", "block")).alias("block"))
    raised = met(home, asked).mapInPandas(_each(floors), "q_block long, low binary")
    asked = table(asked.withColumnRenamed("low", "_low").join(raised, "q_block", "left").withColumn("low", F.coalesce("low", "_low")).drop("_low"), "asked")
    pairs = table(with_ranges(asked).mapInPandas(_each(needed), "q_block long, block long"), "block_pairs")
    return met(pairs, asked).mapInPandas(_each(hits), "anchor_id long, interval int, vec_id long, score long")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows(label, pivot, vec_id, v, ...)`` with ``cut``: groups of one label and pivot larger than ``size`` are split evenly by a hash."""
    large = rows.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("label", "pivot", F.ceil(F.col("n") / size).cast("long").alias("cuts"))
    large = table(large, "large_groups")
    if large.count() <= FEW:
        large = F.broadcast(large)
    return rows.join(large, ["label", "pivot"], "left").withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit(2), "v"), F.coalesce("cuts", F.lit(1)).cast("long"))).drop("cuts")


def hard_negatives(vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, label, embedding)``.

    A component x counts as floor(256 * x), a score is an inner product; higher
    scores come first, equal ones by id. Anchors are the rows whose ``vec_id``
    is divisible by ``every``, an anchor's positives its first ``positives``
    other rows of the same label, and for each of them its first ``negatives``
    rows of other labels that score at most what the positive scores and at
    least ``share`` percent of it, fewer where there are no more.

    Rows with a null id, label or vector, or a null, infinite or NaN component,
    take no part. Shorter vectors are filled up with zeros. A repeated row is a
    candidate as often as it is there, but never for an anchor of its own id;
    of rows that share an anchor's id, the one of the least label and vector is
    asked. Other columns are ignored; an empty table gives no rows.

    Blocks are spread by a hash, so no label, vector or pivot makes a block
    larger than others; a block's ranges of pivot distances are looked at
    before its rows are sent anywhere.
    """
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = ok.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    state = whole.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"), F.coalesce(F.max(length), F.lit(0.0)).alias("square"), F.approx_count_distinct("label").alias("labels")).first()
    dims, square = int(state["dims"]), float(state["square"])
    chance = max(1, state["n"] // SAMPLE)
    sample = whole.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chance)) == 0).orderBy("vec_id").limit(4 * SAMPLE).select("v").collect()
    pivots = farthest_first(augmented(matrix([r["v"] for r in sample], dims), square), PIVOTS) if sample else np.zeros((1, dims + 1))
    deal = lambda size: max(1, min(len(pivots), int(state["n"]) // (size * max(1, int(state["labels"])))))

    def nearest(count: int) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                rows = augmented(matrix(part["v"].to_list(), dims), square)
                yield part.assign(pivot=distances(rows, pivots[:count]).argmin(axis=1))

        return run

    placed = table(whole.mapInPandas(nearest(deal(BLOCK)), "vec_id long, label long, v array<double>, pivot int"), "dealt")

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"label": key[0]} | Block.packed(part["vec_id"].to_numpy(np.int64), matrix(part["v"].to_list(), dims), pivots, square)])

    columns = "ids binary, wide boolean, matrix binary, table binary, least array<double>, most array<double>"
    data = _dealt(placed, BLOCK).groupBy("label", "pivot", "cut").applyInPandas(packed, f"label long, {columns}")
    data = table(data.withColumn("block", F.monotonically_increasing_id()), "vectors")
    groups = max(1, -(-data.count() // TOGETHER))
    ranges = data.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("block", "label", "least", "most")).alias("r"))
    ranges = table(ranges.select("group", *[F.col(f"r.{c}").alias(n) for c, n in (("block", "blocks"), ("label", "labels"), ("least", "least"), ("most", "most"))]), "ranges")
    data = data.select("block", "ids", "wide", "matrix", "table")

    one = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "pivot")).alias("a")).select("vec_id", "a.*")
    anchors = table(_dealt(one.withColumn("pivot", F.pmod("pivot", F.lit(deal(ASKED * every)))), ASKED), "anchors")

    def ask(rows: DataFrame, intervals: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            low, high = intervals(part)
            block = Block.packed(part["vec_id"].to_numpy(np.int64), matrix(part["v"].to_list(), dims), pivots, None)
            return pd.DataFrame([{"q_label": key[0], **{f"q_{c}": block[c] for c in ("ids", "wide", "matrix", "table")}, "low": low.tobytes(), "high": high.tobytes()}])

        made = rows.groupBy("label", "pivot", "cut").applyInPandas(run, "q_label long, q_ids binary, q_wide boolean, q_matrix binary, q_table binary, low binary, high binary")
        return table(made.withColumn("q_block", F.monotonically_increasing_id()), "asked")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("anchor_id", "interval").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    any_score = lambda part: (np.full((len(part), 1), -np.inf), np.full((len(part), 1), np.inf))
    first = table(ranked(_search(ask(anchors, any_score), data, ranges, groups, square, positives, True), positives), "positives")

    def below(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((len(part), positives), np.inf), np.full((len(part), positives), -np.inf)
        for r, scores in enumerate(part["scores"]):
            high[r, : len(scores)] = scores
            low[r, : len(scores)] = [-(-share * int(s) // 100) for s in scores]
        return low, high

    # A positive of a negative score has none: its share would lie above it.
    scores = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s")).select(F.col("anchor_id").alias("vec_id"), F.col("s.score").alias("scores"))
    found = ranked(_search(ask(anchors.join(scores, "vec_id"), below), data, ranges, groups, square, negatives, False), negatives)
    known = first.select("anchor_id", (F.col("rank") - 1).alias("interval"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(known, ["anchor_id", "interval"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


#: The query's result in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_inner_product(a.v, d.v)::BIGINT AS score FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
