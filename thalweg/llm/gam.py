"""Quality scores from a generalised additive model with pairwise interactions.

Each text gives a row of plain statistics. Training bins every statistic by
quantiles and boosts a shallow tree for every feature in each round, so that
every feature ends with a lookup table over its bins; then the few pairs
of features whose joint bins explain most of what is left are boosted the same
way into two-dimensional tables. Scoring is a sum of table entries, a whole
batch at a time. All labelled rows that aren't held out are learned from, by
sums over partitions; statistics, bins and scores are of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import checkpointed, held_out

FEATURES = (
    "log_words", "letters_per_word", "upper", "digits", "marks", "signs", "bars", "shouts",
    "distinct_words", "same_as_last", "distinct_lines", "words_per_line", "beyond_ascii",
)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]\\/=+_"]] = 5
_KIND[ord("|")], _KIND[ord("!")] = 6, 7
_KIND[128:192], _KIND[192:] = 8, 9  # later and first bytes of letters beyond ASCII


def describe(text: str | None) -> list[float]:
    """The statistics of one text, in the order of FEATURES; an empty or null text gives zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    by = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=by, minlength=10)
    letters = kind[1] + kind[2] + kind[9]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        np.log1p(n), letters / n, kind[1] / max(letters, 1), kind[3] / n, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), min(n / len(lines), 1e4), kind[9] / max(letters, 1),
    ]


@dataclass
class Model:
    """bias + sum of tables[j][bin of feature j] + sum of pairs[(j, k)][bin of j, bin of k], through a logistic."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.tables and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for (j, k), t in self.pairs.items():
                z += t[b[:, j], b[:, k]]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a run of bins: gain over not cutting, and how many bins go left."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over the bins of one feature, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b]), a, b) for a, b in parts), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[2] + best[1]), (best[2] + best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the joint bins of two features: one cut of the first, then one of the second in each side."""
    def sides(g, h):
        best = (-1.0, 0, 0, 0)
        for cut in range(1, g.shape[0]):
            low, high = _split(g[:cut].sum(0), h[:cut].sum(0)), _split(g[cut:].sum(0), h[cut:].sum(0))
            whole = _gain(g[:cut].sum(), h[:cut].sum()) + _gain(g[cut:].sum(), h[cut:].sum())
            best = max(best, (low[0] + high[0] + whole, cut, low[1], high[1]))
        return best

    out = np.zeros(g.shape)
    _, cut, low, high = sides(g, h)
    for rows, at in ((slice(0, cut), low), (slice(cut, None), high)):
        for cols in (slice(0, at), slice(at, None)):
            if g[rows, cols].size:
                out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return out


def _sums(model: Model, b: np.ndarray, n: np.ndarray, ones: np.ndarray, pairs: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """Gradients and curvatures by bin of each feature, or by joint bins of each of the ``pairs``, one after the other: rows with bins ``b`` stand for ``n`` texts, ``ones`` of label 1."""
    z = np.full(len(b), model.bias)
    for j, t in enumerate(model.tables):
        z += t[b[:, j]]
    for (j, k), t in model.pairs.items():
        z += t[b[:, j], b[:, k]]
    p = 1 / (1 + np.exp(-z))
    g, h = ones - n * p, n * p * (1 - p)
    sizes = [len(t) for t in model.tables]
    at = [(b[:, j] * sizes[k] + b[:, k], sizes[j] * sizes[k]) for j, k in pairs] or [(b[:, j], sizes[j]) for j in range(len(sizes))]
    return np.concatenate([np.bincount(where, w, m) for where, m in at for w in (g, h)])


def _boosted(model: Model, sums: Callable[..., np.ndarray], *, rounds: int, rate: float, interactions: int, pair_rounds: int) -> Model:
    """Boosts all tables of the model at a time, a round for each call of ``sums``; then those of the pairs that explain most of what is left.

    With up to thirteen features a rate of 0.1 stays short of twice a whole
    step even if all of them tell the same, so rounds settle.
    """
    def parts(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for shape in shapes:
            m = int(np.prod(shape))
            yield flat[at : at + m].reshape(shape), flat[at + m : at + 2 * m].reshape(shape)
            at += 2 * m

    for _ in range(rounds):
        for t, (g, h) in zip(model.tables, parts(sums(model), [t.shape for t in model.tables]), strict=True):
            t += rate * _tree(g, h)
    every = tuple(combinations(range(len(model.tables)), 2))
    if not every:
        return model
    shape = lambda jk: (len(model.tables[jk[0]]), len(model.tables[jk[1]]))
    worth = {}
    for jk, (g, h) in zip(every, parts(sums(model, every), [shape(jk) for jk in every]), strict=True):
        t = _pair_tree(g, h)
        worth[jk] = float((t * g - 0.5 * t * t * h).sum())
    chosen = tuple(sorted(every, key=worth.get, reverse=True)[:interactions])
    model.pairs = {jk: np.zeros(shape(jk)) for jk in chosen}
    for _ in range(pair_rounds):
        for jk, (g, h) in zip(chosen, parts(sums(model, chosen), [shape(jk) for jk in chosen]), strict=True):
            model.pairs[jk] += rate * _pair_tree(g, h)
    return model


def _start(rows: float, ones: float, cuts: list[np.ndarray]) -> Model:
    """The model before any round: without rows the score is 0.5 everywhere, with one kind of label only that label's, smoothed; neither is boosted."""
    share = (ones + 0.5) / (rows + 1.0)
    bias = float(np.log(share / (1 - share)))
    if rows < 2 or ones in (0, rows):
        return Model(bias if rows else 0.0, [], [], {})
    return Model(bias, cuts, [np.zeros(len(c) + 1) for c in cuts], {})


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 80, rate: float = 0.1, interactions: int = 4, pair_rounds: int = 25) -> Model:
    """The model of rows ``x`` with 0/1 labels ``y`` at hand."""
    cuts = [_cuts(*np.unique(col, return_counts=True), bins) for col in x.T] if len(y) else []
    model = _start(len(y), float(y.sum()), cuts)
    if not model.tables:
        return model
    b, one = model.bins(x), np.ones(len(y))
    return _boosted(model, lambda m, pairs=(): _sums(m, b, one, y, pairs), rounds=rounds, rate=rate, interactions=interactions, pair_rounds=pair_rounds)


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Where to cut ``values``, in order, each with its count, into bins of about as many."""
    upto = np.cumsum(counts)
    points = np.unique(values[np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins, side="right").clip(max=len(values) - 1)])
    return points[points > values[0]]


#: Bits of a statistic that its counts leave out: values are told apart to one part in 256.
_DROPPED = 44
#: Parts of the rows of bins, each of which sends its sums to the driver once a round.
_PARTS = 16


def train_quality(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, bins: int = 32, rounds: int = 80, rate: float = 0.1, interactions: int = 4, pair_rounds: int = 25) -> Model:
    """The model of ``labels.quality`` from every labelled text that isn't held out.

    Statistics are worked out once and counted by feature and value for the
    bins; texts of the same bins become one row with its counts. A round sums
    gradients by bin over all of them, and only these sums reach the driver.
    Rows with a null label or id are passed over; an id with several labels
    takes the largest.
    """
    width = len(FEATURES)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = [describe(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    mine = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    known = labels.where(mine & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.where(mine).select("doc_id", "text").mapInArrow(described, f"doc_id {kind}, x array<double>")
    rows = checkpointed(x.join(known, "doc_id").select("x", "y"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            keys = np.array(part["x"].tolist(), dtype=float).reshape(len(part), width).view(np.int64) >> _DROPPED
            for j in range(width):
                k, n = np.unique(keys[:, j], return_counts=True)
                yield pd.DataFrame({"j": j, "k": k, "n": n})

    found = rows.select("x").mapInPandas(counted, "j int, k long, n long").groupBy("j", "k").agg(F.sum("n").alias("n")).orderBy("j", "k").toPandas()
    state = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    cuts = [_cuts((part["k"].to_numpy(np.int64) << _DROPPED).view(float), part["n"].to_numpy(), bins) for _, part in found.groupby("j")]
    model = _start(float(state["n"]), float(state["ones"]), cuts)
    if not model.tables:
        return model

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            b = model.bins(np.array(part["x"].tolist(), dtype=float).reshape(len(part), width)).astype(np.uint8)
            yield pd.DataFrame({"b": [r.tobytes() for r in b], "y": part["y"]})

    # In order, so that sums come out alike in every run.
    packed = rows.mapInPandas(binned, "b binary, y int").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    packed = checkpointed(packed.repartition(_PARTS, "b").sortWithinPartitions("b"))

    def sums(now: Model, pairs: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, first = 0.0, None
            for part in batches:
                if len(part):
                    first = first or part["b"].iloc[0]
                    b = np.frombuffer(b"".join(part["b"]), np.uint8).reshape(len(part), width).astype(np.int64)
                    total = total + _sums(now, b, part["n"].to_numpy(float), part["ones"].to_numpy(float), pairs)
            if first is not None:
                yield pd.DataFrame({"first": [first], "total": [np.asarray(total).tobytes()]})

        made = sorted((bytes(r["first"]), bytes(r["total"])) for r in packed.mapInPandas(added, "first binary, total binary").collect())
        return sum(np.frombuffer(t) for _, t in made)

    return _boosted(model, sums, rounds=rounds, rate=rate, interactions=interactions, pair_rounds=pair_rounds)


def quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of the columns ``keep`` and ``score`` for each row of ``docs``; null texts as empty.

    Repeated rows and ids give repeated results; an empty table gives none.
    The kept columns pass through as they are, nulls and large numbers included.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.array([describe(t) for t in part.column("text").to_pylist()], dtype=float).reshape(part.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(model.predict(x), pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    need = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(scored, schema)
