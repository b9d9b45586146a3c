"""Hard negatives against brute force, and what the pivot distances spare."""

import duckdb
import numpy as np
import pytest

from thalweg.llm import pivots, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>, score string"


def plain(rows, every=100, positives=5, negatives=5, share=80):
    ok = [(i, y, np.floor(256 * np.array(v, np.float32).astype(float))) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    size, out = max((len(v) for *_, v in ok), default=0), []
    ok = [(i, y, np.pad(v, (0, size - len(v)))) for i, y, v in ok]
    asked = {}
    for i, y, v in sorted(ok, key=lambda r: (r[0], r[1], r[2].tolist())):
        if i % every == 0:
            asked.setdefault(i, (y, v))
    for i, (y, v) in asked.items():
        scores = sorted((-int(v @ w), j, y == z) for j, z, w in ok if j != i)
        for p, pid, _ in [s for s in scores if s[2]][:positives]:
            fit = [s for s in scores if not s[2] and share * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, pid, r + 1, nid, -p, -n) for r, (n, nid, _) in enumerate(fit)]
    return sorted(out)


def got(frame):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in frame.collect())


@pytest.mark.parametrize("block, asked, together", [(3072, 256, 2048), (40, 3, 4)])
def test_query_equals_sql(spark, monkeypatch, block, asked, together):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("TOGETHER", together)):
        monkeypatch.setattr(pivots, name, value)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    frame = queries.op11_hard_negatives(spark, DATA)
    want = con.execute(pivots.ORACLE).df()[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]]
    assert got(frame) == sorted(tuple(int(x) for x in r) for r in want.itertuples(index=False)) != []


def test_odd_rows_and_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.integers(0, 3)), (rng.normal(size=4) * 0.2 + [0.5, 0, 0, 0]).tolist()) for k in range(120)]
    rows += [(200 + k, k % 2, [0.5, 0.25, 0.0, 0.0]) for k in range(60)]  # ties
    rows += [(10, 1, None), (20, None, [1.0] * 4), (None, 1, [1.0] * 4), (30, 1, [1.0, None, 0.0, 0.0]), (40, 1, [float("nan")] * 4), (50, 0, [float("inf"), 0.0, 0.0, 0.0]), (60, 1, []), (70, 2, [0.7]), (80, 0, [0.5] * 4), (80, 2, [0.1] * 4), (7, 5, [9.0] * 4), (90, 9, [0.3] * 4)]
    rows.append(rows[3])
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(pivots.hard_negatives(docs, every=10)) == plain(rows, every=10) != []
    assert pivots.hard_negatives(docs.where("false")).count() == 0
    assert pivots.hard_negatives(docs.where("vec_id = 0"), every=1).count() == 0


def test_brackets_hold_and_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 100
    rows = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 5)
    square = (rows * rows).sum(axis=1).max()
    chosen = pivots.farthest_first(pivots.augmented(rows[:200], square), 8)
    data = pivots.Block(**{k: v for k, v in pivots.Block.packed(np.arange(2000), rows, chosen, square).items() if k not in ("least", "most")})
    asked = pivots.Block(**{k: v for k, v in pivots.Block.packed(np.arange(50), rows[:50], chosen, None).items() if k not in ("least", "most")})
    scores = asked.rows @ data.rows.T
    low = np.sort(scores, axis=1)[:, -5, None]
    wanted = pivots.Wanted(asked, square, low, np.full_like(low, np.inf))
    open_ = pivots.within(asked.table, data.table, data.table, wanted.near, wanted.far)
    assert open_[scores >= low].all() and open_.mean() < 0.5
