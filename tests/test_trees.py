"""Contraction of forests against plain recursion."""

import random

import pytest

from thalweg.operators import trees


def forests():
    rng = random.Random(11)
    for n, pick in ((1, lambda k: 0), (300, lambda k: k // 2), (300, lambda k: k - 1), (300, lambda k: 1 if k > 1 else 0), (400, lambda k: max(k - 1 - k * 7919 % 8, 0)), (400, lambda k: rng.randrange(k)), (400, lambda k: max(0, k - rng.choice([1, 1, 1, 2])))):
        yield {k: pick(k) for k in range(1, n + 1)}
    caterpillar = {k: k - 1 for k in range(1, 100)} | {100 + k: k for k in range(1, 100)} | {200 + k: 100 + k for k in range(1, 100, 3)}
    yield caterpillar
    yield {k + 500 * t: (v + 500 * t if v else 0) for t, f in enumerate((caterpillar, {k: k // 3 for k in range(1, 200)})) for k, v in f.items()}


def plain(to):
    """Round and Strahler order, headwaters first."""
    above = {}
    for k, v in to.items():
        above.setdefault(v, []).append(k)
    out, waiting = {}, [(k, False) for k in above.get(0, [])]
    while waiting:
        k, ready = waiting.pop()
        if not ready:
            waiting += [(k, True), *((u, False) for u in above.get(k, []))]
            continue
        kids = [out[u] for u in above.get(k, [])]
        rounds, orders = [r for r, _ in kids], [o for _, o in kids]
        out[k] = (max(min(rounds) + 1, max(rounds)), max(orders) + (orders.count(max(orders)) > 1)) if kids else (0, 1)
    return out


def together():
    """All forests in one, each with numbers of its own."""
    return {k + 10_000 * t: v + 10_000 * t if v else 0 for t, f in enumerate(forests()) for k, v in f.items()}


@pytest.mark.parametrize("small", [0, 700])
def test_rounds_and_orders(spark, monkeypatch, small):
    monkeypatch.setattr(trees, "SMALL", small)  # with 700 the last segments are finished by one task
    to = together()
    frame = spark.createDataFrame(list(to.items()), "segnum long, to_segnum long")
    got = {r["segnum"]: (r["round"], r["stream_order"]) for r in trees.contracted(frame, 0).collect()}
    assert got == plain(to)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    monkeypatch.setattr(trees, "SMALL", 0)
    turns = []
    keep = trees.checkpointed
    monkeypatch.setattr(trees, "checkpointed", lambda df: turns.append(1) or keep(df))
    chain = spark.range(1, 2001).selectExpr("id AS segnum", "id - 1 AS to_segnum")
    assert trees.contracted(chain, 0).where("stream_order <> 1 OR round <> 2000 - segnum").count() == 0
    assert len(turns) <= 14
