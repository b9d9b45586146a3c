"""Segments that fall in waves, against the waves one after the other."""

import random

import pytest

from tests.test_trees import together
from thalweg.operators import reach_elevation


def waves(rows):
    """``{nseg: (elevup, elevdn)}`` by a loop over waves."""
    to = {r[0]: max(r[1], 0) for r in rows}
    up, down = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    fall = {r[0]: r[6] * max((r[4] - r[5]) / (10 * r[6]), 1e-4) for r in rows}
    given, into = {k: up.get(t) for k, t in to.items()}, {}
    for k, t in to.items():
        into.setdefault(t, []).append(k)
    wave = set(to) - set(to.values())
    while wave:
        held = {s: min(up[to[s]], up[s] - fall[s]) if to[s] else min(down[s], up[s] - fall[s]) for s in wave}
        down.update(held)
        given.update({s: h - 0.001 for s, h in held.items() if to[s]})
        up.update({t: min(given[u] for u in into[t]) for t in {to[s] for s in wave} if t})
        wave = {to[s] for s in wave if to[s]}
    return {k: (up[k], down[k]) for k in to}


@pytest.mark.parametrize("steep", [0.0, 30.0])
def test_segments_fall_in_waves(spark, steep):
    """All shapes of forests side by side."""
    rng, to = random.Random(3), together()
    pick = lambda: rng.uniform(20, 20 + steep) if steep else 25 + rng.uniform(0, 0.01)
    rows = [(k, t, pick(), pick(), pick(), pick(), rng.uniform(5, 20)) for k, t in to.items()]
    frame = spark.createDataFrame(rows, "nseg long, outseg long, elevup double, elevdn double, top_up double, top_dn double, seglen double")
    got = {r["nseg"]: (r["elevup"], r["elevdn"]) for r in reach_elevation.forward_segments(frame).collect()}
    want = waves(rows)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_circles_are_refused(spark):
    frame = spark.createDataFrame([(1, 2, 1.0, 0.0, 2.0, 1.0, 1.0), (2, 1, 1.0, 0.0, 2.0, 1.0, 1.0)], "nseg long, outseg long, elevup double, elevdn double, top_up double, top_dn double, seglen double")
    with pytest.raises(ValueError):
        reach_elevation.forward_segments(frame)
