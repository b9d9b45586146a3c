"""Reaches fixed segment by segment, against a loop over all of them."""

import random

import numpy as np
import pandas as pd
import pytest

from thalweg.operators import reach_elevation
from thalweg.operators.reach_elevation import BUFFER, _Cells, _result


def _by_segment(part: pd.DataFrame, min_slope: float, thick: float, fix_layers: bool) -> pd.DataFrame:
    part = part.sort_values(["iseg", "ireach"], ignore_index=True)
    cells = _Cells(part)
    rtp = dict(zip(part["ridx"], part["rtp"].astype(float), strict=True))
    for _, seg in part.groupby("iseg", sort=True):
        rows = list(seg.itertuples())
        bottom = {r.ridx: cells.bots[r.i, r.j][0] for r in rows}
        if not any(r.top <= r.rtp for r in rows):
            for r in rows:
                cells.lower((r.i, r.j), r.rtp - r.rbth, bottom[r.ridx])
            continue
        for r in (rows[0], rows[-1]):
            cells.lower((r.i, r.j), r.rtp - r.rbth, bottom[r.ridx])
        length, end = rows[-1].upto, rows[-1].rtp
        tilt = (rows[0].diff_up - rows[0].diff_dn) / rows[0].seglen
        before, at = rows[0].rtp, rows[0].place
        for r in rows[1:-1]:
            limit = before - (r.place - at) * min_slope
            least = end + (length - r.place) * min_slope
            want = r.top - r.diff_up + (r.place - rows[0].place) * tilt
            floor = bottom[r.ridx] + r.rbth + BUFFER
            if want < least:
                new = least
            elif want > limit:
                new = limit
            elif want - r.rbth < bottom[r.ridx] + BUFFER:
                new = limit if floor > limit else floor
            else:
                new = want
            rtp[r.ridx], before, at = new, new, r.place
            cells.lower((r.i, r.j), new - r.rbth, bottom[r.ridx])
    return _result(part, cells, rtp, fix_layers, thick)


@pytest.mark.parametrize("fix_layers", [True, False])
def test_fixed_by_segment(spark, monkeypatch, fix_layers):
    rng = random.Random(12)
    reaches, data, ridx = [], [], 0
    for seg in range(1, 31):
        n = rng.choice([1, 2, 3, 6, 12])
        for k in range(1, n + 1):
            ridx += 1
            reaches.append((ridx, seg, k, rng.randrange(4), rng.randrange(5), rng.uniform(2, 9), rng.choice([0.5, 1.0])))
        up = rng.uniform(20, 24)
        data.append((seg, up, up - rng.uniform(0, 1), rng.uniform(0.2, 2), rng.uniform(0.2, 2), sum(r[5] for r in reaches if r[1] == seg)))
    found = spark.createDataFrame(reaches, "ridx long, iseg int, ireach int, i int, j int, rlen double, strthick double")
    table = spark.createDataFrame(data, "nseg int, elevup double, elevdn double, diff_up double, diff_dn double, seglen double")
    cells = [(i, j, rng.uniform(20.5, 24)) for i in range(4) for j in range(5)]
    top = spark.createDataFrame(cells, "i int, j int, value double")
    bottoms = [spark.createDataFrame([(i, j, v - d - rng.random()) for i, j, v in cells], "i int, j int, value double") for d in (1.0, 2.5, 4.0)]
    got = {r["ridx"]: r for r in reach_elevation.fix_reaches_by_segment(found, table, top, bottoms, fix_layers=fix_layers, min_slope=1e-2).collect()}
    # The same rows as the loop has them.
    tops = {r["ridx"]: r["strtop"] for r in reach_elevation.elevation.reconcile_tops(found, table).collect()}
    places = {r["ridx"]: r for r in reach_elevation.elevation.reach_places(found).collect()}
    high, bots = {c[:2]: c[2] for c in cells}, {}
    for b in bottoms:
        for r in b.collect():
            bots.setdefault((r["i"], r["j"]), []).append(r["value"])
    ends = {d[0]: d for d in data}
    part = pd.DataFrame([
        {"ridx": r[0], "iseg": r[1], "ireach": r[2], "i": r[3], "j": r[4], "rbth": r[6], "rtp": tops[r[0]], "upto": places[r[0]]["upto"], "place": places[r[0]]["place"], "diff_up": ends[r[1]][3], "diff_dn": ends[r[1]][4], "seglen": ends[r[1]][5], "top": high[r[3], r[4]], "bots": bots[r[3], r[4]]}
        for r in reaches
    ])
    want = _by_segment(part, 1e-2, 0.5, fix_layers).set_index("ridx")
    assert set(got) == set(want.index)
    for k, r in got.items():
        assert r["rtp"] == pytest.approx(want.loc[k, "rtp"]) and r["bots"] == pytest.approx(want.loc[k, "bots"])
    assert any(abs(got[k]["rtp"] - tops[k]) > 1e-6 for k in got) and any(np.abs(np.array(r["bots"]) - bots[r["i"], r["j"]]).max() > 1e-6 for r in got.values())
