"""Goldens and brute-force versions of cleaned reaches, shapes, elevations, rewrites, model adaptors and files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_network import FLUSS, RINGS, THREE, lines_of
from thalweg.functions import geometry as G
from thalweg.functions import text
from thalweg.operators import elevation, export, locate, network, overlay, query, reach_elevation, rewrite, sfr, trees
from thalweg.sources import files

#: Lines for which the reaches below were published.
BARELY = "LINESTRING (15 125, 70 90, 120 120, 130 90, 150 110, 180 90, 190 110, 290 80)"
MERGED = "LINESTRING (30 180, 80 170, 120 210, 140 210, 190 110, 205 90, 240 60, 255 35)"
WINDING = "LINESTRING (103.48 235.46, 103.48 179.46, 95.48 171.46, 95.48 163.46, 103.48 155.46, 103.48 139.46, 119.48 123.46, 199.48 123.46, 207.48 115.46, 215.48 115.46, 223.48 107.46, 239.48 107.46, 247.48 99.46, 255.48 99.46, 271.48 83.46, 271.48 75.46, 279.48 67.46, 279.48 59.46, 287.48 51.46, 287.48 43.46, 295.48 35.46, 295.48 3.46, 303.48 -4.54)"
THREE_LONG = [
    "LINESTRING (-9 295, 63 295, 71 303, 87 303, 95 295, 119 295, 143 271, 143 255, 151 247, 167 247, 175 239, 183 239, 191 247, 255 247, 263 255, 271 255, 279 247, 295 247, 303 239, 303 207, 271 175, 255 175, 247 167, 239 167, 215 143, 215 135, 207 127, 207 119, 199 111, 199 87, 191 79, 191 39, 207 23, 223 23, 231 31, 239 31, 255 47, 263 47, 271 55, 279 55, 287 63, 295 63, 303 71, 311 71, 319 79, 327 79, 335 87, 343 87, 351 95, 367 95, 375 103, 391 103, 399 111, 423 111, 439 95)",
    "LINESTRING (431 415, 391 375, 391 303, 383 295, 383 287, 375 279, 375 263, 383 255, 391 255, 399 247, 431 247, 439 255, 447 255, 455 263, 463 263, 471 271, 495 271, 527 239, 527 231, 535 223, 535 215, 527 207, 527 199, 503 175, 495 175, 487 167, 479 167, 447 135, 447 119, 439 111, 439 95)",
    "LINESTRING (439 95, 439 71, 471 39, 503 39, 511 47, 551 47, 607 -9)",
]


def network_of(spark, parts, first=0):
    return network.from_lines(lines_of(spark, [(first + k, p) for k, p in enumerate(parts)]))


def domain_of(spark, values):
    return spark.createDataFrame([(i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], "i int, j int, domain int")


def laid(found):
    rows = found.orderBy("ridx").collect()
    return [r["i"] for r in rows], [r["j"] for r in rows], [r["rlen"] for r in rows], rows


@pytest.mark.parametrize(
    "line, grid, active, fraction, i, j, lengths",
    [
        (BARELY, (2, 3, 200.0), [[1, 1, 1], [0, 0, 0]], 0.8, [0, 0, 0], [0, 1, 2], [100.177734, 152.08736, 93.96276]),
        (MERGED, (3, 3, 300.0), None, 0.2, [1, 1, 0, 1, 2], [0, 1, 1, 1, 2], [79.274, 14.142, 45.322, 115.206, 85.669]),
        (WINDING, (2, 3, 200.0), [[1, 1, 0], [1, 1, 1]], 0.2, [0, 0, 0, 1], [1, 0, 1, 2], [25.461, 20.784, 134.863, 178.51]),
    ],
)
def test_cleaned_reaches(spark, line, grid, active, fraction, i, j, lengths):
    cells = overlay.Grid(grid[0], grid[1], 100.0, 100.0, 0.0, grid[2])
    found, _ = overlay.reaches(network_of(spark, [line]), cells, None if active is None else domain_of(spark, active), reach_include_fraction=fraction)
    got = laid(found)
    assert (got[0], got[1]) == (i, j) and got[2] == pytest.approx(lengths, abs=1e-3)


def test_cleaned_reaches_of_three_segments(spark):
    net = network_of(spark, THREE_LONG, 100)
    found, marked = overlay.reaches(net, overlay.Grid(4, 6, 100.0, 100.0, 0.0, 400.0))
    i, j, lengths, rows = laid(found)
    assert [r["segnum"] for r in rows] == [100] * 13 + [101] * 7 + [102] * 2
    assert i == [1, 0, 1, 1, 1, 1, 1, 2, 3, 3, 3, 2, 2, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert j == [0, 0, 0, 1, 2, 3, 2, 2, 1, 2, 3, 3, 4, 4, 3, 3, 4, 5, 5, 4, 4, 5]
    assert [r["iseg"] for r in rows] == [1] * 13 + [2] * 7 + [3] * 2 and [r["ireach"] for r in rows] == [*range(1, 14), *range(1, 8), 1, 2]
    assert lengths == pytest.approx([79.1, 24.5, 12.1, 135.9, 108.7, 40.5, 5.7, 143.2, 88.0, 121.5, 85.3, 32.6, 45.6, 43.8, 89.0, 74.0, 112.0, 83.8, 37.9, 112.9, 98.3, 133.5], abs=0.06)
    assert marked.where("in_model").count() == 3


def test_reach_geometry_covers_the_pieces(spark):
    net = network.from_lines(lines_of(spark, THREE))
    found, _ = overlay.reaches(net, overlay.Grid(3, 2, 20.0, 20.0, 30.0, 130.0))
    rows = overlay.with_geometry(found, net.segments).orderBy("ridx").collect()
    assert len(rows) == 7 and all(p["z"] is not None for r in rows for p in r["geometry"])
    assert [r["rlen"] for r in rows] == pytest.approx([18.027756, 6.009252, 12.018504, 21.081851, 10.540926, 10.0, 10.0])
    slopes = {r["ridx"]: r["slope"] for r in overlay.reach_slope(overlay.with_geometry(found, net.segments), segments=net.segments).collect()}
    assert slopes[1] == pytest.approx(1 / 36.05551275) and slopes[7] == pytest.approx(0.1)


def test_rescue_and_in_model(spark):
    net = network_of(spark, ["LINESTRING (10 90, 50 55)", "LINESTRING (90 90, 50 55)", "LINESTRING (50 55, 50 20, 50 -60)"])
    grid, active = overlay.Grid(2, 1, 100.0, 50.0, 0.0, 100.0), domain_of(spark, [[1], [0]])
    found, marked = overlay.reaches(net, grid, active, reach_include_fraction=0.0)
    rows = found.orderBy("ridx").collect()
    assert [(r["segnum"], r["i"], r["iseg"]) for r in rows] == [(0, 0, 1), (1, 0, 2), (2, 0, 3)]
    plain, _ = overlay.reaches(net, grid, active, reach_include_fraction=0.0, rescue=False)
    assert sorted(r["segnum"] for r in plain.collect()) == [0, 1, 2]
    below = network_of(spark, ["LINESTRING (10 90, 50 50)", "LINESTRING (90 90, 50 50)", "LINESTRING (50 50, 50 20, 50 -60)"])
    found, marked = overlay.reaches(below, grid, active, reach_include_fraction=0.0)
    last = [r for r in found.collect() if r["segnum"] == 2]
    assert len(last) == 1 and (last[0]["i"], last[0]["j"], last[0]["rlen"], last[0]["segndist"]) == (0, 0, 75.0, 0.0)
    assert {r["segnum"]: r["in_model"] for r in marked.collect()} == {0: True, 1: True, 2: False}


def test_all_problems_are_kept(spark):
    """Lines that end in the middle of a long one: each is told, however many there are."""
    rows = [(0, "LINESTRING (0 0, 2000 0)")] + [(k, f"LINESTRING ({k} {k % 7 + 1}, {k} 0)") for k in range(1, 1203)]
    net = network.from_lines(lines_of(spark, rows))
    assert net.problems.where("kind = 'outlet in the middle'").count() == 1202
    assert len(net.errors) == 1001 and net.errors[-1] == "... and 202 more, see problems"
    assert net.errors[0] == "segment 1 connects to the middle of segment 0"


def test_lines_beside_their_catchments(spark):
    wkt = {0: RINGS[0][1], 1: RINGS[2][1], 2: "POLYGON ((0 0, 1 0, 1 1, 0 0))"}
    rings = spark.createDataFrame(list(wkt.items()), "segnum long, wkt string").select("segnum", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    net = network.from_lines(lines_of(spark, THREE), rings)
    assert net.errors == ["segment 2 does not intersect its polygon"]
    far = rings.select("segnum", F.transform("rings", lambda r: F.transform(r, lambda p: G.xyz(p["x"] - 1000, p["y"]))).alias("rings"))
    with pytest.raises(ValueError):
        network.from_lines(lines_of(spark, THREE), far)
    with pytest.raises(ValueError):
        network.from_lines(lines_of(spark, THREE), rings.where("segnum < 2"))


def test_network_as_a_whole(spark):
    net = network.from_lines(lines_of(spark, THREE))
    assert repr(net) == "<Network: 3 segments [0, 1, 2], end -1>" and dict(net)["end"] == -1
    rings = spark.createDataFrame(RINGS, "segnum long, wkt string").select("segnum", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    made = net.with_catchments(rings)
    assert [r["upstream_area"] for r in made.segments.orderBy("segnum").collect()] == pytest.approx([2200, 875, 525])
    assert "width" in made.segments.columns and made.with_catchments(None).catchments is None


def test_nearest_on_odd_points(spark):
    net = network.from_lines(lines_of(spark, THREE))
    nan = float("nan")
    points = spark.createDataFrame([(1, 60.0, 90.0), (2, nan, 1.0), (3, None, 2.0), (4, 1e9, -1e9), (5, float("inf"), 0.0)], "loc long, x double, y double")
    got = {r["loc"]: r["segnum"] for r in locate.nearest(points, net.segments.select("segnum", "geometry")).collect()}
    assert got == {1: 0, 4: 0}
    found = {r["loc"]: (r["method"], r["segnum"]) for r in locate.locate(net, points).collect()}
    assert found == {1: ("nearest", 0), 2: ("empty", -1), 3: ("empty", -1), 4: ("nearest", 0), 5: ("empty", -1)}


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    at = lambda: (rng.uniform(0, 100), rng.uniform(0, 100))
    lines = [(k, f"LINESTRING ({a[0]} {a[1]}, {b[0]} {b[1]})") for k in range(300) for a in [at()] for b in [(a[0] + rng.uniform(-3, 3), a[1] + rng.uniform(-3, 3))]] + [(300, "LINESTRING (-500 -500, -400 900)")]
    frame = lines_of(spark, lines)
    points = [(k, rng.uniform(-300, 400), rng.uniform(-300, 400)) for k in range(200)]
    got = {r["loc"]: r["segnum"] for r in locate.nearest(spark.createDataFrame(points, "loc long, x double, y double"), frame.select("segnum", "geometry")).collect()}
    ends = {r["segnum"]: np.array([(p["x"], p["y"]) for p in r["geometry"]]) for r in frame.collect()}
    for k, x, y in points:
        def gap(s, x=x, y=y):
            a, b = ends[s]
            t = np.clip(np.dot([x - a[0], y - a[1]], b - a) / np.dot(b - a, b - a), 0, 1)
            return np.hypot(*(a + t * (b - a) - (x, y)))
        assert gap(got[k]) == pytest.approx(min(map(gap, ends)))


def test_locate_shapes(spark):
    rings = spark.createDataFrame(RINGS, "segnum long, wkt string").select("segnum", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    net = network.from_lines(lines_of(spark, THREE))
    boxes = [(1, "POLYGON ((40 105, 70 105, 70 120, 40 120, 40 105))"), (2, "POLYGON ((58 85, 59 85, 59 88, 58 85))"), (3, "POLYGON ((62 110, 72 110, 72 120, 62 120, 62 110))"), (4, "POLYGON ((50 95, 70 95, 70 130, 50 130, 50 95))")]
    shapes = spark.createDataFrame(boxes, "loc long, wkt string").select("loc", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    whole = net.with_catchments(rings)
    got = {r["loc"]: (r["method"], r["segnum"]) for r in locate.locate(whole, shapes).collect()}
    assert got == {1: ("catchment", 1), 2: ("catchment", 0), 3: ("catchment", 2), 4: ("catchment", 1)}  # box 4 shares 300 with each tributary's catchment: the first
    near = {r["loc"]: r["segnum"] for r in locate.locate(net, shapes).collect()}
    assert near == {1: 1, 2: 0, 3: 2, 4: 2}  # box 4 meets all three: the second tributary runs longest through it
    lines = spark.createDataFrame([(7, "LINESTRING (30 128, 45 135)"), (8, "LINESTRING (61 82, 80 82)")], "loc long, wkt string").select("loc", G.from_wkt(F.col("wkt")).alias("geometry"))
    rows = {r["loc"]: r for r in locate.locate(net, lines).collect()}
    assert (rows[7]["segnum"], rows[8]["segnum"]) == (1, 0)
    assert rows[8]["dist_to_seg"] == pytest.approx(1.0) and rows[8]["seg_ndist"] == pytest.approx(0.9)
    found = locate.locate(net, lines)
    assert text.require_location_frame(found)
    with pytest.raises(ValueError):
        text.require_location_frame(found.drop("segnum"))
    with pytest.raises(TypeError):
        text.require_location_frame(found.drop("link"))
    with pytest.raises(ValueError):
        text.require_location_frame(found.withColumn("link", F.slice("link", 1, 1)))


def test_shared_area_against_sampling():
    rng = np.random.default_rng(3)
    for _ in range(20):
        polygons = []
        for _ in range(2):
            angles = np.sort(rng.uniform(0, 2 * np.pi, 9))
            radius = rng.uniform(0.3, 1, 9)
            ring = [(float(r * np.cos(a) + 0.4 * len(polygons)), float(r * np.sin(a))) for a, r in zip(angles, radius, strict=True)]
            polygons.append([ring + ring[:1]])

        def inside(rings, pts):
            out = np.zeros(len(pts), bool)
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                    cross = (y1 > pts[:, 1]) != (y2 > pts[:, 1])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out ^= cross & (pts[:, 0] < (x2 - x1) * (pts[:, 1] - y1) / (y2 - y1) + x1)
            return out

        pts = rng.uniform([-1, -1], [1.4, 1], (200_000, 2))
        share = (inside(polygons[0], pts) & inside(polygons[1], pts)).mean() * 2.4 * 2
        assert G.shared_area(*polygons) == pytest.approx(share, abs=0.02)


def test_aggregate(spark):
    net = network.from_lines(lines_of(spark, FLUSS))
    made = rewrite.aggregate(net, spark.createDataFrame([(8,), (9,), (17,)], "segnum long"))
    rows = {r["segnum"]: r for r in made.segments.collect()}
    assert set(rows) == {8, 9, 17} | set(rows) and not made.errors
    for r in rows.values():
        assert r["agg_path"][0] == r["segnum"] and set(r["agg_path"]) <= set(r["agg_patch"])
        assert not set(r["agg_unpath"]) & set(r["agg_path"])
    assert sorted(s for r in rows.values() for s in r["agg_patch"]) == sorted(set(s for r in rows.values() for s in r["agg_patch"]))
    for bad, error in (([8, 8], ValueError), ([99], IndexError)):
        with pytest.raises(error):
            rewrite.aggregate(net, spark.createDataFrame([(b,) for b in bad], "segnum long"))
    with pytest.raises(ValueError):
        rewrite.aggregate(net, spark.createDataFrame([(8,)], "segnum long"), follow_up="nil")


def test_coarsen_with_catchments(spark):
    rings = spark.createDataFrame(RINGS, "segnum long, wkt string").select("segnum", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    net = network.from_lines(lines_of(spark, THREE), rings)
    made = rewrite.coarsen(net, 2)
    (row,) = made.segments.collect()
    assert row["catchment_segnums"] == [0, 1, 2] and row["upstream_area"] == pytest.approx(2200)
    (ring,) = made.catchments.collect()
    assert len(ring["rings"]) == 1


def test_fixed_reaches_fall_and_keep_to_the_layer(spark):
    net = network_of(spark, ["LINESTRING (5 95, 45 55)", "LINESTRING (95 95, 45 55)", "LINESTRING (45 55, 45 5)"])
    found, _ = overlay.reaches(net, overlay.Grid(5, 5, 20.0, 20.0, 0.0, 100.0), reach_include_fraction=None)
    rng = random.Random(2)
    cells = [(i, j, rng.uniform(8, 14)) for i in range(5) for j in range(5)]
    top = spark.createDataFrame(cells, "i int, j int, value double")
    bottoms = [top.withColumn("value", F.col("value") - d) for d in (2.0, 2.2, 9.0)]
    rows = found.join(overlay.reach_array(found, top).withColumnRenamed("value", "rtp"), "ridx").withColumn("rbth", F.lit(0.5))
    links = query.reach_links(found, net)
    for way in ("downstream", "upstream", "both"):
        made = {r["ridx"]: r for r in reach_elevation.fix_reach_elevations(rows, links, net.segments, top, bottoms, direction=way, min_slope=1e-3).collect()}
        for a, b in links.collect():
            if b and way != "upstream":
                assert made[b]["rtp"] <= made[a]["rtp"] + 1e-9
        for r in made.values():
            assert r["rtp"] - 0.5 - r["bots"][0] >= 1.0 - 1e-9 and all(a - b >= 0.5 - 1e-9 for a, b in zip(r["bots"], r["bots"][1:], strict=False))
    lower = {r["ridx"]: r for r in reach_elevation.lower_to_next(found.select("ridx", "i", "j"), links, top, bottoms, spacing=20.0, min_slope=1e-3).collect()}
    for a, b in links.collect():
        assert not b or lower[b]["rtp"] <= lower[a]["rtp"] - 0.02 + 1e-9
    with pytest.raises(ValueError):
        reach_elevation.fix_reach_elevations(rows, links, net.segments, top, bottoms, direction="sideways")


def test_segment_data_of_the_classic_package(spark):
    net = network.from_lines(lines_of(spark, [(100 + k, w) for k, w in THREE]))
    made = sfr.mf2005(net, sfr.Model(overlay.Grid(3, 2, 20.0, 20.0, 30.0, 130.0)))
    top = spark.createDataFrame([(i, j, 15.0) for i in range(3) for j in range(2)], "i int, j int, value double")
    data = export.segment_data(made.reaches, net)
    full, rows = elevation.default_segment_data(net, made.segments, made.reaches, data, top, width1=2, width_out=4)
    got = {r["nseg"]: r for r in full.collect()}
    assert [got[k]["segnum"] for k in (1, 2, 3)] == [101, 102, 100] and {r["icalc"] for r in got.values()} == {1}
    assert [got[k]["elevup"] for k in (1, 2, 3)] == pytest.approx([14.75, 14.666667, 13.5]) and [got[k]["elevdn"] for k in (1, 2, 3)] == pytest.approx([14.166667, 14.166667, 12.5])
    assert [(got[k]["width1"], got[k]["width2"]) for k in (1, 2, 3)] == [(2, 2), (2, 2), (2, 4)]
    assert repr(made) == "<ReachNetwork mf2005: 7 in reaches [1, 2, 3, 4, 5, 6, 7], 1 stress period with perlen [1.0]>"
    fixed = reach_elevation.fix_segment_elevations(full, rows, top)
    settled = reach_elevation.fix_reaches_by_segment(rows, fixed, top, [top.withColumn("value", F.lit(10.0))])
    assert settled.count() == 7 and settled.where("rtp - 1 < bots[0]").count() == 0


def test_diversions_of_both_packages(spark):
    net = network.from_lines(lines_of(spark, [(100 + k, w) for k, w in THREE]))
    div = spark.createDataFrame([(10, 58.0, 100.0), (11, 62.0, 81.0), (12, 62.0, 82.0)], "divid long, x double, y double")
    net = locate.set_diversions(net, div)
    model = sfr.Model(overlay.Grid(3, 2, 20.0, 20.0, 30.0, 130.0))
    classic = sfr.mf2005(net, model)
    data = {r["nseg"]: r for r in export.segment_data(classic.reaches, net).collect()}
    taken = {r["divid"]: r["from_segnum"] for r in net.diversions.collect()}
    assert [data[k]["divid"] for k in (4, 5, 6)] == [10, 11, 12] and len(data) == 6
    assert [data[data[k]["iupseg"]]["segnum"] for k in (4, 5, 6)] == [taken[d] for d in (10, 11, 12)]
    newer = sfr.mf6(net, model)
    rows = {r["ridx"]: r for r in newer.reaches.collect()}
    links = {r["ridx"]: r["to_ridx"] for r in newer.links.collect()}
    places = {r["divid"]: r for r in newer.diversions.collect()}
    assert set(links) == set(rows) and len(rows) == 11  # seven reaches, three diversions and the copy of the outlet
    outlet = places[11]["ridx"]
    assert places[12]["ridx"] == outlet and [places[11]["idv"], places[12]["idv"]] == [1, 2]
    assert rows[links[outlet]]["mask"] and links[links[outlet]] == 0 and rows[places[10]["iconr"]]["diversion"]
    assert {r["ridx"] for r in rows.values() if r["ustrf"] == 0.0} == {1, 4} | {p["iconr"] for p in places.values()}
    again = sfr.mf6(net, model)
    assert newer.same_as(again) and not newer.same_as(classic)


def test_model_checks(spark):
    net = network.from_lines(lines_of(spark, THREE))
    model = sfr.Model(overlay.Grid.spaced([20, 20], [20, 20, 20], 30.0, 70.0), None, (10.0,), nper=3)
    assert model.perlen == (10.0, 10.0, 10.0) and model.periods(spark).count() == 3
    model.check_covers(net.segments)
    with pytest.raises(ValueError):
        sfr.Model(overlay.Grid.spaced([20, 20], [20], 3000.0, 70.0)).check_covers(net.segments)
    with pytest.raises(AttributeError, match="perlen"):
        model.check_same(sfr.Model(model.grid, None, (10.0,)))
    assert model.grid.geotransform() == (30.0, 20.0, 0.0, 130.0, 0.0, -20.0)
    with pytest.raises(NotImplementedError):
        overlay.Grid.spaced([20], [20], angle=30.0).geotransform()
    with pytest.raises(ValueError):
        overlay.Grid.spaced([20, 30], [20]).geotransform()
    with pytest.raises(ValueError):
        sfr.ReachNetwork("mf7", net, model.grid, net.segments, net.segments)


def test_a_turned_grid(spark):
    net = network.from_lines(lines_of(spark, THREE))
    straight, _ = overlay.reaches(net, overlay.Grid.spaced([20, 20], [20, 20, 20], 30.0, 70.0))
    turn = lambda x, y: (30 + (x - 30) * 0 - (y - 70) * 1, 70 + (x - 30) * 1 + (y - 70) * 0)
    rows = []
    for k, w in THREE:
        points = [tuple(map(float, p.split())) for p in w[14:-1].split(", ")]
        rows.append((k, "LINESTRING (" + ", ".join("{} {}".format(*turn(x, y)) for x, y, _ in points) + ")"))
    turned, _ = overlay.reaches(network.from_lines(lines_of(spark, rows)), overlay.Grid.spaced([20, 20], [20, 20, 20], 30.0, 70.0, angle=90.0))
    assert [r[:2] for r in zip(*laid(turned)[:2], strict=True)] == [r[:2] for r in zip(*laid(straight)[:2], strict=True)]
    assert laid(turned)[2] == pytest.approx(laid(straight)[2])


def test_profile_equals_a_walk_down(spark):
    """Heights of a random forest, lowered line by line in order of the sequence."""
    rng = random.Random(6)
    n, lines, z_end = 40, [], {}
    spot = {k: (float(k), float(-(k.bit_length()))) for k in range(1, n + 1)} | {0: (0.0, 1.0)}
    for k in range(n, 0, -1):
        (x, y), (ex, ey) = spot[k], spot[k // 2]
        z = [200.0 - 20 * (12 - k.bit_length()) + 100 + rng.uniform(-3, 3) for _ in range(3)]
        z[0] = 1000.0 if 2 * k <= n else z[0]
        lines.append((k, f"LINESTRING Z ({x} {y} {z[0]}, {(x + ex) / 2} {(y + ey) / 2 + 0.1} {z[1]}, {ex} {ey} {z[2]})"))
    net = network.from_lines(lines_of(spark, sorted(lines)))
    got = {r["segnum"]: [p["z"] for p in r["geometry"]] for r in elevation.adjust_elevation_profile(net, 0.05).collect()}
    rows = sorted(net.segments.collect(), key=lambda r: r["sequence"])
    z = {r["segnum"]: [p["z"] for p in r["geometry"]] for r in rows}
    for r in rows:
        h, g = z[r["segnum"]], r["geometry"]
        if r["from_segnums"]:
            h[0] = min(z[u][-1] for u in r["from_segnums"])
        for k in (1, 2):
            h[k] = min(h[k], h[k - 1] - 0.05 * np.hypot(g[k]["x"] - g[k - 1]["x"], g[k]["y"] - g[k - 1]["y"]))
        beside = [s["segnum"] for s in rows if s["to_segnum"] == r["to_segnum"] and r["to_segnum"] != net.end]
        if beside:
            low = min(z[s][-1] for s in beside)
            for s in beside:
                z[s][-1] = low
    for s, h in z.items():
        assert got[s] == pytest.approx(h)


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(80)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in trees.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b c", 1.5, None), (1, None, 2.25, 3)], "id long, word string, x double, n long")
    path = str(tmp_path / "table.txt")
    files.write_table(rows, path)
    assert open(path).read() == "# id  word      x    n\n1            2.25    3\n2     'b c'   1.5  NaN\n"
    files.write_diversions(spark.createDataFrame([(7, 2, 9, "upto"), (7, 1, 8, "upto")], "ridx long, idv int, iconr long, cprior string"), str(tmp_path / "div.dat"))
    assert open(tmp_path / "div.dat").read() == "# ridx idv iconr cprior\n7        1     8 upto\n7        2     9 upto\n"
    frame = spark.createDataFrame([(1, 1, 2, 2, 15.0), (1, 1, 1, 1, 5.5), (2, 1, 1, 2, 7.0)], "per int, k int, i int, j int, elev double")
    files.write_periods(frame, str(tmp_path / "drn_{:02d}.dat"), header=False)
    assert open(tmp_path / "drn_01.dat").read() == "1 1 1  5.5\n1 2 2 15.0\n" and open(tmp_path / "drn_02.dat").read() == "1 1 2 7.0\n"
    package = spark.createDataFrame([(1, 1, 1, 1, 2.0, "a b"), (2, None, None, None, 3.0, None)], "ridx long, k int, i int, j int, rlen double, boundname string")
    files.write_package_data(package, str(tmp_path / "pack.dat"))
    assert open(tmp_path / "pack.dat").read() == "# ridx  k i j  rlen  boundname\n1       1 1 1   2.0  'a b'\n2       NONE    3.0\n"
    flat = files.flat_columns(spark.createDataFrame([(1, [2, 3], True, None)], "segnum long, from_segnums array<long>, mask boolean, note string"))
    assert flat.columns == ["segnum", "from_seg", "mask", "note"] and tuple(flat.first()) == (1, "2,3", 1, "")


def test_values_by_period(spark):
    data = spark.createDataFrame([(1, 101, None, 0, 0.0), (2, 102, None, 0, 0.0), (3, 0, 10, 1, 0.0)], "nseg long, segnum long, divid long, iupseg int, inflow double")
    fixed = spark.createDataFrame([(101, None, 5.0), (999, None, 1.0)], "key long, kper int, value double")
    kept, series = export.set_segment_values(data, None, "inflow", fixed)
    assert [r["inflow"] for r in kept.orderBy("nseg").collect()] == [5.0, 0.0, 0.0] and series.count() == 0
    moving = spark.createDataFrame([(10, 0, 1.0), (10, 1, 2.0)], "key long, kper int, value double")
    _, series = export.set_segment_values(data, series, "inflow", moving, by="diversions")
    _, series = export.set_segment_values(data, series, "inflow", moving.where("kper = 1").withColumn("value", F.lit(9.0)), by="diversions")
    assert sorted((r["kper"], r["nseg"], r["value"]) for r in series.collect()) == [(0, 3, 1.0), (1, 3, 9.0)]
    for name, error in (("nseg", ValueError), ("nothing", KeyError)):
        with pytest.raises(error):
            export.set_segment_values(data, None, name, fixed)
    with pytest.raises(ValueError):
        export.inverted(spark.createDataFrame([(1, 5), (2, 5)], "a long, b long"), "a", "b")
