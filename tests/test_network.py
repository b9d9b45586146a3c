"""Goldens of the three- and nineteen-line networks, and properties of random forests."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import elevation, network, overlay, query, rewrite, trees
from thalweg.sources import files

#: Networks of three and of nineteen lines and their catchments, as the results below were published for them.
THREE = [(0, "LINESTRING Z (60 100 14, 60 80 12)"), (1, "LINESTRING Z (40 130 15, 60 100 14)"), (2, "LINESTRING Z (70 130 15, 60 100 14)")]
RINGS = [(0, "POLYGON ((35 100, 75 100, 75 80, 35 80, 35 100))"), (1, "POLYGON ((35 135, 60 135, 60 100, 35 100, 35 135))"), (2, "POLYGON ((60 135, 75 135, 75 100, 60 100, 60 135))")]
FLUSS = [
    (0, "LINESTRING (380 490, 370 420)"),
    (1, "LINESTRING (300 460, 370 420)"),
    (2, "LINESTRING (370 420, 420 330)"),
    (3, "LINESTRING (190 250, 280 270)"),
    (4, "LINESTRING (225 180, 280 270)"),
    (5, "LINESTRING (280 270, 420 330)"),
    (6, "LINESTRING (420 330, 584 250)"),
    (7, "LINESTRING (520 220, 584 250)"),
    (8, "LINESTRING (584 250, 710 160)"),
    (9, "LINESTRING (740 270, 710 160)"),
    (10, "LINESTRING (735 350, 740 270)"),
    (11, "LINESTRING (880 320, 740 270)"),
    (12, "LINESTRING (925 370, 880 320)"),
    (13, "LINESTRING (974 300, 880 320)"),
    (14, "LINESTRING (760 460, 735 350)"),
    (15, "LINESTRING (650 430, 735 350)"),
    (16, "LINESTRING (710 160, 770 100)"),
    (17, "LINESTRING (700 90, 770 100)"),
    (18, "LINESTRING (770 100, 820 40)"),
]


def lines_of(spark, rows):
    return spark.createDataFrame([(i, k, w) for k, (i, w) in enumerate(rows)], "segnum long, pos long, wkt string").select("segnum", "pos", G.from_wkt(F.col("wkt")).alias("geometry"))


@pytest.fixture(scope="module")
def three(spark):
    rings = spark.createDataFrame(RINGS, "segnum long, wkt string").select("segnum", G.rings_from_wkt(F.col("wkt")).alias("rings"))
    return network.from_lines(lines_of(spark, THREE), rings)


@pytest.fixture(scope="module")
def fluss(spark):
    return network.from_lines(lines_of(spark, FLUSS))


def column(net, name):
    return [r[0] for r in net.segments.orderBy("segnum").select(name).collect()]


# Fixed values in this and the tests of the nineteen lines: results that have to come out.
def test_three_lines(three):
    assert three.end == -1 and not three.errors and not three.warnings and three.has_z and len(three) == 3
    assert column(three, "to_segnum") == [-1, 0, 0]
    assert column(three, "from_segnums") == [[1, 2], [], []]
    assert column(three, "cat_group") == [0, 0, 0]
    assert column(three, "num_to_outlet") == [1, 2, 2]
    assert column(three, "dist_to_outlet") == pytest.approx([20.0, 56.05551, 51.622776])
    assert column(three, "sequence") == [3, 1, 2]
    assert column(three, "stream_order") == [2, 1, 1]
    assert column(three, "upstream_length") == pytest.approx([87.67828936, 36.05551275, 31.6227766])
    assert column(three, "upstream_area") == pytest.approx([2200, 875, 525])
    assert column(three, "width") == pytest.approx([1.4615, 1.4457, 1.4397], abs=1e-4)


def test_pairs(spark, three):
    values = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "segnum long, value long")
    rows = lambda df: [(r["top"], r["bottom"]) for r in df.orderBy("segnum").collect()]
    assert rows(network.pair_segments(three, values)) == [(3, 3), (4, 3), (5, 3)]
    assert rows(network.pair_segments(three, values, out=spark.createDataFrame([(0, 6)], "segnum long, value long"))) == [(3, 6), (4, 3), (5, 3)]
    ten = spark.createDataFrame([(0, 10.0), (1, 2.0), (2, 3.0)], "segnum long, value double")
    assert rows(network.pair_segments(three, ten, method="additive")) == [(10, 10), (2, 4), (3, 6)]
    with pytest.raises(ValueError):
        network.pair_segments(three, values, method="other")


def test_nineteen_lines(fluss):
    assert column(fluss, "to_segnum") == [2, 2, 6, 5, 5, 6, 8, 8, 16, 16, 9, 9, 11, 11, 10, 10, 18, 18, -1]
    assert column(fluss, "num_to_outlet") == [6, 6, 5, 6, 6, 5, 4, 4, 3, 3, 4, 4, 5, 5, 5, 5, 2, 2, 1]
    assert column(fluss, "sequence") == [4, 3, 12, 2, 1, 11, 15, 9, 16, 17, 14, 13, 6, 5, 8, 7, 18, 10, 19]
    assert column(fluss, "stream_order") == [1, 1, 2, 1, 1, 2, 3, 1, 3, 3, 2, 2, 1, 1, 1, 1, 4, 1, 4]
    assert sorted(r[0] for r in fluss.headwater.collect()) == [0, 1, 3, 4, 7, 12, 13, 14, 15, 17]


def test_routes(fluss):
    assert query.route(fluss, 6, 16) == [6, 8, 16]
    assert query.route(fluss, 16, 6) == [16, 8, 6]
    assert query.route(fluss, 3, 3) == [3]
    assert query.route(fluss, 0, 11, allow_indirect=True) == [0, 2, 6, 8, 9, 11]
    with pytest.raises(ConnectionError):
        query.route(fluss, 0, 11)
    with pytest.raises(IndexError):
        query.route(fluss, 0, 99)


def test_gather(fluss):
    found = lambda **k: {r["segnum"] for r in query.gather(fluss, **k).collect()}
    assert found(upstream=[9]) == set(range(9, 16))
    assert found(upstream=[16], barrier=[9, 5]) == {0, 1, 2, 5, 6, 7, 8, 9, 16}
    assert [r["segnum"] for r in query.gather(fluss, downstream=[0]).orderBy("depth").collect()] == [2, 6, 8, 16, 18]
    assert found(downstream=[0], barrier=[8], gather_upstream=True) == {1, 2, 3, 4, 5, 6, 8}


def test_coarsen_and_aggregate(spark, fluss):
    rows = {r["segnum"]: (r["to_segnum"], r["stream_order"], r["traced_segnums"]) for r in rewrite.coarsen_table(fluss, 2).collect()}
    assert rows == {2: (8, 2, [2]), 5: (8, 2, [5]), 8: (18, 3, [6, 8]), 9: (18, 3, [9]), 10: (9, 2, [10]), 11: (9, 2, [11]), 18: (-1, 4, [16, 18])}
    given = spark.createDataFrame([(5,), (10,), (18,)], "segnum long")
    assert sorted(r["segnum"] for r in rewrite.junction_set(fluss, given).collect()) == [2, 5, 8, 9, 10, 11, 18]
    with pytest.raises(ValueError):
        rewrite.coarsen_table(fluss, 9)


def test_reversed_and_middle(spark):
    flipped = network.from_lines(lines_of(spark, [(0, "LINESTRING (60 80, 60 100)"), (1, "LINESTRING (60 100, 40 130)"), (2, "LINESTRING (60 100, 70 130)")]))
    assert len(flipped.errors) == 2 and flipped.end == -1
    middle = network.from_lines(lines_of(spark, [(0, "LINESTRING (60 100, 60 80)"), (1, "LINESTRING (40 130, 60 90)")]))
    assert middle.errors == ["segment 1 connects to the middle of segment 0"]
    with pytest.raises(ValueError):
        network.from_lines(lines_of(spark, THREE).where("segnum > 9"))


@pytest.mark.parametrize("z, slope, want", [([8, 9], 0.001, [8, 7.999]), ([8, 9, 6], 0.1, [8, 7.9, 6]), ([8, 5, 6, 5], 0.2, [8, 5, 4.8, 4.6])])
def test_profiles(spark, z, slope, want):
    net = network.from_lines(lines_of(spark, [(0, f"LINESTRING Z ({', '.join(f'{k} 0 {h}' for k, h in enumerate(z))})")]))
    row = elevation.adjust_elevation_profile(net, slope).first()
    assert [p["z"] for p in row["geometry"]] == pytest.approx(want)
    with pytest.raises(ValueError):
        elevation.adjust_elevation_profile(net, 0.0)


def test_grid(spark, three):
    grid = overlay.Grid(3, 2, 20.0, 20.0, 30.0, 130.0)
    found, marked = overlay.reaches(three, grid)
    rows = found.orderBy("ridx").collect()
    assert [r["segnum"] for r in rows] == [1, 1, 1, 2, 2, 0, 0]
    assert [r["i"] for r in rows] == [0, 0, 1, 0, 1, 1, 2] and [r["j"] for r in rows] == [0, 1, 1, 1, 1, 1, 1]
    assert [r["iseg"] for r in rows] == [1, 1, 1, 2, 2, 3, 3] and [r["ireach"] for r in rows] == [1, 2, 3, 1, 2, 1, 2]
    assert [r["rlen"] for r in rows] == pytest.approx([18.027756, 6.009252, 12.018504, 21.081851, 10.540926, 10, 10])
    assert [r["segndist"] for r in rows] == pytest.approx([0.25, 0.583333, 0.833333, 0.333333, 0.833333, 0.25, 0.75], abs=1e-6)
    links = {r["ridx"]: r["to_ridx"] for r in query.reach_links(found, three).collect()}
    assert [links[k] for k in range(1, 8)] == [2, 3, 6, 5, 6, 7, 0]
    k = network.pair_segments(three, spark.createDataFrame([(0, 1.0), (1, 10.0), (2, 100.0)], "segnum long, value double"))
    value = lambda log: [r["value"] for r in overlay.reach_values(found, k, log=log).orderBy("ridx").collect()]
    assert value(False) == pytest.approx([7.75, 4.75, 2.5, 67, 17.5, 1, 1], abs=1e-4)
    assert value(True) == pytest.approx([5.62341325, 2.61015722, 1.46779927, 21.5443469, 2.15443469, 1, 1])
    slope = [r["slope"] for r in overlay.reach_slope(found, "zcoord_ab", segments=three.segments).orderBy("ridx").collect()]
    assert slope == pytest.approx([0.027735] * 3 + [0.0316228] * 2 + [0.1] * 2, abs=1e-6)
    top = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate([[16, 15], [15, 15], [14, 14]]) for j, v in enumerate(row)], "i int, j int, value double")
    steep = [r["slope"] for r in overlay.reach_slope(found, "grid_top", top=top, grid=grid).orderBy("ridx").collect()]
    short = [r["slope"] for r in overlay.reach_slope(found, "rch_len", top=top, grid=grid).orderBy("ridx").collect()]
    assert short == pytest.approx([0.078446, 0.16641, 0.041603, 0.047434, 0.047434, 0.05, 0.1], abs=1e-5)
    assert steep == pytest.approx([0.070711, 0.05, 0.025, 0.05, 0.025, 0.025, 0.05], abs=1e-5)


def test_random_forests(spark):
    """Invariants: sums over outlets, sizes, topological order, order bounds, routes reversed."""
    rng = random.Random(5)
    n = 400
    rows = [(k, 0 if rng.random() < 0.02 else rng.randrange(0, k), k) for k in range(1, n + 1)]
    edges = spark.createDataFrame(rows, "segnum long, to_segnum long, pos long").withColumn("value", F.lit(1.0))
    up = trees.checkpointed(trees.climb(edges, 0, values=("value",)))
    below = {s: t for s, t, _ in rows}
    size = dict.fromkeys(below, 1)
    for s in sorted(below, reverse=True):
        if below[s]:
            size[below[s]] += size[s]
    got = {r["segnum"]: r for r in up.collect()}
    assert {s: int(r["up_value"]) for s, r in got.items()} == size
    assert all(got[s]["num_to_outlet"] == (got[t]["num_to_outlet"] + 1 if t else 1) for s, t in below.items())
    ranked = {r["segnum"]: r for r in trees.orders(edges.join(up, "segnum"), 0).collect()}
    assert sorted(r["sequence"] for r in ranked.values()) == list(range(1, n + 1))
    assert all(ranked[s]["sequence"] < ranked[t]["sequence"] for s, t in below.items() if t)
    assert all(ranked[s]["stream_order"] <= ranked[t]["stream_order"] for s, t in below.items() if t)


def test_cycles_keep_the_sentinel(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 0)], "segnum long, to_segnum long")
    got = {r["segnum"]: (r["cat_group"], r["num_to_outlet"], r["dist_to_outlet"]) for r in trees.climb(edges, 0).collect()}
    assert got == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (4, 1, 1.0)}


def test_table_files(spark, tmp_path):
    rows = [(1, -1e10, 1, "first one"), (12, -1e-10, 10, "two"), (33, 0.0, 100, "three"), (40, 1e-10, 1000, None), (6267, 1000.0, 100000, "six")]
    df = spark.createDataFrame(rows, "rno long, value1 double, value2 long, value3 string")
    files.write_table(df, str(tmp_path / "t"))
    back = files.read_table(spark, str(tmp_path / "t"))
    assert back.columns == df.columns and [tuple(r) for r in back.orderBy("rno").collect()] == rows
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines[0].startswith("# rno ") and not [f for f in tmp_path.iterdir() if f.name != "t" and not f.name.startswith(".")]
    assert lines[1].startswith("1 ") and lines[1].endswith("'first one'") and len({len(x[: x.rfind("  ")]) for x in lines[2:4]}) >= 1


def test_save_and_load(spark, three, tmp_path):
    files.save(three, str(tmp_path / "net"))
    again = files.load(spark, str(tmp_path / "net"))
    assert again.same_as(three) and again.catchments.count() == 3
