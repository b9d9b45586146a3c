"""Steps that must not gather on one key, one task or the driver as tables grow."""

import math
import random

import pytest
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import locate as L
from thalweg.operators import network as N
from thalweg.operators import rewrite
from thalweg.operators import trees


def box(x0, x1, y0, y1):
    corner = lambda a, b: G.xyz(F.col(a), F.col(b))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


def test_boxes_of_all_sizes_meet(spark):
    """As brute force, for boxes from 2^-12 to 8 wide, some of no width, in other places or copies of each other."""
    rng = random.Random(7)
    made = []
    for k in range(300):
        w, h = rng.choice([0, 2**-12, 2**-6, 0.1, 1, 8]), rng.choice([0, 2**-12, 0.3, 2])
        x, y = rng.choice([0, rng.uniform(-3, 3)]), rng.choice([0, rng.uniform(-2, 2)])
        made.append((k, float(x), float(x + w), float(y), float(y + h)))
    rows = spark.createDataFrame(made, "k long, x0 double, x1 double, y0 double, y1 double").select("k", box("x0", "x1", "y0", "y1").alias("rings"))
    asked, own = rows.where("k < 150").withColumnRenamed("k", "loc"), rows.where("k >= 150").withColumnRenamed("k", "segnum")
    got = [tuple(r) for r in L.meeting_catchments(L.shapes(asked), own, 0.5).select("loc", "segnum").collect()]
    want = {(a[0], b[0]) for a in made[:150] for b in made[150:] if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    assert len(got) == len(set(got))
    assert set(got) == want
    nothing = L.meeting_catchments(L.shapes(asked.limit(0)), own, 0.5)
    assert nothing.columns == ["loc", "segnum", "kind", "points", "rings", "own"] and nothing.count() == 0


def test_narrow_polygons_do_not_share_a_bin(spark):
    """Of 2,000 boxes and 2,000 lines side by side in a bin of the given size, only neighbours are paired."""
    k = F.col("id").cast("double")
    cells = spark.range(2000).select(F.col("id").alias("segnum"), (k / 4096).alias("x0"), ((k + 1) / 4096).alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))
    lines = spark.range(2000).select(F.col("id").alias("loc"), F.array(G.xyz((k + 0.25) / 4096, F.lit(0.5)), G.xyz((k + 0.75) / 4096, F.lit(0.75))).alias("geometry"))
    found = L.meeting_catchments(L.shapes(lines), cells.select("segnum", box("x0", "x1", "y0", "y1").alias("rings")), 0.5)
    plan = found.select("loc", "segnum")._jdf.queryExecution().toString()
    assert "kx" in plan and "Deduplicate" not in plan
    assert sorted(map(tuple, found.select("loc", "segnum").collect())) == [(i, i) for i in range(2000)]


def test_many_rows_are_not_broadcast(spark):
    few, many = spark.range(100), spark.range(trees.MANY + 1)
    for rows, sent in ((few, True), (many, False)):
        table = trees.checkpointed(rows)
        joined = table.join(table.select(F.col("id").alias("other")), F.col("id") == F.col("other"))
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent
        assert joined.count() == rows.count()
    assert trees.checkpointed(few.where("id < 0")).count() == 0


def test_nearest_of_many_narrow_lines(spark):
    """Upright lines side by side, asked from far off, from above and from among them: few edges are left to be measured."""
    k, n = F.col("id").cast("double"), 3000
    lines = spark.range(n).select(F.col("id").alias("segnum"), F.array(G.xyz(k / 4096, F.lit(0.0)), G.xyz(k / 4096, F.lit(1.0))).alias("geometry"))
    at = [(0, 5.0, 0.5, 5.25, 0.75), (1, -3.0, 2.0, -3.0, 4.0), (2, 0.25, 1.5, 0.25, 2.0), (3, 0.1, 0.4, 0.1 + 1 / 16384, 0.4), (4, 0.2, 0.3, 0.2, 0.3), (5, 9.0, 9.0, 9.0, 9.0)]
    asked = spark.createDataFrame(at, "loc long, ax double, ay double, qx double, qy double")
    line = F.when(F.col("loc") < 4, F.array(G.xyz(F.col("ax"), F.col("ay")), G.xyz(F.col("qx"), F.col("qy")))).otherwise(F.array(G.xyz(F.col("ax"), F.col("ay"))))
    geoms = L.shapes(asked.select("loc", line.alias("geometry")))
    got = {r["loc"]: (r["segnum"], round(r["dist"], 9)) for r in L.nearest_shapes(geoms, lines).collect()}

    def plain(ax, ay, qx, qy):
        (x0, x1), y = sorted((ax, qx)), min(ay, qy)
        return min((round((max(x0 - s / 4096, s / 4096 - x1, 0) ** 2 + max(y - 1, 0) ** 2) ** 0.5, 9), s) for s in range(n))

    assert got == {loc: plain(*rest)[::-1] for loc, *rest in at}
    _, levels = L.edge_tree(L.edge_rows(lines))
    left = L.nearest_edges(L._boxed(geoms), levels).groupBy("loc").count().collect()
    assert len(left) == len(at) and max(r["count"] for r in left) <= 64


def test_shapes_that_are_alike_are_looked_up_once(spark):
    points = spark.range(40).select(F.col("id").alias("loc"), (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    ones, whose = L.of_each_shape(L.shapes(points))
    assert sorted(r["loc"] for r in ones.collect()) == [0, 1, 2]
    assert {(r["loc"], r["one"]) for r in whose.collect()} == {(i, i % 3) for i in range(40)}


def test_linked_ends_are_not_broadcast(spark):
    """Lines that are few bytes a row, whose ends are linked and held against the middle of others."""
    k = F.col("id").cast("double")
    lines = spark.range(50).select(F.col("id").alias("segnum"), F.col("id").alias("pos"), F.array(G.xyz(k, F.lit(0.0)), G.xyz(k, F.lit(4.0))).alias("geometry"))
    ends = N.endpoints(lines)
    links = N.downstream_links(ends)
    for found in (links, N.shared_starts(ends, links).select("segnum"), N.outlets_in_middle(lines, ends, links, size=1.0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
    plan = N.outlets_in_middle(lines, ends, links, size=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_narrow_boxes_of_a_patch_do_not_share_a_bin(spark):
    """sides 1 high and 1/512 apart, above a row of wider boxes, meet few corners each, and the outline is that of a plain count."""
    n = 512
    ring = lambda x0, x1, y0, y1: [{"x": x, "y": y, "z": None} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    shapes = [ring(k / n, (k + 1) / n, 1.0, 2.0) for k in range(n)] + [ring(k / 64, (k + 1) / 64, 0.0, 1.0) for k in range(64)]
    rows = spark.createDataFrame([(1, [s]) for s in shapes], "patch long, rings array<array<struct<x: double, y: double, z: double>>>")
    seen = []
    inner = rewrite._near_corners
    try:
        rewrite._near_corners = lambda sides: seen.append((sides, inner(sides))) or seen[-1][1]
        found = {tuple(r)[1:] for r in rewrite.outline(rows).collect()}
    finally:
        rewrite._near_corners = inner
    sides, pairs = seen[0]
    assert pairs.count() < 20 * sides.count()
    top, bottom = {(k / n, 2.0, (k + 1) / n, 2.0) for k in range(n)}, {(k / 64, 0.0, (k + 1) / 64, 0.0) for k in range(64)}
    assert found == top | bottom | {(x, y, x, y + 1) for x in (0.0, 1.0) for y in (0.0, 1.0)}


def test_a_cut_line_is_measured_once(spark):
    """F16: cuts, places and projections list the edges of a line once each, and are those of a plain walk."""
    line, start, end = F.col("line"), F.col("start"), F.col("end")
    place = F.struct(F.col("start").alias("x"), F.col("end").alias("y"))
    made = {"cut": G.substring(line, start, end), "at": G.interpolate(line, start), "near": G.project(line, place)}
    for name, column in made.items():
        assert str(column).count("zip_with") == 1, name
    rng = random.Random(3)
    rows = []
    for k in range(60):
        points = [(float(rng.randrange(4)), float(rng.randrange(4)), None) for _ in range(rng.randrange(1, 6))]
        rows.append((k, points, rng.choice([-0.5, 0.0, 0.25, 0.5, rng.random()]), rng.choice([0.25, 0.75, 1.0, 1.5, rng.random()])))
    rows.append((60, None, 0.25, 0.75))
    data = spark.createDataFrame(rows, "k int, line array<struct<x: double, y: double, z: double>>, start double, end double")
    got = data.where("k < 60").select("*", *[c.alias(n) for n, c in made.items() if n != "near"], G.distance_to_edges(G.edges(line), place).alias("dist")).collect()
    for r in got:
        p = [(q["x"], q["y"]) for q in r["line"]]
        steps = [math.dist(a, b) for a, b in zip(p, p[1:], strict=False)]
        total = sum(steps)

        def at(share, p=p, steps=steps, total=total):
            want, gone = min(max(share, 0.0), 1.0) * total, 0.0
            for a, b, n in zip(p, p[1:], steps, strict=False):
                if n > 0 and gone + n >= want:
                    return tuple(u + (v - u) * ((want - gone) / n) for u, v in zip(a, b, strict=True))
                gone += n
            return p[-1]

        ends = [sum(steps[: i + 1]) for i in range(len(steps))]
        inner = [b for b, e in zip(p[1:], ends, strict=True) if r["start"] * total < e < r["end"] * total]
        cut = [at(r["start"])] if r["start"] >= r["end"] else [at(r["start"]), *inner, at(r["end"])]
        assert [(q["x"], q["y"]) for q in r["cut"]] == [tuple(map(pytest.approx, q)) for q in cut]
        assert (r["at"]["x"], r["at"]["y"]) == tuple(map(pytest.approx, at(r["start"])))
        spot = (r["start"], r["end"])

        def away(a, b, spot=spot):
            square = math.dist(a, b) ** 2
            t = min(max(sum((s - u) * (v - u) for s, u, v in zip(spot, a, b, strict=True)) / square, 0.0), 1.0) if square else 0.0
            return math.dist(spot, [u + (v - u) * t for u, v in zip(a, b, strict=True)])

        near = min((away(a, b) for a, b in zip(p, p[1:], strict=False)), default=None)
        assert r["dist"] == (None if near is None else pytest.approx(near))
    empty = data.where("k = 60").select(made["at"].alias("at"), G.distance_to_edges(G.edges(line), place).alias("dist")).first()
    assert empty["at"] is None and empty["dist"] is None


def test_lists_of_one_place_are_made_by_several_tasks(spark):
    """Of 400 lines, half start at one place and four at another, the first of these at the end of a line: each headwater lists the others, and no task makes most of the lists."""
    place = lambda k: (0.0, 0.0) if k < 200 else (1.0, 0.0) if k < 204 else (float(k), 0.0)
    ends = [(k, *place(k), *((500.0, 0.0) if k else (1.0, 0.0))) for k in range(398)] + [(398, 7.0, 7.0, 8.0, 8.0), (399, None, None, 0.5, 0.5)]
    ends = spark.createDataFrame([(k, k, a, b, 0.0, c, d, 0.0) for k, a, b, c, d in ends], "segnum long, pos long, sx double, sy double, sz double, ex double, ey double, ez double")
    links = N.downstream_links(ends)
    downstream = {r["to_segnum"] for r in links.collect()}
    got = N.shared_starts(ends, links, listed=4000).withColumn("task", F.spark_partition_id()).collect()
    starts = {k: [j for j in range(204) if place(j) == place(k)] for k in range(204)}
    assert downstream == {200}
    assert {(r["segnum"], *r["others"]) for r in got} == {(k, *(j for j in starts[k] if j != k)) for k in starts if k not in downstream}
    assert len(got) == 203
    tasks = [sum(len(r["others"]) for r in got if r["task"] == t) for t in {r["task"] for r in got}]
    assert max(tasks) < sum(tasks) / 2
