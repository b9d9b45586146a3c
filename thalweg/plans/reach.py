"""Queries of shapes, cleaned reaches, model adaptors, elevations, rewrites and package files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import elevation as V
from thalweg.operators import export as E
from thalweg.operators import locate as L
from thalweg.operators import network as N
from thalweg.operators import overlay as O
from thalweg.operators import query as R
from thalweg.operators import reach_elevation as X
from thalweg.operators import rewrite as W
from thalweg.operators import sfr
from thalweg.operators.trees import checkpointed, shared_folder
from thalweg.plans import derived as D
from thalweg.plans import model as M
from thalweg.plans.graph import CLIMB, DOWN, FOREST, LINES, ORDERS, PART, joined, r6
from thalweg.sources import files


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{spark.sparkContext.applicationId}"


def _beside(spark: SparkSession, d: str, by: int) -> DataFrame:
    """Each line with the box, and each box with the box, of the segment ``by`` numbers on."""
    rings = D.supplier_rings(spark, d)
    return D.supplier_lines(spark, d).join(rings, "segnum").join(rings.select((F.col("segnum") - by).alias("segnum"), F.col("rings").alias("other")), "segnum")


def n9(spark: SparkSession, d: str) -> DataFrame:
    rings = _beside(spark, d, 1).select("segnum", F.col("other").alias("rings"))
    return N.beside_catchments(D.supplier_lines(spark, d), rings)


def g9_length(spark: SparkSession, d: str) -> DataFrame:
    return _beside(spark, d, 1).select("segnum", r6(G.length_inside(F.col("geometry"), F.col("other"))).alias("inside"))


def g9_area(spark: SparkSession, d: str) -> DataFrame:
    moved = F.transform("other", lambda ring: F.transform(ring, lambda p: G.xyz(p["x"] - 1 / 64, p["y"] + 0.25)))
    return _beside(spark, d, 1).select("segnum", r6(L._shared_area(F.col("rings"), moved)).alias("area"))


def g10(spark: SparkSession, d: str) -> DataFrame:
    return _beside(spark, d, 2).select("segnum", G.polygons_meet(F.col("rings"), F.col("other")).alias("meet"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = D.supplier_lines(spark, d).select("segnum", "geometry")
    return lines.join(lines.select((F.col("segnum") - 2).alias("segnum"), F.col("geometry").alias("other")), "segnum")


def g4(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("segnum", r6(G.lines_distance(F.col("geometry"), F.col("other"))).alias("dist"))


def g5(spark: SparkSession, d: str) -> DataFrame:
    spot = G.nearest_point(G.edges(F.col("geometry")), G.edges(F.col("other")))
    return _pairs(spark, d).withColumn("spot", spot).select("segnum", r6(G.project(F.col("other"), F.col("spot"))["dist"]).alias("dist"), r6(G.project(F.col("geometry"), F.col("spot"))["dist"]).alias("off"))


def g14(spark: SparkSession, d: str) -> DataFrame:
    rings = D.supplier_rings(spark, d)
    made = W.dissolved(rings, rings.select("segnum", F.expr("segnum div 2").alias("patch")))
    return made.select("segnum", r6(G.area(F.col("rings"))).alias("area"))


def j3_lines(spark: SparkSession, d: str) -> DataFrame:
    geoms = L.shapes(D.supplier_lines(spark, d).select(F.col("segnum").alias("loc"), "geometry"))
    return L.meeting_catchments(geoms, D.supplier_rings(spark, d), 0.5).select("loc", "segnum")


def j4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines moved half a unit, and the lines nearest to them."""
    moved = D.supplier_lines(spark, d).select(F.col("segnum").alias("loc"), F.transform("geometry", lambda p: G.xyz(p["x"] + 0.5, p["y"] + 0.3)).alias("geometry"))
    return L.nearest_shapes(L.shapes(moved), D.supplier_lines(spark, d)).groupBy("loc").agg(F.min(r6("dist")).alias("dist"))


def j5(spark: SparkSession, d: str) -> DataFrame:
    points = D.customer_points(spark, d).select(F.col("loc").alias("id"), "x", "y")
    return O.nearest_cell(points, M.GRID, M._cells(spark)).withColumnRenamed("id", "loc")


def j6_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around points, put to catchments and lines of sufficient order."""
    net = N.Network(M._network(spark, d).segments, 0, D.supplier_rings(spark, d))
    around = D.customer_points(spark, d)
    corner = lambda a, b: G.xyz(F.col("x") + a / 32, F.col("y") + b / 4)
    boxes = around.select("loc", F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))).alias("rings"))
    found = L.locate(net, boxes, min_stream_order=2, downstream_bias=0.1)
    return found.select("loc", "method", "segnum", r6("seg_ndist").alias("seg_ndist"), r6("dist_to_seg").alias("dist_to_seg"))


def j10(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    ends = X.segment_ends(E.segment_data(found, net), found, M._cells(spark))
    return ends.select(F.col("nseg").cast("long").alias("nseg"), "i_up", "j_up", "i_dn", "j_dn", "top_up", "top_dn", r6("seglen").alias("seglen"))


def m3(spark: SparkSession, d: str) -> DataFrame:
    """A grid with a column for each supplier and a row for each nation: widths by the part of a key, heights by another's."""
    sides = lambda name, key, by, most: [float(most + (r[0] * by) % 50) for r in D.read(spark, d, name).select(key).orderBy(key).collect()]
    grid = O.Grid.spaced(sides("supplier", "s_suppkey", 37, 100), sides("nation", "n_nationkey", 7, 60))
    box = grid.cells(spark).agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1"), F.count(F.lit(1)).alias("n"))
    return box.select(F.lit(grid.cell_size).alias("cell_size"), "x0", "x1", "y0", "y1", "n")


def m4(spark: SparkSession, d: str) -> DataFrame:
    """Overlay with a grid of uneven cells, measured by cell."""
    grid = O.Grid.spaced([0.25, 0.125, 0.375, 0.25], [4.0, 2.0, 1.0, 10.0], 0.0, -1.0)
    return O.overlay(D.supplier_lines(spark, d), grid).groupBy("i", "j").agg(F.round(F.sum("length"), 5).alias("length"))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    found, _ = O.reaches(M._network(spark, d), M.GRID, M._cells(spark), reach_include_fraction=0.8)
    return found.select("ridx", "segnum", "i", "j", "iseg", "ireach", r6("segndist").alias("segndist"), r6("rlen").alias("rlen"))


def m8(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    g = F.col("geometry")
    rows = O.with_geometry(found, net.segments)
    return rows.select("ridx", r6(G.first(g)["x"]).alias("x0"), r6(G.first(g)["y"]).alias("y0"), r6(G.last(g)["x"]).alias("x1"), r6(G.last(g)["y"]).alias("y1"), r6(G.length(g)).alias("length"))


def m11(spark: SparkSession, d: str) -> DataFrame:
    net = M._network(spark, d)
    cells = M._cells(spark)
    pieces = O.overlay(net.segments.select("segnum", "geometry"), M.GRID).join(cells.where("domain <> 0").select("i", "j"), ["i", "j"])
    return O.rescued(pieces, net, M.GRID, cells).select("segnum", "i", "j", r6("length").alias("length"))


def _diverted(spark: SparkSession, d: str) -> N.Network:
    """The supplier network, with every customer point a diversion from a segment given by its key."""
    n = D.read(spark, d, "supplier").count()
    div = D.customer_points(spark, d).select((F.col("loc") + 1).alias("divid"), (F.col("loc") % n + 1).alias("from_segnum"), "x", "y")
    return L.set_diversions(M._network(spark, d), div)


def _model(spark: SparkSession) -> sfr.Model:
    return sfr.Model(M.GRID, M._cells(spark).select("i", "j", "domain"), (31.0, 28.0), "2001-01-01 00:00:00")


def m16(spark: SparkSession, d: str) -> DataFrame:
    made = sfr.mf6(_diverted(spark, d), _model(spark), reach_include_fraction=None)
    first = made.diversions.agg(F.min("iconr").alias("first"))
    return made.diversions.crossJoin(F.broadcast(first)).select("divid", "from_segnum", "idv", (F.col("iconr") - F.col("first")).alias("place"))


def m16_links(spark: SparkSession, d: str) -> DataFrame:
    made = sfr.mf6(_diverted(spark, d), _model(spark), reach_include_fraction=None)
    rows = made.reaches.join(made.links, "ridx")
    return rows.select("ridx", "to_ridx", "segnum", "diversion", "mask", "ustrf")


def r4(spark: SparkSession, d: str) -> DataFrame:
    """The next reach of every reach by segment numbers."""
    net, found, _ = M._reaches(spark, d)
    return R.classic_links(found, E.segment_data(found, net)).select("ridx", "to_ridx")


def r4_route(spark: SparkSession, d: str) -> DataFrame:
    """The way from the first reach of the first segment to the reach that it ends in."""
    net, found, _ = M._reaches(spark, d)
    links = checkpointed(R.classic_links(found, E.segment_data(found, net)))
    return R.route_reaches(links, 1, R.last_reach(links, 1))


def m17(spark: SparkSession, d: str) -> DataFrame:
    made = sfr.mf2005(_diverted(spark, d), _model(spark), reach_include_fraction=None)
    data = E.segment_data(made.reaches, made.network)
    return data.select(F.col("nseg").cast("long").alias("nseg"), "segnum", F.coalesce("divid", F.lit(0)).alias("divid"), F.col("outseg").cast("long").alias("outseg"), F.col("iupseg").cast("long").alias("iupseg"))


def _tall(spark: SparkSession, d: str) -> N.Network:
    net = M._network(spark, d)
    return N.Network(net.segments.withColumn("geometry", F.transform("geometry", lambda p: G.xyz(p["x"], p["y"], p["y"] * 2))), 0)


def v4_auto(spark: SparkSession, d: str) -> DataFrame:
    net = _tall(spark, d)
    _, found, _ = M._reaches(spark, d)
    rows = O.with_geometry(found, net.segments)
    return O.reach_slope(rows, "auto", segments=net.segments).select("ridx", r6("slope").alias("slope"))


def v7(spark: SparkSession, d: str) -> DataFrame:
    net, found, marked = M._reaches(spark, d)
    data, _ = V.default_segment_data(net, marked, found, E.segment_data(found, net), M._cells(spark), hyd_cond1=2.0, hyd_cond_out=20.0, width1=2.0, width_out=4.0)
    return data.select(F.col("nseg").cast("long").alias("nseg"), "icalc", "hcond1", "hcond2", "thickm1", "width1", "width2", "roughch", "elevup", "elevdn")


def _bottoms(spark: SparkSession) -> list[DataFrame]:
    cells = M._cells(spark)
    return [cells.select("i", "j", (F.col("value") - 2.0 - 3.0 * k).alias("value")) for k in range(2)]


def v8(direction: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        net, found, _ = M._reaches(spark, d)
        rows = found.join(O.reach_array(found, M._cells(spark)).withColumnRenamed("value", "rtp"), "ridx").withColumn("rbth", F.lit(1.0))
        made = X.fix_reach_elevations(rows, checkpointed(R.reach_links(found, net)), net.segments, M._cells(spark), _bottoms(spark), direction=direction)
        return made.select("ridx", r6("rtp").alias("rtp"), r6(F.col("bots")[0]).alias("bot1"), r6(F.col("bots")[1]).alias("bot2"))

    return run


def v9(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    made = X.lower_to_next(found.select("ridx", "i", "j"), checkpointed(R.reach_links(found, net)), M._cells(spark), _bottoms(spark), spacing=M.GRID.cell_size, min_slope=0.01)
    return made.select("ridx", r6("rtp").alias("rtp"), r6("top").alias("top"))


def _segments_fixed(spark: SparkSession, d: str):
    net, found, marked = M._reaches(spark, d)
    top = M._cells(spark)
    data, rows = V.default_segment_data(net, marked, found, E.segment_data(found, net), top)
    return rows, X.fix_segment_elevations(data, found, top), top


def v11(spark: SparkSession, d: str) -> DataFrame:
    _, data, _ = _segments_fixed(spark, d)
    return data.select(F.col("nseg").cast("long").alias("nseg"), r6("elevup").alias("elevup"), r6("elevdn").alias("elevdn"), r6("diff_up").alias("diff_up"))


def v13(spark: SparkSession, d: str) -> DataFrame:
    rows, data, top = _segments_fixed(spark, d)
    made = X.fix_reaches_by_segment(rows, checkpointed(data), top, _bottoms(spark))
    return made.select("ridx", r6("rtp").alias("rtp"), r6(F.col("bots")[0]).alias("bot1"))


def _heap(spark: SparkSession, d: str) -> N.Network:
    return N.Network(D.part_heap(spark, d).select("segnum", "to_segnum", "pos", F.col("value").alias("upstream_length")))


def a4_paths(spark: SparkSession, d: str) -> DataFrame:
    table = W.aggregate_table(_heap(spark, d), spark.createDataFrame([(1,), (5,), (6,), (23,)], "segnum long"))
    return table.select("segnum", F.size("agg_patch").cast("long").alias("patch"), joined(F.col("agg_path")).alias("agg_path"), joined(F.col("agg_unpath")).alias("agg_unpath"))


def a4_network(spark: SparkSession, d: str) -> DataFrame:
    net = M._network(spark, d)
    length = net.segments.select("segnum", F.lit(1.0).alias("upstream_length"))
    whole = N.Network(net.segments.join(length, "segnum"), 0, D.supplier_rings(spark, d))
    made = W.aggregate(whole, spark.createDataFrame([(1,), (5,), (6,)], "segnum long"))
    return made.segments.select("segnum", "to_segnum", r6(G.length(F.col("geometry"))).alias("length"), r6("upstream_area").alias("upstream_area"))


def a5_catchments(spark: SparkSession, d: str) -> DataFrame:
    net = M._network(spark, d)
    made = W.coarsen(N.Network(net.segments, 0, D.supplier_rings(spark, d)), 2)
    return made.segments.select("segnum", F.size("catchment_segnums").cast("long").alias("n"), r6("upstream_area").alias("upstream_area"))


def p4(spark: SparkSession, d: str) -> DataFrame:
    made = M._network(spark, d).with_catchments(D.supplier_rings(spark, d))
    return made.segments.select("segnum", r6("upstream_area").alias("upstream_area"), r6("width").alias("width"))


def p19(spark: SparkSession, d: str) -> DataFrame:
    data = D.read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3 + 1).alias("code"))
    both = E.by_period(E.inverted(data, "s_suppkey", "code"), [0, 1])
    return both.select(F.col("kper").cast("long").alias("kper"), "s_suppkey", "code")


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    n = D.read(spark, d, "supplier").count()
    return D.read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("kper"), (F.col("l_suppkey") % n + 1).alias("key")).agg(F.sum("l_quantity").cast("double").alias("value"))


def p21(spark: SparkSession, d: str) -> DataFrame:
    data = _yearly(spark, d).withColumnRenamed("key", "nseg").withColumnRenamed("value", "flow").withColumn("runoff", F.col("flow") / 2)
    years = [r[0] for r in data.select("kper").distinct().orderBy("kper").collect()]
    back = E.long_by_period(E.wide_by_period(data, years)).where("flow IS NOT NULL")
    return back.select(F.col("kper").cast("long").alias("kper"), "nseg", r6("flow").alias("flow"), r6("runoff").alias("runoff"))


def e3(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    data = E.segment_data(found, net)
    data, _ = E.set_segment_values(data, None, "inflow", D.read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("key"), F.lit(None).cast("int").alias("kper"), F.abs("s_acctbal").alias("value")))
    _, series = E.set_segment_values(data, None, "abstraction", _yearly(spark, d))
    _, series = E.set_segment_values(data, series, "abstraction", _yearly(spark, d).where("kper = 1995").withColumn("value", F.col("value") * 10))
    rows = series.join(data.select("nseg", "segnum", "inflow"), "nseg")
    return rows.select("segnum", F.col("kper").cast("long").alias("kper"), r6("value").alias("value"), r6("inflow").alias("inflow"))


def e9(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    return E.reach_data(found.withColumn("strtop", F.lit(1.5)).withColumn("other", F.lit(1))).select("*").withColumn("rchlen", r6("rchlen"))


def s4(spark: SparkSession, d: str) -> DataFrame:
    path = f"{folder(spark)}/series"
    D.monthly_flows(spark, d).withColumn("nrun", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("flow", F.col("flow") + F.col("nrun")).write.mode("overwrite").parquet(path)
    made = files.read_long_series(spark, path, time="month", key="segnum", value="flow", mult=86.4, run=1)
    return made.select(F.col("month").cast("date").cast("string").alias("month"), "segnum", r6("flow").alias("flow"))


def s8(spark: SparkSession, d: str) -> DataFrame:
    net = D.network_of(D.supplier_forest(spark, d))
    flat = files.flat_columns(net.segments.select("segnum", "from_segnums", "num_to_outlet", "stream_order", (F.col("segnum") % 2 == 0).alias("in_model")))
    return flat.select("segnum", "from_seg", F.col("num_to_out").cast("long").alias("num_to_out"), F.col("strm_order").cast("long").alias("strm_order"), F.col("in_model").cast("long").alias("in_model"))


def s10(spark: SparkSession, d: str) -> DataFrame:
    path = f"{folder(spark)}/model"
    files.save_model(sfr.mf6(M._network(spark, d), _model(spark), reach_include_fraction=None), path)
    made = files.load_model(spark, path)
    return made.reaches.join(made.links, "ridx").select("segnum", "i", "j", r6("rlen").alias("rlen"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), " +", " ").alias("line"))


def s12(spark: SparkSession, d: str) -> DataFrame:
    full, links, div = M._packaged(spark, d)
    path = f"{folder(spark)}/packagedata.dat"
    rows = E.package_data(full, links, div)
    files.write_package_data(rows.select("ridx", "k", "i", "j", "rwid", "rtp", "ncon", "ndv"), path)
    return _lines(spark, path)


def s14(spark: SparkSession, d: str) -> DataFrame:
    *_, div = M._packaged(spark, d)
    path = f"{folder(spark)}/diversions.dat"
    files.write_diversions(E.number_diversions(div), path)
    return _lines(spark, path)


def s16(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    rows = E.package_period(found.withColumn("elev", F.lit(100) - F.col("i")).withColumn("cond", F.col("j") * 2), "drn")
    path = f"{folder(spark)}/drn_{{:02d}}.dat"
    files.write_periods(rows, path, header=False)
    return _lines(spark, path.format(1))


QUERIES = {
    "N9_beside_catchment": n9, "G4_distance": g4, "G5_nearest_point": g5, "G9_length_inside": g9_length, "G9_shared_area": g9_area, "G10_intersects": g10, "G14_dissolve": g14,
    "J3_catchment_lines": j3_lines, "J4_nearest_lines": j4_lines, "J5_nearest_cell": j5, "J6_locate_shapes": j6_shapes, "J10_segment_ends": j10, "M3_cell_size": m3, "M4_uneven_grid": m4,
    "M5_M7_cleaned_reaches": cleaned, "M8_reach_geometry": m8, "M11_confluence_rescue": m11, "M16_mf6_diversions": m16, "M16_mf6_links": m16_links, "M17_mf2005_segments": m17, "R4_classic_links": r4, "R4_classic_route": r4_route,
    "V4_slope_auto": v4_auto, "V7_default_segment_data": v7, "V8_reach_elevations": v8("downstream"), "V8_reach_elevations_both": v8("both"), "V9_lower_to_next": v9, "V11_fix_segments": v11,
    "V13_reaches_by_segment": v13, "A4_aggregate_paths": a4_paths, "A4_aggregate_network": a4_network, "A5_coarsen_catchments": a5_catchments, "P4_set_catchments": p4, "P19_inverted_by_period": p19,
    "P21_wide_by_period": p21, "E3_segment_values": e3, "E9_reach_data": e9, "S4_long_series": s4, "S8_flat_columns": s8, "S10_saved_model": s10, "S12_package_file": s12, "S14_diversion_file": s14, "S16_period_file": s16,
}

_RINGS = f"ring AS (SELECT s_suppkey + 1 AS segnum, {M._RING} - 0.5::DOUBLE / (1 << (length(bin(s_suppkey + 1)) - 1)) AS x0, {M._RING} + 0.5::DOUBLE / (1 << (length(bin(s_suppkey + 1)) - 1)) AS x1, length(bin(s_suppkey + 1)) - 1.5::DOUBLE AS y0, length(bin(s_suppkey + 1)) - 0.5::DOUBLE AS y1 FROM supplier)"
#: Share of each edge ``e`` within a box ``r``, from ``t0`` to ``t1``; empty where t1 < t0.
_IN = """t0 AS (SELECT e.segnum, e.k, r.segnum AS ring, e.len,
  greatest(0, CASE WHEN qx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - ax) / (qx - ax), (x1 - ax) / (qx - ax)) END, CASE WHEN qy = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - ay) / (qy - ay), (y1 - ay) / (qy - ay)) END) AS a,
  least(1, CASE WHEN qx = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 1 ELSE -1 END ELSE greatest((x0 - ax) / (qx - ax), (x1 - ax) / (qx - ax)) END, CASE WHEN qy = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 1 ELSE -1 END ELSE greatest((y0 - ay) / (qy - ay), (y1 - ay) / (qy - ay)) END) AS b
  FROM edge e, ring r)"""
_PE = "sqrt(pow({p}x - ({a}ax + ({a}qx - {a}ax) * least(greatest((({p}x - {a}ax) * ({a}qx - {a}ax) + ({p}y - {a}ay) * ({a}qy - {a}ay)) / (pow({a}qx - {a}ax, 2) + pow({a}qy - {a}ay, 2)), 0), 1)), 2) + pow({p}y - ({a}ay + ({a}qy - {a}ay) * least(greatest((({p}x - {a}ax) * ({a}qx - {a}ax) + ({p}y - {a}ay) * ({a}qy - {a}ay)) / (pow({a}qx - {a}ax, 2) + pow({a}qy - {a}ay, 2)), 0), 1)), 2))"


def _edge_gap(e: str, f: str) -> str:
    """SQL of the distance between two edges: 0 if they cross, else the least of their ends' distances."""
    side = lambda a, p: f"sign(({a}.qx - {a}.ax) * ({p[0]} - {a}.ay) - ({a}.qy - {a}.ay) * ({p[1]} - {a}.ax))"
    ends = lambda a: ((f"{a}.ay", f"{a}.ax"), (f"{a}.qy", f"{a}.qx"))
    cross = " AND ".join(f"{side(x, ends(y)[0])} * {side(x, ends(y)[1])} <= 0" for x, y in ((e, f), (f, e)))
    gaps = []
    for p, a in ((e, f), (f, e)):
        for u in ("a", "q"):
            gaps.append(_PE.replace("{p}x", f"{p}.{u}x").replace("{p}y", f"{p}.{u}y").replace("{a}", f"{a}."))
    return f"CASE WHEN {cross} THEN 0 ELSE least({', '.join(gaps)}) END"


def _aggregated(given: str, worth: str) -> str:
    """CTEs of a network ``net`` aggregated at the ``given`` junctions: junction, patch, path (``j, segnum, d``) and what lies beside it (``un``)."""
    return f"""{DOWN}, given AS (SELECT unnest([{given}])::BIGINT AS segnum), traced AS (SELECT DISTINCT segnum FROM down WHERE start IN (SELECT segnum FROM given)),
fork AS (SELECT t.segnum AS node, bool_or(n.segnum IN (SELECT segnum FROM given)) AS g, count(*) FILTER (n.segnum IN (SELECT segnum FROM traced)) AS t FROM traced t JOIN net n ON n.to_segnum = t.segnum GROUP BY t.segnum),
junction AS MATERIALIZED (SELECT segnum FROM given UNION SELECT n.segnum FROM net n JOIN fork f ON f.node = n.to_segnum WHERE (f.g AND n.segnum NOT IN (SELECT segnum FROM traced)) OR (f.t > 1 AND n.segnum IN (SELECT segnum FROM traced))),
patch AS MATERIALIZED (SELECT start AS segnum, segnum AS patch FROM down WHERE segnum IN (SELECT segnum FROM junction) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth) = 1),
inner_ AS MATERIALIZED (SELECT DISTINCT p.patch FROM junction j JOIN net n ON n.segnum = j.segnum JOIN patch p ON p.segnum = n.to_segnum),
best AS MATERIALIZED (SELECT n.segnum, n.to_segnum FROM net n JOIN patch p ON p.segnum = n.segnum WHERE n.segnum NOT IN (SELECT segnum FROM junction) AND (p.patch NOT IN (SELECT patch FROM inner_) OR n.segnum IN (SELECT segnum FROM traced)) QUALIFY row_number() OVER (PARTITION BY n.to_segnum ORDER BY {worth} DESC, n.segnum) = 1),
path AS (SELECT segnum AS j, segnum, 0 AS d FROM junction UNION ALL SELECT p.j, b.segnum, p.d + 1 FROM path p JOIN best b ON b.to_segnum = p.segnum),
un AS (SELECT p.j, p.d, n.segnum FROM path p JOIN net n ON n.to_segnum = p.segnum WHERE n.segnum NOT IN (SELECT q.segnum FROM path q WHERE q.j = p.j))"""


_GAPS = f"gap AS (SELECT e.segnum, min({_edge_gap('e', 'f')}) AS dist FROM edge e JOIN edge f ON f.segnum = e.segnum + 2 GROUP BY e.segnum)"
_AREAS = "area AS (SELECT s_suppkey + 1 AS segnum, 1.0::DOUBLE / (1 << (length(bin(s_suppkey + 1)) - 1)) AS a FROM supplier)"
_DIV = "dv AS (SELECT loc + 1 AS divid, loc % (SELECT count(*) FROM supplier) + 1 AS from_segnum, x, y FROM point), mine AS (SELECT * FROM dv WHERE from_segnum IN (SELECT segnum FROM reach))"
#: Reaches one after the other within segments, then the first of the segment that the last flows into.
_CLASSIC = """outs AS (SELECT DISTINCT r.iseg, (SELECT min(b.iseg) FROM reach b WHERE b.segnum = n.to_segnum) AS outseg FROM reach r JOIN net n USING (segnum)),
classic AS MATERIALIZED (SELECT r.ridx, coalesce(lead(r.ridx) OVER (PARTITION BY r.iseg ORDER BY r.ireach), (SELECT min_by(b.ridx, b.ireach) FROM reach b JOIN outs o ON o.outseg = b.iseg WHERE o.iseg = r.iseg), 0) AS to_ridx FROM reach r)"""
#: Segments of the model with the ends that they start from, and all waves over them, one after the other.
_SEGS = """segs AS MATERIALIZED (SELECT r.iseg::BIGINT AS nseg, coalesce((SELECT min(b.iseg) FROM reach b WHERE b.segnum = n.to_segnum), 0)::BIGINT AS outseg, min_by(c.value, r.ireach) AS top_up, max_by(c.value, r.ireach) AS top_dn, sum(r.rlen) AS seglen
FROM reach r JOIN cell c USING (i, j) JOIN net n USING (segnum) GROUP BY r.iseg, n.to_segnum),
w AS (SELECT 0 AS w, s.nseg, s.outseg, s.top_up - 0.2::DOUBLE AS up, s.top_dn - 0.2::DOUBLE AS dn, s.seglen * greatest((s.top_up - s.top_dn) / (10 * s.seglen), 1e-4::DOUBLE) AS fall, t.top_up - 0.2::DOUBLE AS given, s.nseg NOT IN (SELECT outseg FROM segs) AS live FROM segs s LEFT JOIN segs t ON t.nseg = s.outseg
UNION ALL (WITH h AS (SELECT a.*, CASE WHEN NOT a.live THEN a.dn WHEN a.outseg > 0 THEN least(b.up, a.up - a.fall) ELSE least(a.dn, a.up - a.fall) END AS held FROM w a LEFT JOIN w b ON b.nseg = a.outseg WHERE (SELECT bool_or(live) FROM w)),
g AS (SELECT outseg AS nseg, min(CASE WHEN live THEN held - 0.001::DOUBLE ELSE given END) AS up, bool_or(live) AS live FROM h WHERE outseg > 0 GROUP BY outseg)
SELECT h.w + 1, h.nseg, h.outseg, coalesce(g.up, h.up), h.held, h.fall, CASE WHEN h.live AND h.outseg > 0 THEN h.held - 0.001::DOUBLE ELSE h.given END, coalesce(g.live, false) FROM h LEFT JOIN g USING (nseg)))"""
_STRETCH = f"""stretch AS (SELECT r.segnum, r.ridx, s.ux AS ax, s.uy AS ay, s.vx AS qx, s.vy AS qy FROM reach r JOIN spot s ON s.segnum = r.segnum AND s.piece = r.piece UNION ALL SELECT x.segnum, 1000000 + x.segnum, e.ax, e.ay, e.qx, e.qy FROM extra x JOIN edge e ON e.segnum = x.segnum WHERE e.k = 0),
hit AS (SELECT divid, from_segnum, ridx, min({M._DIST}) AS dist FROM (SELECT d.divid, d.from_segnum, d.x, d.y, t.*, {M._SHARE} AS t FROM dv d JOIN stretch t ON t.segnum = d.from_segnum) GROUP BY divid, from_segnum, ridx),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY divid ORDER BY round(dist, 9), ridx DESC) = 1)"""
_RESCUED = """lens AS (SELECT segnum, sum(len) AS len FROM edge GROUP BY segnum), fed AS (SELECT m.segnum FROM inmod m JOIN inmod o ON o.to_segnum = m.segnum AND o.in_model WHERE NOT m.in_model GROUP BY m.segnum HAVING count(*) > 1), extra AS (SELECT f.segnum, c.i, c.j, round(least(n.len, (0.125::DOUBLE + 0.5) / 2), 6) AS length FROM fed f JOIN line l USING (segnum) JOIN lens n USING (segnum), cell c WHERE c.domain <> 0
QUALIFY row_number() OVER (PARTITION BY f.segnum ORDER BY sqrt(pow(greatest(x0 - sx, sx - x1, 0), 2) + pow(greatest(y0 - sy, sy - y1, 0), 2)), c.i, c.j) = 1)"""

ORACLES = {
    "N9_beside_catchment": f"WITH {LINES}, {M._EDGES}, {_RINGS}, {_IN} SELECT segnum FROM t0 WHERE ring = segnum + 1 GROUP BY segnum HAVING NOT bool_or(a <= b)",
    "G4_distance": f"WITH {LINES}, {M._EDGES}, {_GAPS} SELECT segnum, round(dist, 6) AS dist FROM gap",
    "G5_nearest_point": f"WITH {LINES}, {M._EDGES}, {_GAPS} SELECT segnum, round(dist, 6) AS dist, 0.0::DOUBLE AS off FROM gap",
    "G9_length_inside": f"WITH {LINES}, {M._EDGES}, {_RINGS}, {_IN} SELECT segnum, round(sum(greatest(b - a, 0) * len), 6) AS inside FROM t0 WHERE ring = segnum + 1 GROUP BY segnum",
    "G9_shared_area": f"WITH {_RINGS} SELECT a.segnum, round(greatest(least(a.x1, b.x1 - 1 / 64.0::DOUBLE) - greatest(a.x0, b.x0 - 1 / 64.0::DOUBLE), 0) * greatest(least(a.y1, b.y1 + 0.25::DOUBLE) - greatest(a.y0, b.y0 + 0.25::DOUBLE), 0), 6) AS area FROM ring a JOIN ring b ON b.segnum = a.segnum + 1",
    "G10_intersects": f"WITH {_RINGS} SELECT a.segnum, a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS meet FROM ring a JOIN ring b ON b.segnum = a.segnum + 2",
    "G14_dissolve": f"WITH {_AREAS} SELECT segnum // 2 AS segnum, round(sum(a), 6) AS area FROM area GROUP BY segnum // 2",
    "J3_catchment_lines": f"WITH {LINES}, {M._EDGES}, {_RINGS}, {_IN} SELECT segnum AS loc, ring AS segnum FROM t0 GROUP BY segnum, ring HAVING bool_or(a <= b)",
    "J4_nearest_lines": f"WITH {LINES}, {M._EDGES}, moved AS (SELECT segnum, ax + 0.5::DOUBLE AS ax, ay + 0.3::DOUBLE AS ay, qx + 0.5::DOUBLE AS qx, qy + 0.3::DOUBLE AS qy FROM edge) SELECT e.segnum AS loc, round(min({_edge_gap('e', 'f')}), 6) AS dist FROM moved e, edge f GROUP BY e.segnum",
    "J5_nearest_cell": f"WITH {M._CELLS}, {M._POINTS} SELECT loc, i, j FROM point, cell WHERE domain <> 0 QUALIFY row_number() OVER (PARTITION BY loc ORDER BY sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)), i, j) = 1",
    "J10_segment_ends": f"WITH RECURSIVE {M._REACH} SELECT r.iseg::BIGINT AS nseg, min_by(r.i, r.ireach) AS i_up, min_by(r.j, r.ireach) AS j_up, max_by(r.i, r.ireach) AS i_dn, max_by(r.j, r.ireach) AS j_dn, min_by(c.value, r.ireach) AS top_up, max_by(c.value, r.ireach) AS top_dn, round(sum(r.rlen), 6) AS seglen FROM reach r JOIN cell c USING (i, j) GROUP BY r.iseg",
    "M3_cell_size": "WITH c AS (SELECT 100.0::DOUBLE + (s_suppkey * 37) % 50 AS w FROM supplier), r AS (SELECT 60.0::DOUBLE + (n_nationkey * 7) % 50 AS h FROM nation) SELECT ((SELECT median(w) FROM c) + (SELECT median(h) FROM r)) / 2 AS cell_size, 0.0::DOUBLE AS x0, (SELECT sum(w) FROM c) AS x1, 0.0::DOUBLE AS y0, (SELECT sum(h) FROM r) AS y1, (SELECT count(*) FROM c, r) AS n",
    "M4_uneven_grid": f"""WITH {LINES}, {M._EDGES}, cols AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.25::DOUBLE), (1, 0.25, 0.375), (2, 0.375, 0.75), (3, 0.75, 1.0)) c(j, x0, x1)), rows_ AS (SELECT * FROM (VALUES (0, 12.0::DOUBLE, 16.0::DOUBLE), (1, 10.0, 12.0), (2, 9.0, 10.0), (3, -1.0, 9.0)) r(i, y0, y1)),
ring AS (SELECT i * 10 + j AS segnum, * FROM cols, rows_), {_IN}, own AS (SELECT *, row_number() OVER (PARTITION BY segnum, k, a, b ORDER BY ring) AS rn FROM t0 WHERE b > a)
SELECT (ring // 10)::INTEGER AS i, (ring % 10)::INTEGER AS j, round(sum((b - a) * len), 5) AS length FROM own WHERE rn = 1 GROUP BY ring""",
    "M8_reach_geometry": f"WITH RECURSIVE {M._REACH} SELECT r.ridx, round(min_by(s.ux, s.start), 6) AS x0, round(min_by(s.uy, s.start), 6) AS y0, round(max_by(s.vx, s.stop), 6) AS x1, round(max_by(s.vy, s.stop), 6) AS y1, round(any_value(r.rlen), 6) AS length FROM reach r JOIN spot s ON s.segnum = r.segnum AND s.piece = r.piece GROUP BY r.ridx",
    "M11_confluence_rescue": f"WITH RECURSIVE {M._REACH}, {_RESCUED} SELECT segnum, i, j, length FROM extra",
    "M16_mf6_diversions": f"""WITH RECURSIVE {M._REACH}, {M._POINTS}, {_DIV}, {_RESCUED}, {_STRETCH}
SELECT divid, from_segnum, (row_number() OVER (PARTITION BY ridx ORDER BY divid))::INTEGER AS idv, row_number() OVER (ORDER BY divid) - 1 AS place FROM best""",
    "M17_mf2005_segments": f"""WITH RECURSIVE {M._REACH}, {M._POINTS}, {_DIV}, fed AS (SELECT m.segnum FROM inmod m JOIN inmod o ON o.to_segnum = m.segnum AND o.in_model WHERE NOT m.in_model GROUP BY m.segnum HAVING count(*) > 1),
segs AS (SELECT segnum FROM reach UNION SELECT segnum FROM fed), num AS (SELECT s.segnum, row_number() OVER (ORDER BY q.sequence) AS nseg FROM segs s JOIN seq q USING (segnum)), dm AS (SELECT * FROM dv WHERE from_segnum IN (SELECT segnum FROM segs))
SELECT a.nseg, a.segnum, 0::BIGINT AS divid, coalesce(b.nseg, 0) AS outseg, 0::BIGINT AS iupseg FROM num a JOIN net n USING (segnum) LEFT JOIN num b ON b.segnum = n.to_segnum
UNION ALL SELECT (SELECT max(nseg) FROM num) + row_number() OVER (ORDER BY divid), 0, divid, 0, u.nseg FROM dm JOIN num u ON u.segnum = dm.from_segnum""",
    "M16_mf6_links": f"""WITH RECURSIVE {M._REACH}, {M._POINTS}, {_DIV}, {_RESCUED}, {_STRETCH}, {DOWN},
own AS (SELECT row_number() OVER (ORDER BY q.sequence, a.segndist) AS ridx, a.segnum, a.old FROM (SELECT segnum, segndist, ridx AS old FROM reach UNION ALL SELECT segnum, 0, 1000000 + segnum FROM extra) a JOIN seq q USING (segnum)),
firsts AS (SELECT segnum, min(ridx) AS first FROM own GROUP BY segnum),
olink AS MATERIALIZED (SELECT r.ridx, r.segnum, coalesce(lead(r.ridx) OVER (PARTITION BY r.segnum ORDER BY r.ridx), (SELECT f.first FROM down d JOIN firsts f USING (segnum) WHERE d.start = r.segnum AND d.depth > 0 ORDER BY d.depth LIMIT 1), 0) AS to_ridx FROM own r),
taken AS (SELECT DISTINCT o.ridx FROM best b JOIN own o ON o.old = b.ridx), n AS (SELECT (SELECT max(ridx) FROM own) AS own, (SELECT count(*) FROM best) AS div),
copy AS (SELECT l.ridx AS of, l.segnum, n.own + n.div + row_number() OVER (ORDER BY l.ridx) AS ridx FROM olink l JOIN taken USING (ridx), n WHERE l.to_ridx = 0),
final AS MATERIALIZED (SELECT l.ridx, coalesce(c.ridx, l.to_ridx) AS to_ridx, l.segnum, false AS diversion, false AS mask FROM olink l LEFT JOIN copy c ON c.of = l.ridx UNION ALL SELECT n.own + row_number() OVER (ORDER BY divid), 0, 0, true, false FROM best, n UNION ALL SELECT ridx, 0, segnum, false, true FROM copy)
SELECT ridx, to_ridx, segnum, diversion, mask, CASE WHEN ridx IN (SELECT to_ridx FROM final) THEN 1.0 ELSE 0.0 END::DOUBLE AS ustrf FROM final""",
    "S8_flat_columns": f"WITH RECURSIVE {FOREST}, {CLIMB}, {ORDERS} SELECT l.segnum, coalesce((SELECT string_agg(n.segnum::VARCHAR, ',' ORDER BY n.segnum) FROM net n WHERE n.to_segnum = l.segnum), '') AS from_seg, l.num::BIGINT AS num_to_out, l.so::BIGINT AS strm_order, (l.segnum % 2 = 0)::BIGINT AS in_model FROM levels l",
    "V4_slope_auto": f"WITH RECURSIVE {M._REACH} SELECT r.ridx, round(greatest(2 * (min_by(s.uy, s.start) - max_by(s.vy, s.stop)) / any_value(r.rlen), 0.001), 6) AS slope FROM reach r JOIN spot s ON s.segnum = r.segnum AND s.piece = r.piece GROUP BY r.ridx",
    "V7_default_segment_data": f"WITH RECURSIVE {M._REACH} SELECT r.iseg::BIGINT AS nseg, 1 AS icalc, 2.0::DOUBLE AS hcond1, CASE WHEN n.to_segnum = 0 THEN 20.0 ELSE 2.0 END::DOUBLE AS hcond2, 1.0::DOUBLE AS thickm1, 2.0::DOUBLE AS width1, CASE WHEN n.to_segnum = 0 THEN 4.0 ELSE 2.0 END::DOUBLE AS width2, 0.024::DOUBLE AS roughch, min_by(c.value, r.ireach) AS elevup, max_by(c.value, r.ireach) AS elevdn FROM reach r JOIN cell c USING (i, j) JOIN net n USING (segnum) GROUP BY r.iseg, n.to_segnum",
    "R4_classic_links": f"WITH RECURSIVE {M._REACH}, {_CLASSIC} SELECT ridx, to_ridx FROM classic",
    "R4_classic_route": f"WITH RECURSIVE {M._REACH}, {_CLASSIC}, way AS (SELECT 1::BIGINT AS ridx, 0::BIGINT AS step UNION ALL SELECT c.to_ridx, w.step + 1 FROM way w JOIN classic c USING (ridx) WHERE c.to_ridx <> 0) SELECT step, ridx FROM way",
    "V11_fix_segments": f"WITH RECURSIVE {M._REACH}, {_SEGS} SELECT nseg, round(up, 6) AS elevup, round(dn, 6) AS elevdn, round(top_up - up, 6) AS diff_up FROM w JOIN segs USING (nseg) WHERE w = (SELECT max(w) FROM w)",
    "A4_aggregate_paths": f"""WITH RECURSIVE {PART}, {_aggregated("1, 5, 6, 23", "n.value")}
SELECT j.segnum, (SELECT count(*) FROM patch WHERE patch = j.segnum) AS patch, (SELECT string_agg(segnum::VARCHAR, ',' ORDER BY d) FROM path p WHERE p.j = j.segnum) AS agg_path, coalesce((SELECT string_agg(segnum::VARCHAR, ',' ORDER BY d, segnum) FROM un WHERE un.j = j.segnum), '') AS agg_unpath FROM junction j""",
    "A4_aggregate_network": f"""WITH RECURSIVE {LINES}, {M._NET}, {M._EDGES}, {_AREAS}, lens AS (SELECT segnum, sum(len) AS len FROM edge GROUP BY segnum), {_aggregated("1, 5, 6", "1")}
SELECT j.segnum, coalesce(p.patch, 0) AS to_segnum, (SELECT round(sum(l.len), 6) FROM path w JOIN lens l ON l.segnum = w.segnum WHERE w.j = j.segnum) AS length, (SELECT round(sum(a.a), 6) FROM down d JOIN area a ON a.segnum = d.start WHERE d.segnum = j.segnum) AS upstream_area
FROM junction j JOIN net n USING (segnum) LEFT JOIN patch p ON p.segnum = n.to_segnum""",
    "S10_saved_model": f"""WITH RECURSIVE {M._REACH}, {_RESCUED} SELECT segnum, i, j, round(rlen, 6) AS rlen FROM reach UNION ALL SELECT segnum, i, j, length FROM extra""",
    "A5_coarsen_catchments": f"""WITH RECURSIVE {LINES}, {M._NET}, {CLIMB}, {M.ORDERS}, {DOWN}, {_AREAS}, lv AS MATERIALIZED (SELECT segnum, so FROM levels), {M._CHAIN.replace('FROM levels l', 'FROM lv l')},
own AS (SELECT d.start AS segnum, c.chain FROM down d JOIN chain c ON c.segnum = d.segnum QUALIFY row_number() OVER (PARTITION BY d.start ORDER BY d.depth) = 1)
SELECT o.chain AS segnum, count(*) AS n, (SELECT round(sum(a.a), 6) FROM down d JOIN area a ON a.segnum = d.start WHERE d.segnum = o.chain) AS upstream_area FROM own o GROUP BY o.chain""",
    "P4_set_catchments": f"WITH RECURSIVE {LINES}, {M._NET}, {DOWN}, {_AREAS}, up AS (SELECT d.segnum, sum(a.a) AS area FROM down d JOIN area a ON a.segnum = d.start GROUP BY d.segnum) SELECT segnum, round(area, 6) AS upstream_area, round(1.42 + pow(area / 1e6, 0.52), 6) AS width FROM up",
    "P19_inverted_by_period": "SELECT k::BIGINT AS kper, s_suppkey * 3 + 1 AS s_suppkey, s_suppkey AS code FROM supplier, (VALUES (0), (1)) t(k)",
    "P21_wide_by_period": f"WITH {M._YEARLY} SELECT kper, segnum AS nseg, round(value::DOUBLE, 6) AS flow, round(value::DOUBLE / 2, 6) AS runoff FROM yearly",
    "E3_segment_values": f"WITH RECURSIVE {M._REACH}, {M._YEARLY} SELECT y.segnum, y.kper, round(y.value::DOUBLE * CASE WHEN y.kper = 1995 THEN 10 ELSE 1 END, 6) AS value, round(abs(s.s_acctbal)::DOUBLE, 6) AS inflow FROM yearly y JOIN supplier s ON s.s_suppkey + 1 = y.segnum WHERE y.segnum IN (SELECT segnum FROM reach)",
    "E9_reach_data": f"WITH RECURSIVE {M._REACH} SELECT ridx, 0 AS k, i, j, iseg, ireach, round(rlen, 6) AS rchlen, 1.5::DOUBLE AS strtop FROM reach",
    "S4_long_series": "SELECT strftime(date_trunc('month', l_shipdate::DATE), '%Y-%m-%d') AS month, l_partkey + 1 AS segnum, round((sum(l_quantity)::DOUBLE + 1) * 86.4::DOUBLE, 6) AS flow FROM lineitem GROUP BY ALL",
    "S12_package_file": f"""WITH RECURSIVE {M._REACH}, {M._LINKS}, u AS (SELECT a.ridx, count(b.ridx) AS n FROM links a LEFT JOIN links b ON b.to_ridx = a.ridx GROUP BY a.ridx), dl AS (SELECT segnum, max(ridx) AS ridx FROM reach GROUP BY segnum)
SELECT '# ridx k i j rwid rtp ncon ndv' AS line UNION ALL SELECT concat_ws(' ', r.ridx, 1, r.i + 1, r.j + 1, '10.0', (100.0::DOUBLE - r.i)::VARCHAR, u.n + (l.to_ridx > 0)::INTEGER + (d.ridx IS NOT NULL)::INTEGER, (d.ridx IS NOT NULL)::INTEGER) FROM reach r JOIN links l USING (ridx) JOIN u USING (ridx) LEFT JOIN dl d ON d.ridx = r.ridx""",
    "S14_diversion_file": f"WITH RECURSIVE {M._REACH} SELECT '# ridx idv iconr cprior' AS line UNION ALL SELECT concat_ws(' ', max(ridx), 1, segnum + 1000000, 'upto') FROM reach GROUP BY segnum",
    "S16_period_file": f"WITH RECURSIVE {M._REACH} SELECT concat_ws(' ', 1, i + 1, j + 1, 100 - i, j * 2) AS line FROM reach",
}
