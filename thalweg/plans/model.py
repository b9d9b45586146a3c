"""Queries and oracles of the spatial layer, the grid overlay, reach values, exports and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import export as E
from thalweg.operators import locate as L
from thalweg.operators import network as N
from thalweg.operators import overlay as O
from thalweg.operators import query as R
from thalweg.operators import rewrite as W
from thalweg.operators import series as S
from thalweg.operators import trees
from thalweg.operators.trees import checkpointed
from thalweg.plans import derived as D
from thalweg.plans.graph import CLIMB, DOWN, LINES, ORDERS, PART, joined, r6

GRID = O.Grid(nrow=34, ncol=8, dx=0.125, dy=0.5, xmin=0.0, ymax=16.0)


def _network(spark: SparkSession, d: str) -> N.Network:
    """Supplier lines with links, orders and tributaries by arithmetic and doubling."""
    edges = D.supplier_lines(spark, d).withColumn("to_segnum", F.expr("segnum div 2"))
    up = checkpointed(trees.climb(edges.select("segnum", "to_segnum"), 0))
    orders = trees.orders(edges.select("segnum", "pos", "to_segnum").join(up, "segnum"), 0)
    return N.Network(checkpointed(edges.join(up, "segnum").join(orders, "segnum").join(trees.from_segnums(edges, 0), "segnum")), 0)


def _cells(spark: SparkSession) -> DataFrame:
    return GRID.cells(spark).select("i", "j", F.when((F.col("i") + F.col("j")) % 4 == 0, 1).otherwise(0).alias("domain"), ((F.col("i") * 7 + F.col("j") * 13) % 17).cast("double").alias("value"))


def _reaches(spark: SparkSession, d: str) -> tuple[N.Network, DataFrame, DataFrame]:
    net = _network(spark, d)
    return net, *O.reaches(net, GRID, _cells(spark), reach_include_fraction=None, rescue=False)


def j4(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest(D.customer_points(spark, d), D.supplier_lines(spark, d)).select("loc", "segnum", r6("dist").alias("dist"))


def j3(spark: SparkSession, d: str) -> DataFrame:
    return L.in_catchment(D.customer_points(spark, d), D.supplier_rings(spark, d), 0.5)


def j6(spark: SparkSession, d: str) -> DataFrame:
    found = L.locate(_network(spark, d), D.customer_points(spark, d), override={0: 1, 1: None}, min_stream_order=2)
    return found.select("loc", "method", "segnum", r6("dist_to_seg").alias("dist_to_seg"))


def p14(spark: SparkSession, d: str) -> DataFrame:
    n = D.read(spark, d, "supplier").count()
    rows = D.customer_points(spark, d).select(F.col("loc").alias("divid"), (F.col("loc") % n + 1).alias("from_segnum"), "x", "y")
    net = L.set_diversions(N.Network(D.supplier_lines(spark, d)), rows)
    return net.segments.select("segnum", F.size("diversions").cast("long").alias("n"), F.array_join(F.transform("diversions", lambda x: x.cast("string")), ",").alias("diversions"))


def j7(spark: SparkSession, d: str) -> DataFrame:
    return O.overlay(D.supplier_lines(spark, d), GRID).select("segnum", "piece", "i", "j", r6("start").alias("start"), r6("length").alias("length"), r6("segndist").alias("segndist"))


def m12(spark: SparkSession, d: str) -> DataFrame:
    *_, marked = _reaches(spark, d)
    return marked.select("segnum", "in_model", joined(F.col("inflow_segnums")).alias("inflow_segnums"))


def m14(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _reaches(spark, d)
    return found.select("ridx", "segnum", "k", "i", "j", "iseg", "ireach", r6("segndist").alias("segndist"), r6("rlen").alias("rlen"))


def m9(spark: SparkSession, d: str) -> DataFrame:
    net = _network(spark, d)
    found, _ = O.reaches(net, GRID, _cells(spark), action="modify", reach_include_fraction=None)
    return O.activated(_cells(spark), found)


def m18(spark: SparkSession, d: str) -> DataFrame:
    *_, marked = _reaches(spark, d)
    n = D.read(spark, d, "supplier").count()
    data = D.read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("kper"), (F.col("l_suppkey") % n + 1).alias("segnum")).agg(F.sum("l_quantity").alias("value"))
    return S.inflow_by_segment(marked, data).select(F.col("kper").cast("long").alias("kper"), "segnum", r6("inflow").alias("inflow"))


def m19(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = _reaches(spark, d)
    n = D.read(spark, d, "supplier").count()
    locs = D.customer_points(spark, d).withColumn("segnum", F.col("loc") % n + 1)
    return O.reach_lookup(locs, found, net.segments).select("loc", "ridx", r6("dist_to_reach").alias("dist_to_reach"))


def _paired(spark: SparkSession, d: str, net: N.Network) -> DataFrame:
    values = D.read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("segnum"), (F.abs("s_acctbal") + 1).alias("value"))
    return N.pair_segments(net, values)


def v2(log: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        net, found, _ = _reaches(spark, d)
        return O.reach_values(found, _paired(spark, d, net), log=log).select("ridx", F.round("value", 5).alias("value"))

    return run


def v3(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _reaches(spark, d)
    return O.reach_array(found, _cells(spark)).select("ridx", "value")


def v4(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _reaches(spark, d)
    return O.reach_slope(found, "grid_top", top=_cells(spark), grid=GRID).select("ridx", r6("slope").alias("slope"))


def v4_length(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _reaches(spark, d)
    return O.reach_slope(found, "rch_len", top=_cells(spark), grid=GRID).select("ridx", r6("slope").alias("slope"))


def v14(spark: SparkSession, d: str) -> DataFrame:
    return O.bilinear(D.customer_points(spark, d), _cells(spark), GRID).select("loc", r6("z").alias("z"))


def r9(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = _reaches(spark, d)
    return R.reach_links(found, net)


def e1(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = _reaches(spark, d)
    return E.segment_data(found, net).select(F.col("nseg").cast("long").alias("nseg"), "segnum", F.col("outseg").cast("long").alias("outseg"))


def e4(spark: SparkSession, d: str) -> DataFrame:
    n = D.read(spark, d, "supplier").count()
    ids = D.read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("nseg"), F.abs("s_acctbal").alias("flow"), F.lit(2.0).alias("inflow"), F.lit(-0.5).alias("abstraction"))
    series = D.read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("kper"), (F.col("l_suppkey") % n + 1).alias("nseg")).agg(F.sum("l_quantity").alias("value")).withColumn("name", F.lit("inflow"))
    periods = D.read(spark, d, "lineitem").select(F.year("l_shipdate").alias("kper")).distinct()
    return E.flow_by_period(ids, series, periods).select(F.col("kper").cast("long").alias("kper"), "nseg", r6("flow").alias("flow"))


def _packaged(spark: SparkSession, d: str):
    net, found, _ = _reaches(spark, d)
    links = checkpointed(R.reach_links(found, net))
    full = found.select("*", F.lit(10.0).alias("rwid"), F.lit(0.001).alias("rgrd"), (F.lit(100.0) - F.col("i")).alias("rtp"), F.lit(1.0).alias("rbth"), F.lit(1.0).alias("rhk"), F.lit(0.024).alias("man"), F.lit(1).alias("domain"))
    div = found.groupBy("segnum").agg(F.max("ridx").alias("ridx")).select(F.col("segnum").alias("divid"), "ridx", (F.col("segnum") + 1_000_000).alias("iconr"))
    return full, links, div


def e5(spark: SparkSession, d: str) -> DataFrame:
    full, links, div = _packaged(spark, d)
    return E.package_data(full, links, div).select("ridx", "k", "i", "j", r6("rlen").alias("rlen"), "rwid", "rtp", "ncon", "ustrf", "ndv")


def e6(style: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, links, _ = _packaged(spark, d)
        return E.connection_data(links, None, style).select("ridx", joined(F.col("connections")).alias("connections"))

    return run


def e7(spark: SparkSession, d: str) -> DataFrame:
    *_, div = _packaged(spark, d)
    return E.number_diversions(div)


def a12(spark: SparkSession, d: str) -> DataFrame:
    found = S.resample_mean(D.read(spark, d, "events"), "ts", "user_id", "value", 7, "2024-01-01")
    return found.select(F.col("period_start").cast("string").alias("period_start"), "user_id", r6("mean").alias("mean"))


def s5(spark: SparkSession, d: str) -> DataFrame:
    wide = D.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    wide = wide.select("day", *[F.coalesce(F.col(c), F.lit(0.0)).alias(str(k)) for k, c in enumerate(("F", "O", "P"))])
    return S.unpivot(wide, "day").select(F.col("day").cast("string").alias("day"), "segnum", F.round("flow", 2).alias("flow"))


def p18(spark: SparkSession, d: str) -> DataFrame:
    data = D.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("kper")).agg(F.sum("o_totalprice").alias("value"))
    mapping = D.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 1).alias("to"))
    ignore = D.read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key"))
    return S.long_values(data, None, spark, mapping=mapping, ignore=ignore).select("key", F.col("kper").cast("long").alias("kper"), F.round("value", 2).alias("value"))


def a5(spark: SparkSession, d: str) -> DataFrame:
    net = D.network_of(D.part_comb(spark, d))
    return W.coarsen_table(net, 2).select("segnum", "to_segnum", F.col("stream_order").cast("long").alias("stream_order"), joined(F.col("traced_segnums")).alias("traced_segnums"))


def a5_lines(spark: SparkSession, d: str) -> DataFrame:
    made = W.coarsen(_network(spark, d), 2)
    return made.segments.select("segnum", "to_segnum", F.col("stream_order").cast("long").alias("stream_order"), r6("upstream_length").alias("upstream_length"))


def a4(spark: SparkSession, d: str) -> DataFrame:
    net = N.Network(D.part_heap(spark, d))
    return W.aggregate_patches(net, spark.createDataFrame([(1,), (5,), (6,), (23,)], "segnum long"))


QUERIES = {
    "J3_catchment": j3, "J4_nearest": j4, "J6_locate": j6, "J7_overlay": j7, "P14_diversions": p14, "P18_long_values": p18,
    "M9_activated": m9, "M12_inflow_segnums": m12, "M14_numbering": m14, "M18_inflow": m18, "M19_reach_lookup": m19,
    "V2_reach_from_segments": v2(False), "V2_reach_from_segments_log": v2(True), "V3_reach_from_array": v3, "V4_slope": v4, "V4_slope_length": v4_length, "V14_bilinear": v14,
    "R9_reach_graph": r9, "E1_segment_data": e1, "E4_flow_by_period": e4, "E5_packagedata": e5, "E6_connectiondata": e6("native"), "E6_connectiondata_flopy": e6("flopy"), "E7_diversions": e7,
    "A4_aggregate": a4, "A5_coarsen": a5, "A5_coarsen_lines": a5_lines, "A12_resample7d": a12, "S5_wide_series": s5,
}

_EDGES = """edge AS (SELECT segnum, 0 AS k, sx AS ax, sy AS ay, mx AS qx, my AS qy, 0.0::DOUBLE AS base, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) AS len FROM line
UNION ALL SELECT segnum, 1, mx, my, ex, ey, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)), sqrt((ex - mx) * (ex - mx) + (ey - my) * (ey - my)) FROM line)"""
_POINTS = "point AS (SELECT c_custkey AS loc, ((c_custkey * 7919) % 64)::DOUBLE / 64 + 1.0::DOUBLE / 256 AS x, ((c_custkey * 104729) % 512)::DOUBLE / 64 - 1 AS y FROM customer)"
_SHARE = "least(greatest(CASE WHEN (qx - ax) * (qx - ax) + (qy - ay) * (qy - ay) > 0 THEN ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) ELSE 0 END, 0.0::DOUBLE), 1.0::DOUBLE)"
_DIST = "sqrt(pow(ax + (qx - ax) * t - x, 2) + pow(ay + (qy - ay) * t - y, 2))"
_RING = "(((s_suppkey + 1) - (1 << (length(bin(s_suppkey + 1)) - 1))) + 0.5::DOUBLE) / (1 << (length(bin(s_suppkey + 1)) - 1))"
_CELLS = "cell AS (SELECT i, j, j * 0.125::DOUBLE AS x0, (j + 1) * 0.125::DOUBLE AS x1, 16 - (i + 1) * 0.5::DOUBLE AS y0, 16 - i * 0.5::DOUBLE AS y1, CASE WHEN (i + j) % 4 = 0 THEN 1 ELSE 0 END AS domain, ((i * 7 + j * 13) % 17)::DOUBLE AS value FROM (SELECT unnest(range(34))::INTEGER AS i) a, (SELECT unnest(range(8))::INTEGER AS j) b)"
_CUT = f"""{_EDGES}, {_CELLS}, slab AS (SELECT e.*, c.i, c.j, c.domain,
  CASE WHEN qx = ax THEN CASE WHEN (ax > x0 AND ax <= x1) OR (j = 0 AND ax = x0) THEN 0 ELSE 2 END ELSE least((x0 - ax) / (qx - ax), (x1 - ax) / (qx - ax)) END AS a0,
  CASE WHEN qx = ax THEN CASE WHEN (ax > x0 AND ax <= x1) OR (j = 0 AND ax = x0) THEN 1 ELSE -1 END ELSE greatest((x0 - ax) / (qx - ax), (x1 - ax) / (qx - ax)) END AS a1,
  CASE WHEN qy = ay THEN CASE WHEN (ay >= y0 AND ay < y1) OR (i = 0 AND ay = y1) THEN 0 ELSE 2 END ELSE least((y0 - ay) / (qy - ay), (y1 - ay) / (qy - ay)) END AS b0,
  CASE WHEN qy = ay THEN CASE WHEN (ay >= y0 AND ay < y1) OR (i = 0 AND ay = y1) THEN 1 ELSE -1 END ELSE greatest((y0 - ay) / (qy - ay), (y1 - ay) / (qy - ay)) END AS b1
  FROM edge e, cell c),
part AS (SELECT segnum, k, i, j, domain, ax, ay, qx, qy, greatest(a0, b0, 0)::DOUBLE AS t0, least(a1, b1, 1)::DOUBLE AS t1, base, len FROM slab WHERE least(a1, b1, 1) > greatest(a0, b0, 0)),
cut AS (SELECT segnum, i, j, domain, base + t0 * len AS start, base + t1 * len AS stop, ax + (qx - ax) * t0 AS ux, ay + (qy - ay) * t0 AS uy, ax + (qx - ax) * t1 AS vx, ay + (qy - ay) * t1 AS vy FROM part),
fresh AS (SELECT *, CASE WHEN lag(i) OVER w = i AND lag(j) OVER w = j AND start - lag(stop) OVER w <= 1e-9 THEN 0 ELSE 1 END AS f FROM cut WINDOW w AS (PARTITION BY segnum ORDER BY start, stop)),
spot AS (SELECT *, (sum(f) OVER (PARTITION BY segnum ORDER BY start, stop))::INTEGER AS piece FROM fresh),
total AS (SELECT segnum, sum(len) AS total FROM edge GROUP BY segnum),
pieces AS (SELECT segnum, piece, i, j, domain, min(start) AS start, max(stop) AS stop FROM spot GROUP BY segnum, piece, i, j, domain),
piece AS (SELECT p.*, stop - start AS length, (start + stop) / 2 / total AS segndist FROM pieces p JOIN total USING (segnum))"""
_NET = "net AS (SELECT segnum, segnum // 2 AS to_segnum, pos FROM line)"
_REACH = f"""{LINES}, {_NET}, {CLIMB}, {ORDERS}, seq AS (SELECT l.segnum, row_number() OVER (ORDER BY l.r, l.num DESC, CASE WHEN l.r = 0 THEN n.pos ELSE n.segnum END) AS sequence FROM levels l JOIN net n USING (segnum)),
{_CUT}, reach AS (SELECT row_number() OVER (ORDER BY sequence, segndist) AS ridx, segnum, piece, i, j, (dense_rank() OVER (ORDER BY sequence))::INTEGER AS iseg, (row_number() OVER (PARTITION BY segnum ORDER BY segndist))::INTEGER AS ireach, segndist, length AS rlen, start, stop
FROM piece JOIN seq USING (segnum) WHERE domain <> 0),
inmod AS (SELECT n.segnum, n.to_segnum, n.segnum IN (SELECT segnum FROM reach) AS in_model FROM net n)"""
_LINKS = f"""{DOWN}, firsts AS (SELECT segnum, min(ridx) AS first FROM reach GROUP BY segnum),
links AS (SELECT r.ridx, coalesce(lead(r.ridx) OVER (PARTITION BY r.segnum ORDER BY r.ireach), (SELECT f.first FROM down d JOIN firsts f USING (segnum) WHERE d.start = r.segnum AND d.depth > 0 ORDER BY d.depth LIMIT 1), 0) AS to_ridx FROM reach r)"""
_PAIRED = "val AS (SELECT s_suppkey + 1 AS segnum, abs(s_acctbal) + 1 AS v FROM supplier), paired AS (SELECT n.segnum, a.v AS top, coalesce(b.v, a.v) AS bottom FROM net n JOIN val a ON a.segnum = n.segnum LEFT JOIN val b ON b.segnum = n.to_segnum)"
_GRAD = """grad AS (SELECT i, j, sqrt(pow(CASE WHEN lag(value) OVER r IS NULL THEN (lead(value) OVER r - value) / 0.125 WHEN lead(value) OVER r IS NULL THEN (value - lag(value) OVER r) / 0.125 ELSE (lead(value) OVER r - lag(value) OVER r) / 0.25 END, 2)
+ pow(CASE WHEN lag(value) OVER c IS NULL THEN (lead(value) OVER c - value) / 0.5 WHEN lead(value) OVER c IS NULL THEN (value - lag(value) OVER c) / 0.5 ELSE (lead(value) OVER c - lag(value) OVER c) / 1.0 END, 2)) AS slope
FROM cell WINDOW r AS (PARTITION BY j ORDER BY i), c AS (PARTITION BY i ORDER BY j))"""
_YEARLY = "yearly AS (SELECT year(l_shipdate) AS kper, l_suppkey % (SELECT count(*) FROM supplier) + 1 AS segnum, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_NEAR = f"""near AS (SELECT loc, segnum, min({_DIST}) AS dist FROM (SELECT p.*, e.*, {_SHARE} AS t FROM point p, edge e) GROUP BY loc, segnum)"""
_CONN = """flow AS (SELECT a.ridx, a.to_ridx, coalesce((SELECT list(b.ridx ORDER BY b.ridx) FROM links b WHERE b.to_ridx = a.ridx), []) AS up FROM links a)"""
_COMBNET = "net AS (SELECT p_partkey + 1 AS segnum, greatest(p_partkey - ((p_partkey + 1) * 7919) % 8, 0) AS to_segnum, p_partkey AS pos FROM part)"
_CHAIN = """kept AS (SELECT l.segnum, n.to_segnum, l.so FROM levels l JOIN net n USING (segnum) WHERE l.so >= 2),
ends AS (SELECT k.segnum FROM kept k WHERE k.to_segnum NOT IN (SELECT segnum FROM kept) OR (SELECT count(*) FROM kept m WHERE m.to_segnum = k.to_segnum) > 1),
chain AS (SELECT segnum, segnum AS chain, 1 AS d FROM ends UNION ALL SELECT k.segnum, c.chain, c.d + 1 FROM kept k JOIN chain c ON k.to_segnum = c.segnum WHERE k.segnum NOT IN (SELECT segnum FROM ends))"""

ORACLES = {
    "J3_catchment": f"WITH {_POINTS}, ring AS (SELECT s_suppkey + 1 AS segnum, {_RING} AS cx, length(bin(s_suppkey + 1)) - 1 AS lv FROM supplier) SELECT loc, segnum FROM point, ring WHERE abs(x - cx) <= 0.5::DOUBLE / (1 << lv) AND abs(y - lv) <= 0.5",
    "J4_nearest": f"WITH {LINES}, {_EDGES}, {_POINTS}, {_NEAR} SELECT loc, segnum, round(dist, 6) AS dist FROM near QUALIFY dist = min(dist) OVER (PARTITION BY loc)",
    "J6_locate": f"""WITH RECURSIVE {LINES}, {_NET}, {CLIMB}, {ORDERS}, {_EDGES}, {_POINTS}, {_NEAR.replace("near AS (", "near AS MATERIALIZED (")},
lv AS MATERIALIZED (SELECT segnum, so FROM levels), enough AS MATERIALIZED (SELECT segnum FROM lv, (SELECT least(2, max(so)) AS top FROM lv) WHERE so >= top),
best AS (SELECT n.loc, n.segnum, n.dist FROM near n JOIN enough USING (segnum) WHERE n.loc > 1 QUALIFY row_number() OVER (PARTITION BY loc ORDER BY round(dist, 12), segnum) = 1)
SELECT loc, 'nearest' AS method, segnum, round(dist, 6) AS dist_to_seg FROM best UNION ALL SELECT 0, 'override', 1, round(dist, 6) FROM near WHERE loc = 0 AND segnum = 1 UNION ALL SELECT 1, 'override', 0, NULL""",
    "J7_overlay": f"WITH {LINES}, {_CUT} SELECT segnum, piece, i, j, round(start, 6) AS start, round(length, 6) AS length, round(segndist, 6) AS segndist FROM piece",
    "P14_diversions": "SELECT s_suppkey + 1 AS segnum, count(c_custkey) AS n, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey), '') AS diversions FROM supplier LEFT JOIN customer ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey GROUP BY s_suppkey",
    "P18_long_values": "SELECT c_custkey + 1 AS key, year(o_orderdate) AS kper, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3 GROUP BY ALL",
    "M9_activated": f"WITH {LINES}, {_CUT} SELECT i, j, CASE WHEN domain = 0 AND EXISTS (SELECT 1 FROM piece p WHERE p.i = c.i AND p.j = c.j) THEN 1 ELSE domain END AS domain, domain AS prev_domain FROM cell c",
    "M12_inflow_segnums": f"WITH RECURSIVE {_REACH} SELECT m.segnum, m.in_model, coalesce(string_agg(o.segnum::VARCHAR, ',' ORDER BY o.segnum) FILTER (m.in_model), '') AS inflow_segnums FROM inmod m LEFT JOIN inmod o ON o.to_segnum = m.segnum AND NOT o.in_model GROUP BY m.segnum, m.in_model",
    "M14_numbering": f"WITH RECURSIVE {_REACH} SELECT ridx, segnum, 0 AS k, i, j, iseg, ireach, round(segndist, 6) AS segndist, round(rlen, 6) AS rlen FROM reach",
    "M18_inflow": f"WITH RECURSIVE {_REACH}, {_YEARLY} SELECT y.kper, m.segnum, round(sum(y.value), 6) AS inflow FROM inmod m JOIN inmod o ON o.to_segnum = m.segnum AND NOT o.in_model JOIN yearly y ON y.segnum = o.segnum WHERE m.in_model GROUP BY ALL",
    "M19_reach_lookup": f"""WITH RECURSIVE {_REACH}, {_POINTS}, loc AS (SELECT *, loc % (SELECT count(*) FROM supplier) + 1 AS segnum FROM point),
d AS (SELECT l.loc, r.ridx, l.x, l.y, s.ux AS ax, s.uy AS ay, s.vx AS qx, s.vy AS qy FROM loc l JOIN reach r USING (segnum) JOIN spot s ON s.segnum = r.segnum AND s.piece = r.piece),
m AS (SELECT loc, ridx, min({_DIST}) AS dist FROM (SELECT *, {_SHARE} AS t FROM d) GROUP BY loc, ridx)
SELECT loc, ridx, round(dist, 6) AS dist_to_reach FROM m QUALIFY row_number() OVER (PARTITION BY loc ORDER BY round(dist, 9), ridx DESC) = 1""",
    "V2_reach_from_segments": f"WITH RECURSIVE {_REACH}, {_PAIRED} SELECT ridx, round((bottom - top) * segndist + top, 5) AS value FROM reach JOIN paired USING (segnum)",
    "V2_reach_from_segments_log": f"WITH RECURSIVE {_REACH}, {_PAIRED} SELECT ridx, round(CASE WHEN top = bottom THEN top ELSE pow(10, log10(top) + (log10(bottom) - log10(top)) * segndist) END, 5) AS value FROM reach JOIN paired USING (segnum)",
    "V3_reach_from_array": f"WITH RECURSIVE {_REACH} SELECT ridx, value FROM reach JOIN cell USING (i, j)",
    "V4_slope": f"WITH RECURSIVE {_REACH}, {_GRAD} SELECT ridx, round(greatest(slope, 0.001), 6) AS slope FROM reach JOIN grad USING (i, j)",
    "V4_slope_length": f"WITH RECURSIVE {_REACH}, {_GRAD.replace('0.125', '1.0').replace('0.25', '2.0').replace('/ 0.5', '/ 1.0').replace('/ 1.0 END, 2)) AS', '/ 2.0 END, 2)) AS')} SELECT ridx, round(greatest(slope / rlen, 0.001), 6) AS slope FROM reach JOIN grad USING (i, j)",
    "V14_bilinear": f"""WITH {_CELLS}, {_POINTS}, p AS (SELECT loc, x / 0.125 - 0.5 AS u, (16 - y) / 0.5 - 0.5 AS v FROM point), q AS (SELECT *, u - floor(u) AS fu, v - floor(v) AS fv FROM p),
c AS (SELECT loc, least(greatest(floor(v) + a, 0), 33)::INTEGER AS i, least(greatest(floor(u) + b, 0), 7)::INTEGER AS j, (CASE WHEN a = 1 THEN fv ELSE 1 - fv END) * (CASE WHEN b = 1 THEN fu ELSE 1 - fu END) AS w FROM q, (VALUES (0), (1)) r(a), (VALUES (0), (1)) s(b))
SELECT loc, round(sum(w * value), 6) AS z FROM c JOIN cell USING (i, j) GROUP BY loc""",
    "R9_reach_graph": f"WITH RECURSIVE {_REACH}, {_LINKS} SELECT ridx, to_ridx FROM links",
    "E1_segment_data": f"WITH RECURSIVE {_REACH} SELECT DISTINCT r.iseg::BIGINT AS nseg, r.segnum, coalesce((SELECT min(b.iseg) FROM reach b WHERE b.segnum = n.to_segnum), 0)::BIGINT AS outseg FROM reach r JOIN net n USING (segnum)",
    "E4_flow_by_period": f"WITH {_YEARLY}, k AS (SELECT DISTINCT year(l_shipdate) AS kper FROM lineitem) SELECT k.kper, s_suppkey + 1 AS nseg, round(abs(s_acctbal) - 0.5 + coalesce(y.value, 2.0), 6) AS flow FROM supplier, k LEFT JOIN yearly y ON y.kper = k.kper AND y.segnum = s_suppkey + 1",
    "E5_packagedata": f"""WITH RECURSIVE {_REACH}, {_LINKS}, dv AS (SELECT segnum, max(ridx) AS ridx FROM reach GROUP BY segnum)
SELECT r.ridx, 1 AS k, r.i + 1 AS i, r.j + 1 AS j, round(rlen, 6) AS rlen, 10.0::DOUBLE AS rwid, 100.0::DOUBLE - r.i AS rtp,
  (u.n + (l.to_ridx > 0)::INTEGER + (d.ridx IS NOT NULL)::INTEGER)::INTEGER AS ncon, (u.n > 0)::INTEGER::DOUBLE AS ustrf, (d.ridx IS NOT NULL)::INTEGER AS ndv
FROM reach r JOIN links l USING (ridx) LEFT JOIN dv d ON d.ridx = r.ridx JOIN (SELECT a.ridx, count(b.ridx) AS n FROM links a LEFT JOIN links b ON b.to_ridx = a.ridx GROUP BY a.ridx) u ON u.ridx = r.ridx""",
    "E6_connectiondata": f"WITH RECURSIVE {_REACH}, {_LINKS}, {_CONN} SELECT ridx, coalesce(array_to_string(list_concat(up, CASE WHEN to_ridx > 0 THEN [-to_ridx] ELSE [] END), ','), '') AS connections FROM flow",
    "E6_connectiondata_flopy": f"WITH RECURSIVE {_REACH}, {_LINKS}, {_CONN} SELECT ridx - 1 AS ridx, coalesce(array_to_string(list_concat(list_transform(up, lambda x: x - 1), CASE WHEN to_ridx > 0 THEN [1 - to_ridx] ELSE [] END), ','), '') AS connections FROM flow",
    "E7_diversions": f"WITH RECURSIVE {_REACH} SELECT max(ridx) AS ridx, 1 AS idv, segnum + 1000000 AS iconr, 'upto' AS cprior FROM reach GROUP BY segnum",
    "A4_aggregate": f"""WITH RECURSIVE {PART}, {DOWN}, given AS (SELECT unnest([1, 5, 6, 23])::BIGINT AS segnum), traced AS (SELECT DISTINCT segnum FROM down WHERE start IN (SELECT segnum FROM given)),
fork AS (SELECT t.segnum AS node, bool_or(n.segnum IN (SELECT segnum FROM given)) AS g, count(*) FILTER (n.segnum IN (SELECT segnum FROM traced)) AS t FROM traced t JOIN net n ON n.to_segnum = t.segnum GROUP BY t.segnum),
junction AS (SELECT segnum FROM given UNION SELECT n.segnum FROM net n JOIN fork f ON f.node = n.to_segnum WHERE (f.g AND n.segnum NOT IN (SELECT segnum FROM traced)) OR (NOT f.g AND f.t > 1 AND n.segnum IN (SELECT segnum FROM traced)) OR (f.g AND f.t > 1 AND n.segnum IN (SELECT segnum FROM traced)))
SELECT start AS segnum, segnum AS patch FROM down WHERE segnum IN (SELECT segnum FROM junction) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth) = 1""",
    "A5_coarsen": f"WITH RECURSIVE {_COMBNET}, {CLIMB}, {ORDERS}, {_CHAIN} SELECT c.chain AS segnum, coalesce((SELECT e.chain FROM chain e WHERE e.segnum = (SELECT k.to_segnum FROM kept k WHERE k.segnum = c.chain)), 0) AS to_segnum, max(k.so) AS stream_order, string_agg(c.segnum::VARCHAR, ',' ORDER BY c.d DESC) AS traced_segnums FROM chain c JOIN kept k USING (segnum) GROUP BY c.chain",
    "A5_coarsen_lines": f"""WITH RECURSIVE {LINES}, {_NET}, {CLIMB}, {ORDERS}, {DOWN}, lens AS (SELECT segnum, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) + sqrt((ex - mx) * (ex - mx) + (ey - my) * (ey - my)) AS len FROM line), {_CHAIN}
SELECT c.chain AS segnum, coalesce((SELECT e.chain FROM chain e WHERE e.segnum = (SELECT k.to_segnum FROM kept k WHERE k.segnum = c.chain)), 0) AS to_segnum, max(k.so) AS stream_order,
  (SELECT round(sum(l.len), 6) FROM down d JOIN lens l ON l.segnum = d.start JOIN kept q ON q.segnum = d.start WHERE d.segnum = c.chain) AS upstream_length FROM chain c JOIN kept k USING (segnum) GROUP BY c.chain""",
    "A12_resample7d": "SELECT strftime(DATE '2024-01-01' + ((ts::DATE - DATE '2024-01-01') // 7 * 7)::INTEGER, '%Y-%m-%d') AS period_start, user_id, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "S5_wide_series": "SELECT strftime(d.day, '%Y-%m-%d') AS day, k.segnum, round(coalesce(sum(o.o_totalprice), 0), 2) AS flow FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) d, (SELECT unnest([0, 1, 2])::BIGINT AS segnum, unnest(['F', 'O', 'P']) AS s) k LEFT JOIN orders o ON o.o_orderdate::DATE = d.day AND o.o_orderstatus = k.s GROUP BY ALL",
}
