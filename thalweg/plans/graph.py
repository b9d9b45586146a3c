"""Queries and oracles of the graph layer: linking, recursion, orders, routes, pairs, accumulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import network as N
from thalweg.operators import query as R
from thalweg.operators import trees
from thalweg.plans import derived as D

# Derived networks in DuckDB SQL, as CTE ``net(segnum, to_segnum, pos, value)``.
PART = "net AS (SELECT p_partkey + 1 AS segnum, (p_partkey + 1) // 2 AS to_segnum, p_partkey AS pos, p_retailprice AS value FROM part)"
COMB = "net AS (SELECT p_partkey + 1 AS segnum, greatest(p_partkey - ((p_partkey + 1) * 7919) % 8, 0) AS to_segnum, p_partkey AS pos, p_retailprice AS value FROM part)"
FOREST = """ranked AS (SELECT s_suppkey + 1 AS segnum, s_nationkey, s_suppkey AS pos, s_acctbal AS value, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier),
net AS (SELECT a.segnum, coalesce(b.segnum, 0) AS to_segnum, a.pos, a.value FROM ranked a LEFT JOIN ranked b ON a.s_nationkey = b.s_nationkey AND b.rank = a.rank // 2)"""
CLIMB = """climb AS (SELECT segnum, segnum AS cat_group, 1 AS num FROM net WHERE to_segnum = 0
UNION ALL SELECT n.segnum, c.cat_group, c.num + 1 FROM net n JOIN climb c ON n.to_segnum = c.segnum)"""
DOWN = """down AS (SELECT segnum AS start, segnum, 0 AS depth FROM net
UNION ALL SELECT d.start, n.to_segnum, d.depth + 1 FROM down d JOIN net n ON n.segnum = d.segnum WHERE n.to_segnum <> 0)"""
ORDERS = """levels AS (SELECT c.segnum, n.to_segnum, c.num, 0::BIGINT AS r, 1::BIGINT AS so FROM climb c JOIN net n USING (segnum) WHERE c.num = (SELECT max(num) FROM climb)
UNION ALL SELECT n.segnum, n.to_segnum, c.num, CASE WHEN count(l.segnum) = 0 THEN 0 ELSE greatest(1 + min(l.r), max(l.r)) END,
  CASE WHEN count(l.segnum) = 0 THEN 1 ELSE max(l.so) + (CASE WHEN len(list_filter(list(l.so), lambda x: x = list_max(list(l.so)))) >= 2 THEN 1 ELSE 0 END) END
FROM (SELECT DISTINCT num FROM levels) q JOIN climb c ON c.num = q.num - 1 JOIN net n ON n.segnum = c.segnum LEFT JOIN levels l ON l.to_segnum = n.segnum
GROUP BY n.segnum, n.to_segnum, c.num)"""
# Heap lines over suppliers as CTE ``line(segnum, pos, sx, sy, mx, my, ex, ey)``.
LINES = """k AS (SELECT s_suppkey + 1 AS segnum, s_suppkey AS pos, length(bin(s_suppkey + 1)) - 1 AS lv, length(bin((s_suppkey + 1) // 2)) - 1 AS ulv FROM supplier),
xy AS (SELECT segnum, pos, (segnum - (1 << lv) + 0.5::DOUBLE) / (1 << lv) AS sx, lv::DOUBLE AS sy,
  CASE WHEN segnum = 1 THEN 0.5 ELSE (segnum // 2 - (1 << ulv) + 0.5::DOUBLE) / (1 << ulv) END AS ex, CASE WHEN segnum = 1 THEN -1.0 ELSE ulv END::DOUBLE AS ey FROM k),
line AS (SELECT *, (sx + ex) / 2 AS mx, (sy + ey) / 2 + 0.125 AS my FROM xy)"""


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def r6(c):
    return F.round(c, 6)


def n4(spark: SparkSession, d: str) -> DataFrame:
    ends = N.endpoints(D.supplier_lines(spark, d))
    links = N.downstream_links(ends)
    return ends.select("segnum").join(links, "segnum", "left").select("segnum", F.coalesce("to_segnum", F.lit(0)).cast("long").alias("to_segnum"), F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n"))


def n5(spark: SparkSession, d: str) -> DataFrame:
    lines = D.supplier_lines(spark, d).withColumn("geometry", F.transform("geometry", lambda p: G.xyz(p["x"], p["y"], (F.col("segnum") % 3).cast("double"))))
    ends = N.endpoints(lines)
    return N.z_mismatches(ends, N.downstream_links(ends)).select("segnum", "to_segnum", "end_z", "start_z")


def _converging(spark: SparkSession, d: str) -> DataFrame:
    """Lines from each customer's place to a point its nation shares; every seventh begins where its nation's lines begin."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    x = F.when(k % 7 == 0, n).otherwise(k.cast("double") + 100)
    return D.read(spark, d, "customer").select((k + 1).alias("segnum"), k.alias("pos"), F.array(G.xyz(x, F.lit(5.0)), G.xyz(n, F.lit(1.0) + (k % 2))).alias("geometry"))


def n6(spark: SparkSession, d: str) -> DataFrame:
    ends = N.endpoints(_converging(spark, d))
    return N.shared_outlets(ends, N.downstream_links(ends)).select("x", "y", F.size("segnums").cast("long").alias("n"), joined(F.col("segnums")).alias("segnums"))


def n7(spark: SparkSession, d: str) -> DataFrame:
    """Part lines that end on the middle of long customer lines."""
    k = F.col("c_custkey")
    long = D.read(spark, d, "customer").select((k + 1).alias("segnum"), k.alias("pos"), F.array(G.xyz(k.cast("double"), 0.0), G.xyz(k.cast("double"), 64.0)).alias("geometry"))
    p = F.col("p_partkey")
    short = D.read(spark, d, "part").select((p + 10_000_001).alias("segnum"), (p + 10_000_000).alias("pos"), F.array(G.xyz(p.cast("double") - 0.5, (p % 70).cast("double") + 0.25), G.xyz(p.cast("double"), (p % 70).cast("double"))).alias("geometry"))
    lines = long.unionByName(short)
    ends = N.endpoints(lines)
    return N.outlets_in_middle(lines, ends, N.downstream_links(ends), size=8.0)


def n8(spark: SparkSession, d: str) -> DataFrame:
    ends = N.endpoints(_converging(spark, d))
    return N.shared_starts(ends, N.downstream_links(ends)).select("segnum", F.size("others").cast("long").alias("n"), joined(F.col("others")).alias("others"))


def n10(spark: SparkSession, d: str) -> DataFrame:
    return trees.from_segnums(D.part_comb(spark, d), 0).select("segnum", joined(F.col("from_segnums")).alias("from_segnums"))


def n11(spark: SparkSession, d: str) -> DataFrame:
    return trees.climb(D.part_comb(spark, d), 0).select("segnum", "cat_group", F.col("num_to_outlet").cast("long").alias("num_to_outlet"), r6("dist_to_outlet").alias("dist_to_outlet"))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    edges = D.part_comb(spark, d)
    up = trees.checkpointed(trees.climb(edges, 0))
    return trees.orders(edges.select("segnum", "pos", "to_segnum").join(up, "segnum"), 0)


def n12(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).select("segnum", F.col("sequence").cast("long").alias("sequence"))


def n13(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).select("segnum", F.col("stream_order").cast("long").alias("stream_order"))


def n14(spark: SparkSession, d: str) -> DataFrame:
    net = N.from_lines(D.supplier_lines(spark, d), D.supplier_rings(spark, d))
    return net.segments.select("segnum", "to_segnum", "cat_group", F.col("num_to_outlet").cast("long").alias("num_to_outlet"), r6("dist_to_outlet").alias("dist_to_outlet"), r6("upstream_length").alias("upstream_length"), r6("upstream_area").alias("upstream_area"), F.col("stream_order").cast("long").alias("stream_order"))


def p1(spark: SparkSession, d: str) -> DataFrame:
    sliced = D.part_heap(spark, d).where("value < 980")
    return N.Network.wrap(sliced).segments.select("segnum", "to_segnum")


def p7(spark: SparkSession, d: str) -> DataFrame:
    return N.Network(D.part_comb(spark, d)).headwater


def p8(spark: SparkSession, d: str) -> DataFrame:
    return N.Network(D.supplier_forest(spark, d)).outlets


def p11(spark: SparkSession, d: str) -> DataFrame:
    net = N.Network(D.part_heap(spark, d).withColumn("upstream_area", F.col("value") * 1000))
    return net.estimate_width().select("segnum", r6("width").alias("width"))


def p12(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = D.supplier_forest(spark, d).withColumn("value", F.abs("value") + 1)
        found = N.pair_segments(N.Network(edges), edges.select("segnum", "value"), method=method)
        return found.select("segnum", r6("top").alias("top"), r6("bottom").alias("bottom"))

    return run


def p13(spark: SparkSession, d: str) -> DataFrame:
    net = D.network_of(D.part_heap(spark, d))
    return net.remove(F.col("stream_order") == 1, segnums=[2, 3]).segments.select("segnum", "to_segnum", F.col("stream_order").cast("long").alias("stream_order"))


def _route(a: int, b: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = R.route_frame(D.part_heap(spark, d), a, b, 0, allow_indirect=True)
        return found.select(F.col("step").cast("long").alias("step"), "segnum")

    return run


def _gather(**kwargs):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.gather(N.Network(D.part_heap(spark, d)), **kwargs).select("start", "segnum", F.coalesce("depth", F.lit(-1)).alias("depth"))

    return run


def r7(source=D.part_heap, **kwargs):
    def run(spark: SparkSession, d: str) -> DataFrame:
        net = D.network_of(source(spark, d))
        locs = D.read(spark, d, "customer").join(D.read(spark, d, "part").agg(F.count(F.lit(1)).alias("n")))
        locs = locs.select(F.col("c_custkey").alias("loc"), ((F.col("c_custkey") * 37) % F.col("n") + 1).alias("segnum"), (((F.col("c_custkey") * 13) % 64) / 64).alias("seg_ndist"))
        return R.location_pairs(locs, net, **kwargs)

    return run


def r8(spark: SparkSession, d: str) -> DataFrame:
    lines = D.supplier_lines(spark, d)
    net = N.Network(lines.withColumn("to_segnum", F.expr("segnum div 2")))
    locs = lines.select(F.col("segnum").alias("loc"), "segnum", F.lit(0.25).alias("seg_ndist"))
    pairs = lines.where("segnum >= 4").select(F.col("segnum").alias("upstream"), F.expr("segnum div 4").alias("downstream"))
    found = R.location_pair_lines(pairs, locs, net)
    return found.select("upstream", "downstream", r6(G.length(F.col("geometry"))).alias("length"))


def a1(spark: SparkSession, d: str) -> DataFrame:
    found = trees.climb(D.part_comb(spark, d), 0, values=("value",))
    return found.select("segnum", "cat_group", F.col("num_to_outlet").cast("long").alias("num_to_outlet"), F.round("up_value", 4).alias("accumulated"))


def a2(spark: SparkSession, d: str) -> DataFrame:
    net = N.Network(D.supplier_lines(spark, d).withColumn("to_segnum", F.expr("segnum div 2")))
    return net.upstream_length().select("segnum", r6("accumulated").alias("upstream_length"))


def a3(spark: SparkSession, d: str) -> DataFrame:
    net = N.Network(D.supplier_lines(spark, d).withColumn("to_segnum", F.expr("segnum div 2")), 0, D.supplier_rings(spark, d))
    return net.upstream_area().select("segnum", r6("accumulated").alias("upstream_area"))


def g1(spark: SparkSession, d: str) -> DataFrame:
    return D.supplier_lines(spark, d).select("segnum", r6(G.length(F.col("geometry"))).alias("length"))


def g2(spark: SparkSession, d: str) -> DataFrame:
    at = G.interpolate(F.col("geometry"), F.lit(0.25))
    return D.supplier_lines(spark, d).select("segnum", r6(at["x"]).alias("x"), r6(at["y"]).alias("y"))


def g3(spark: SparkSession, d: str) -> DataFrame:
    spot = G.project(F.col("geometry"), G.xyz(0.3, 2.25))
    return D.supplier_lines(spark, d).select("segnum", r6(spot["dist"]).alias("dist"), r6(spot["at"]).alias("at"))


def g6(spark: SparkSession, d: str) -> DataFrame:
    part = G.substring(F.col("geometry"), F.lit(0.25), F.lit(0.75))
    return D.supplier_lines(spark, d).select("segnum", r6(G.length(part)).alias("length"), F.size(part).cast("long").alias("vertices"))


def g8(spark: SparkSession, d: str) -> DataFrame:
    return D.supplier_rings(spark, d).select("segnum", r6(G.area(F.col("rings"))).alias("area"))


def g15(spark: SparkSession, d: str) -> DataFrame:
    text = G.to_wkt(F.col("geometry"))
    back = D.supplier_lines(spark, d).select("segnum", F.col("geometry").alias("was"), G.from_wkt(text).alias("geometry"))
    return back.select("segnum", (F.col("was") == F.col("geometry")).alias("same"), r6(G.length(F.col("geometry"))).alias("length"))


QUERIES = {
    "A1_accumulate": a1, "A2_upstream_length": a2, "A3_upstream_area": a3,
    "N4_downstream_link": n4, "N5_z_mismatch": n5, "N6_shared_outlets": n6, "N7_touch_middle": n7, "N8_shared_starts": n8,
    "N10_from_segnums": n10, "N11_outlet_recursion": n11, "N12_sequence": n12, "N13_stream_order": n13, "N14_from_lines": n14,
    "P1_repair_links": p1, "P7_headwater": p7, "P8_outlets": p8, "P11_width": p11,
    "P12_pair_continuous": p12("continuous"), "P12_pair_constant": p12("constant"), "P12_pair_additive": p12("additive"), "P13_remove": p13,
    "R1_route_down": _route(100, 3), "R1_route_up": _route(3, 100), "R1_route_indirect": _route(99, 70),
    "R2_gather_up": _gather(upstream=[5, 6]), "R2_gather_down": _gather(downstream=[90, 75]),
    "R2_gather_barrier": _gather(upstream=[1], barrier=[5, 6]), "R2_gather_sidebranch": _gather(downstream=[50], barrier=[3], gather_upstream=True),
    "R7_location_pairs": r7(), "R7_location_pairs_all": r7(all_pairs=True), "R7_location_pairs_nobranch": r7(D.part_comb, exclude_branches=True), "R8_pair_lines": r8,
    "G1_length": g1, "G2_interpolate": g2, "G3_project": g3, "G6_substring": g6, "G8_area": g8, "G15_wkt": g15,
}

_CONVERGING = """c AS (SELECT c_custkey + 1 AS segnum, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey::DOUBLE ELSE c_custkey + 100.0::DOUBLE END AS sx, c_nationkey::DOUBLE AS ex, (1 + c_custkey % 2)::DOUBLE AS ey FROM customer)"""
_LEN = "sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) + sqrt((ex - mx) * (ex - mx) + (ey - my) * (ey - my))"
_AREA = "CASE WHEN 1 = 1 THEN 1.0::DOUBLE / (1 << (length(bin(s_suppkey + 1)) - 1)) END"
_LOCS = "loc AS (SELECT c_custkey AS loc, (c_custkey * 37) % (SELECT count(*) FROM part) + 1 AS segnum, ((c_custkey * 13) % 64) / 64.0::DOUBLE AS nd FROM customer)"
_HEAPNET = "net AS (SELECT segnum, segnum // 2 AS to_segnum, pos FROM line)"


def _pairs(every: bool, edges: str = "net") -> str:
    down = DOWN.replace("FROM net\n", "FROM net\n").replace("JOIN net n", f"JOIN {edges} n")
    branch = "nb AS (SELECT n.segnum, CASE WHEN (SELECT count(*) FROM net m WHERE m.to_segnum = n.to_segnum) > 1 THEN 0 ELSE n.to_segnum END AS to_segnum FROM net n)," if edges == "nb" else ""
    pick = "" if every else "QUALIFY row_number() OVER (PARTITION BY upstream ORDER BY depth, ds, downstream) = 1"
    return f"""WITH RECURSIVE {COMB if edges == "nb" else PART}, {branch} {CLIMB}, {down}, {ORDERS}, {_LOCS},
ranked AS (SELECT l.*, row_number() OVER (ORDER BY r, num, segnum_tie) AS dummy FROM (SELECT loc.*, v.r, -v.num AS num, CASE WHEN v.r = 0 THEN n.pos ELSE n.segnum END AS segnum_tie FROM loc JOIN levels v USING (segnum) JOIN net n USING (segnum)) l),
final AS (SELECT loc FROM ranked ORDER BY r DESC, num DESC, segnum_tie DESC, nd DESC, loc DESC LIMIT 1)
SELECT upstream, downstream FROM (SELECT a.loc AS upstream, b.loc AS downstream, d.depth, b.nd AS ds FROM loc a JOIN down d ON d.start = a.segnum JOIN loc b ON b.segnum = d.segnum
WHERE a.loc NOT IN (SELECT loc FROM final) AND (d.depth > 0 OR (b.nd, b.loc) > (a.nd, a.loc))) {pick}"""


_ROUTE = """WITH RECURSIVE {net}, a AS (SELECT {a}::BIGINT AS segnum, 0 AS depth UNION ALL SELECT n.to_segnum, a.depth + 1 FROM a JOIN net n USING (segnum) WHERE n.to_segnum <> 0),
b AS (SELECT {b}::BIGINT AS segnum, 0 AS depth UNION ALL SELECT n.to_segnum, b.depth + 1 FROM b JOIN net n USING (segnum) WHERE n.to_segnum <> 0),
m AS (SELECT a.segnum, a.depth AS da, b.depth AS db FROM a JOIN b USING (segnum) ORDER BY a.depth LIMIT 1)
SELECT a.depth::BIGINT AS step, a.segnum FROM a, m WHERE a.depth < m.da + (CASE WHEN m.db = 0 THEN 1 ELSE 0 END)
UNION ALL SELECT (CASE WHEN m.da = 0 THEN m.db ELSE m.da + m.db - 1 END - b.depth)::BIGINT, b.segnum FROM b, m WHERE m.db > 0 AND b.depth < m.db + (CASE WHEN m.da = 0 THEN 1 ELSE 0 END)"""

ORACLES = {
    "A1_accumulate": f"WITH RECURSIVE {COMB}, {CLIMB}, {DOWN} SELECT s.segnum, c.cat_group, c.num::BIGINT AS num_to_outlet, s.accumulated FROM (SELECT d.segnum, round(sum(n.value), 4) AS accumulated FROM down d JOIN net n ON n.segnum = d.start GROUP BY d.segnum) s JOIN climb c USING (segnum)",
    "A2_upstream_length": f"WITH RECURSIVE {LINES}, {_HEAPNET}, {DOWN} SELECT d.segnum, round(sum({_LEN}), 6) AS upstream_length FROM down d JOIN line l ON l.segnum = d.start GROUP BY d.segnum",
    "A3_upstream_area": f"WITH RECURSIVE {LINES}, {_HEAPNET}, {DOWN} SELECT d.segnum, round(sum({_AREA}), 6) AS upstream_area FROM down d JOIN supplier ON s_suppkey + 1 = d.start GROUP BY d.segnum",
    "N4_downstream_link": f"WITH {LINES} SELECT a.segnum, coalesce(min(b.segnum), 0) AS to_segnum, count(b.segnum) AS n FROM line a LEFT JOIN line b ON a.ex = b.sx AND a.ey = b.sy GROUP BY a.segnum",
    "N5_z_mismatch": f"WITH {LINES} SELECT a.segnum, b.segnum AS to_segnum, (a.segnum % 3)::DOUBLE AS end_z, (b.segnum % 3)::DOUBLE AS start_z FROM line a JOIN line b ON a.ex = b.sx AND a.ey = b.sy WHERE a.segnum % 3 <> b.segnum % 3",
    "N6_shared_outlets": f"WITH {_CONVERGING} SELECT ex AS x, ey AS y, count(*) AS n, string_agg(segnum::VARCHAR, ',' ORDER BY segnum) AS segnums FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.sx = c.ex AND c.ey = 5) GROUP BY ex, ey HAVING count(*) > 1",
    "N7_touch_middle": "SELECT p_partkey + 10000001 AS segnum, c_custkey + 1 AS other FROM part JOIN customer ON c_custkey = p_partkey WHERE p_partkey % 70 BETWEEN 1 AND 63",
    "N8_shared_starts": f"WITH {_CONVERGING} SELECT a.segnum, count(*) AS n, string_agg(b.segnum::VARCHAR, ',' ORDER BY b.segnum) AS others FROM c a JOIN c b ON a.sx = b.sx AND a.segnum <> b.segnum GROUP BY a.segnum",
    "N10_from_segnums": f"WITH {COMB} SELECT a.segnum, coalesce(string_agg(b.segnum::VARCHAR, ',' ORDER BY b.segnum), '') AS from_segnums FROM net a LEFT JOIN net b ON b.to_segnum = a.segnum GROUP BY a.segnum",
    "N11_outlet_recursion": f"WITH RECURSIVE {COMB}, {CLIMB} SELECT segnum, cat_group, num::BIGINT AS num_to_outlet, num::DOUBLE AS dist_to_outlet FROM climb",
    "N12_sequence": f"WITH RECURSIVE {COMB}, {CLIMB}, {ORDERS} SELECT l.segnum, row_number() OVER (ORDER BY l.r, l.num DESC, CASE WHEN l.r = 0 THEN n.pos ELSE n.segnum END) AS sequence FROM levels l JOIN net n USING (segnum)",
    "N13_stream_order": f"WITH RECURSIVE {COMB}, {CLIMB}, {ORDERS} SELECT segnum, so AS stream_order FROM levels",
    "N14_from_lines": f"""WITH RECURSIVE {LINES}, {_HEAPNET}, {CLIMB}, {DOWN}, {ORDERS}, lens AS (SELECT segnum, {_LEN} AS len FROM line),
up AS (SELECT d.segnum, sum(l.len) AS ul, sum(1.0::DOUBLE / (1 << (length(bin(d.start)) - 1))) AS ua FROM down d JOIN lens l ON l.segnum = d.start GROUP BY d.segnum),
dn AS (SELECT d.start AS segnum, sum(l.len) AS dl FROM down d JOIN lens l USING (segnum) GROUP BY d.start)
SELECT n.segnum, n.to_segnum, c.cat_group, c.num::BIGINT AS num_to_outlet, round(dl, 6) AS dist_to_outlet, round(ul, 6) AS upstream_length, round(ua, 6) AS upstream_area, o.so AS stream_order
FROM net n JOIN climb c USING (segnum) JOIN up USING (segnum) JOIN dn USING (segnum) JOIN levels o USING (segnum)""",
    "P1_repair_links": f"WITH {PART}, kept AS (SELECT * FROM net WHERE value < 980) SELECT segnum, CASE WHEN to_segnum IN (SELECT segnum FROM kept) THEN to_segnum ELSE 0 END AS to_segnum FROM kept",
    "P7_headwater": f"WITH {COMB} SELECT segnum FROM net WHERE segnum NOT IN (SELECT to_segnum FROM net)",
    "P8_outlets": f"WITH {FOREST} SELECT segnum FROM net WHERE to_segnum = 0",
    "P11_width": f"WITH {PART} SELECT segnum, round(1.42 + pow(value * 1000 / 1e6, 0.52), 6) AS width FROM net",
    "P12_pair_continuous": f"WITH {FOREST} SELECT a.segnum, round(abs(a.value) + 1, 6) AS top, round(abs(coalesce(b.value, a.value)) + 1, 6) AS bottom FROM net a LEFT JOIN net b ON b.segnum = a.to_segnum",
    "P12_pair_constant": f"WITH {FOREST} SELECT segnum, round(abs(value) + 1, 6) AS top, round(abs(value) + 1, 6) AS bottom FROM net",
    "P12_pair_additive": f"""WITH {FOREST} SELECT a.segnum, round(abs(a.value) + 1, 6) AS top, round(CASE WHEN a.to_segnum <> 0 AND count(*) OVER w > 1 THEN (abs(a.value) + 1) / sum(abs(a.value) + 1) OVER w * (abs(b.value) + 1) ELSE abs(a.value) + 1 END, 6) AS bottom
FROM net a LEFT JOIN net b ON b.segnum = a.to_segnum WINDOW w AS (PARTITION BY a.to_segnum)""",
    "P13_remove": f"WITH RECURSIVE {PART}, {CLIMB}, {ORDERS} SELECT segnum, to_segnum, so AS stream_order FROM levels WHERE so <> 1 AND segnum NOT IN (2, 3)",
    "R1_route_down": _ROUTE.format(net=PART, a=100, b=3), "R1_route_up": _ROUTE.format(net=PART, a=3, b=100), "R1_route_indirect": _ROUTE.format(net=PART, a=99, b=70),
    "R2_gather_up": f"WITH RECURSIVE {PART}, {DOWN} SELECT segnum AS start, start AS segnum, -1::BIGINT AS depth FROM down WHERE segnum IN (5, 6)",
    "R2_gather_down": f"WITH RECURSIVE {PART}, {DOWN} SELECT start, segnum, depth::BIGINT AS depth FROM down WHERE start IN (90, 75) AND depth > 0",
    "R2_gather_barrier": f"WITH RECURSIVE {PART}, {DOWN} SELECT 1::BIGINT AS start, d.start AS segnum, -1::BIGINT AS depth FROM down d WHERE d.segnum = 1 AND NOT EXISTS (SELECT 1 FROM down e WHERE e.start = d.start AND e.segnum IN (5, 6) AND e.depth > 0)",
    "R2_gather_sidebranch": f"""WITH RECURSIVE {PART}, {DOWN}, way AS (SELECT segnum, depth FROM down WHERE start = 50 AND segnum >= 3 AND depth > 0)
SELECT 50::BIGINT AS start, segnum, depth::BIGINT AS depth FROM way
UNION ALL SELECT 50, d.start, -1 FROM down d WHERE d.segnum IN (SELECT n.segnum FROM net n JOIN way w ON n.to_segnum = w.segnum AND w.segnum <> 3 WHERE n.segnum <> 50 AND n.segnum NOT IN (SELECT segnum FROM way))
AND NOT EXISTS (SELECT 1 FROM down e WHERE e.start = d.start AND e.segnum = 3 AND e.depth > 0 AND d.segnum < 3)""",
    "R7_location_pairs": _pairs(False), "R7_location_pairs_all": _pairs(True), "R7_location_pairs_nobranch": _pairs(False, "nb"),
    "R8_pair_lines": f"""WITH {LINES}, lens AS (SELECT segnum, {_LEN} AS len FROM line)
SELECT a.segnum AS upstream, a.segnum // 4 AS downstream, round(a.len * 0.75 + b.len + c.len * 0.25, 6) AS length FROM lens a JOIN lens b ON b.segnum = a.segnum // 2 JOIN lens c ON c.segnum = a.segnum // 4""",
    "G1_length": f"WITH {LINES} SELECT segnum, round({_LEN}, 6) AS length FROM line",
    "G2_interpolate": f"""WITH {LINES}, l AS (SELECT *, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) AS l1, sqrt((ex - mx) * (ex - mx) + (ey - my) * (ey - my)) AS l2 FROM line), w AS (SELECT *, 0.25::DOUBLE * (l1 + l2) AS t FROM l)
SELECT segnum, round(CASE WHEN t <= l1 THEN sx + (mx - sx) * t / l1 ELSE mx + (ex - mx) * (t - l1) / l2 END, 6) AS x, round(CASE WHEN t <= l1 THEN sy + (my - sy) * t / l1 ELSE my + (ey - my) * (t - l1) / l2 END, 6) AS y FROM w""",
    "G3_project": f"""WITH {LINES}, e AS (SELECT segnum, 0 AS k, sx AS ax, sy AS ay, mx AS qx, my AS qy, 0.0::DOUBLE AS base FROM line UNION ALL SELECT segnum, 1, mx, my, ex, ey, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) FROM line),
t AS (SELECT *, least(greatest(((0.3 - ax) * (qx - ax) + (2.25 - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)), 0), 1)::DOUBLE AS t FROM e),
p AS (SELECT segnum, k, sqrt(pow(ax + (qx - ax) * t - 0.3, 2) + pow(ay + (qy - ay) * t - 2.25, 2)) AS dist, base + t * sqrt(pow(qx - ax, 2) + pow(qy - ay, 2)) AS "at" FROM t)
SELECT segnum, round(dist, 6) AS dist, round("at", 6) AS "at" FROM p QUALIFY row_number() OVER (PARTITION BY segnum ORDER BY dist, "at") = 1""",
    "G6_substring": f"WITH {LINES}, l AS (SELECT segnum, {_LEN} AS len, sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) AS l1 FROM line) SELECT segnum, round(len / 2, 6) AS length, (2 + CASE WHEN l1 > 0.25 * len AND l1 < 0.75 * len THEN 1 ELSE 0 END)::BIGINT AS vertices FROM l",
    "G8_area": f"SELECT s_suppkey + 1 AS segnum, round({_AREA}, 6) AS area FROM supplier",
    "G15_wkt": f"WITH {LINES} SELECT segnum, true AS same, round({_LEN}, 6) AS length FROM line",
}
