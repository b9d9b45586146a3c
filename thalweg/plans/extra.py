"""Queries of smaller operators: coercions, geometry helpers, package tables and files, diversion reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.functions import text
from thalweg.operators import export as E
from thalweg.operators import network as N
from thalweg.operators import overlay as O
from thalweg.operators import query as R
from thalweg.operators import series as S
from thalweg.operators.trees import checkpointed, shared_folder
from thalweg.plans import derived as D
from thalweg.plans import model as M
from thalweg.plans.graph import COMB, LINES, r6
from thalweg.sources import files


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{spark.sparkContext.applicationId}"


def r5(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    links = checkpointed(R.reach_links(found, net)).select(F.col("ridx").alias("segnum"), F.col("to_ridx").alias("to_segnum"))
    last = found.agg(F.max("ridx")).first()[0]
    return R.route_frame(links, 1, last, 0).select(F.col("step").cast("long").alias("step"), F.col("segnum").alias("ridx"))


def p10(spark: SparkSession, d: str) -> DataFrame:
    edges = D.part_comb(spark, d)
    return S.segments_series(N.Network(edges), edges.select("segnum", (F.col("value") * 2).alias("value")), "doubled").select("segnum", r6("doubled").alias("doubled"))


def p15(spark: SparkSession, d: str) -> DataFrame:
    ids = D.read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("ids"))
    return ids.select(F.col("s_nationkey").cast("long").alias("nation"), text.abbreviated(F.col("ids"), 3).alias("ids"))


def g7(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("geometry")
    return D.supplier_lines(spark, d).select("segnum", r6(G.length(G.bias_substring(g, 0.25))).alias("upper"), r6(G.length(G.bias_substring(g, -0.5))).alias("lower"))


def g13(spark: SparkSession, d: str) -> DataFrame:
    flat = G.round_coords(G.force_2d(F.col("geometry")), 2)
    return D.supplier_lines(spark, d).select("segnum", G.first(flat)["x"].alias("x"), G.first(flat)["y"].alias("y"), F.size(G.z_coords(flat)).cast("long").alias("heights"))


def a6(spark: SparkSession, d: str) -> DataFrame:
    lines = D.supplier_lines(spark, d)
    pairs = lines.select("segnum", F.col("geometry").alias("a"), F.expr("segnum div 2").alias("to")).join(lines.select(F.col("segnum").alias("to"), F.col("geometry").alias("b")), "to")
    merged = G.merge_lines(F.array("a", "b"))
    return pairs.select("segnum", F.size(merged).cast("long").alias("vertices"), r6(G.length(merged)).alias("length"))


def a10(spark: SparkSession, d: str) -> DataFrame:
    """A period for each year of orders, of a day and a half for every day with one."""
    days = D.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().groupBy(F.year("day").alias("year")).count().orderBy("year").collect()
    found = S.stress_periods(spark, [r["count"] * 1.5 for r in days], "2001-01-01 00:00:00")
    return found.select(F.col("kper").cast("long").alias("kper"), F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


def e2(spark: SparkSession, d: str) -> DataFrame:
    data = D.read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("nseg"), (F.col("s_nationkey") % 3).alias("iupseg"), F.lit(0.0).alias("hcond1"))
    return E.set_segment_data(E.set_segment_data(data, "hcond1", F.lit(5.0), "segments"), "hcond1", F.lit(7.0), "diversions").select("nseg", "hcond1")


def e8(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    rows = found.withColumn("elev", F.lit(100.0) - F.col("i")).withColumn("cond", F.col("rlen") * 2)
    return E.package_period(rows, "drn").select("per", "k", "i", "j", "elev", r6("cond").alias("cond"))


def m13(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    n = D.read(spark, d, "supplier").count()
    div = D.customer_points(spark, d).select(F.col("loc").alias("divid"), (F.col("loc") % n + 1).alias("from_segnum"), "x", "y")
    return O.diversion_reaches(found, div, M.GRID).where("diversion").select("ridx", "segnum", "divid", "i", "j")


def s1(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as text, read back and measured."""
    path = f"{_folder(spark)}/lines"
    D.supplier_lines(spark, d).select("segnum", G.to_wkt(F.col("geometry")).alias("wkt")).write.mode("overwrite").parquet(path)
    return files.read_lines(spark, path).select("segnum", r6(G.length(F.col("geometry"))).alias("length"))


def s9(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/network"
    files.save(N.Network(D.part_comb(spark, d)), path)
    return files.load(spark, path).segments.select("segnum", "to_segnum")


def s13(spark: SparkSession, d: str) -> DataFrame:
    _, links, _ = M._packaged(spark, d)
    path = f"{_folder(spark)}/connections"
    files.write_connection_data(E.connection_data(links), path)
    return spark.read.text(path).select(F.regexp_replace("value", " +", " ").alias("line"))


def s15(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/drn_period_{{}}.dat"
    _, found, _ = M._reaches(spark, d)
    rows = found.withColumn("elev", F.lit(100) - F.col("i")).withColumn("cond", F.col("j") * 2)
    files.write_periods(E.package_period(rows, "drn"), path)
    return spark.read.text(path.format(1)).select(F.regexp_replace(F.trim("value"), " +", " ").alias("line"))


QUERIES = {
    "R5_route_reaches": r5, "P10_segments_series": p10, "P15_abbreviated": p15, "G7_bias_substring": g7, "G13_round_2d": g13, "A6_merge_lines": a6, "A10_stress_periods": a10,
    "E2_segment_scalar": e2, "E8_package_period": e8, "M13_diversion_reaches": m13, "S1_lines_source": s1, "S9_save_load": s9, "S13_connection_file": s13, "S15_period_file": s15,
}

_LEN = "sqrt((mx - sx) * (mx - sx) + (my - sy) * (my - sy)) + sqrt((ex - mx) * (ex - mx) + (ey - my) * (ey - my))"

ORACLES = {
    "R5_route_reaches": f"WITH RECURSIVE {M._REACH}, {M._LINKS}, way AS (SELECT 1::BIGINT AS ridx, 0::BIGINT AS step UNION ALL SELECT l.to_ridx, w.step + 1 FROM way w JOIN links l USING (ridx) WHERE l.to_ridx <> 0) SELECT step, ridx FROM way WHERE EXISTS (SELECT 1 FROM way WHERE ridx = (SELECT max(ridx) FROM reach))",
    "P10_segments_series": f"WITH {COMB} SELECT segnum, round(value * 2, 6) AS doubled FROM net",
    "P15_abbreviated": "WITH l AS (SELECT s_nationkey::BIGINT AS nation, list(s_suppkey ORDER BY s_suppkey) AS ids FROM supplier GROUP BY s_nationkey) SELECT nation, CASE WHEN len(ids) <= 3 THEN '[' || array_to_string(ids, ', ') || ']' ELSE '[' || ids[1] || ', ' || ids[2] || ', ..., ' || ids[-1] || ']' END AS ids FROM l",
    "G7_bias_substring": f"WITH {LINES} SELECT segnum, round(({_LEN}) * 0.75, 6) AS upper, round(({_LEN}) * 0.5, 6) AS lower FROM line",
    "G13_round_2d": f"WITH {LINES} SELECT segnum, round(sx, 2) AS x, round(sy, 2) AS y, 0::BIGINT AS heights FROM line",
    "A6_merge_lines": f"WITH {LINES}, l AS (SELECT segnum, {_LEN} AS len FROM line) SELECT a.segnum, 5::BIGINT AS vertices, round(a.len + b.len, 6) AS length FROM l a JOIN l b ON b.segnum = a.segnum // 2",
    "A10_stress_periods": """WITH y AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_orderdate::DATE) AS n FROM orders GROUP BY ALL), e AS (SELECT row_number() OVER (ORDER BY y) - 1 AS kper, n, sum(n) OVER (ORDER BY y) AS upto FROM y)
SELECT kper, strftime(TIMESTAMP '2001-01-01' + to_hours(((upto - n) * 36)::BIGINT), '%Y-%m-%d %H:%M:%S') AS start_date, strftime(TIMESTAMP '2001-01-01' + to_hours((upto * 36)::BIGINT), '%Y-%m-%d %H:%M:%S') AS end_date FROM e""",
    "E2_segment_scalar": "SELECT s_suppkey + 1 AS nseg, CASE WHEN s_nationkey % 3 = 0 THEN 5.0 ELSE 7.0 END::DOUBLE AS hcond1 FROM supplier",
    "E8_package_period": f"WITH RECURSIVE {M._REACH} SELECT 1 AS per, 1 AS k, i + 1 AS i, j + 1 AS j, 100.0::DOUBLE - i AS elev, round(rlen * 2, 6) AS cond FROM reach",
    "M13_diversion_reaches": f"""WITH RECURSIVE {M._REACH}, {M._POINTS}, d AS (SELECT *, loc % (SELECT count(*) FROM supplier) + 1 AS from_segnum FROM point)
SELECT (SELECT max(ridx) FROM reach) + row_number() OVER (ORDER BY loc) AS ridx, 0::BIGINT AS segnum, loc AS divid, least(greatest(floor((16 - y) / 0.5), 0), 33)::INTEGER AS i, least(greatest(floor(x / 0.125), 0), 7)::INTEGER AS j FROM d WHERE from_segnum IN (SELECT segnum FROM reach)""",
    "S1_lines_source": f"WITH {LINES} SELECT segnum, round({_LEN}, 6) AS length FROM line",
    "S9_save_load": f"WITH {COMB} SELECT segnum, to_segnum FROM net",
    "S13_connection_file": f"WITH RECURSIVE {M._REACH}, {M._LINKS}, {M._CONN} SELECT '# ridx' || coalesce(' ' || (SELECT string_agg('ic' || k, ' ' ORDER BY k) FROM range(1, (SELECT max(len(up) + (to_ridx > 0)::INTEGER) FROM flow) + 1) t(k)), '') AS line UNION ALL SELECT rtrim(ridx || ' ' || coalesce(array_to_string(list_concat(up, CASE WHEN to_ridx > 0 THEN [-to_ridx] ELSE [] END), ' '), '')) AS line FROM flow",
    "S15_period_file": f"WITH RECURSIVE {M._REACH} SELECT '# k i j elev cond' AS line UNION ALL SELECT concat_ws(' ', 1, i + 1, j + 1, 100 - i, j * 2) FROM reach",
}
