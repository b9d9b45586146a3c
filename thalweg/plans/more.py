"""Queries of elevations, files and reach graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import elevation as V
from thalweg.operators import network as N
from thalweg.operators import query as R
from thalweg.operators.trees import checkpointed, shared_folder
from thalweg.plans import derived as D
from thalweg.plans import model as M
from thalweg.plans.graph import LINES, r6
from thalweg.sources import files


def v1(spark: SparkSession, d: str) -> DataFrame:
    net = M._network(spark, d)
    tall = net.segments.withColumn("geometry", F.transform("geometry", lambda p: G.xyz(p["x"], p["y"], p["y"] * 2 + F.col("segnum") % 3)))
    found = V.adjust_elevation_profile(N.Network(tall), 0.01)
    return found.select("segnum", r6(G.first(F.col("geometry"))["z"]).alias("first_z"), r6(G.last(F.col("geometry"))["z"]).alias("last_z"), "adjusted")


def v5(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    cells = M._cells(spark)
    return V.add_top_bottom(found, cells, cells.withColumn("value", F.col("value") - 10)).select("ridx", "top", "bot")


def v6(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    made = V.default_packagedata(net, found, M.GRID, M._cells(spark), hyd_cond1=2.0, hyd_cond_out=20.0)
    return made.select("ridx", "rwid", r6("rgrd").alias("rgrd"), "rtp", "rbth", r6("rhk").alias("rhk"), "man")


def v12(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = M._reaches(spark, d)
    data = found.groupBy("iseg").agg(F.max("segnum").alias("s")).select(F.col("iseg").alias("nseg"), (F.lit(100.0) + F.col("s")).alias("elevup"), (F.lit(90.0) + F.col("s") / 2).alias("elevdn"))
    return V.reconcile_tops(found, data).select("ridx", r6("strtop").alias("strtop"))


def v11(spark: SparkSession, d: str) -> DataFrame:
    s = D.read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("nseg"), F.abs("s_acctbal").alias("elevup"), (F.abs("s_acctbal") * 0.9).alias("elevdn"), F.lit(500.0).alias("top_up"), F.lit(450.0).alias("top_dn"), (F.lit(10.0) + F.col("s_suppkey")).alias("seglen"))
    return V.incised(s, max_top=480.0).select("nseg", r6("elevup").alias("elevup"), r6("elevdn").alias("elevdn"), r6("prefslope").alias("prefslope"))


def r6_gather(spark: SparkSession, d: str) -> DataFrame:
    net, found, _ = M._reaches(spark, d)
    links = checkpointed(R.reach_links(found, net))
    last = links.where("to_ridx = 0").agg(F.max("ridx")).first()[0] or 1
    return R.gather_reaches(links, [last]).select("start", "ridx")


def s6_s7(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/table-{spark.sparkContext.applicationId}.txt"
    rows = D.read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("nation "), F.col("n_regionkey").cast("string"))).alias("label"), (F.col("n_regionkey") / 4).alias("share"))
    files.write_table(rows.select("n_nationkey", "share", "label"), path)
    return files.read_table(spark, path)


QUERIES = {
    "V1_elevation_profile": v1, "V5_top_bottom": v5, "V6_default_packagedata": v6, "V11_incision": v11, "V12_reconcile_tops": v12, "R6_gather_reaches": r6_gather, "S6_S7_formatted_table": s6_s7,
}

_TALL = "tall AS (SELECT *, 2 * sy + segnum % 3 AS sz, 2 * my + segnum % 3 AS mz, 2 * ey + segnum % 3 AS ez, sqrt(pow(mx - sx, 2) + pow(my - sy, 2)) AS l1, sqrt(pow(ex - mx, 2) + pow(ey - my, 2)) AS l2 FROM line)"
ORACLES = {
    "V1_elevation_profile": f"""WITH RECURSIVE {LINES}, {M._NET}, {_TALL}, fed AS (SELECT DISTINCT to_segnum AS segnum FROM net),
own AS (SELECT t.segnum, 0.01::DOUBLE * (l1 + l2) AS fall, least(mz - 0.01::DOUBLE * l2, ez, CASE WHEN t.segnum IN (SELECT segnum FROM fed) THEN 1e300 ELSE sz - 0.01::DOUBLE * (l1 + l2) END) AS bound FROM tall t),
walk AS (SELECT o.segnum AS place, n.to_segnum AS nxt, o.bound AS z FROM own o JOIN net n USING (segnum) UNION ALL SELECT w.nxt, n.to_segnum, w.z - o.fall FROM walk w JOIN own o ON o.segnum = w.nxt JOIN net n ON n.segnum = w.nxt),
ending AS MATERIALIZED (SELECT place AS segnum, min(z) AS z FROM walk GROUP BY place), arrive AS MATERIALIZED (SELECT n.to_segnum AS segnum, min(e.z) AS z FROM ending e JOIN net n USING (segnum) GROUP BY n.to_segnum),
done AS (SELECT t.*, coalesce(a.z, t.sz) AS fz, CASE WHEN n.to_segnum = 0 THEN e.z ELSE b.z END AS lz FROM tall t JOIN net n USING (segnum) JOIN ending e ON e.segnum = t.segnum LEFT JOIN arrive a ON a.segnum = t.segnum LEFT JOIN arrive b ON b.segnum = n.to_segnum)
SELECT segnum, round(fz, 6) AS first_z, round(lz, 6) AS last_z, (abs(fz - sz) > 1e-9)::INTEGER + (mz - (fz - 0.01::DOUBLE * l1) > 1e-9)::INTEGER + (abs(lz - ez) > 1e-9)::INTEGER AS adjusted FROM done""",
    "V5_top_bottom": f"WITH RECURSIVE {M._REACH} SELECT ridx, value AS top, value - 10 AS bot FROM reach JOIN cell USING (i, j)",
    "V6_default_packagedata": f"""WITH RECURSIVE {M._REACH}, {M._GRAD} SELECT ridx, 10.0::DOUBLE AS rwid, round(greatest(slope, 0.001), 6) AS rgrd, value AS rtp, 1.0::DOUBLE AS rbth,
round(CASE WHEN n.to_segnum = 0 THEN pow(10, log10(2.0::DOUBLE) + (log10(20.0::DOUBLE) - log10(2.0::DOUBLE)) * segndist) ELSE 2.0 END, 6) AS rhk, 0.024::DOUBLE AS man FROM reach JOIN net n USING (segnum) JOIN grad USING (i, j) JOIN cell USING (i, j)""",
    "V11_incision": "SELECT s_suppkey + 1 AS nseg, round(least(abs(s_acctbal), 499.8, 480)::DOUBLE, 6) AS elevup, round(least(abs(s_acctbal) * 0.9, 449.8)::DOUBLE, 6) AS elevdn, round(greatest(50.0::DOUBLE / (10 * (10 + s_suppkey)), 0.0001), 6) AS prefslope FROM supplier",
    "V12_reconcile_tops": f"""WITH RECURSIVE {M._REACH}, p AS (SELECT ridx, segnum, rlen, sum(rlen) OVER (PARTITION BY iseg) AS len, lag(ridx) OVER w AS pr, lead(ridx) OVER w AS nx, sum(rlen) OVER w - rlen AS before FROM reach WINDOW w AS (PARTITION BY iseg ORDER BY ireach))
SELECT ridx, round(100 + segnum + (CASE WHEN nx IS NULL THEN len WHEN pr IS NULL THEN 0 ELSE before + rlen / 2 END) * (90 + segnum / 2.0::DOUBLE - 100 - segnum) / len, 6) AS strtop FROM p""",
    "R6_gather_reaches": f"WITH RECURSIVE {M._REACH}, {M._LINKS}, up AS (SELECT max(ridx) AS start, max(ridx) AS ridx FROM links WHERE to_ridx = 0 UNION ALL SELECT u.start, l.ridx FROM up u JOIN links l ON l.to_ridx = u.ridx) SELECT start, ridx FROM up",
    "S6_S7_formatted_table": "SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey / 4 AS share, CASE WHEN n_nationkey % 4 <> 0 THEN 'nation ' || n_regionkey END AS label FROM nation",
}
