"""Elevations along networks and reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import overlay as O
from thalweg.operators import trees
from thalweg.operators.network import Network, pair_segments
from thalweg.operators.trees import checkpointed


def _lowest(line: Column, slope: Column, skip_first: Column) -> Column:
    """The least height that a vertex of a line allows its end, falling at ``slope`` from there on; the first vertex may be left out."""
    total = G.length(line)
    bound = lambda e: e["b"]["z"] - slope * (total - e["at"] - e["len"])
    inner = F.array_min(F.transform(G.measured(line), bound))
    return F.when(skip_first, inner).otherwise(F.least(inner, G.first(line)["z"] - slope * total))


def _profile(line: Column, start: Column, slope: Column, end: Column) -> Column:
    """``array<struct<dist, z>>`` of a line that starts at ``start`` and falls by ``slope`` or more at each vertex; its last height is ``end``."""
    lowered = F.aggregate(
        G.measured(line), F.array(F.struct(F.lit(0.0).alias("dist"), start.alias("z"))),
        lambda acc, e: F.concat(acc, F.array(F.struct((e["at"] + e["len"]).alias("dist"), F.least(e["b"]["z"], F.element_at(acc, -1)["z"] - slope * e["len"]).alias("z")))),
    )
    n = F.size(lowered)
    return F.transform(lowered, lambda p, k: F.when(k == n - 1, F.struct(p["dist"].alias("dist"), end.alias("z"))).otherwise(p))


def adjust_elevation_profile(network: Network, min_slope: float | DataFrame = 1e-3) -> DataFrame:
    """``(segnum, geometry, profile, adjusted, most)``: heights lowered so that every line falls by ``min_slope`` or more.

    A line starts as high as its lowest tributary ends, falls at each vertex,
    and tributaries of one segment end at the same height; a line that starts
    below the ends of its tributaries raises NotImplementedError. ``min_slope``
    is a number or a frame ``(segnum, value)``.

    The end of a line is the least, over itself and all lines upstream, of
    what their vertices allow less the fall on the way down. With ways
    measured to the outlet that is a smallest value upstream, so pointer
    doubling finds it for all lines at once; each line's vertices then follow
    from its start alone.
    """
    if not isinstance(min_slope, DataFrame):
        if min_slope <= 0:
            raise ValueError("min_slope must be greater than zero")
        rows = network.segments.withColumn("_slope", F.lit(float(min_slope)))
    else:
        if min_slope.where("value <= 0").limit(1).count():
            raise ValueError("min_slope must be greater than zero")
        rows = network.segments.join(min_slope.select("segnum", F.col("value").cast("double").alias("_slope")), "segnum")
    if not network.has_z:
        raise AttributeError("line geometry does not have Z dimension")
    fed = rows.select(F.col("to_segnum").alias("segnum")).distinct().withColumn("_fed", F.lit(True))
    g, slope = F.col("geometry"), F.col("_slope")
    rows = rows.select("segnum", "to_segnum", "geometry", "_slope").join(fed, "segnum", "left").withColumn("_fed", F.coalesce("_fed", F.lit(False)))
    rows = checkpointed(rows.withColumn("fall", slope * G.length(g)).withColumn("bound", _lowest(g, slope, F.col("_fed"))))
    # What is left to fall after a line, from its end to the outlet; keys are bounds as seen from the outlet.
    ways = trees.climb(rows.select("segnum", "to_segnum", "fall"), network.end, length="fall").select("segnum", "dist_to_outlet")
    keyed = checkpointed(rows.select("segnum", "to_segnum", "fall", "bound").join(ways, "segnum").withColumn("after", F.col("dist_to_outlet") - F.col("fall")).withColumn("key", F.col("bound") - F.col("after")))
    least = trees.climb(keyed.select("segnum", "to_segnum", "key"), network.end, mins=("key",)).select("segnum", "least_key")
    ends = checkpointed(keyed.join(least, "segnum").select("segnum", "to_segnum", (F.col("least_key") + F.col("after")).alias("end_z")))
    arriving = checkpointed(ends.groupBy(F.col("to_segnum").alias("segnum")).agg(F.min("end_z").alias("arrive")))
    full = rows.join(ends.drop("to_segnum"), "segnum").join(arriving, "segnum", "left").join(arriving.select(F.col("segnum").alias("to_segnum"), F.col("arrive").alias("level")).where(F.col("to_segnum") != network.end), "to_segnum", "left")
    full = checkpointed(full)
    rising = full.where(F.col("arrive") > G.first(g)["z"] + 1e-9).select("segnum").orderBy("segnum").limit(1).collect()
    if rising:
        raise NotImplementedError(f"segment {rising[0][0]} starts below the ends of its tributaries")
    start = F.coalesce("arrive", G.first(g)["z"])
    made = full.withColumn("profile", _profile(g, start, slope, F.coalesce("level", "end_z")))
    lowered = F.zip_with(g, F.col("profile"), lambda p, q: G.xyz(p["x"], p["y"], q["z"]))
    change = F.zip_with(g, F.col("profile"), lambda p, q: F.abs(p["z"] - q["z"]))
    return made.select(
        "segnum", lowered.alias("geometry"), "profile", F.size(F.filter(change, lambda c: c > 1e-9)).alias("adjusted"), F.array_max(change).alias("most")
    )


def add_top_bottom(found: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Reaches with the model's ``top`` and first ``bot`` at their cells; both frames are ``(i, j, value)``."""
    return found.join(top.select("i", "j", F.col("value").alias("top")), ["i", "j"], "left").join(bottom.select("i", "j", F.col("value").alias("bot")), ["i", "j"], "left")


#: A number for all segments, or a frame ``(segnum, value)``.
Value = float | DataFrame


def _frame(network: Network, value: Value) -> DataFrame:
    if isinstance(value, DataFrame):
        return value.select("segnum", F.col("value").cast("double").alias("value"))
    return network.segments.select("segnum", F.lit(float(value)).alias("value"))


def _pair(network: Network, first: Value, out: Value | None, method: str = "continuous") -> DataFrame:
    out = out if out is None or isinstance(out, DataFrame) else float(out)
    return pair_segments(network, _frame(network, first), out=out, method=method)


def _width(network: Network, width1: Value | None) -> Value:
    """The given width, else that of segments, else 10."""
    if width1 is not None:
        return width1
    return network.segments.select("segnum", F.col("width").alias("value")) if "width" in network.segments.columns else 10.0


def _along(network: Network, found: DataFrame, first: Value, out: Value | None, name: str, *, log: bool = False, method: str = "continuous") -> DataFrame:
    return O.reach_values(found, _pair(network, first, out, method), log=log).withColumnRenamed("value", name)


def _tops(found: DataFrame, top: DataFrame, name: str) -> DataFrame:
    """Reach heights: of the model top, or the mean of a reach's own vertices where they have any."""
    rows = O.reach_array(found, top).select("ridx", F.col("value").cast("double").alias("_top"))
    if "geometry" not in found.columns:
        return rows.withColumnRenamed("_top", name)
    return rows.join(O.zcoords(found).select("ridx", "zcoord_avg"), "ridx").select("ridx", F.coalesce("zcoord_avg", "_top").alias(name))


def default_packagedata(
    network: Network, found: DataFrame, grid: O.Grid, top: DataFrame, *, hyd_cond1: Value = 1.0, hyd_cond_out: Value | None = None, thickness1: Value = 1.0, thickness_out: Value | None = None,
    width1: Value | None = None, width_out: Value | None = None, roughch: Value = 0.024,
) -> DataFrame:
    """Reaches with ``rwid, rgrd, rtp, rbth, rhk, man``.

    Widths are those given, of segments or 10; slopes and heights are the
    reaches' own where they have ``geometry`` with heights, else those of the
    model ``top(i, j, value)``; thickness and (on a log scale) conductivity run
    from segment to segment. Diversions have width 1 and conductivity 0.
    """
    lines = network.segments if "geometry" in network.segments.columns else None
    slope = O.reach_slope(found, "auto" if lines is not None and "geometry" in found.columns else "grid_top", segments=lines, top=top, grid=grid)
    rows = found.join(slope.withColumnRenamed("slope", "rgrd"), "ridx").join(_tops(found, top, "rtp"), "ridx")
    rows = rows.join(_along(network, found, thickness1, thickness_out, "rbth"), "ridx").join(_along(network, found, hyd_cond1, hyd_cond_out, "rhk", log=True), "ridx")
    rows = rows.join(_along(network, found, _width(network, width1), width_out, "rwid", method="constant"), "ridx")
    rows = rows.join(_along(network, found, roughch, None, "man", method="constant"), "ridx")
    if "diversion" not in found.columns:
        return rows
    own = lambda c, v: F.when(F.col("diversion"), v).otherwise(F.col(c)).alias(c)
    fixed = {"rwid": 1.0, "rhk": 0.0, "rbth": 1.0, "man": float(roughch) if not isinstance(roughch, DataFrame) else 0.024}
    return rows.select(*[own(c, F.lit(fixed[c])) if c in fixed else F.col(c) for c in rows.columns])


def default_segment_data(
    network: Network, marked: DataFrame, found: DataFrame, data: DataFrame, top: DataFrame, *, hyd_cond1: Value = 1.0, hyd_cond_out: Value | None = None, thickness1: Value = 1.0,
    thickness_out: Value | None = None, width1: Value | None = None, width_out: Value | None = None, roughch: Value = 0.024,
) -> tuple[DataFrame, DataFrame]:
    """``data(nseg, segnum, outseg, iupseg, ...)`` with the columns of a segment, and reaches with ``strthick, strhc1, strtop``.

    A segment has ``icalc`` 1, ``hcond1, hcond2, thickm1, thickm2, width1,
    width2`` at its two ends, ``roughch``, and ``elevup, elevdn`` of its first
    and last reach. Segments that ``marked(segnum, in_model)`` says are outside
    have ``icalc`` and ``hcond1`` 0 and depth 1; diversions (``iupseg`` not 0)
    ``icalc`` 0 and thickness and depth 1.
    """
    both = _pair(network, hyd_cond1, hyd_cond_out).select("segnum", F.col("top").alias("hcond1"), F.col("bottom").alias("hcond2"))
    both = both.join(_pair(network, thickness1, thickness_out).select("segnum", F.col("top").alias("thickm1"), F.col("bottom").alias("thickm2")), "segnum")
    both = both.join(_pair(network, _width(network, width1), width_out, "constant").select("segnum", F.col("top").alias("width1"), F.col("bottom").alias("width2")), "segnum")
    both = both.join(_frame(network, roughch).withColumnRenamed("value", "roughch"), "segnum")
    reached = found.join(_along(network, found, thickness1, thickness_out, "strthick"), "ridx").join(_along(network, found, hyd_cond1, hyd_cond_out, "strhc1", log=True), "ridx").join(_tops(found, top, "strtop"), "ridx")
    ends = reached.groupBy(F.col("iseg").alias("nseg")).agg(F.min_by("strtop", "ireach").alias("elevup"), F.max_by("strtop", "ireach").alias("elevdn"))
    added = ["icalc", "hcond1", "hcond2", "thickm1", "thickm2", "width1", "width2", "roughch", "elevup", "elevdn", "depth1", "depth2"]
    rows = data.drop(*added).join(both, "segnum", "left").join(ends, "nseg", "left").join(marked.select("segnum", F.col("in_model").alias("_in")), "segnum", "left")
    taken, outside = F.col("iupseg") != 0, ~F.coalesce("_in", F.lit(True))

    def pick(c: str):
        own = F.coalesce(F.col(c), F.lit(0.0)) if c in both.columns else F.lit(0.0)
        if c in ("thickm1", "thickm2"):
            return F.when(taken, 1.0).otherwise(own)
        if c in ("depth1", "depth2"):
            return F.when(taken | outside, 1.0).otherwise(0.0)
        return F.when(outside & ~taken, 0.0).otherwise(own) if c == "hcond1" else own

    icalc = F.when(taken | outside, 0).otherwise(1)
    return rows.select(*[c for c in data.columns if c not in added], icalc.alias("icalc"), *[pick(c).alias(c) for c in added[1:8]], "elevup", "elevdn", pick("depth1").alias("depth1"), pick("depth2").alias("depth2")), reached


def reach_places(found: DataFrame) -> DataFrame:
    """``(ridx, upto, place)``: length of the segment's reaches up to and with each, and its middle: 0 for the first, the whole length for the last."""
    by = Window.partitionBy("iseg").orderBy("ireach")
    upto = F.sum("rlen").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.select("ridx", "iseg", "ireach", "rlen").withColumn("upto", upto).withColumn("seglen", F.sum("rlen").over(Window.partitionBy("iseg")))
    place = F.when(F.lead("ridx").over(by).isNull(), F.col("seglen")).when(F.lag("ridx").over(by).isNull(), 0.0).otherwise(F.lag("upto").over(by) + F.col("rlen") / 2)
    return rows.withColumn("place", place).select("ridx", "upto", "place")


def reconcile_tops(found: DataFrame, segment_data: DataFrame) -> DataFrame:
    """``(ridx, strtop)`` from ``segment_data(nseg, elevup, elevdn)``: on the straight line between a segment's ends, at the middle of each reach, at the ends for the first and last.

    The middle is where the reach before ends, as the source measures it, plus half the reach's length.
    """
    rows = found.select("ridx", "iseg", F.sum("rlen").over(Window.partitionBy("iseg")).alias("seglen")).join(reach_places(found), "ridx").join(segment_data.select(F.col("nseg").alias("iseg"), "elevup", "elevdn"), "iseg")
    return rows.select("ridx", (F.col("elevup") + F.col("place") * (F.col("elevdn") - F.col("elevup")) / F.col("seglen")).alias("strtop"))


def incised(segment_data: DataFrame, min_incise: float = 0.2, min_slope: float = 1e-4, max_top: float | None = None) -> DataFrame:
    """``segment_data(nseg, elevup, elevdn, top_up, top_dn, seglen)`` with ends at least ``min_incise`` below the top and no higher than ``max_top``, and the slope each should have."""
    def end(elev: str, top: str):
        low = F.least(F.col(elev), F.col(top) - min_incise)
        return low if max_top is None else F.least(low, F.lit(max_top))

    slope = F.greatest((F.col("top_up") - F.col("top_dn")) / (10 * F.col("seglen")), F.lit(min_slope))
    return segment_data.withColumn("elevup", end("elevup", "top_up")).withColumn("elevdn", end("elevdn", "top_dn")).withColumn("prefslope", slope)
