"""Elevations of segments and reaches made to fall, with layers moved out of their way.

Segment ends fall in waves from the headwaters, which doubling gathers. Reaches
are settled one after the other, since each looks at the one before and at a
layer bottom that others in its cell may have lowered; what shares no cell,
directly or by way of others, doesn't depend on each other and is worked out
apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators import elevation
from thalweg.operators.trees import checkpointed, climb, components, upstream_minima

#: What stays between the bed and the bottom of the first layer.
BUFFER = 1.0
#: How much lower the next segment starts than the one before ends.
STEP = 0.001


def segment_ends(data: DataFrame, found: DataFrame, top: DataFrame) -> DataFrame:
    """``data(nseg, ...)`` with the cells of each segment's first and last reach (``k_up, i_up, j_up, k_dn, i_dn, j_dn``),
    the model top there (``top_up, top_dn``) and the length of its reaches (``seglen``). ``top`` is ``(i, j, value)``."""
    per = found.groupBy(F.col("iseg").alias("nseg")).agg(F.min_by(F.struct("k", "i", "j"), "ireach").alias("u"), F.max_by(F.struct("k", "i", "j"), "ireach").alias("d"), F.sum("rlen").alias("seglen"))
    per = per.select("nseg", *[F.col(f"{s}.{c}").alias(f"{c}_{e}") for s, e in (("u", "up"), ("d", "dn")) for c in "kij"], "seglen")
    rows = data.drop(*[c for c in per.columns if c != "nseg"], "top_up", "top_dn").join(per, "nseg", "left")
    for e in ("up", "dn"):
        rows = rows.join(top.select(F.col("i").alias(f"i_{e}"), F.col("j").alias(f"j_{e}"), F.col("value").alias(f"top_{e}")), [f"i_{e}", f"j_{e}"], "left")
    return rows


def with_incision(data: DataFrame) -> DataFrame:
    """``data`` with ``diff_up, diff_dn``: how far its ends lie below the model top."""
    return data.drop("diff_up", "diff_dn").select("*", (F.col("top_up") - F.col("elevup")).alias("diff_up"), (F.col("top_dn") - F.col("elevdn")).alias("diff_dn"))


def forward_segments(data: DataFrame, min_slope: float = 1e-4) -> DataFrame:
    """``data(nseg, outseg, elevup, elevdn, top_up, top_dn, seglen)`` with ends that fall from segment to segment.

    The rule is one of waves: they start at the segments that none flows into
    and move on to the next ones, and a segment is in a wave once for every
    different number of steps from such a start. It then ends where the next
    one starts, or where its slope (a tenth of that of the model top, at least
    ``min_slope``) takes it if that is lower, and the next one starts STEP below
    the lowest end that flows into it.

    So what a segment s brings to t further down is its first height, less the
    falls between, less STEP for each segment on the way and for each wave that
    comes to t after it: it arrives with the first wave that comes to s, since
    every wave that it could wait for comes to t as well. Waves are told apart
    by how far from the outlet they start. The least heights by wave are
    gathered over all that lies upstream by pointer doubling, and a running
    minimum by wave gives every height there ever was. Rounds follow the
    logarithm of the longest way.
    """
    fall = F.col("seglen") * F.greatest((F.col("top_up") - F.col("top_dn")) / (10.0 * F.col("seglen")), F.lit(min_slope))
    rows = data.select(F.col("nseg").cast("long").alias("segnum"), F.greatest(F.col("outseg"), F.lit(0)).cast("long").alias("to_segnum"), "elevup", "elevdn", fall.alias("fall"))
    fed = rows.select(F.col("to_segnum").alias("segnum")).distinct().withColumn("fed", F.lit(True))
    rows = checkpointed(rows.join(fed, "segnum", "left").withColumn("fed", F.coalesce("fed", F.lit(False))))
    edges = rows.select("segnum", "to_segnum", "fall")
    far = checkpointed(climb(edges, 0, length="fall").select("segnum", F.col("num_to_outlet").alias("hops"), F.col("dist_to_outlet").alias("down")))
    if far.where("hops = 0").limit(1).count():
        raise ValueError("segments flow in a circle")
    rows = checkpointed(rows.join(far, "segnum"))
    first = climb(rows.select("segnum", "to_segnum", F.when(~F.col("fed"), F.col("hops")).alias("start")), 0, mins=("start",)).select("segnum", F.col("least_start").cast("long").alias("wave"))
    height = F.col("elevup") - F.col("down") - STEP * (F.col("hops") + F.col("fed").cast("int"))
    brought = upstream_minima(rows.select("segnum", "to_segnum"), rows.join(first, "segnum").select("segnum", "wave", height.alias("least")), "wave", 0)
    # What each wave leaves of a segment's height, and what was before it.
    by = Window.partitionBy("segnum").orderBy("wave")
    so_far = brought.withColumn("n", F.row_number().over(by)).withColumn("low", F.min(F.col("least") + STEP * F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    waves = so_far.join(rows.select("segnum", "elevup", "fed", "hops", "down"), "segnum").withColumn("left", F.col("low") - STEP * F.col("n") + F.col("down") + STEP * F.col("hops"))
    waves = checkpointed(waves.select("segnum", "wave", F.coalesce(F.lag("left").over(by), "elevup").alias("before"), "left"))
    last = waves.groupBy("segnum").agg(F.max_by("left", "wave").alias("up"), F.max("wave").alias("wave"))
    # The last wave that comes to a segment finds the next one as the waves before have left it.
    then = waves.select(F.col("segnum").alias("to_segnum"), "wave", "before")
    ends = rows.join(last, "segnum").join(then, ["to_segnum", "wave"], "left").select(
        F.col("segnum").alias("nseg"), F.col("up").alias("elevup"), F.least(F.when(F.col("to_segnum") > 0, F.col("before")).otherwise(F.col("elevdn")), F.col("up") - F.col("fall")).alias("elevdn")
    )
    return data.drop("elevup", "elevdn").join(ends, "nseg")


def fix_segment_elevations(data: DataFrame, found: DataFrame, top: DataFrame, *, min_incise: float = 0.2, min_slope: float = 1e-4, max_top: float | None = None) -> DataFrame:
    """``data(nseg, outseg, elevup, elevdn)`` with ends below the model top that fall downstream, and all that was worked out on the way."""
    ends = segment_ends(data, found, top)
    cut = elevation.incised(ends, min_incise, min_slope, max_top).drop("prefslope")
    return with_incision(forward_segments(checkpointed(cut), min_slope))


def _layers(bottoms: list[DataFrame]) -> DataFrame:
    """``(i, j, bots)`` of the layers' ``(i, j, value)``, the first layer first."""
    out = bottoms[0].select("i", "j", F.array("value").alias("bots"))
    for more in bottoms[1:]:
        out = out.join(more.select("i", "j", F.col("value").alias("_b")), ["i", "j"]).select("i", "j", F.concat("bots", F.array("_b")).alias("bots"))
    return out


def _grouped_by_cells(rows: DataFrame, unit: str) -> DataFrame:
    """``rows`` with ``part``: the same for units that share a cell, directly or by way of others."""
    firsts = rows.groupBy("i", "j").agg(F.min(unit).alias("_first"))
    edges = rows.select(unit, "i", "j").join(firsts, ["i", "j"]).select(F.col(unit).alias("a"), F.col("_first").alias("b")).distinct()
    return rows.join(components(edges).select(F.col("node").alias(unit), F.col("component").alias("part")), unit)


def _thick_enough(bots: np.ndarray, least: float) -> np.ndarray:
    """Layer bottoms pushed down until each deeper layer is ``least`` thick."""
    out = bots.copy()
    for k in range(len(out) - 1):
        out[k + 1] = out[k] - max(out[k] - out[k + 1], least)
    return out


class _Cells:
    """Layer bottoms (and tops) of the cells of one part."""

    def __init__(self, part: pd.DataFrame):
        self.bots = {(r.i, r.j): np.array(r.bots, dtype=float) for r in part.itertuples()}
        self.tops = {(r.i, r.j): float(r.top) for r in part.itertuples()}

    def lower(self, cell: tuple[int, int], bed: float, seen: float) -> None:
        """Makes room for a bed: BUFFER below it, if the bottom as ``seen`` is higher."""
        if bed - BUFFER < seen:
            self.bots[cell][0] = bed - BUFFER


def _result(part: pd.DataFrame, cells: _Cells, tops: dict[int, float], fix_layers: bool, thick: float) -> pd.DataFrame:
    keys = list(zip(part["i"], part["j"], strict=True))
    settled = {c: _thick_enough(b, thick) if fix_layers else b for c, b in cells.bots.items()}
    return pd.DataFrame({"ridx": part["ridx"], "rtp": [tops[r] for r in part["ridx"]], "i": part["i"], "j": part["j"], "top": [cells.tops[c] for c in keys], "bots": [settled[c].tolist() for c in keys]})


RESULT = "ridx long, rtp double, i int, j int, top double, bots array<double>"


def _profiles(part: pd.DataFrame, min_slope: float, min_incise: float, thick: float, fix_layers: bool, upstream: bool) -> pd.DataFrame:
    """Reaches of one part, headwater by headwater, each profile from its first reach to the outlet or back."""
    part = part.sort_values("ridx", ignore_index=True)
    cells, rows = _Cells(part), {r.ridx: r for r in part.itertuples()}
    rtp = {r: float(x.rtp) for r, x in rows.items()}
    for head in [r for r, x in rows.items() if x.head and not x.diversion]:
        path, at = [], head
        while at in rows and len(path) <= len(rows):
            path.append(at)
            at = rows[at].to_ridx
        if path != sorted(set(path)):
            raise ValueError("reach numbers don't increase downstream")
        bottom = {r: cells.bots[rows[r].i, rows[r].j][0] for r in path}
        rtp[head] = min(rtp[head], rows[head].top - min_incise)
        was = {r: rtp[r] for r in path}
        last = path[-1]
        rtp[last] = min(rtp[last], rows[last].top - min_incise)
        cut_up, cut_down = rows[head].top - rtp[head], rows[last].top - rtp[last]
        lengths = np.array([rows[r].rlen for r in path])
        middle = dict(zip(path, np.cumsum(lengths) - lengths / 2, strict=True))
        order = path[::-1] if upstream else path
        before, at = (rtp[last] if upstream else rtp[head]), middle[order[0]]
        origin, tilt = at, (cut_up - cut_down) / lengths.sum()
        first = rows[order[0]]
        cells.lower((first.i, first.j), was[order[0]] - first.rbth, bottom[order[0]])
        for r in order[1:]:
            x = rows[r]
            limit = before - (middle[r] - at) * min_slope
            beyond: Callable[[float], bool] = (lambda v, limit=limit: v < limit) if upstream else (lambda v, limit=limit: v > limit)
            floor = bottom[r] + x.rbth + BUFFER
            want = x.top - cut_up + (middle[r] - origin) * tilt if was[r] > x.top - min_incise else was[r]
            if was[r] > x.top - min_incise and beyond(want):
                new = limit
            elif want - x.rbth < bottom[r] + BUFFER:
                new = limit if beyond(floor) else floor
            else:
                new = limit if beyond(want) else want
            rtp[r], before, at = new, new, middle[r]
            cells.lower((x.i, x.j), new - x.rbth, bottom[r])
    return _result(part, cells, rtp, fix_layers, thick)


def _profile_run(*settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda part: _profiles(part, *settings)


def fix_reach_elevations(
    found: DataFrame, links: DataFrame, segments: DataFrame, top: DataFrame, bottoms: list[DataFrame], *,
    min_slope: float = 1e-4, min_incise: float = 0.2, min_thick: float = 0.5, fix_layers: bool = True, direction: str = "downstream",
) -> DataFrame:
    """``(ridx, rtp, i, j, top, bots)``: reaches lowered so that they lie below the model top, fall by ``min_slope`` and keep to the first layer, and the layer bottoms of their cells.

    ``found(ridx, segnum, i, j, rlen, rtp, rbth)``, ``links(ridx, to_ridx)``.
    ``direction``: ``downstream`` holds to headwaters, ``upstream`` to outlets,
    ``both`` goes up and then down. Where the slope can't be kept within the
    first layer its bottom is lowered, and with ``fix_layers`` deeper layers
    keep ``min_thick``.
    """
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError("direction must be downstream, upstream or both")
    into = links.where("to_ridx <> 0").select(F.col("to_ridx").alias("ridx")).distinct().withColumn("_fed", F.lit(True))
    trees_of = segments.select("segnum", "cat_group")
    rows = found.select("ridx", "segnum", "i", "j", "rlen", "rtp", "rbth", (F.col("diversion") if "diversion" in found.columns else F.lit(False)).alias("diversion"))
    rows = rows.join(links, "ridx").join(into, "ridx", "left").join(trees_of, "segnum", "left").withColumn("head", F.col("_fed").isNull()).drop("_fed")
    rows = rows.withColumn("cat_group", F.coalesce("cat_group", -F.col("ridx")))
    rows = rows.join(top.select("i", "j", F.col("value").cast("double").alias("top")), ["i", "j"]).join(_layers(bottoms), ["i", "j"])
    rows = checkpointed(_grouped_by_cells(rows, "cat_group"))
    ways = {"both": (True, False), "upstream": (True,), "downstream": (False,)}[direction]
    for k, up in enumerate(ways):
        last = k == len(ways) - 1
        made = checkpointed(rows.groupBy("part").applyInPandas(_profile_run(min_slope, min_incise, min_thick, fix_layers and last, up), RESULT))
        if not last:
            rows = rows.drop("rtp", "bots").join(made.select("ridx", "rtp", "bots"), "ridx")
    return made


def _to_next(part: pd.DataFrame, min_slope: float, thick: float, buffer: float, fix_layers: bool) -> pd.DataFrame:
    part = part.sort_values("ridx", ignore_index=True)
    cells, rows = _Cells(part), {r.ridx: r for r in part.itertuples()}
    rtp = {r: float(x.rtp) for r, x in rows.items()}
    seen = {r: rtp.get(x.to_ridx, np.nan) for r, x in rows.items()}
    step = {r: min_slope * x.spacing for r, x in rows.items()}
    while True:
        changed = 0
        for r in [r for r in rows if seen[r] > rtp[r] - step[r]]:
            at, after = r, rows[r].to_ridx
            if after not in rows or not rtp[after] > rtp[at] - step[at]:
                continue
            done = []
            while after in rows:  # from here to the outlet, whether a reach is too high or not
                seen[at] = rtp[after] = rtp[at] - step[at]
                done.append(after)
                at, after = after, rows[after].to_ridx
            for d in done if fix_layers else ():
                x, cell = rows[d], (rows[d].i, rows[d].j)
                cells.tops[cell] = max(cells.tops[cell], rtp[d] + x.incise)
                cells.bots[cell] -= max(0.0, cells.bots[cell][0] - (rtp[d] - x.rbth - buffer))
            changed += len(done)
        if not changed:
            return _result(part, cells, rtp, False, thick)


def lower_to_next(
    found: DataFrame, links: DataFrame, top: DataFrame, bottoms: list[DataFrame], *, spacing: float, min_slope: float = 1e-4, min_incise: float = 0.2, min_thick: float = 0.5, buffer: float = 0.5, fix_layers: bool = True
) -> DataFrame:
    """``(ridx, rtp, i, j, top, bots)``: each reach that starts too high for the one before is lowered, and with it all reaches down to the outlet.

    A reach should be ``min_slope`` times the cells' ``spacing`` lower than the
    one before. Every reach on the way down is rewritten, also one that was low
    already; tops are raised to ``incise`` above the reach and bottoms moved
    down with it. Reaches without ``rtp`` start ``min_incise`` below the top.
    """
    have = set(found.columns)
    rows = found.join(links, "ridx").join(top.select("i", "j", F.col("value").cast("double").alias("top")), ["i", "j"]).join(_layers(bottoms), ["i", "j"])
    given = F.col("rtp").cast("double") if "rtp" in have else F.lit(None).cast("double")
    bed = F.col("rbth").cast("double") if "rbth" in have else F.lit(float(min_thick))
    rows = rows.select(
        "ridx", "to_ridx", "i", "j", "top", "bots", F.coalesce(given, F.col("top") - min_incise).alias("rtp"), F.when(given.isNull(), F.greatest(bed, F.lit(float(min_thick)))).otherwise(bed).alias("rbth"),
        (F.col("incise") if "incise" in have else F.lit(float(min_incise))).alias("incise"), F.lit(float(spacing)).alias("spacing"),
    )
    # Reaches that flow into each other belong together as well as those that share a cell.
    firsts = rows.groupBy("i", "j").agg(F.min("ridx").alias("_first"))
    edges = rows.join(firsts, ["i", "j"]).select(F.col("ridx").alias("a"), F.col("_first").alias("b")).unionByName(links.where("to_ridx <> 0").select(F.col("ridx").alias("a"), F.col("to_ridx").alias("b")))
    rows = rows.join(components(edges).select(F.col("node").alias("ridx"), F.col("component").alias("part")), "ridx")
    return rows.groupBy("part").applyInPandas(lambda part: _to_next(part, min_slope, min_thick, buffer, fix_layers), RESULT)


def _settled_by_segment(rows: DataFrame, min_slope: float) -> DataFrame:
    """``rows`` with ``new``, their heights, and ``value``: where the bottom of their cell goes, null if it is low enough. ``seen`` is the bottom that their segment finds.

    Inside a segment every reach is ``least`` where what it wants is lower, and
    elsewhere ``min(before - fall, limit)``. Such steps compose, so the height is
    a running minimum of limits plus what falls up to them, begun anew at
    every ``least``.
    """
    along = Window.partitionBy("iseg").orderBy("ireach")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    want = F.col("top") - F.col("diff_up") + (F.col("place") - F.col("place0")) * F.col("tilt")
    least = F.col("end") + (F.col("length") - F.col("place")) * min_slope
    inner = ~F.col("is_first") & ~F.col("is_last")
    made = rows.withColumn("want", want).withColumn("least", least).withColumn("anew", inner & (F.col("want") < F.col("least")))
    limit = F.when(F.col("is_first"), F.col("rtp")).when(F.col("anew"), F.col("least")).when(inner, F.greatest("want", F.col("seen") + F.col("rbth") + BUFFER))
    made = made.withColumn("limit", limit).withColumn("run", F.sum(F.col("anew").cast("int")).over(upto))
    low = F.min(F.col("limit") + F.col("place") * min_slope).over(Window.partitionBy("iseg", "run").orderBy("ireach").rowsBetween(Window.unboundedPreceding, 0))
    made = made.withColumn("new", F.when(F.col("high") & inner, low - F.col("place") * min_slope).otherwise(F.col("rtp")))
    bottom = F.col("new") - F.col("rbth") - BUFFER
    return made.withColumn("value", F.when(bottom < F.col("seen"), bottom))


def fix_reaches_by_segment(found: DataFrame, data: DataFrame, top: DataFrame, bottoms: list[DataFrame], *, min_slope: float = 1e-4, min_thick: float = 0.5, fix_layers: bool = True) -> DataFrame:
    """``(ridx, rtp, i, j, top, bots)``: reaches of segments that rise above the model top, lowered between their two ends, and layer bottoms out of the way of all.

    ``found(ridx, iseg, ireach, i, j, rlen, strthick)``; ``data`` as
    ``fix_segment_elevations`` gives it. Reaches first get the height of the
    straight line between their segment's ends (see ``reconcile_tops``); the
    first and the last of a segment keep it. Segments that share a cell find
    its bottom as those of lower number have left it: heights are settled with
    the bottoms known so far, again until each segment finds what it was
    settled with, which takes as many rounds as segments push each other on.
    """
    places = elevation.reach_places(found)
    tops = elevation.reconcile_tops(found, data)
    rows = found.select("ridx", "iseg", "ireach", "i", "j", F.col("strthick").cast("double").alias("rbth")).join(tops.withColumnRenamed("strtop", "rtp"), "ridx").join(places, "ridx")
    rows = rows.join(data.select(F.col("nseg").alias("iseg"), "diff_up", "diff_dn", "seglen"), "iseg")
    rows = rows.join(top.select("i", "j", F.col("value").cast("double").alias("top")), ["i", "j"]).join(_layers(bottoms), ["i", "j"])
    along = Window.partitionBy("iseg").orderBy("ireach").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", (F.first("ridx").over(along) == F.col("ridx")).alias("is_first"), (F.last("ridx").over(along) == F.col("ridx")).alias("is_last"), F.first("place").over(along).alias("place0"),
        F.last("upto").over(along).alias("length"), F.last("rtp").over(along).alias("end"), F.bool_or(F.col("top") <= F.col("rtp")).over(along).alias("high"),
        (F.first(F.col("diff_up") - F.col("diff_dn")).over(along) / F.first("seglen").over(along)).alias("tilt"), F.col("bots")[0].alias("seen"),
    )
    rows = checkpointed(rows)
    # Of a segment's reaches that move a cell's bottom the last counts; a segment with reaches above the top sees to its two ends first.
    turn = F.struct((F.col("high") & ~F.col("is_first") & ~F.col("is_last")).cast("int"), F.when(F.col("is_first"), 0).otherwise(F.col("ireach")))
    by = Window.partitionBy("i", "j").orderBy("iseg")
    while True:
        settled = _settled_by_segment(rows, min_slope)
        moved = settled.groupBy("i", "j", "iseg").agg(F.max_by("value", F.when(F.col("value").isNotNull(), turn)).alias("v"))
        moved = checkpointed(moved.withColumn("before", F.last("v", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))))
        # What the segments before have left: once all have found just that, nothing changes any more.
        again = rows.join(moved.select("i", "j", "iseg", "before"), ["i", "j", "iseg"]).withColumn("finds", F.coalesce("before", F.col("bots")[0])).drop("before")
        again = checkpointed(again.withColumn("news", F.col("finds") != F.col("seen")).drop("seen").withColumnRenamed("finds", "seen"))
        rows, news = again.drop("news"), again.where("news").limit(1).count()
        if not news:
            break
    last = moved.groupBy("i", "j").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("iseg"))).alias("v"))
    out = _settled_by_segment(rows, min_slope).join(last, ["i", "j"]).withColumn("bots", F.concat(F.array(F.coalesce("v", F.col("bots")[0])), F.slice("bots", 2, F.size("bots"))))
    thick = F.aggregate(F.slice("bots", 2, F.size("bots")), F.slice("bots", 1, 1), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) - F.greatest(F.element_at(acc, -1) - b, F.lit(float(min_thick))))))
    return out.select("ridx", F.col("new").alias("rtp"), "i", "j", "top", (thick if fix_layers else F.col("bots")).alias("bots"))


def layer_bottoms(made: DataFrame, bottoms: list[DataFrame]) -> list[DataFrame]:
    """The layers' ``(i, j, value)`` with what reaches needed."""
    new = made.groupBy("i", "j").agg(F.first("bots").alias("bots"))
    return [b.join(new, ["i", "j"], "left").select("i", "j", F.coalesce(F.get("bots", F.lit(k)), F.col("value")).alias("value")) for k, b in enumerate(bottoms)]
