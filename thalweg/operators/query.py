"""Graph queries: routes, gathered segments, location pairs, reach links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import trees
from thalweg.operators.network import Network
from thalweg.operators.trees import checkpointed


def _ids(network: Network, ids) -> DataFrame:
    return network.segments.sparkSession.createDataFrame([(int(i),) for i in ids], "segnum long")


def route_frame(edges: DataFrame, start: int, end_at: int, end: int, allow_indirect: bool = False) -> DataFrame:
    """``(step, segnum)`` of the way from ``start`` to ``end_at``; empty if there is none. See ``route``."""
    spark = edges.sparkSession
    both = spark.createDataFrame([(start,), (end_at,)], "segnum long")
    paths = trees.downstream_of(edges, both, end)
    mine, other = paths.where(F.col("start") == start), paths.where(F.col("start") == end_at)
    direct = mine.where(F.col("segnum") == end_at).select(F.col("depth").alias("stop"), F.lit("down").alias("way"))
    reverse = other.where(F.col("segnum") == start).select(F.col("depth").alias("stop"), F.lit("up").alias("way"))
    found = direct.unionByName(reverse).orderBy("way").limit(1).collect()
    if found:
        side = mine if found[0]["way"] == "down" else other
        order = F.col("depth") if found[0]["way"] == "down" else F.lit(found[0]["stop"]) - F.col("depth")
        return side.where(F.col("depth") <= found[0]["stop"]).select(order.cast("int").alias("step"), "segnum")
    meet = mine.select("segnum", F.col("depth").alias("a")).join(other.select("segnum", F.col("depth").alias("b")), "segnum").orderBy("a").limit(1).collect()
    if not allow_indirect or not meet:
        return mine.where(F.lit(False)).select(F.col("depth").cast("int").alias("step"), "segnum")
    a, b = meet[0]["a"], meet[0]["b"]
    down = mine.where(F.col("depth") < a).select(F.col("depth").cast("int").alias("step"), "segnum")
    up = other.where(F.col("depth") < b).select((F.lit(a + b - 1) - F.col("depth")).cast("int").alias("step"), "segnum")
    return down.unionByName(up)


def route(network: Network, start: int, end_at: int, *, allow_indirect: bool = False) -> list[int]:
    """Segments from one to another, both included: down, else up, else (if allowed) down to their confluence and up, the confluence left out."""
    network.require([start], "invalid start segnum")
    network.require([end_at], "invalid end segnum")
    rows = [r["segnum"] for r in route_frame(network.segments, start, end_at, network.end, allow_indirect).orderBy("step").collect()]
    if not rows:
        ends = trees.downstream_of(network.segments, _ids(network, [start, end_at]), network.end).groupBy("segnum").count().where("count > 1").limit(1).count()
        raise ConnectionError(f"{start} does not connect to {end_at}" + ("" if ends else " -- segment networks are disjoint"))
    return rows


def gather(network: Network, *, upstream=(), downstream=(), barrier=(), gather_upstream: bool = False) -> DataFrame:
    """``(query, start, segnum, depth)`` of the segments up or down from each start.

    Upstream takes in the start; a barrier that has tributaries stays but what
    is above it doesn't, a headwater barrier goes. Downstream leaves the start
    out, is ordered by ``depth`` and stops at a barrier, which is included.
    ``gather_upstream`` adds the side branches of each segment passed on the
    way down (``depth`` null). A barrier at an outlet counts as any other.
    """
    ups, downs, stops = (list(map(int, [x] if isinstance(x, int) else x)) for x in (upstream, downstream, barrier))
    for ids, what in ((ups, "upstream"), (downs, "downstream"), (stops, "barrier")):
        network.require(ids, what)
    edges = network.segments.select("segnum", "to_segnum")
    heads = network.headwater
    cut = None
    if stops:
        cut = _ids(network, stops).distinct().join(heads.withColumn("_head", F.lit(True)), "segnum", "left").select("segnum", F.col("_head").isNull().alias("keep"))
    out = []
    if ups:
        found = trees.upstream_of(edges, _ids(network, ups), network.end, cut=cut)
        out.append(found.select(F.lit("upstream").alias("query"), "start", "segnum", F.lit(None).cast("long").alias("depth")))
    if downs:
        paths = trees.downstream_of(edges, _ids(network, downs), network.end, stop=cut).where("depth > 0")
        out.append(paths.select(F.lit("downstream").alias("query"), "start", "segnum", "depth"))
        if gather_upstream:
            on_way = paths.select("start", F.col("segnum").alias("node")).unionByName(_ids(network, downs).select(F.col("segnum").alias("start"), F.col("segnum").alias("node")))
            inflow = edges.where(F.col("to_segnum") != network.end).select("segnum", F.col("to_segnum").alias("node"))
            passed = paths.select("start", F.col("segnum").alias("node"))
            if cut is not None:  # nothing above a barrier is gathered
                passed = passed.join(cut.select(F.col("segnum").alias("node")), "node", "left_anti")
            sides = passed.join(inflow, "node").join(on_way.select("start", F.col("node").alias("segnum")), ["start", "segnum"], "left_anti")
            sides = checkpointed(sides.select("start", F.col("segnum").alias("side")))
            above = trees.upstream_of(edges, sides.select(F.col("side").alias("segnum")).distinct(), network.end, cut=cut)
            found = sides.join(above.select(F.col("start").alias("side"), "segnum"), "side").select(F.lit("downstream").alias("query"), "start", "segnum", F.lit(None).cast("long").alias("depth"))
            out.append(found)
    if not out:
        return network.segments.sparkSession.createDataFrame([], "query string, start long, segnum long, depth long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def location_pairs(locations: DataFrame, network: Network, *, all_pairs: bool = False, exclude_branches: bool = False) -> DataFrame:
    """``(upstream, downstream)`` pairs of ``locations(loc, segnum, seg_ndist)`` along the network.

    Each location is paired with the next one on its segment, or else the
    first one on the nearest segment downstream that has any; with
    ``all_pairs`` with every later one. ``exclude_branches`` stops before a
    segment with several tributaries. The location that is last by sequence
    and place starts no pair.
    """
    placed = locations.select("loc", "segnum", "seg_ndist").join(network.segments.select("segnum", "sequence", F.size("from_segnums").alias("feeders")), "segnum")
    if placed.count() != locations.count():
        raise ValueError("loc_df has segnum values not found in surface water network")
    placed = checkpointed(placed)
    last = placed.orderBy(F.desc("sequence"), F.desc("seg_ndist"), F.desc("loc")).limit(1).select("loc")
    edges = network.segments.select("segnum", "to_segnum")
    if exclude_branches:
        branched = network.segments.where(F.size("from_segnums") > 1).select(F.col("segnum").alias("to_segnum"), F.lit(True).alias("_b"))
        edges = edges.join(branched, "to_segnum", "left").select("segnum", F.when(F.col("_b"), F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum"))
    # Only segments with locations matter: each is led to the next one downstream, however far it is.
    located = checkpointed(placed.select("segnum").distinct())
    ways = checkpointed(trees.next_stop(edges, located, network.end).join(located, "segnum", "left_semi"))
    if all_pairs:
        below = trees.downstream_of(located.join(ways, "segnum", "left").select("segnum", F.coalesce("stop", F.lit(network.end)).alias("to_segnum")), located, network.end).where("depth > 0")
        a = placed.select(F.col("loc").alias("upstream"), F.col("segnum").alias("start"), F.col("seg_ndist").alias("us"))
        b = placed.select(F.col("loc").alias("downstream"), "segnum", F.col("seg_ndist").alias("ds"))
        own = a.withColumnRenamed("start", "segnum").join(b, "segnum").where(F.struct("ds", "downstream") > F.struct("us", "upstream")).select("upstream", "downstream")
        pairs = a.join(below.select("start", "segnum"), "start").join(b, "segnum").select("upstream", "downstream").unionByName(own)
    else:
        along = Window.partitionBy("segnum").orderBy("seg_ndist", "loc")
        first = placed.groupBy("segnum").agg(F.min(F.struct("seg_ndist", "loc")).alias("f")).select(F.col("segnum").alias("stop"), F.col("f.loc").alias("first"))
        stepped = placed.select("loc", "segnum", F.lead("loc").over(along).alias("next"))
        onward = ways.join(first, "stop").select("segnum", "first")
        pairs = stepped.join(onward, "segnum", "left").select(F.col("loc").alias("upstream"), F.coalesce("next", "first").alias("downstream")).where("downstream IS NOT NULL")
    return pairs.join(last.withColumnRenamed("loc", "upstream"), "upstream", "left_anti")


def location_pair_lines(pairs: DataFrame, locations: DataFrame, network: Network) -> DataFrame:
    """``(upstream, downstream, geometry)``: the line along the network between the two, null if they aren't directly connected."""
    us = locations.select(F.col("loc").alias("upstream"), F.col("segnum").alias("start"), F.col("seg_ndist").alias("us"))
    ds = locations.select(F.col("loc").alias("downstream"), F.col("segnum").alias("stop"), F.col("seg_ndist").alias("ds"))
    asked = checkpointed(pairs.join(us, "upstream").join(ds, "downstream"))
    paths = trees.downstream_of(network.segments, asked.select(F.col("start").alias("segnum")).distinct(), network.end)
    ends = paths.select("start", F.col("segnum").alias("stop"), F.col("depth").alias("reach"))
    linked = asked.join(ends, ["start", "stop"])
    parts = linked.join(paths, "start").where(F.col("depth") <= F.col("reach")).join(network.segments.select("segnum", "geometry"), "segnum")
    low = F.when(F.col("depth") == 0, F.col("us")).otherwise(0.0)
    high = F.when(F.col("depth") == F.col("reach"), F.col("ds")).otherwise(1.0)
    piece = G.force_2d(G.substring(F.col("geometry"), low, high))
    lines = parts.select("upstream", "downstream", F.struct("depth", piece.alias("line")).alias("p")).groupBy("upstream", "downstream").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    lines = lines.select("upstream", "downstream", G.merge_lines(F.transform("ps", lambda p: p["line"])).alias("geometry"))
    return pairs.join(lines, ["upstream", "downstream"], "left")


def reach_links(reaches: DataFrame, network: Network) -> DataFrame:
    """``(ridx, to_ridx)`` of ``reaches(ridx, segnum, ireach)``: the next on the segment, else the first of the nearest segment downstream that has any, else 0."""
    rows = reaches.select("ridx", "segnum", "ireach")
    along = Window.partitionBy("segnum").orderBy("ireach")
    stepped = checkpointed(rows.withColumn("next", F.lead("ridx").over(along)).withColumn("is_first", F.row_number().over(along) == 1))
    firsts = stepped.where("is_first").select("segnum", F.col("ridx").alias("first"))
    # Segments without a reach are passed over.
    lasts = stepped.where("next IS NULL").select("ridx", "segnum")
    onward = trees.next_stop(network.segments.select("segnum", "to_segnum"), firsts.select("segnum"), network.end)
    target = onward.join(firsts.withColumnRenamed("segnum", "stop"), "stop").select("segnum", "first")
    jumped = lasts.join(target, "segnum", "left").select("ridx", F.coalesce("first", F.lit(0)).cast("long").alias("to_ridx"))
    return stepped.where("next IS NOT NULL").select("ridx", F.col("next").cast("long").alias("to_ridx")).unionByName(jumped)


def classic_links(reaches: DataFrame, data: DataFrame) -> DataFrame:
    """``(ridx, to_ridx)`` of the classic package: ``reaches(ridx, iseg, ireach)`` one after the other within a segment, the last to the
    first reach of the segment that ``data(nseg, outseg)`` says it flows into, else 0. Segments outside the model are not passed over."""
    along = Window.partitionBy("iseg").orderBy("ireach")
    stepped = checkpointed(reaches.select("ridx", "iseg", F.lead("ridx").over(along).alias("next"), (F.row_number().over(along) == 1).alias("is_first")))
    firsts = stepped.where("is_first").select(F.col("iseg").cast("long").alias("outseg"), F.col("ridx").alias("first"))
    onward = data.select(F.col("nseg").cast("long").alias("iseg"), F.col("outseg").cast("long").alias("outseg")).join(firsts, "outseg").select("iseg", "first")
    lasts = stepped.where("next IS NULL").select("ridx", F.col("iseg").cast("long").alias("iseg")).join(onward, "iseg", "left").select("ridx", F.coalesce("first", F.lit(0)).cast("long").alias("to_ridx"))
    return stepped.where("next IS NOT NULL").select("ridx", F.col("next").cast("long").alias("to_ridx")).unionByName(lasts)


def last_reach(links: DataFrame, start: int) -> int:
    """The reach without a next one that the way from ``start`` ends in."""
    up = trees.climb(links.select(F.col("ridx").alias("segnum"), F.col("to_ridx").alias("to_segnum")), 0).where(F.col("segnum") == start).select("cat_group").first()
    if up is None:
        raise IndexError(f"invalid reach {start}")
    return up[0]


def route_reaches(links: DataFrame, start: int, end_at: int, *, allow_indirect: bool = False) -> DataFrame:
    """``(step, ridx)`` of the way between two reaches over ``links(ridx, to_ridx)``, of either package: down, else up, else (if allowed) by their confluence."""
    known = {r[0] for r in links.where(F.col("ridx").isin([start, end_at])).select("ridx").collect()}
    for at in (start, end_at):
        if at not in known:
            raise IndexError(f"invalid reach {at}")
    edges = links.select(F.col("ridx").alias("segnum"), F.col("to_ridx").alias("to_segnum"))
    found = checkpointed(route_frame(edges, start, end_at, 0, allow_indirect))
    if not found.limit(1).count():
        raise ConnectionError(f"reach {start} does not connect to {end_at}")
    return found.select(F.col("step").cast("long").alias("step"), F.col("segnum").alias("ridx"))


def gather_reaches(links: DataFrame, starts, *, direction: str = "upstream", barrier=(), end: int = 0) -> DataFrame:
    """``(start, ridx)`` or, downstream, ``(start, ridx, depth)``; barriers are cut on both sides, so they aren't reached from below."""
    spark = links.sparkSession
    edges = links.select(F.col("ridx").alias("segnum"), F.col("to_ridx").alias("to_segnum"))
    ids = spark.createDataFrame([(int(s),) for s in starts], "segnum long")
    cut = spark.createDataFrame([(int(b), False) for b in barrier], "segnum long, keep boolean") if barrier else None
    if direction == "upstream":
        return trees.upstream_of(edges, ids, end, cut=cut).select("start", F.col("segnum").alias("ridx"))
    return trees.downstream_of(edges, ids, end, stop=None if cut is None else cut.select("segnum")).where("depth > 0").select("start", F.col("segnum").alias("ridx"), "depth")
