"""Networks made simpler: coarsened to an order, or aggregated at junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import trees
from thalweg.operators.network import Network, from_lines
from thalweg.operators.trees import checkpointed


def chains(network: Network, level: int) -> DataFrame:
    """``(segnum, chain, depth)`` of segments of order ``level`` or more: runs without a confluence of such, named after their last segment."""
    kept = network.segments.where(F.col("stream_order") >= level).select("segnum", "to_segnum")
    if not kept.limit(1).count():
        raise ValueError(f"no segments found with stream_order >= {level}")
    feeders = kept.groupBy("to_segnum").agg(F.count(F.lit(1)).alias("n"))
    known = kept.select(F.col("segnum").alias("to_segnum"), F.lit(True).alias("_k"))
    linked = kept.join(feeders, "to_segnum").join(known, "to_segnum", "left")
    ends = F.col("_k").isNull() | (F.col("n") > 1)
    inner = checkpointed(linked.select("segnum", F.when(ends, F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum")))
    up = trees.climb(inner, network.end)
    return up.select("segnum", F.col("cat_group").alias("chain"), F.col("num_to_outlet").alias("depth"))


def coarsen_table(network: Network, level: int) -> DataFrame:
    """``(segnum, to_segnum, stream_order, traced_segnums)`` of the coarser network, chains in flow order."""
    found = checkpointed(chains(network, level).join(network.segments.select("segnum", "to_segnum", "stream_order"), "segnum"))
    traced = found.groupBy("chain").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "segnum")), asc=False), lambda x: x["segnum"]).alias("traced_segnums"),
        F.max("stream_order").alias("stream_order"), F.min_by("to_segnum", "depth").alias("to"),
    )
    below = found.select(F.col("segnum").alias("to"), F.col("chain").alias("to_segnum"))
    return traced.join(below, "to", "left").select(F.col("chain").alias("segnum"), F.coalesce("to_segnum", F.lit(network.end)).alias("to_segnum"), "stream_order", "traced_segnums")


def coarsen(network: Network, level: int) -> Network:
    """The network of segments of order ``level`` or more, each run between confluences one line, numbered as its last segment."""
    table = checkpointed(coarsen_table(network, level))
    parts = table.select("segnum", F.posexplode("traced_segnums").alias("k", "part")).join(network.segments.select(F.col("segnum").alias("part"), "geometry", "pos"), "part")
    lines = parts.groupBy("segnum").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "geometry"))), lambda x: x["geometry"]).alias("lines"), F.max_by("pos", "k").alias("pos")
    )
    catchments, members = None, None
    if network.catchments is not None:
        members = checkpointed(coarse_patches(network, level, table))
        catchments = checkpointed(dissolved(network.catchments, members.withColumnRenamed("chain", "patch")))
    made = from_lines(lines.select("segnum", "pos", G.merge_lines(F.col("lines")).alias("geometry")), catchments)
    segments = made.segments.withColumn("stream_order", F.col("stream_order") + level - 1).join(table.select("segnum", "traced_segnums"), "segnum")
    if members is not None:
        listed = members.groupBy(F.col("chain").alias("segnum")).agg(F.array_sort(F.collect_list("segnum")).alias("catchment_segnums"))
        segments = segments.join(listed, "segnum")
    return Network(checkpointed(segments), made.end, catchments, None, made.problems)


def coarse_patches(network: Network, level: int, table: DataFrame) -> DataFrame:
    """``(segnum, chain)``: the chain of the coarser network that each segment drains into: its own, or the first below that is kept."""
    kept = table.select(F.col("segnum").alias("chain"), F.explode("traced_segnums").alias("segnum"))
    cut = network.segments.select("segnum", "to_segnum").join(kept.select("segnum", F.lit(True).alias("_k")), "segnum", "left")
    up = trees.climb(cut.select("segnum", F.when(F.col("_k"), F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum")), network.end)
    return up.select("segnum", F.col("cat_group").alias("root")).join(kept.withColumnRenamed("segnum", "root"), "root").select("segnum", "chain")


def _reach(span: Column) -> Column:
    """The least power of four that a side's ``span`` along one axis doesn't exceed, 0 for none at all."""
    return F.when(span == 0, 0.0).otherwise(F.pow(F.lit(4.0), F.ceil(F.log2(F.abs(span)) / 2)))


def _bin(at: Column, reach: Column) -> Column:
    """The bin of a place along an axis: of width ``reach``, or the place itself if that is 0."""
    return F.when(reach == 0, at).otherwise(F.floor(at / F.when(reach != 0, reach)).cast("double"))


def _bins(a: Column, b: Column, reach: Column) -> Column:
    """The bins from ``a`` to ``b``: one or two, or three where rounding has it so."""
    low, high = _bin(F.least(a, b), reach), _bin(F.greatest(a, b), reach)
    return F.when(reach == 0, F.array(a)).otherwise(F.transform(F.sequence(F.lit(0), (high - low).cast("int")), lambda k: low + k))


def _near_corners(sides: DataFrame) -> DataFrame:
    """Sides with the corners ``x, y`` of their patch that share a bin with them."""
    corners = sides.select("patch", F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    # Every corner looks for sides of each kind; kinds are few, as they rise by powers of four.
    kinds = sides.select("wide", "high").distinct()
    corners = corners.crossJoin(F.broadcast(kinds)).select("*", _bin(F.col("x"), F.col("wide")).alias("bx"), _bin(F.col("y"), F.col("high")).alias("by"))
    binned = sides.withColumn("bx", F.explode(_bins(F.col("ax"), F.col("qx"), F.col("wide")))).withColumn("by", F.explode(_bins(F.col("ay"), F.col("qy"), F.col("high"))))
    return binned.join(corners.hint("merge"), ["patch", "wide", "high", "bx", "by"])


def outline(polygons: DataFrame) -> DataFrame:
    """``(patch, ax, ay, qx, qy)``: the sides of the union of ``polygons(patch, rings)`` that lie side by side, each once, its lesser end first.

    Sides are cut at vertices of the patch that lie on them, which meet by
    bins as wide and as high as the side, see ``_reach``: with square bins of
    one size all long and narrow polygons side by side would meet. A side that
    two polygons have vanishes, by one combinable count.
    """
    ring = polygons.select("patch", F.explode("rings").alias("ring")).select("patch", F.explode(G.edges(F.col("ring"))).alias("e"))
    sides = ring.select("patch", *[F.col(f"e.{e}.{c}").alias(f"{n}{c}") for e, n in (("a", "a"), ("b", "q")) for c in "xy"]).where("ax <> qx OR ay <> qy")
    wide, high = _reach(F.col("qx") - F.col("ax")), _reach(F.col("qy") - F.col("ay"))
    sides = checkpointed(sides.select("*", wide.alias("wide"), high.alias("high")).withColumn("side", F.monotonically_increasing_id()))
    dx, dy, px, py = F.col("qx") - F.col("ax"), F.col("qy") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along = px * dx + py * dy
    on = _near_corners(sides).where((px * dy == py * dx) & (along > 0) & (along < dx * dx + dy * dy))
    cuts = on.groupBy("side").agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "x", "y"))).alias("cuts"))
    point = lambda x, y: F.struct(F.lit(0.0).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    whole = sides.join(cuts, "side", "left").select("patch", F.concat(F.array(point("ax", "ay")), F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>")), F.array(point("qx", "qy"))).alias("p"))
    parts = whole.select("patch", F.explode(F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(F.struct(a["x"].alias("x"), a["y"].alias("y")).alias("a"), F.struct(b["x"].alias("x"), b["y"].alias("y")).alias("b")))).alias("s"))
    parts = parts.select("patch", F.least("s.a", "s.b").alias("lo"), F.greatest("s.a", "s.b").alias("hi"))
    kept = parts.groupBy("patch", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return kept.select("patch", F.col("lo.x").alias("ax"), F.col("lo.y").alias("ay"), F.col("hi.x").alias("qx"), F.col("hi.y").alias("qy"))


def stitched(sides: DataFrame) -> DataFrame:
    """``(patch, ring, size)``: closed rings of ``sides(patch, ax, ay, qx, qy)`` and the area of each.

    Every side is walked both ways. Where walks meet, the sides around the
    point are paired by angle, so each step has one that follows it. The least
    step of every walk is found by doubling the step that follows; there it is
    cut open, and ``climb`` ranks the steps of all walks at once. Of the two
    walks around a ring the one that sets out to the lesser neighbour stays.
    """
    turned = sides.select("patch", F.col("qx").alias("ax"), F.col("qy").alias("ay"), F.col("ax").alias("qx"), F.col("ay").alias("qy"))
    around = Window.partitionBy("patch", "qx", "qy").orderBy(F.atan2(F.col("ay") - F.col("qy"), F.col("ax") - F.col("qx")), "ax", "ay")
    odd = F.row_number().over(around) % 2 == 1
    mate = lambda c: F.when(odd, F.lead(c).over(around)).otherwise(F.lag(c).over(around))
    steps = sides.unionByName(turned).select("*", mate("ax").alias("mx"), mate("ay").alias("my"))
    steps = checkpointed(steps.withColumn("step", F.monotonically_increasing_id() + 1))
    ahead = steps.select("patch", F.col("ax").alias("qx"), F.col("ay").alias("qy"), F.col("qx").alias("mx"), F.col("qy").alias("my"), F.col("step").alias("after"))
    linked = checkpointed(steps.join(ahead, ["patch", "qx", "qy", "mx", "my"]))
    name = F.struct("ax", "ay", "qx", "qy", "step")
    state = checkpointed(linked.select("step", F.col("after").alias("jump"), name.alias("least")))
    for _ in range(trees.MAX_ROUNDS):
        far = state.select(F.col("step").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("there"))
        moved = checkpointed(state.join(far, "jump").select("step", F.col("next").alias("jump"), F.least("least", "there").alias("least"), (F.col("there") < F.col("least")).alias("news")))
        state = moved.drop("news")
        if not moved.where("news").limit(1).count():
            break
    first = checkpointed(linked.join(state.select("step", "least"), "step"))
    # A walk ends where its least step follows; it stays if that one leads to the lesser of its point's two neighbours in the walk.
    opened = first.select("step", F.when(F.col("after") == F.col("least.step"), F.lit(0)).otherwise(F.col("after")).alias("to"))
    ranks = trees.climb(opened.select(F.col("step").alias("segnum"), F.col("to").alias("to_segnum")), 0).select(F.col("segnum").alias("step"), F.col("num_to_outlet").alias("rank"))
    closing = first.where(F.col("after") == F.col("least.step")).where(F.struct("least.qx", "least.qy") < F.struct("ax", "ay")).select(F.col("least.step").alias("walk"))
    kept = first.withColumn("walk", F.col("least.step")).join(closing, "walk", "left_semi").join(ranks, "step")
    corner = lambda s: G.xyz(s["x"], s["y"], None)
    rings = kept.groupBy("patch", "walk").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("ax").alias("x"), F.col("ay").alias("y"))), asc=False).alias("s"))
    rings = rings.select("patch", F.transform(F.concat("s", F.array(F.get("s", F.lit(0)))), corner).alias("ring"))
    return rings.where(F.size("ring") > 3).withColumn("size", G.ring_area(F.col("ring")))


def dissolved(catchments: DataFrame, patches: DataFrame) -> DataFrame:
    """``(segnum, rings)``: the outline of the catchments of each patch of ``patches(segnum, patch)``, its largest ring first; a patch of one keeps its polygon as it is."""
    rows = checkpointed(catchments.select("segnum", "rings").join(patches, "segnum"))
    many = rows.groupBy("patch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("patch")
    alone = rows.join(many, "patch", "left_anti").select(F.col("patch").alias("segnum"), F.col("rings").cast(G.RINGS).alias("rings"))
    found = stitched(outline(rows.join(many, "patch", "left_semi").select("patch", "rings")))
    order = F.sort_array(F.collect_list(F.struct("size", "ring")), asc=False)
    return alone.unionByName(found.groupBy(F.col("patch").alias("segnum")).agg(F.transform(order, lambda r: r["ring"]).cast(G.RINGS).alias("rings")))


def aggregate_patches(network: Network, junctions: DataFrame) -> DataFrame:
    """``(segnum, patch)``: each segment above a junction and the nearest junction below it, itself included.

    ``junctions(segnum)`` are taken with the extra ones that forks of traced
    paths call for: tributaries of a traced segment that are traced
    themselves when several are, and all that aren't traced when one is a junction.
    """
    return _patches(network, junction_set(network, junctions))


def _patches(network: Network, every: DataFrame) -> DataFrame:
    edges = network.segments.select("segnum", "to_segnum").join(every.select("segnum", F.lit(True).alias("_j")), "segnum", "left")
    cut = edges.select("segnum", F.when(F.col("_j"), F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum"))
    up = trees.climb(cut, network.end).select("segnum", F.col("cat_group").alias("patch"))
    return up.join(every.select(F.col("segnum").alias("patch")), "patch", "left_semi").select("segnum", "patch")


def traced_segments(network: Network, junctions: DataFrame) -> DataFrame:
    """``(segnum)`` of all on the way from a junction to its outlet: those with a junction at or above them, by one climb that counts these."""
    marked = network.segments.select("segnum", "to_segnum").join(junctions.select("segnum", F.lit(1.0).alias("mark")).distinct(), "segnum", "left")
    return checkpointed(trees.climb(marked.withColumn("mark", F.coalesce("mark", F.lit(0.0))), network.end, values=("mark",)).where("up_mark > 0").select("segnum"))


def junction_set(network: Network, junctions: DataFrame, traced: DataFrame | None = None) -> DataFrame:
    """The given junctions and the extra ones, ``(segnum, given)``."""
    if junctions.count() != junctions.distinct().count():
        raise ValueError("list of segnums contains duplicates")
    lost = junctions.join(network.segments.select("segnum"), "segnum", "left_anti").limit(1).collect()
    if lost:
        raise IndexError(f"segnum {lost[0][0]} not found in segments")
    traced = traced_segments(network, junctions) if traced is None else traced
    flags = network.segments.select("segnum", "to_segnum").join(traced.withColumn("_t", F.lit(True)), "segnum", "left").join(junctions.select("segnum").withColumn("_g", F.lit(True)), "segnum", "left")
    flags = checkpointed(flags.select("segnum", "to_segnum", F.coalesce("_t", F.lit(False)).alias("t"), F.coalesce("_g", F.lit(False)).alias("g")))
    forks = flags.groupBy(F.col("to_segnum").alias("node")).agg(F.bool_or("g").alias("has_given"), F.count_if("t").alias("traced"))
    # Only traced segments at or above a given junction are looked at.
    cut = flags.select("segnum", F.when(F.col("g"), F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum"))
    above_given = trees.climb(cut, network.end).join(junctions.select(F.col("segnum").alias("cat_group")), "cat_group", "left_semi").select(F.col("segnum").alias("node"))
    forks = forks.join(traced.select(F.col("segnum").alias("node")), "node", "left_semi").join(above_given, "node", "left_semi")
    above = flags.join(forks, F.col("to_segnum") == F.col("node"))
    extra = above.where((~F.col("g")) & ((F.col("has_given") & ~F.col("t")) | (F.col("traced") > 1) & F.col("t"))).select("segnum")
    return junctions.select("segnum", F.lit(True).alias("given")).unionByName(extra.select("segnum", F.lit(False).alias("given")))


def aggregate_table(network: Network, junctions: DataFrame, follow_up: str = "upstream_length") -> DataFrame:
    """``(segnum, agg_patch, agg_path, agg_unpath)`` of the network aggregated at junctions.

    A patch is what drains to its junction without passing another. Its path
    leads up from the junction: along the way that traced segments take if
    another junction flows into the patch, else along the tributary with the
    largest ``follow_up``, the smallest number of equals. ``agg_path`` goes
    upwards, ``agg_unpath`` lists the tributaries beside it in that order.
    """
    if follow_up not in network.segments.columns:
        raise ValueError(f"cannot find {follow_up!r} column in segments")
    traced = traced_segments(network, junctions)
    every = checkpointed(junction_set(network, junctions, traced))
    patches = checkpointed(_patches(network, every))
    links = network.segments.select("segnum", "to_segnum", F.col(follow_up).alias("worth"))
    inner = every.select("segnum").join(links.select("segnum", "to_segnum"), "segnum").join(patches.select(F.col("segnum").alias("to_segnum"), "patch"), "to_segnum").select("patch").distinct().withColumn("_inner", F.lit(True))
    rows = links.join(patches, "segnum").join(inner, "patch", "left").join(traced.withColumn("_t", F.lit(True)), "segnum", "left").join(every.select("segnum", F.lit(True).alias("_j")), "segnum", "left")
    rows = checkpointed(rows.select("segnum", "to_segnum", "patch", "worth", F.coalesce("_inner", F.lit(False)).alias("inner"), F.coalesce("_t", F.lit(False)).alias("t"), F.coalesce("_j", F.lit(False)).alias("j")))
    # The tributary that a path goes on to from each segment.
    open_rows = rows.where("NOT j AND (t OR NOT inner)")
    best = open_rows.groupBy("to_segnum").agg(F.max(F.struct("worth", (-F.col("segnum")).alias("less"))).alias("b")).select((-F.col("b.less")).alias("segnum"), F.lit(True).alias("_best"))
    cut = rows.join(best, "segnum", "left").select("segnum", F.when(F.col("j") | F.col("_best").isNull(), F.lit(network.end)).otherwise(F.col("to_segnum")).alias("to_segnum"), "patch")
    up = trees.climb(cut.select("segnum", "to_segnum"), network.end).select("segnum", F.col("cat_group").alias("root"), "num_to_outlet")
    on = checkpointed(cut.join(up, "segnum").where("root = patch").select("segnum", "patch", F.col("num_to_outlet").alias("depth")))
    path = on.groupBy("patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "segnum"))), lambda x: x["segnum"]).alias("agg_path"))
    beside = network.segments.select("segnum", "to_segnum").join(on.select(F.col("segnum").alias("to_segnum"), "patch", "depth"), "to_segnum").join(on.select("segnum", F.col("patch").alias("_own")), "segnum", "left")
    beside = beside.where(F.col("_own").isNull() | (F.col("_own") != F.col("patch")))
    unpath = beside.groupBy("patch").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "segnum"))), lambda x: x["segnum"]).alias("agg_unpath"))
    whole = patches.groupBy("patch").agg(F.array_sort(F.collect_list("segnum")).alias("agg_patch"))
    return whole.join(path, "patch").join(unpath, "patch", "left").select(F.col("patch").alias("segnum"), "agg_patch", "agg_path", F.coalesce("agg_unpath", F.array().cast("array<bigint>")).alias("agg_unpath"))


def aggregate(network: Network, junctions: DataFrame, follow_up: str = "upstream_length") -> Network:
    """The network with one segment for each junction, see ``aggregate_table``: its path as one line, its patch's catchments as one polygon."""
    table = checkpointed(aggregate_table(network, junctions, follow_up))
    parts = table.select("segnum", F.posexplode("agg_path").alias("k", "part")).join(network.segments.select(F.col("segnum").alias("part"), "geometry", "pos"), "part")
    lines = parts.groupBy("segnum").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "geometry"))), lambda x: x["geometry"]).alias("lines"), F.min_by("pos", "k").alias("pos"))
    catchments = None
    if network.catchments is not None:
        catchments = checkpointed(dissolved(network.catchments, table.select(F.col("segnum").alias("patch"), F.explode("agg_patch").alias("segnum"))))
    made = from_lines(lines.select("segnum", "pos", G.merge_lines(F.col("lines")).alias("geometry")), catchments)
    return Network(checkpointed(made.segments.join(table, "segnum")), made.end, catchments, None, made.problems)
