"""Tree operators over edges ``(segnum, to_segnum)``: pointer doubling, paths, orders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 60
#: Segments that one task may finish after rounds of contraction.
SMALL = 4096
#: Rows beyond which a written table isn't sent whole to the driver and all executors to be joined.
MANY = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what ``spark.checkpoint.dir`` names, else the context's checkpoint directory.

    Where neither is set, a session on one machine gets a temporary folder; on
    a cluster that is an error, since executors wouldn't see it.
    """
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (None if given.isEmpty() else given.get())
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="thalweg-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if given.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder and read again.

    A written table cuts the lineage and outlives lost executors, as a
    checkpoint does; but a checkpoint also hands on the optimiser's estimates,
    and the size of a join is estimated as the product of both sides. Over
    many rounds these numbers double in length with each, until planning takes
    all the time. A table has the size of its files, by which Spark also sees
    which sides of joins are small. Numbers pack so well in files that millions
    of rows would count as small, though; so rows are counted as they are
    written, and beyond MANY joins with the table are merge joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/thalweg-rows-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if seen.get.get("n", 0) > MANY else table


def climb(edges: DataFrame, end: int, *, length: str | None = None, values: tuple[str, ...] = (), mins: tuple[str, ...] = ()) -> DataFrame:
    """Outlet recursion and upstream sums in one pass of pointer doubling.

    ``edges`` holds ``segnum, to_segnum`` and the columns named. Adds
    ``cat_group`` (outlet), ``num_to_outlet`` (1 at the outlet),
    ``dist_to_outlet`` (own length included), ``up_<value>`` (sum of own value
    and all upstream) and ``least_<min>`` (smallest of these). Only rows that
    still have a way to go look their next jump up, so finished ones don't
    gather on one key. A round is one join and, with values, one combinable
    aggregation; depth d takes about log2(d) rounds and the state stays one
    row a segment. Segments on or above a cycle keep ``end``, 0 and 0.
    """
    size = F.col(length) if length else F.lit(1.0)
    sums, lows = [f"up_{v}" for v in values], [f"least_{v}" for v in mins]
    state = checkpointed(
        edges.select(
            F.col("segnum"), F.col("to_segnum").alias("jump"), F.col("segnum").alias("root"), F.lit(1).cast("long").alias("hops"),
            size.cast("double").alias("dist"), *[F.col(v).cast("double").alias(f"up_{v}") for v in values], *[F.col(v).cast("double").alias(f"least_{v}") for v in mins],
        )
    )
    going = F.col("jump") != end
    look = lambda s: s.agg(F.count(F.lit(1)).alias("n"), F.count_if(going).alias("live"), F.min(F.when(going, F.col("hops"))).alias("shortest")).first()
    seen = look(state)
    for _ in range(MAX_ROUNDS):
        # On a cycle jumps never end; once every live path is longer than the network, only cycles are left.
        if not seen["live"] or seen["shortest"] > seen["n"]:
            break
        live, done = state.where(going), state.where(~going)
        ahead = state.select(F.col("segnum").alias("jump"), F.col("jump").alias("n_jump"), F.col("root").alias("n_root"), F.col("hops").alias("n_hops"), F.col("dist").alias("n_dist"))
        moved = live.join(ahead, "jump", "left").select(
            "segnum", F.coalesce("n_jump", F.lit(end)).alias("jump"), F.coalesce("n_root", "root").alias("root"),
            (F.col("hops") + F.coalesce("n_hops", F.lit(0))).alias("hops"), (F.col("dist") + F.coalesce("n_dist", F.lit(0.0))).alias("dist"), *sums, *lows,
        ).unionByName(done)
        if sums or lows:
            below = live.groupBy(F.col("jump").alias("segnum")).agg(*[F.sum(c).alias(f"in_{c}") for c in sums], *[F.min(c).alias(f"in_{c}") for c in lows])
            moved = moved.join(below, "segnum", "left").select(
                "segnum", "jump", "root", "hops", "dist", *[(F.col(c) + F.coalesce(f"in_{c}", F.lit(0.0))).alias(c) for c in sums],
                *[F.least(F.col(c), F.col(f"in_{c}")).alias(c) for c in lows],
            )
        state = checkpointed(moved)
        seen = look(state)
    done = F.col("jump") == end
    return state.select(
        "segnum", F.when(done, F.col("root")).otherwise(F.lit(end)).cast("long").alias("cat_group"), F.when(done, F.col("hops")).otherwise(0).cast("int").alias("num_to_outlet"),
        F.when(done, F.col("dist")).otherwise(0.0).alias("dist_to_outlet"), *sums, *lows,
    )


def upstream_minima(edges: DataFrame, rows: DataFrame, key: str, end: int) -> DataFrame:
    """``(segnum, key, least)``: for each segment, and each ``key`` among its own and all upstream ``rows(segnum, key, least)``, the least of that key.

    Doubling: after k rounds a segment has what lies less than 2^k above it,
    and jumps 2^k ahead; a round is two joins and a combinable minimum. The
    state grows with the number of different keys upstream, not with that of
    segments.
    """
    have = checkpointed(rows.groupBy("segnum", key).agg(F.min("least").alias("least")))
    jumps = checkpointed(edges.where(F.col("to_segnum") != end).select("segnum", F.col("to_segnum").alias("jump")))
    for _ in range(MAX_ROUNDS):
        if not jumps.limit(1).count():
            break
        moved = have.join(jumps, "segnum").select(F.col("jump").alias("segnum"), key, "least")
        have = checkpointed(have.unionByName(moved).groupBy("segnum", key).agg(F.min("least").alias("least")))
        far = jumps.select(F.col("segnum").alias("jump"), F.col("jump").alias("next"))
        jumps = checkpointed(jumps.join(far, "jump").select("segnum", F.col("next").alias("jump")))
    return have


def next_stop(edges: DataFrame, stops: DataFrame, end: int) -> DataFrame:
    """``(segnum, stop)``: the first of ``stops(segnum)`` strictly downstream of each segment that has one.

    Pointers double until they meet a stop, so the state stays one row a
    segment however long the ways are, and settled rows don't move any more.
    """
    known = stops.select(F.col("segnum").alias("jump"), F.lit(True).alias("_stop")).distinct()
    state = edges.where(F.col("to_segnum") != end).select("segnum", F.col("to_segnum").alias("jump")).join(known, "jump", "left")
    state = checkpointed(state.select("segnum", "jump", F.coalesce("_stop", F.lit(False)).alias("settled")))
    for _ in range(MAX_ROUNDS):
        live = state.where(~F.col("settled"))
        if not live.limit(1).count():
            break
        ahead = state.select(F.col("segnum").alias("jump"), F.col("jump").alias("n_jump"), F.col("settled").alias("n_settled"))
        # A way without a stop ends where no row goes on.
        moved = live.join(ahead, "jump").where(F.col("segnum") != F.col("n_jump")).select("segnum", F.col("n_jump").alias("jump"), F.col("n_settled").alias("settled"))
        state = checkpointed(state.where("settled").unionByName(moved))
    return state.where("settled").select("segnum", F.col("jump").alias("stop"))


def from_segnums(edges: DataFrame, end: int) -> DataFrame:
    """``(segnum, from_segnums)`` for every segment: its tributaries in ascending order, an empty array for a headwater."""
    into = edges.where(F.col("to_segnum") != end).groupBy(F.col("to_segnum").alias("segnum")).agg(F.array_sort(F.collect_set("segnum")).alias("from_segnums"))
    return edges.select("segnum").join(into.hint("merge"), "segnum", "left").withColumn("from_segnums", F.coalesce("from_segnums", F.array().cast("array<bigint>")))


def _step(least: Column, most: Column, low: Column, more: Column) -> Column:
    """The function that is ``low`` below ``least``, ``most + more + 1`` from there to ``most``, and ``x + more`` beyond."""
    return F.struct(least.cast("long").alias("s"), most.cast("long").alias("t"), low.cast("long").alias("lo"), more.cast("long").alias("k"))


def _applied(f: Column, x: Column) -> Column:
    return F.when(x < f["s"], f["lo"]).when(x <= f["t"], f["t"] + f["k"] + 1).otherwise(x + f["k"])


def _composed(g: Column, f: Column) -> Column:
    """``g`` after ``f``, a function of the same kind."""
    more, moved = f["k"] + g["k"], g["t"] - f["k"]
    return (
        F.when(moved <= f["t"], _step(f["s"], f["t"], _applied(g, f["lo"]), more))
        .when(g["s"] > f["t"] + 1 + f["k"], _step(g["s"] - f["k"], moved, g["lo"], more))
        .otherwise(_step(f["s"], moved, _applied(g, f["lo"]), more))
    )


def _finished(part: pd.DataFrame) -> pd.DataFrame:
    """Rounds and orders of the few segments that rounds of contraction have left, each after what it waits for."""
    rows = {r.segnum: r for r in part.itertuples()}
    known = {k: (int(r.round), int(r.order)) for k, r in rows.items() if r.order == r.order}
    kids: dict[int, list[int]] = {}
    for k, r in rows.items():
        if r.untold:
            kids.setdefault(r.next, []).append(k)
    value = lambda f, x: int(f[2] if x < f[0] else f[1] + f[3] + 1 if x <= f[1] else x + f[3])
    open_ = [k for k in rows if k not in known]
    stack = list(open_)
    while stack:
        k = stack[-1]
        r = rows[k]
        needs = [r.wait] if r.waits else kids.get(k, [])
        lacking = [u for u in needs if u not in known]
        if k in known or lacking:
            stack = stack[:-1] if k in known else stack + lacking
            continue
        if r.waits:
            known[k] = (value(r.g, known[r.wait][0]), value(r.f, known[r.wait][1]))
        else:
            rounds, orders = [known[u][0] for u in needs], [known[u][1] for u in needs]
            if r.top == r.top and r.top is not None:  # those that were told before
                rounds += [int(r.low), int(r.high)]
                orders += [int(r.top)] * (1 + bool(r.twice))
            known[k] = (max(min(rounds) + 1, max(rounds)), max(orders) + (orders.count(max(orders)) > 1))
        stack.pop()
    made = [(k, *known[k]) for k in open_]
    return pd.DataFrame(made, columns=["segnum", "round", "order"])


def contracted(edges: DataFrame, end: int) -> DataFrame:
    """``(segnum, round, stream_order)`` of a forest ``edges(segnum, to_segnum)`` by tree contraction.

    The round of a headwater is 0, of another segment the larger of its
    tributaries' largest round and one more than their smallest; the Strahler
    order of a headwater is 1, of another its tributaries' largest, and one
    more where two have it.

    A segment that waits for one tributary only is a function of that one's
    value: ``low`` up to some value, one more than a second value up to that,
    and the value itself (for rounds, plus a number) beyond. Such functions
    compose to functions of the same kind. In every round known segments are
    told to the next one downstream, which adds them up by combinable
    aggregates, and each segment that waits for one tributary jumps over it if
    that one waits for a single one as well. Leaves go and chains halve
    together, so the rounds follow the logarithm of the number of segments,
    whatever the shape; a round is two joins, and no group grows with a tree.
    The last SMALL segments, counted, are finished by one task.
    """
    null = F.lit(None).cast("long")
    one, plus = _step(F.lit(0), F.lit(-1), F.lit(0), F.lit(0)), _step(F.lit(0), F.lit(-1), F.lit(0), F.lit(1))
    above = edges.where(F.col("to_segnum") != end).groupBy(F.col("to_segnum").alias("segnum")).agg(F.count(F.lit(1)).alias("left"), F.bit_xor("segnum").alias("ids"))
    rows = edges.select("segnum", F.col("to_segnum").alias("next")).join(above, "segnum", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))
    head, alone = F.col("left") == 0, F.col("left") == 1
    state = checkpointed(rows.select(
        "segnum", "next", "left", "ids", F.when(alone, F.col("ids")).alias("wait"), F.when(head, F.lit(0).cast("long")).alias("round"), F.when(head, F.lit(1).cast("long")).alias("order"),
        F.when(head, 0).alias("born"), null.alias("top"), F.lit(False).alias("twice"), null.alias("low"), null.alias("high"), F.when(alone, one).alias("f"), F.when(alone, plus).alias("g"),
    ))
    names = state.columns
    for turn in range(1, 4 * MAX_ROUNDS):
        known, chained = F.col("order").isNotNull(), F.col("wait").isNotNull()
        # Those known since the last round tell the next one, by order first, so that none of them is many.
        told = state.where((F.col("born") == turn - 1) & (F.col("next") != end)).groupBy("next", "order").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("segnum").alias("ids"), F.min("round").alias("low"), F.max("round").alias("high")
        )
        told = told.groupBy(F.col("next").alias("segnum")).agg(
            F.sum("n").alias("n"), F.bit_xor("ids").alias("u_ids"), F.max(F.struct("order", "n")).alias("u"), F.min("low").alias("u_low"), F.max("high").alias("u_high")
        )
        more = state.where(~known & ~chained).join(told, "segnum", "left")
        u = F.col("u.order")
        twice = F.when(u.isNull(), F.col("twice")).when(F.col("top").isNull() | (u > F.col("top")), F.col("u.n") > 1).otherwise(F.col("twice") | (u == F.col("top")))
        more = more.select(
            "segnum", "next", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.when(F.col("n").isNull(), F.col("ids")).otherwise(F.col("ids").bitwiseXOR(F.col("u_ids"))).alias("ids"), "born",
            F.greatest("top", u).alias("top"), twice.alias("twice"), F.least("low", "u_low").alias("low"), F.greatest("high", "u_high").alias("high"),
        )
        order, even = F.col("top") + F.col("twice").cast("long"), F.col("low") == F.col("high")
        f = _step(F.col("top"), F.col("top"), order, F.lit(0))
        g = F.when(even, _step(F.col("low"), F.col("low"), F.col("low"), F.lit(0))).otherwise(_step(F.lit(0), F.col("high") - 1, F.lit(0), F.lit(0)))
        more = more.select(
            "segnum", "next", "left", "ids", F.when(alone, F.col("ids")).alias("wait"), F.when(head, F.greatest(F.col("low") + 1, F.col("high"))).alias("round"), F.when(head, order).alias("order"),
            F.when(head, turn).alias("born"), "top", "twice", "low", "high", F.when(alone, f).alias("f"), F.when(alone, g).alias("g"),
        )
        ahead = state.select(F.col("segnum").alias("wait"), F.struct("round", "order", "wait", "f", "g").alias("a"))
        jump, there = F.col("a.wait").isNotNull(), F.col("a.order").isNotNull()
        chain = state.where(~known & chained).join(ahead, "wait").select(
            "segnum", "next", "left", "ids", F.when(jump, F.col("a.wait")).otherwise(F.col("wait")).alias("wait"), F.when(there, _applied(F.col("g"), F.col("a.round"))).alias("round"),
            F.when(there, _applied(F.col("f"), F.col("a.order"))).alias("order"), F.when(there, turn).alias("born"), "top", "twice", "low", "high",
            F.when(jump, _composed(F.col("f"), F.col("a.f"))).otherwise(F.col("f")).alias("f"), F.when(jump, _composed(F.col("g"), F.col("a.g"))).otherwise(F.col("g")).alias("g"),
        )
        state = checkpointed(state.where(known).unionByName(more.select(*names)).unionByName(chain.select(*names)))
        untold = F.col("order").isNull() | ((F.col("born") == turn) & (F.col("next") != end))
        left = state.agg(F.count_if(F.col("order").isNull()).alias("open"), F.count_if(untold).alias("untold")).first()
        done = state.where(F.col("order").isNotNull()).select("segnum", "round", "order")
        if left["open"] and left["untold"] <= SMALL:
            # So few are left that one task can finish them, with what they wait for.
            waits = state.where("order IS NULL AND wait IS NOT NULL").select(F.col("wait").alias("segnum")).distinct()
            rest = state.where(untold).unionByName(state.where(~untold).join(waits, "segnum", "left_semi"))
            step = lambda f: F.array(*[F.col(f"{f}.{c}") for c in ("s", "t", "lo", "k")]).alias(f)
            zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
            rest = rest.select(F.lit(0).alias("one"), untold.alias("untold"), "segnum", "next", F.col("wait").isNotNull().alias("waits"), zero("wait"), "round", "order", "top", "twice", "low", "high", step("f"), step("g"))
            done = done.unionByName(rest.groupBy("one").applyInPandas(_finished, "segnum long, round long, order long"))
        if not left["open"] or left["untold"] <= SMALL:
            return done.select("segnum", "round", F.col("order").alias("stream_order"))
    raise RuntimeError("tree contraction did not end; is there a cycle?")


def orders(tree: DataFrame, end: int) -> DataFrame:
    """``(segnum, sequence, stream_order)`` of ``tree(segnum, to_segnum, pos, cat_group, num_to_outlet, dist_to_outlet)``.

    Rounds and orders come from ``contracted``; the sequence is the rank by
    round, farthest first, headwaters by position and others by number where
    they tie. Ranks are taken within (round, hops) buckets and shifted by the
    sizes of earlier buckets, so no single task sorts the whole network.
    """
    cycle = tree.where(F.col("num_to_outlet") == 0).select("segnum", F.lit(0).alias("sequence"), F.lit(0).alias("stream_order"))
    found = contracted(tree.where("num_to_outlet > 0").select("segnum", "to_segnum"), end)
    ranked = checkpointed(tree.join(found, "segnum"))
    tie = F.when(F.col("round") == 0, F.col("pos")).otherwise(F.col("segnum"))
    sizes = ranked.groupBy("round", "num_to_outlet").agg(F.count(F.lit(1)).alias("n"))
    shift = F.sum("n").over(Window.orderBy("round", F.desc("num_to_outlet")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("round", "num_to_outlet", F.coalesce(shift, F.lit(0)).alias("earlier"))
    inner = F.row_number().over(Window.partitionBy("round", "num_to_outlet").orderBy(F.desc("dist_to_outlet"), tie))
    out = ranked.withColumn("inner", inner).join(sizes, ["round", "num_to_outlet"]).select(
        "segnum", (F.col("inner") + F.col("earlier")).cast("int").alias("sequence"), F.col("stream_order").cast("int").alias("stream_order")
    )
    return out.unionByName(cycle)


def downstream_of(edges: DataFrame, starts: DataFrame, end: int, *, stop: DataFrame | None = None) -> DataFrame:
    """``(start, segnum, depth)``: every segment from each start down to its outlet, the start itself at depth 0.

    Only the starts' own paths are built, by doubling jumps of the network
    (one join a round) and joining paths with them, so a path of length d
    takes log2(d) rounds. ``stop(segnum)``: paths end at these, inclusive.
    """
    if stop is not None:
        edges = edges.join(stop.select("segnum", F.lit(True).alias("_stop")), "segnum", "left").select("segnum", F.when(F.col("_stop"), F.lit(end)).otherwise(F.col("to_segnum")).alias("to_segnum"))
    jumps = checkpointed(edges.select("segnum", F.col("to_segnum").alias("jump")).where(F.col("to_segnum") != end))
    known = edges.select("segnum")
    paths = starts.select(F.col("segnum").alias("start"), "segnum").distinct().join(known, "segnum", "left_semi").select("start", "segnum", F.lit(0).cast("long").alias("depth"))
    step = 1
    for _ in range(MAX_ROUNDS):
        # Paths hold depths below ``step``, jumps go ``step`` ahead: together they reach twice as far.
        more = paths.join(jumps, "segnum").select("start", F.col("jump").alias("segnum"), (F.col("depth") + step).alias("depth"))
        paths = checkpointed(paths.unionByName(more))
        far = jumps.select(F.col("segnum").alias("jump"), F.col("jump").alias("next"))
        jumps = checkpointed(jumps.join(far, "jump").select("segnum", F.col("next").alias("jump")))
        step *= 2
        if jumps.limit(1).count() == 0:
            break
    return paths


def upstream_of(edges: DataFrame, starts: DataFrame, end: int, *, cut: DataFrame | None = None) -> DataFrame:
    """``(start, segnum)``: each start and every segment that drains through it.

    ``cut(segnum, keep)``: paths from above end there; the segment itself
    stays where ``keep`` holds. A segment's whole path down is walked by
    doubling, carrying the starts it meets.
    """
    if cut is not None:
        edges = edges.join(cut, "segnum", "left").where(F.coalesce("keep", F.lit(True))).drop("keep")
        edges = edges.join(cut.select(F.col("segnum").alias("to_segnum"), F.lit(True).alias("_cut")), "to_segnum", "left").select("segnum", F.when(F.col("_cut"), F.lit(end)).otherwise(F.col("to_segnum")).alias("to_segnum"))
    frontier = starts.select(F.col("segnum").alias("start"), "segnum").distinct().join(edges.select("segnum"), "segnum", "left_semi").select("start", "segnum")
    back = checkpointed(edges.where(F.col("to_segnum") != end).select(F.col("to_segnum").alias("segnum"), F.col("segnum").alias("above")))
    found = checkpointed(frontier)
    for _ in range(MAX_ROUNDS):
        # ``back`` leads to all segments exactly 2^k above; found holds those less than 2^k above.
        more = found.join(back, "segnum").select("start", F.col("above").alias("segnum"))
        found = checkpointed(found.unionByName(more))
        far = back.select(F.col("segnum").alias("above"), F.col("above").alias("higher"))
        back = checkpointed(back.join(far, "above").select("segnum", F.col("higher").alias("above")))
        if back.limit(1).count() == 0:
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, named after the smallest member; loops and repeats are allowed.

    Every round each node takes the least name among its neighbours' and its
    own, and then the name that this name has taken, so names travel twice as
    far each time; all steps are combinable minima and equi-joins.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("name")).select(F.col("a").alias("node"), "name"))
    for _ in range(MAX_ROUNDS):
        near = both.join(names.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("name").alias("near"))
        met = names.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("name").alias("was"), F.least("name", "near").alias("name"))
        # The old name's node hears of the better one as well.
        told = met.where("name < was").groupBy(F.col("was").alias("node")).agg(F.min("name").alias("better"))
        met = met.join(told, "node", "left").select("node", "was", F.least("name", "better").alias("name"))
        jump = met.select(F.col("node").alias("name"), F.col("name").alias("next"))
        state = checkpointed(met.join(jump, "name", "left").select("node", "was", F.least("name", "next").alias("name")))
        names = state.select("node", "name")
        if not state.where("name <> was").limit(1).count():
            return names.withColumnRenamed("name", "component")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
