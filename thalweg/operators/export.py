"""Tables that streamflow-routing packages are written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.network import Network
from thalweg.operators.overlay import prefix_sums

# The columns that packages ask for.
REQUIRED = {
    "packagedata": ("rlen", "rwid", "rgrd", "rtp", "rbth", "rhk", "man", "ncon", "ustrf", "ndv"),
    "diversions": ("ridx", "idv", "iconr", "cprior"),
    "drn": ("elev", "cond"),
    "ghb": ("bhead", "cond"),
    "riv": ("stage", "cond", "rbot"),
}


def with_from(links: DataFrame) -> DataFrame:
    """``(ridx, to_ridx, from_ridxs)`` of ``links(ridx, to_ridx)``."""
    into = links.where("to_ridx <> 0").groupBy(F.col("to_ridx").alias("ridx")).agg(F.array_sort(F.collect_set("ridx")).alias("from_ridxs"))
    return links.select("ridx", "to_ridx").join(into, "ridx", "left").withColumn("from_ridxs", F.coalesce("from_ridxs", F.array().cast("array<bigint>")))


def connection_data(links: DataFrame, diversions: DataFrame | None = None, style: str = "native") -> DataFrame:
    """``(ridx, connections)``: reaches above, then minus the one below, then minus those that diversions lead to.

    ``native`` counts from 1; ``flopy`` moves each number one towards zero.
    ``diversions(ridx, iconr)``: reach and the diversion's own reach.
    """
    if style not in ("native", "flopy"):
        raise ValueError("style must be either 'native' or 'flopy'")
    rows = with_from(links)
    ids = F.col("from_ridxs")
    if diversions is not None:
        out = diversions.groupBy("ridx").agg(F.array_sort(F.collect_set("iconr")).alias("div_to"))
        back = diversions.select(F.col("iconr").alias("ridx"), F.col("ridx").alias("div_from"))
        rows = rows.join(out, "ridx", "left").join(back, "ridx", "left")
        none = F.array().cast("array<bigint>")
        ids = F.concat(ids, F.when(F.col("div_from").isNotNull(), F.array("div_from")).otherwise(none))
        below = F.transform(F.coalesce("div_to", none), lambda x: -x)
    else:
        below = F.array().cast("array<bigint>")
    ids = F.concat(ids, F.when(F.col("to_ridx") > 0, F.array(-F.col("to_ridx"))).otherwise(F.array().cast("array<bigint>")), below)
    if style == "flopy":
        ids = F.transform(ids, lambda x: x - F.signum(x).cast("bigint"))
        return rows.select((F.col("ridx") - 1).alias("ridx"), ids.alias("connections"))
    return rows.select("ridx", ids.alias("connections"))


def package_data(found: DataFrame, links: DataFrame, diversions: DataFrame | None = None, *, style: str = "native", auxiliary=(), boundname: str | None = None) -> DataFrame:
    """One row a reach with its cell, the REQUIRED columns of ``packagedata``, auxiliary ones and a name of 40 letters at most.

    Cells count from 1 in ``native`` style and from 0 in ``flopy``; an inactive
    cell (``domain`` below 1) or masked reach has the cell null, written NONE.
    KeyError names the columns that reaches lack.
    """
    if style not in ("native", "flopy"):
        raise ValueError("style must be either 'native' or 'flopy'")
    need = [c for c in REQUIRED["packagedata"] if c not in ("ncon", "ndv", "ustrf")] + list(auxiliary) + ([boundname] if boundname else [])
    lost = sorted(set(need) - set(found.columns))
    if lost:
        raise KeyError(f"missing {len(lost)} column(s) from reaches: {', '.join(lost)}")
    rows = found.join(with_from(links), "ridx")
    ndv, came = F.lit(0), F.lit(0)
    if diversions is not None:
        rows = rows.join(diversions.groupBy("ridx").agg(F.count(F.lit(1)).cast("int").alias("_ndv")), "ridx", "left").join(
            diversions.select(F.col("iconr").alias("ridx"), F.lit(1).alias("_from")), "ridx", "left"
        )
        ndv, came = F.coalesce("_ndv", F.lit(0)), F.coalesce("_from", F.lit(0))
    add = 1 if style == "native" else 0
    active = F.col("domain") > 0 if "domain" in found.columns else F.lit(True)
    if "mask" in found.columns:
        active = active & ~F.col("mask")
    cell = lambda c: F.when(active, F.col(c) + add).alias(c)
    return rows.select(
        (F.col("ridx") - (1 - add)).alias("ridx"), cell("k"), cell("i"), cell("j"), "rlen", "rwid", "rgrd", "rtp", "rbth", "rhk", "man",
        (F.size("from_ridxs") + (F.col("to_ridx") > 0).cast("int") + ndv + came).alias("ncon"), (F.size("from_ridxs") > 0).cast("int").cast("double").alias("ustrf"), ndv.alias("ndv"),
        *auxiliary, *([F.substring(F.col(boundname).cast("string"), 1, 40).alias("boundname")] if boundname else []),
    )


def number_diversions(diversions: DataFrame, style: str = "native") -> DataFrame:
    """``(ridx, idv, iconr, cprior)`` of ``diversions(divid, ridx, iconr)``: numbered within each reach in order of ``divid``, priority "upto" unless given."""
    from pyspark.sql import Window

    less = 0 if style == "native" else 1
    idv = F.row_number().over(Window.partitionBy("ridx").orderBy("divid"))
    prior = F.col("cprior") if "cprior" in diversions.columns else F.lit("upto")
    return diversions.select((F.col("ridx") - less).alias("ridx"), (idv - less).cast("int").alias("idv"), (F.col("iconr") - less).alias("iconr"), prior.alias("cprior"))


def package_period(found: DataFrame, package: str, style: str = "native", auxiliary=()) -> DataFrame:
    """``per, k, i, j`` and the package's columns of each reach, for the first period."""
    if package not in REQUIRED:
        raise KeyError(f"unknown package {package!r}")
    lost = sorted({*REQUIRED[package], *auxiliary} - set(found.columns))
    if lost:
        raise KeyError(f"missing {len(lost)} column(s) from reaches: {', '.join(lost)}")
    add = 1 if style == "native" else 0
    return found.select(F.lit(1).alias("per"), *[(F.col(c) + add).alias(c) for c in ("k", "i", "j")], *REQUIRED[package], *auxiliary)


def number_diversion_segments(found: DataFrame) -> DataFrame:
    """Reaches whose diversions are segments of their own, as classic packages have it: numbered after all others, by ``divid``, each with one reach."""
    own = found.where(~F.col("diversion"))
    last = own.agg(F.coalesce(F.max("iseg"), F.lit(0))).first()[0]
    made = found.where("diversion").select(F.col("divid").alias("_key"), F.lit(1).cast("long").alias("one"))
    rank = prefix_sums(made, "_key", "one").withColumnRenamed("_key", "divid")
    taken = found.where("diversion").drop("iseg", "ireach").join(rank, "divid").withColumn("iseg", (F.lit(last) + F.col("before") + 1).cast("int")).withColumn("ireach", F.lit(1)).drop("before")
    return own.unionByName(taken)


def segment_data(found: DataFrame, network: Network) -> DataFrame:
    """``(nseg, segnum, divid, outseg, iupseg, icalc, inflow, abstraction)``: a row per segment that has reaches; ``outseg`` is the number of the one below, or 0.

    Where ``found`` has diversions (see ``number_diversion_segments``) each has
    a row too: ``iupseg`` is the number of the segment it takes from, 0 for
    segments, and ``outseg`` 0.
    """
    marked = found if "diversion" in found.columns else found.select("*", F.lit(False).alias("diversion"), F.lit(None).cast("long").alias("divid"))
    per = marked.groupBy("iseg").agg(F.first("segnum").alias("segnum"), F.first("diversion").alias("diversion"), F.first("divid").alias("divid")).select(F.col("iseg").alias("nseg"), "segnum", "diversion", "divid")
    known = per.where(~F.col("diversion")).select("segnum", "nseg")
    links = network.segments.select("segnum", "to_segnum")
    rows = per.join(links, "segnum", "left").join(known.select(F.col("segnum").alias("to_segnum"), F.col("nseg").alias("outseg")), "to_segnum", "left")
    up = F.lit(0)
    if network.diversions is not None:
        above = network.diversions.select("divid", F.col("from_segnum").alias("_from")).join(known.select(F.col("segnum").alias("_from"), F.col("nseg").alias("_up")), "_from").select("divid", "_up")
        rows, up = rows.join(above, "divid", "left"), F.when(F.col("diversion"), F.col("_up")).otherwise(0)
    return rows.select("nseg", "segnum", "divid", F.coalesce("outseg", F.lit(0)).alias("outseg"), F.coalesce(up, F.lit(0)).alias("iupseg"), F.lit(0).alias("icalc"), F.lit(0.0).alias("inflow"), F.lit(0.0).alias("abstraction"))


def set_segment_data(data: DataFrame, name: str, value: Column, which: str = "all") -> DataFrame:
    """``data`` with a column set for all rows, for ``segments`` (no ``iupseg``) or for ``diversions``."""
    if name == "nseg":
        raise ValueError("nseg cannot be set")
    if which not in ("all", "segments", "diversions"):
        raise ValueError("which must be all, segments or diversions")
    chosen = {"all": F.lit(True), "segments": F.col("iupseg") == 0, "diversions": F.col("iupseg") != 0}[which]
    was = F.col(name) if name in data.columns else F.lit(0.0)
    return data.withColumn(name, F.when(chosen, value).otherwise(was))


def set_segment_values(data: DataFrame, series: DataFrame | None, name: str, values: DataFrame, by: str = "segments") -> tuple[DataFrame, DataFrame | None]:
    """``data`` and ``series(name, kper, nseg, value)`` with ``values(key, kper, value)`` put in, keys being segments or diversions.

    Constant values (``kper`` null) go into the column ``name`` of the rows they
    name and replace earlier ones; time-varying ones into the series, where
    they replace earlier ones of the same name, period and segment. Keys of
    segments without reaches are passed over; KeyError for others that are unknown.
    """
    if name == "nseg":
        raise ValueError("nseg cannot be set")
    if by not in ("segments", "diversions"):
        raise ValueError("by must be segments or diversions")
    if name not in data.columns:
        raise KeyError(f"could not find {name!r} in {', '.join(data.columns)}")
    key, mine = ("segnum", F.col("iupseg") == 0) if by == "segments" else ("divid", F.col("iupseg") != 0)
    numbered = values.join(data.where(mine).select(F.col(key).alias("key"), "nseg"), "key")
    fixed = numbered.where("kper IS NULL").select("nseg", F.col("value").alias("_new"))
    kept = data.join(fixed, "nseg", "left").withColumn(name, F.coalesce("_new", name)).drop("_new").select(*data.columns)
    moving = numbered.where("kper IS NOT NULL").select(F.lit(name).alias("name"), "kper", "nseg", "value")
    if series is not None:
        moving = series.join(moving, ["name", "kper", "nseg"], "left_anti").select("name", "kper", "nseg", "value").unionByName(moving)
    return kept, moving


# The columns that reach data may have, in their order.
REACH_COLUMNS = ("k", "i", "j", "iseg", "ireach", "rchlen", "strtop", "slope", "strthick", "strhc1", "thts", "thti", "eps", "uhc", "reachID", "outreach")


def reach_data(found: DataFrame) -> DataFrame:
    """``ridx`` and those of REACH_COLUMNS that reaches have; ``rlen`` is written as ``rchlen``."""
    rows = found.withColumnRenamed("rlen", "rchlen") if "rlen" in found.columns and "rchlen" not in found.columns else found
    return rows.select("ridx", *[c for c in REACH_COLUMNS if c in rows.columns])


def by_period(data: DataFrame, periods: list[int]) -> DataFrame:
    """``(kper, ...)``: constant rows repeated for every period."""
    return data.select(F.explode(F.array(*[F.lit(int(k)) for k in periods])).alias("kper"), "*")


def wide_by_period(data: DataFrame, periods: list[int]) -> DataFrame:
    """A row per ``nseg`` with a column ``<kper>:<column>`` for every period and column of ``data(kper, nseg, ...)``."""
    cols = [c for c in data.columns if c not in ("kper", "nseg")]
    rows = data.groupBy("nseg").pivot("kper", periods).agg(*[F.first(c).alias(c) for c in cols])
    old = lambda k, c: str(k) if len(cols) == 1 else f"{k}_{c}"
    return rows.select("nseg", *[F.col(f"`{old(k, c)}`").alias(f"{k}:{c}") for k in periods for c in cols])


def long_by_period(wide: DataFrame) -> DataFrame:
    """The inverse of ``wide_by_period``: ``(kper, nseg, ...)``."""
    names = [c.split(":", 1) for c in wide.columns if c != "nseg"]
    periods, cols = list(dict.fromkeys(int(k) for k, _ in names)), list(dict.fromkeys(c for _, c in names))
    rows = F.array(*[F.struct(F.lit(k).alias("kper"), *[F.col(f"`{k}:{c}`").alias(c) for c in cols]) for k in periods])
    return wide.select("nseg", F.explode(rows).alias("r")).select("r.kper", "nseg", *[f"r.{c}" for c in cols])


def inverted(frame: DataFrame, key: str, value: str) -> DataFrame:
    """``frame(key, value)`` with the two swapped; ValueError if a value stands for several keys."""
    if frame.groupBy(value).count().where("count > 1").limit(1).count():
        raise ValueError(f"{value} has repeated values")
    return frame.select(F.col(value).alias(key), F.col(key).alias(value))


def flow_by_period(data: DataFrame, series: DataFrame, periods: DataFrame) -> DataFrame:
    """``(kper, nseg, flow)``: time-varying ``series(name, kper, nseg, value)`` laid over the constant columns, then inflow and abstraction added to flow.

    The series is pivoted once to a row per period and segment, so each
    segment and period meets it in one equi-join. Stress periods are a list
    that the driver knows; each segment has a row for every one of them.
    """
    listed = sorted(r["kper"] for r in periods.select("kper").distinct().collect())
    wide = series.groupBy("kper", "nseg").pivot("name", ["flow", "inflow", "abstraction"]).agg(F.first("value"))
    rows = data.select("nseg", *[(F.col(c) if c in data.columns else F.lit(0.0)).alias(f"_{c}") for c in ("flow", "inflow", "abstraction")])
    rows = by_period(rows, listed)
    part = lambda c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0))
    return rows.join(wide, ["kper", "nseg"], "left").select("kper", "nseg", (part("flow") + part("abstraction") + part("inflow")).alias("flow"))
