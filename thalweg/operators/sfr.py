"""A stream network laid over a model: its grid, periods and reaches, as the newer and the classic packages want them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import export, overlay, query
from thalweg.operators.network import Network
from thalweg.operators.overlay import Grid, prefix_sums
from thalweg.operators.series import stress_periods
from thalweg.operators.trees import checkpointed


@dataclass(frozen=True)
class Model:
    """What a groundwater model tells of itself: its grid, ``domain(i, j, domain)`` and the lengths of its stress periods in days from ``start``."""

    grid: Grid
    domain: DataFrame | None = None
    perlen: tuple[float, ...] = (1.0,)
    start: str = "1970-01-01 00:00:00"
    nper: int | None = None

    def __post_init__(self) -> None:
        lengths = tuple(map(float, self.perlen))
        if self.nper is not None and len(lengths) == 1:
            lengths *= self.nper
        if self.nper is not None and len(lengths) != self.nper:
            raise ValueError(f"{len(lengths)} period lengths for {self.nper} periods")
        object.__setattr__(self, "perlen", lengths)

    def periods(self, spark: SparkSession) -> DataFrame:
        """``(kper, start_date, end_date)``."""
        return stress_periods(spark, list(self.perlen), self.start)

    def check_covers(self, lines: DataFrame) -> None:
        """ValueError unless the grid's extent meets that of ``lines(geometry)``."""
        local = lines.select(F.explode(self.grid.to_local(F.col("geometry"))).alias("p"))
        box = local.agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1")).first()
        x0, x1, y0, y1 = self.grid.extent
        if box["x0"] is None or box["x1"] < x0 or box["x0"] > x1 or box["y1"] < y0 or box["y0"] > y1:
            raise ValueError("model grid extent does not cover the segments")

    def check_same(self, other: Model) -> None:
        """AttributeError that names the parts in which another model differs."""
        odd = [f"grid.{f.name}" for f in fields(Grid) if getattr(self.grid, f.name) != getattr(other.grid, f.name)]
        odd += [n for n in ("perlen", "start") if getattr(self, n) != getattr(other, n)]
        if (self.domain is None) != (other.domain is None) or self.domain is not None and self.domain.exceptAll(other.domain.select(*self.domain.columns)).limit(1).count():
            odd.append("domain")
        if odd:
            raise AttributeError(f"model is too different: {', '.join(odd)}")


@dataclass(frozen=True, repr=False)
class ReachNetwork:
    """Reaches of a network over a model, of ``kind`` "mf6" or "mf2005", with the segments as the model sees them.

    ``links(ridx, to_ridx)`` and ``diversions(divid, from_segnum, ridx, idv,
    iconr, ...)`` belong to "mf6"; for "mf2005" diversions are segments.
    """

    kind: str
    network: Network
    grid: Grid
    reaches: DataFrame
    segments: DataFrame
    links: DataFrame | None = None
    diversions: DataFrame | None = None
    perlen: tuple[float, ...] = (1.0,)

    def __post_init__(self) -> None:
        if self.kind not in ("mf6", "mf2005"):
            raise ValueError("kind must be mf6 or mf2005")
        for name, need in (("reaches", {"ridx", "segnum", "k", "i", "j"}), ("segments", {"segnum", "in_model"})):
            frame = getattr(self, name)
            if not isinstance(frame, DataFrame):
                raise ValueError(f"{name} must be a DataFrame")
            if need - set(frame.columns):
                raise ValueError(f"{name} lacks {', '.join(sorted(need - set(frame.columns)))}")

    def __repr__(self) -> str:
        ids = [r[0] for r in self.reaches.select("ridx").orderBy("ridx").limit(8).collect()]
        n, per = self.reaches.count(), len(self.perlen)
        shown = ", ".join(map(str, ids if n <= 8 else ids[:4])) + (", ..." if n > 8 else "")
        return f"<ReachNetwork {self.kind}: {n} in reaches [{shown}], {per} stress period{'s' * (per != 1)} with perlen {list(self.perlen[:4])}{' ...' * (per > 4)}>"

    def __iter__(self):
        return iter([(f.name, getattr(self, f.name)) for f in fields(self)])

    def same_as(self, other: ReachNetwork) -> bool:
        """Equal kind, grid, periods and tables, whatever the order of their rows."""
        def equal(a: DataFrame | None, b: DataFrame | None) -> bool:
            if a is None or b is None:
                return a is b
            return a.columns == b.columns and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

        plain = (self.kind, self.grid, self.perlen) == (other.kind, other.grid, other.perlen)
        return plain and self.network.same_as(other.network) and all(equal(getattr(self, n), getattr(other, n)) for n in ("reaches", "segments", "links", "diversions"))

    def with_reaches(self, **columns) -> ReachNetwork:
        """With columns of reaches set: numbers for all, or Column expressions over the reaches."""
        named = {k: v if not isinstance(v, (int, float, str)) else F.lit(v) for k, v in columns.items()}
        return replace(self, reaches=self.reaches.withColumns(named))


def _laid(network: Network, model: Model, action: str, fraction) -> tuple[DataFrame, DataFrame]:
    model.check_covers(network.segments)
    found, marked = overlay.reaches(network, model.grid, model.domain, action=action, reach_include_fraction=fraction)
    local = network.segments.select("segnum", model.grid.to_local(F.col("geometry")).alias("geometry"))
    found = overlay.with_geometry(found, local)
    if model.domain is not None:
        found = found.join(model.domain.select("i", "j", F.col("domain").alias("_d")), ["i", "j"], "left")
        found = found.withColumn("domain", F.when(F.lit(action == "modify") & (F.col("_d") == 0), 1).otherwise(F.col("_d")))
        found = found.withColumnRenamed("_d", "prev_domain") if action == "modify" else found.drop("_d")
    return checkpointed(found), checkpointed(marked)


def mf2005(network: Network, model: Model, *, action: str = "freeze", reach_include_fraction: float | DataFrame | None = 0.2) -> ReachNetwork:
    """Reaches with segment numbers; every diversion is a segment of its own after all others."""
    found, marked = _laid(network, model, action, reach_include_fraction)
    if "diversion" in found.columns:
        found = checkpointed(export.number_diversion_segments(found))
    return ReachNetwork("mf2005", network, model.grid, found, marked, None, network.diversions, model.perlen)


def mf6(network: Network, model: Model, *, action: str = "freeze", reach_include_fraction: float | DataFrame | None = 0.2, diversion_downstream_bias: float = 0.0) -> ReachNetwork:
    """Reaches with the links between them, ``ustrf`` (0 for reaches nothing flows into, else 1) and diversions.

    A diversion takes from the reach of its segment that is nearest to it
    (``ridx``), as the ``idv``-th of that reach, and leads to its own reach
    (``iconr``). An outlet reach that diversions hang on gets a copy after all
    others, masked and without a line, which it flows into.
    """
    found, marked = _laid(network, model, action, reach_include_fraction)
    own = found.where(~F.col("diversion")) if "diversion" in found.columns else found
    links = query.reach_links(own, network)
    diversions = None
    if "diversion" in found.columns:
        taken = found.where("diversion")
        spatial = {"x", "y"} <= set(network.diversions.columns)
        places = network.diversions.select(F.col("divid").alias("loc"), F.col("from_segnum").alias("segnum"), *(["x", "y"] if spatial else []), *(["seg_ndist"] if "seg_ndist" in network.diversions.columns else []))
        hit = overlay.reach_lookup(places, own, network.segments, diversion_downstream_bias).select(F.col("loc").alias("divid"), "ridx")
        numbered = export.number_diversions(hit.join(taken.select("divid", F.col("ridx").alias("iconr")), "divid")).select("ridx", "idv", "iconr", "cprior")
        mine = network.diversions.drop("ridx", "idv", "iconr").join(taken.select("divid", F.col("ridx").alias("iconr")), "divid")
        diversions = checkpointed(mine.join(numbered.select("iconr", "ridx", "idv"), "iconr"))
        links = links.unionByName(taken.select("ridx", F.lit(0).cast("long").alias("to_ridx")))
        links = checkpointed(links)
        ends = links.where("to_ridx = 0").join(diversions.select("ridx").distinct(), "ridx", "left_semi")
        last = found.agg(F.max("ridx")).first()[0]
        extra = prefix_sums(ends.select("ridx", F.lit(1).cast("long").alias("one")), "ridx", "one").select("ridx", (F.lit(last) + F.col("before") + 1).cast("long").alias("copy"))
        extra = checkpointed(extra)
        links = links.join(extra, "ridx", "left").select("ridx", F.coalesce("copy", "to_ridx").alias("to_ridx")).unionByName(extra.select(F.col("copy").alias("ridx"), F.lit(0).cast("long").alias("to_ridx")))
        copies = found.join(extra, "ridx").withColumn("ridx", F.col("copy")).drop("copy").withColumn("ireach", F.col("ireach") + 1).withColumn("geometry", F.array().cast(found.schema["geometry"].dataType)).withColumn("mask", F.lit(True))
        found = found.withColumn("mask", F.lit(False)).unionByName(copies)
    links = checkpointed(links)
    fed = links.where("to_ridx <> 0").select(F.col("to_ridx").alias("ridx")).distinct().withColumn("_fed", F.lit(1.0))
    found = found.join(fed, "ridx", "left").withColumn("ustrf", F.coalesce("_fed", F.lit(0.0))).drop("_fed")
    return ReachNetwork("mf6", network, model.grid, checkpointed(found), marked, links, diversions, model.perlen)
