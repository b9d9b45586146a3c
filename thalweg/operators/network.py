"""The network: stream lines linked into a forest, with what is derived from it."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import trees
from thalweg.operators.trees import checkpointed


def sentinel(lines: DataFrame) -> int:
    """The number that stands for "no segment": 0 if all are positive, else one less than the smallest."""
    least = lines.agg(F.min("segnum")).first()[0]
    return 0 if least is None or least > 0 else least - 1


def endpoints(lines: DataFrame) -> DataFrame:
    """``segnum, pos`` and the first and last vertex as ``sx, sy, sz, ex, ey, ez``."""
    a, b = G.first(F.col("geometry")), G.last(F.col("geometry"))
    return lines.select("segnum", "pos", a["x"].alias("sx"), a["y"].alias("sy"), a["z"].alias("sz"), b["x"].alias("ex"), b["y"].alias("ey"), b["z"].alias("ez"))


def downstream_links(ends: DataFrame) -> DataFrame:
    """``(segnum, to_segnum, matches)`` of segments whose last vertex is the first of another: the first by position, and all of them.

    An equi-join on exact coordinates of line ends with one row per start point,
    by merging: files are packed so well that their size would have millions of
    rows sent to the driver to be broadcast. The joins below do the same.
    """
    starts = ends.groupBy("sx", "sy").agg(F.min_by("segnum", "pos").alias("to_segnum"), F.array_sort(F.collect_list("segnum")).alias("matches"))
    return ends.select("segnum", F.col("ex").alias("sx"), F.col("ey").alias("sy")).join(starts.hint("merge"), ["sx", "sy"]).select("segnum", "to_segnum", "matches")


def z_mismatches(ends: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose ends meet in the plane but not in height."""
    below = ends.select(F.col("segnum").alias("to_segnum"), F.col("sz").alias("start_z"))
    return links.join(ends.select("segnum", "ez"), "segnum").join(below, "to_segnum").where(~F.col("ez").eqNullSafe(F.col("start_z"))).select("segnum", "to_segnum", F.col("ez").alias("end_z"), "start_z")


def shared_outlets(ends: DataFrame, links: DataFrame) -> DataFrame:
    """Points at which several outlets end: ``x, y, segnums``."""
    out = ends.join(links.hint("merge"), "segnum", "left_anti").groupBy(F.col("ex").alias("x"), F.col("ey").alias("y")).agg(F.array_sort(F.collect_set("segnum")).alias("segnums"))
    return out.where(F.size("segnums") > 1)


def shared_starts(ends: DataFrame, links: DataFrame, listed: int = 4_000_000) -> DataFrame:
    """Headwaters that start where others start: ``segnum, others``.

    The lists of a place grow with the square of its lines, so its headwaters are
    dealt to as many slices as it takes for each to list about ``listed`` numbers;
    slices are rows that the lines of the place come along with, and there are as
    many tasks as slices.
    """
    heads = ends.join(links.select(F.col("to_segnum").alias("segnum")).hint("merge"), "segnum", "left_anti")
    n, keys = F.size("all").cast("long"), ["place", "slice"]  # a join by coordinates would deal its rows anew, by its own number of tasks
    every = checkpointed(ends.groupBy("sx", "sy").agg(F.array_sort(F.collect_set("segnum")).alias("all")).where(F.size("all") > 1).withColumn("place", F.monotonically_increasing_id()))
    places = every.withColumn("slices", F.ceil(n * n / listed))
    tasks = max(places.agg(F.sum(n * n)).first()[0] or 0, 1) // listed + int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.join(places.select("sx", "sy", "place", "slices"), ["sx", "sy"]).select("segnum", "place", F.pmod(F.xxhash64("segnum"), F.col("slices")).alias("slice"))
    lists = places.select("place", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    met = dealt.repartition(tasks, *keys).join(lists.repartition(tasks, *keys).hint("merge"), keys)
    return met.select("segnum", F.array_remove("all", F.col("segnum")).alias("others"))


def bins(xmin: Column, xmax: Column, ymin: Column, ymax: Column, wide: Column | float, high: Column | float) -> Column:
    """All bins ``wide`` by ``high`` that a box meets, as ``array<struct<bx, by>>``."""
    span = lambda a, b, side: F.sequence(F.floor(a / side), F.floor(b / side))
    return F.flatten(F.transform(span(xmin, xmax, wide), lambda bx: F.transform(span(ymin, ymax, high), lambda by: F.struct(bx.alias("bx"), by.alias("by")))))


def bins_along(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """The bins that an edge passes, as ``array<struct<bx, by>>``: for each column of bins the rows between where the edge enters and leaves it.

    One more row is taken on either side of borders that rounding could shift,
    so the count grows with the edge's length, not with its box.
    """
    low, high = F.least(ax, bx), F.greatest(ax, bx)
    slope = F.when(ax != bx, (by - ay) / (bx - ax)).otherwise(0.0)

    def rows(col: Column) -> Column:
        x0, x1 = F.greatest(col * size, low), F.least((col + 1) * size, high)
        y0 = F.when(ax == bx, F.least(ay, by)).otherwise(ay + (x0 - ax) * slope)
        y1 = F.when(ax == bx, F.greatest(ay, by)).otherwise(ay + (x1 - ax) * slope)
        slack = 1e-9 * (1 + F.abs(y0) + F.abs(y1))
        return F.transform(F.sequence(F.floor((F.least(y0, y1) - slack) / size), F.floor((F.greatest(y0, y1) + slack) / size)), lambda row: F.struct(col.alias("bx"), row.alias("by")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), rows))


def edge_rows(lines: DataFrame) -> DataFrame:
    """One row per edge: ``segnum, edge, ax, ay, az, bx_, by_, bz, at, len``."""
    return lines.select("segnum", F.posexplode(G.measured(F.col("geometry"))).alias("edge", "e")).select(
        "segnum", "edge", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.a.z").alias("az"), F.col("e.b.x").alias("qx"), F.col("e.b.y").alias("qy"), F.col("e.b.z").alias("qz"), F.col("e.at").alias("at"), F.col("e.len").alias("len")
    )


def bin_size(lines: DataFrame) -> float:
    """A bin of about the mean edge length, so an edge meets few bins."""
    mean = edge_rows(lines).agg(F.avg("len")).first()[0]
    return float(mean) if mean else 1.0


def outlets_in_middle(lines: DataFrame, ends: DataFrame, links: DataFrame, size: float | None = None) -> DataFrame:
    """Outlets that end on another line: ``segnum, other``. Points and edges meet by bins, then by exact cross product."""
    size = size or bin_size(lines)
    spared = shared_outlets(ends, links).select(F.explode("segnums").alias("segnum"))
    points = ends.join(links.hint("merge"), "segnum", "left_anti").join(spared.hint("merge"), "segnum", "left_anti").select("segnum", "ex", "ey", F.floor(F.col("ex") / size).alias("bx"), F.floor(F.col("ey") / size).alias("by"))
    low, high = F.least, F.greatest
    rows = edge_rows(lines).select(
        F.col("segnum").alias("other"), "ax", "ay", "qx", "qy", F.explode(bins_along(F.col("ax"), F.col("ay"), F.col("qx"), F.col("qy"), size)).alias("bin")
    ).select("other", "ax", "ay", "qx", "qy", "bin.bx", "bin.by")
    cross = (F.col("qx") - F.col("ax")) * (F.col("ey") - F.col("ay")) - (F.col("qy") - F.col("ay")) * (F.col("ex") - F.col("ax"))
    inside = F.col("ex").between(low("ax", "qx"), high("ax", "qx")) & F.col("ey").between(low("ay", "qy"), high("ay", "qy"))
    return points.join(rows.hint("merge"), ["bx", "by"]).where((cross == 0) & inside & (F.col("segnum") != F.col("other"))).select("segnum", "other").distinct()


def check_catchments(lines: DataFrame, catchments: DataFrame) -> None:
    """ValueError unless ``catchments(segnum, rings)`` has one polygon for each line and no other, and all are polygons."""
    odd = lines.select("segnum").join(catchments.select("segnum", F.lit(1).alias("_c")), "segnum", "full").where("_c IS NULL").limit(1).count()
    if odd or catchments.count() != lines.count():
        raise ValueError("polygons.index is different than lines.index")
    if catchments.where(F.coalesce(F.size("rings"), F.lit(0)).__lt__(1) | F.exists("rings", lambda r: F.size(r) < 4)).limit(1).count():
        raise ValueError("polygons must all be Polygon types")


def beside_catchments(lines: DataFrame, catchments: DataFrame) -> DataFrame:
    """``(segnum)`` of the lines that don't meet their own catchment."""
    return lines.select("segnum", "geometry").join(catchments.select("segnum", "rings"), "segnum").where(~G.line_meets_polygon(F.col("geometry"), F.col("rings"))).select("segnum")


def problems(lines: DataFrame, ends: DataFrame, links: DataFrame, catchments: DataFrame | None = None) -> DataFrame:
    """``(level, kind, rank, segnum, message)`` of all that is wrong with the lines, as one frame."""
    text = lambda c: F.col(c).cast("string")
    ids = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))

    def named(df: DataFrame, level: str, kind: str, rank: int, segnum, *message) -> DataFrame:
        return df.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), segnum.cast("long").alias("segnum"), F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message]).alias("message"))

    seg = F.col("segnum")
    found = [
        named(links.where(F.size("matches") > 1), "error", "several downstream", 1, seg, "ending segment ", text("segnum"), " matches more than one downstream segment: ", ids("matches")),
        named(z_mismatches(ends, links), "warning", "height differs", 2, seg, "ending segment ", text("segnum"), " matches starting segment ", text("to_segnum"), " in 2D, but not in Z dimension (",
              F.coalesce(text("end_z"), F.lit("none")), " and ", F.coalesce(text("start_z"), F.lit("none")), ")"),
        named(shared_outlets(ends, links), "warning", "outlets meet", 3, F.col("segnums")[0], "ending coordinate (", text("x"), ", ", text("y"), ") matches end segments: ", ids("segnums")),
        named(outlets_in_middle(lines, ends, links), "error", "outlet in the middle", 4, seg, "segment ", text("segnum"), " connects to the middle of segment ", text("other")),
        named(shared_starts(ends, links), "error", "starts meet", 5, seg, "starting segment ", text("segnum"), " matches start segments: ", ids("others")),
    ]
    if catchments is not None:
        found.append(named(beside_catchments(lines, catchments), "error", "beside catchment", 6, seg, "segment ", text("segnum"), " does not intersect its polygon"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True, repr=False)
class Network:
    """``segments`` (a row per segment, ``pos`` its place in the input), the sentinel ``end`` and what rides along."""

    segments: DataFrame
    end: int = 0
    catchments: DataFrame | None = None
    diversions: DataFrame | None = None
    #: ``(level, kind, segnum, message)``: all that is wrong with the lines, a row each.
    problems: DataFrame | None = None

    def _messages(self, level: str, listed: int = 1000) -> list[str]:
        """The first messages of a level; where there are more, the last entry says how many."""
        if self.problems is None:
            return []
        mine = self.problems.where(F.col("level") == level)
        out = [r["message"] for r in mine.orderBy("rank", "segnum", "message").limit(listed + 1).collect()]
        return out if len(out) <= listed else [*out[:listed], f"... and {mine.count() - listed} more, see problems"]

    @property
    def errors(self) -> list[str]:
        return self._messages("error")

    @property
    def warnings(self) -> list[str]:
        return self._messages("warning")

    def __repr__(self) -> str:
        ids = [r[0] for r in self.segments.select("segnum").orderBy("segnum").limit(8).collect()]
        n = len(self)
        shown = ", ".join(map(str, ids if n <= 8 else ids[:4])) + (", ..." if n > 8 else "")
        extra = "".join(f" with {name}" for name in ("catchments", "diversions") if getattr(self, name) is not None)
        return f"<Network: {n} segments [{shown}], end {self.end}{extra}>"

    def __iter__(self):
        """Name and value of each part, as a mapping takes them."""
        return iter([(f.name, getattr(self, f.name)) for f in fields(self)])

    def with_catchments(self, catchments: DataFrame | None) -> Network:
        """With ``catchments(segnum, rings)``, one a segment, or None for without. Upstream areas and widths are worked out where segments have none yet."""
        if catchments is None:
            return replace(self, catchments=None)
        check_catchments(self.segments, catchments)
        made = replace(self, catchments=catchments)
        if "upstream_area" not in self.segments.columns:
            made = replace(made, segments=self.segments.join(made.upstream_area().withColumnRenamed("accumulated", "upstream_area"), "segnum"))
        if "width" not in self.segments.columns:
            made = replace(made, segments=made.segments.join(made.estimate_width(), "segnum"))
        return made

    @classmethod
    def wrap(cls, segments: DataFrame, end: int = 0, **kwargs) -> Network:
        """Segments as they are, with links to segments that aren't there sent to ``end``."""
        known = segments.select(F.col("segnum").alias("to_segnum"), F.lit(True).alias("_known"))
        fixed = segments.join(known, "to_segnum", "left").withColumn("to_segnum", F.when(F.col("_known"), F.col("to_segnum")).otherwise(F.lit(end))).drop("_known")
        return cls(fixed.select(*segments.columns), end, **kwargs)

    @property
    def headwater(self) -> DataFrame:
        """Segments that nothing flows into."""
        return self.segments.select("segnum").join(self.segments.select(F.col("to_segnum").alias("segnum")), "segnum", "left_anti")

    @property
    def outlets(self) -> DataFrame:
        return self.segments.where(F.col("to_segnum") == self.end).select("segnum")

    @property
    def to_segnums(self) -> DataFrame:
        return self.segments.where(F.col("to_segnum") != self.end).select("segnum", "to_segnum")

    @property
    def from_segnums(self) -> DataFrame:
        return trees.from_segnums(self.segments, self.end).where(F.size("from_segnums") > 0)

    @property
    def has_z(self) -> bool:
        """Whether every vertex of every line has a height."""
        row = self.segments.agg(F.bool_and(F.forall("geometry", lambda p: p["z"].isNotNull()))).first()
        return bool(row[0])

    def __len__(self) -> int:
        return self.segments.count()

    def same_as(self, other: Network) -> bool:
        """Equal sentinel and equal segments, whatever their order."""
        if self.end != other.end or self.segments.columns != other.segments.columns:
            return False
        return not self.segments.exceptAll(other.segments).limit(1).count() and not other.segments.exceptAll(self.segments).limit(1).count()

    def require(self, ids, what: str = "segnum") -> None:
        """IndexError unless every id is a segment."""
        ids = list(ids)
        spark = self.segments.sparkSession
        if ids:
            lost = spark.createDataFrame([(int(i),) for i in ids], "segnum long").join(self.segments.select("segnum"), "segnum", "left_anti").orderBy("segnum").limit(16).collect()
            if lost:
                raise IndexError(f"{what} {[r[0] for r in lost]} not found in segments")

    def accumulate(self, values: DataFrame, column: str = "value") -> DataFrame:
        """``(segnum, accumulated)``: each value with all upstream ones. ``values(segnum, column)`` must cover the segments exactly."""
        gaps = self.segments.select("segnum").join(values.select("segnum", F.lit(1).alias("_v")), "segnum", "full").where(F.col("_v").isNull()).limit(1).count()
        if gaps or values.count() != len(self):
            raise ValueError("index is different")
        live = Network.wrap(self.segments.select("segnum", "to_segnum"), self.end).segments.join(values.select("segnum", F.col(column).alias("v")), "segnum")
        return trees.climb(live, self.end, values=("v",)).select("segnum", F.col("up_v").alias("accumulated"))

    def upstream_length(self) -> DataFrame:
        return self.accumulate(self.segments.select("segnum", G.length(F.col("geometry")).alias("value")))

    def upstream_area(self) -> DataFrame:
        if self.catchments is None:
            raise ValueError("can't evaluate upstream area without catchment polygons")
        return self.accumulate(self.catchments.select("segnum", G.area(F.col("rings")).alias("value")))

    def estimate_width(self, a: float | str = 1.42, b: float | str = 0.52, upstream_area: str = "upstream_area", legacy_b: bool = False) -> DataFrame:
        """``(segnum, width)`` by a + (area / 1e6) ** b; ``a`` and ``b`` are numbers or columns. ``legacy_b``: a column ``b`` reads as ``a``."""
        if upstream_area not in self.segments.columns:
            raise ValueError(f"cannot find {upstream_area!r} column in segments")
        col = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
        if legacy_b and isinstance(b, str):
            b = a
        return self.segments.select("segnum", (col(a) + F.pow(F.col(upstream_area) / 1e6, col(b))).alias("width"))

    def remove(self, condition: Column | None = None, segnums=()) -> Network:
        """Without the segments that meet the condition or are listed. Derived columns stay as they were."""
        self.require(segnums)
        gone = F.lit(False) if condition is None else F.coalesce(condition, F.lit(False))
        if segnums:
            gone = gone | F.col("segnum").isin([int(s) for s in segnums])
        kept = self.segments.where(~gone)
        if not kept.limit(1).count():
            raise ValueError("all segments were selected to remove; must keep at least one")
        links = None if self.catchments is None else self.catchments.join(kept.select("segnum"), "segnum", "left_semi")
        return replace(self, segments=kept, catchments=links)


def from_lines(lines: DataFrame, catchments: DataFrame | None = None) -> Network:
    """A network of ``lines(segnum, pos, geometry)`` whose ends meet; ``catchments(segnum, rings)`` one a line.

    Adds ``to_segnum, from_segnums, cat_group, num_to_outlet, dist_to_outlet,
    sequence, stream_order, upstream_length`` (and with catchments
    ``upstream_area, width``); what is wrong with the lines is told in
    ``problems``, a row each, and listed in ``errors`` and ``warnings``.
    """
    state = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.size("geometry"), F.lit(0)) < 2).alias("bad")).first()
    if not state["n"]:
        raise ValueError("one or more lines are required")
    if state["bad"]:
        raise ValueError("lines must all be LineString types")
    if catchments is not None:
        check_catchments(lines, catchments)
        apart = beside_catchments(lines, catchments).count()
        if apart == state["n"]:
            raise ValueError("lines do not intersect their polygons")
    end = sentinel(lines)
    ends = checkpointed(endpoints(lines))
    links = checkpointed(downstream_links(ends))
    found = checkpointed(problems(lines, ends, links, catchments))
    base = checkpointed(
        lines.join(links.select("segnum", "to_segnum"), "segnum", "left").withColumn("to_segnum", F.coalesce("to_segnum", F.lit(end)))
        .withColumn("length", G.length(F.col("geometry")))
    )
    values = ["length"]
    if catchments is not None:
        base = checkpointed(base.join(catchments.select("segnum", G.area(F.col("rings")).alias("area")), "segnum"))
        values.append("area")
    up = checkpointed(trees.climb(base, end, length="length", values=tuple(values)))
    tree = base.select("segnum", "pos", "to_segnum").join(up, "segnum")
    full = (
        base.drop("length", "area").join(trees.from_segnums(base, end), "segnum").join(up, "segnum").join(trees.orders(tree, end), "segnum")
        .withColumnsRenamed({"up_length": "upstream_length", "up_area": "upstream_area"})
    )
    columns = [*lines.columns, "to_segnum", "from_segnums", "cat_group", "num_to_outlet", "dist_to_outlet", "sequence", "stream_order", "upstream_length"]
    if catchments is not None:
        full = full.withColumn("width", 1.42 + F.pow(F.col("upstream_area") / 1e6, F.lit(0.52)))
        columns += ["upstream_area", "width"]
    return Network(checkpointed(full.select(*columns)), end, catchments, None, found)


def pair_segments(network: Network, values: DataFrame, *, out: DataFrame | float | None = None, method: str = "continuous") -> DataFrame:
    """``(segnum, top, bottom)`` of ``values(segnum, value)``.

    ``continuous``: the bottom is the downstream segment's value; ``constant``:
    its own; ``additive``: its share, among the tributaries of a confluence,
    of the value downstream. ``out`` overrides bottoms, of outlets if a number.
    """
    if method not in ("continuous", "constant", "additive"):
        raise ValueError(f"method must be 'continuous', 'constant' or 'additive', not {method!r}")
    from pyspark.sql import Window

    links = network.segments.select("segnum", "to_segnum").join(values.select("segnum", F.col("value").alias("top")), "segnum")
    if method == "constant":
        paired = links.withColumn("bottom", F.col("top"))
    else:
        below = values.select(F.col("segnum").alias("to_segnum"), F.col("value").alias("next"))
        paired = links.join(below, "to_segnum", "left")
        if method == "continuous":
            paired = paired.withColumn("bottom", F.coalesce("next", "top"))
        else:
            fork = Window.partitionBy("to_segnum")
            share = F.col("top") / F.sum("top").over(fork) * F.col("next")
            paired = paired.withColumn("bottom", F.when((F.col("to_segnum") != network.end) & (F.count(F.lit(1)).over(fork) > 1), share).otherwise(F.col("top").cast("double")))
    if isinstance(out, DataFrame):
        paired = paired.join(out.select("segnum", F.col("value").alias("_out")), "segnum", "left").withColumn("bottom", F.coalesce("_out", "bottom"))
    elif out is not None:
        paired = paired.withColumn("bottom", F.when(F.col("to_segnum") == network.end, F.lit(out)).otherwise(F.col("bottom")))
    return paired.select("segnum", "top", "bottom")
