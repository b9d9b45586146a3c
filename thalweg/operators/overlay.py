"""Lines over a model grid: cells, pieces, reaches, their numbers and the values they take."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import cleaning
from thalweg.operators.network import Network, edge_rows
from thalweg.operators.trees import checkpointed


@dataclass(frozen=True)
class Grid:
    """Cells in rows and columns, row 0 at the top, from the upper left corner.

    They are ``dy`` by ``dx``, or as wide and high as ``delr`` (columns) and
    ``delc`` (rows) list them. A grid that is turned by ``angle`` degrees about
    its lower left corner has lines turned back by ``to_local`` before they meet it.
    """

    nrow: int
    ncol: int
    dx: float
    dy: float
    xmin: float
    ymax: float
    delr: tuple[float, ...] | None = None
    delc: tuple[float, ...] | None = None
    angle: float = 0.0

    @classmethod
    def spaced(cls, delr, delc, xmin: float = 0.0, ymin: float = 0.0, angle: float = 0.0) -> Grid:
        """A grid of listed column widths and row heights from its lower left corner."""
        delr, delc = tuple(map(float, delr)), tuple(map(float, delc))
        if not delr or not delc or min(*delr, *delc) <= 0:
            raise ValueError("delr and delc must be positive")
        even = len({*delr}) == 1 and len({*delc}) == 1
        return cls(len(delc), len(delr), median(delr), median(delc), xmin, ymin + sum(delc), None if even else delr, None if even else delc, angle)

    @property
    def cell_size(self) -> float:
        """Mean of the median width and the median height."""
        return (self.dx + self.dy) / 2

    def _edges(self) -> tuple[list[float], list[float]]:
        xs, ys = [self.xmin], [self.ymax]
        for d in self.delr or ():
            xs.append(xs[-1] + d)
        for d in self.delc or ():
            ys.append(ys[-1] - d)
        return xs, ys

    def x_at(self, j: Column) -> Column:
        """Left side of column ``j``; that of the number of columns is the right side of the grid."""
        if self.delr is None:
            return self.xmin + j * self.dx
        return F.element_at(F.array(*map(F.lit, self._edges()[0])), (j + 1).cast("int"))

    def y_at(self, i: Column) -> Column:
        """Upper side of row ``i``."""
        if self.delc is None:
            return self.ymax - i * self.dy
        return F.element_at(F.array(*map(F.lit, self._edges()[1])), (i + 1).cast("int"))

    def col_of(self, x: Column) -> Column:
        """The column that ``x`` lies in, -1 left of the grid and the number of columns right of it or more."""
        if self.delr is None:
            return F.floor((x - self.xmin) / self.dx)
        return F.size(F.filter(F.array(*map(F.lit, self._edges()[0])), lambda e: e <= x)) - 1

    def row_of(self, y: Column) -> Column:
        """The row that ``y`` lies in, counted from the top."""
        if self.delc is None:
            return F.floor((self.ymax - y) / self.dy)
        return F.size(F.filter(F.array(*map(F.lit, self._edges()[1])), lambda e: e >= y)) - 1

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """``xmin, xmax, ymin, ymax``, before any turning."""
        width, height = (sum(d) if d else n * s for d, n, s in ((self.delr, self.ncol, self.dx), (self.delc, self.nrow, self.dy)))
        return self.xmin, self.xmin + width, self.ymax - height, self.ymax

    def to_local(self, line: Column) -> Column:
        """A line turned back about the lower left corner, so that the grid lies straight."""
        if not self.angle:
            return line
        x0, _, y0, _ = self.extent
        c, s = F.cos(F.radians(F.lit(-self.angle))), F.sin(F.radians(F.lit(-self.angle)))
        return F.transform(line, lambda p: G.xyz(x0 + (p["x"] - x0) * c - (p["y"] - y0) * s, y0 + (p["x"] - x0) * s + (p["y"] - y0) * c, p["z"]))

    def geotransform(self) -> tuple[float, float, float, float, float, float]:
        """The six numbers that place a raster of this grid."""
        if self.angle:
            raise NotImplementedError("rotated grids have no plain geotransform")
        if self.delr or self.delc:
            raise ValueError("cells must be of one size")
        return self.xmin, self.dx, 0.0, self.ymax, 0.0, -self.dy

    def cells(self, spark: SparkSession) -> DataFrame:
        """``i, j, xmin, xmax, ymin, ymax`` of every cell."""
        flat = spark.range(self.nrow * self.ncol)
        i, j = (F.col("id") / self.ncol).cast("int"), (F.col("id") % self.ncol).cast("int")
        rows = flat.select(i.alias("i"), j.alias("j"))
        return rows.select("i", "j", self.x_at(F.col("j")).alias("xmin"), self.x_at(F.col("j") + 1).alias("xmax"), self.y_at(F.col("i") + 1).alias("ymin"), self.y_at(F.col("i")).alias("ymax"))


def _slab(start: Column, step: Column, low: Column, high: Column, on_border: Column) -> tuple[Column, Column]:
    """Shares of an edge at which it enters and leaves a strip; a parallel edge is in it wholly or not at all."""
    a, b = (low - start) / step, (high - start) / step
    return (
        F.when(step == 0, F.when(on_border, 0.0).otherwise(2.0)).otherwise(F.least(a, b)),
        F.when(step == 0, F.when(on_border, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)),
    )


def overlay(lines: DataFrame, grid: Grid) -> DataFrame:
    """``(segnum, piece, i, j, start, stop, length, segndist)``: the parts of each line in each cell, in flow order.

    Each edge meets the cells of its box, found by arithmetic, and is clipped
    by their sides; what follows on in the same cell is one piece. An edge
    along a side belongs to the cell of lower number. ``start`` and ``stop``
    are distances along the line, ``segndist`` the middle as a share of it.
    """
    e = edge_rows(lines)
    low, high = F.least, F.greatest
    inside = lambda v, n: F.least(F.greatest(v, F.lit(-1)), F.lit(n)).cast("int")
    j0, j1 = inside(grid.col_of(low("ax", "qx")) - 1, grid.ncol), inside(grid.col_of(high("ax", "qx")), grid.ncol)
    i0, i1 = inside(grid.row_of(high("ay", "qy")) - 1, grid.nrow), inside(grid.row_of(low("ay", "qy")), grid.nrow)
    cells = e.withColumn("j", F.explode(F.sequence(F.greatest(j0, F.lit(0)), F.greatest(j1, F.lit(0))))).withColumn("i", F.explode(F.sequence(F.greatest(i0, F.lit(0)), F.greatest(i1, F.lit(0))))).where(f"i < {grid.nrow} AND j < {grid.ncol}")
    x0, x1 = grid.x_at(F.col("j")), grid.x_at(F.col("j") + 1)
    y0, y1 = grid.y_at(F.col("i") + 1), grid.y_at(F.col("i"))
    dx, dy = F.col("qx") - F.col("ax"), F.col("qy") - F.col("ay")
    in_col = ((F.col("ax") > x0) & (F.col("ax") <= x1)) | ((F.col("j") == 0) & (F.col("ax") == x0))
    in_row = ((F.col("ay") >= y0) & (F.col("ay") < y1)) | ((F.col("i") == 0) & (F.col("ay") == y1))
    tx0, tx1 = _slab(F.col("ax"), dx, x0, x1, in_col)
    ty0, ty1 = _slab(F.col("ay"), dy, y0, y1, in_row)
    cut = cells.withColumn("t0", F.greatest(tx0, ty0, F.lit(0.0))).withColumn("t1", F.least(tx1, ty1, F.lit(1.0))).where(F.col("t1") > F.col("t0"))
    cut = cut.select("segnum", "i", "j", (F.col("at") + F.col("t0") * F.col("len")).alias("start"), (F.col("at") + F.col("t1") * F.col("len")).alias("stop"))
    by = Window.partitionBy("segnum").orderBy("start", "stop")
    fresh = (F.lag("i").over(by).isNull()) | (F.lag("i").over(by) != F.col("i")) | (F.lag("j").over(by) != F.col("j")) | (F.col("start") - F.lag("stop").over(by) > 1e-9)
    marked = cut.withColumn("fresh", fresh.cast("int")).withColumn("piece", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    pieces = marked.groupBy("segnum", "piece").agg(F.first("i").alias("i"), F.first("j").alias("j"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    total = lines.select("segnum", G.length(F.col("geometry")).alias("total"))
    return pieces.join(total, "segnum").select("segnum", "piece", "i", "j", "start", "stop", (F.col("stop") - F.col("start")).alias("length"), ((F.col("start") + F.col("stop")) / 2 / F.col("total")).alias("segndist"))


def prefix_sums(df: DataFrame, key: str, value: str, width: int = 4096) -> DataFrame:
    """``(key, before)``: the sum of ``value`` over rows with smaller keys, whole-number keys each once.

    Sums within ranges of keys, then over the ranges, so no task sorts all rows.
    """
    ranged = df.select(key, value, F.floor(F.col(key) / width).alias("_r"))
    parts = ranged.groupBy("_r").agg(F.sum(value).alias("_n"))
    parts = parts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inner).join(parts, "_r").select(key, (F.col("_in") + F.col("_earlier")).alias("before"))


def number_reaches(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Pieces as reaches: ``ridx, segnum, k, i, j, iseg, ireach, segndist, rlen``, by sequence of the segment, then along it; all counted from 1."""
    rows = pieces.join(segments.select("segnum", "sequence"), "segnum")
    along = Window.partitionBy("segnum").orderBy("segndist", "i", "j")
    rows = checkpointed(rows.withColumn("ireach", F.row_number().over(along)))
    per = rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("long"))
    at = prefix_sums(per, "sequence", "n").withColumnRenamed("before", "earlier").join(prefix_sums(per, "sequence", "one").withColumnRenamed("before", "rank"), "sequence")
    return rows.join(at, "sequence").select(
        (F.col("earlier") + F.col("ireach")).cast("long").alias("ridx"), "segnum", F.lit(0).alias("k"), "i", "j", (F.col("rank") + 1).cast("int").alias("iseg"), F.col("ireach").cast("int").alias("ireach"),
        "segndist", F.when(F.col("length") == 0, 1.0).otherwise(F.col("length")).alias("rlen"), "start", "stop",
    )


def near_cells(lines: DataFrame, grid: Grid) -> DataFrame:
    """``(segnum, i, j)`` of the cells that each line's edges pass or come next to."""
    e = edge_rows(lines)
    low, high = F.least, F.greatest
    span = lambda a, b, n: F.sequence(F.greatest(a - 1, F.lit(0)).cast("int"), F.least(b + 1, F.lit(n - 1)).cast("int"))
    j0, j1 = grid.col_of(low("ax", "qx")), grid.col_of(high("ax", "qx"))
    i0, i1 = grid.row_of(high("ay", "qy")), grid.row_of(low("ay", "qy"))
    meets = (j0 - 1 < grid.ncol) & (j1 + 1 >= 0) & (i0 - 1 < grid.nrow) & (i1 + 1 >= 0)
    rows = e.where(meets).withColumn("j", F.explode(span(j0, j1, grid.ncol))).withColumn("i", F.explode(span(i0, i1, grid.nrow)))
    return rows.select("segnum", "i", "j").distinct()


def clean(pieces: DataFrame, lines: DataFrame, grid: Grid, fraction: float | DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``pieces`` of ``overlay`` with leftovers taken in, short pieces moved and neighbours of one cell joined.

    A stretch beside the active cells, or a piece that only clips one, goes to
    the cell next to it if it is no longer, or no farther off, than
    ``fraction`` of the cell size (a number or a frame ``(segnum, value)``);
    see ``cleaning``. Segments on which nothing can change aren't looked at.
    """
    size = grid.cell_size
    reach = lines.select("segnum", F.lit(float(fraction) * size).alias("reach")) if not isinstance(fraction, DataFrame) else fraction.select("segnum", (F.col("value") * size).alias("reach"))
    total = lines.select("segnum", "geometry", G.length(F.col("geometry")).alias("total")).join(reach, "segnum")
    listed = pieces.groupBy("segnum").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "i", "j"))).alias("pieces"), F.sum("length").alias("covered"), F.min("length").alias("least"),
        F.count(F.lit(1)).alias("n"), F.countDistinct("i", "j").alias("cells_hit"),
    )
    rows = checkpointed(total.join(listed, "segnum"))
    odd = (F.col("covered") < F.col("total") * (1 - 1e-9)) | (F.col("least") < F.col("reach")) | (F.col("n") > F.col("cells_hit"))
    boxes = grid.cells(lines.sparkSession)
    boxes = boxes.withColumn("active", F.lit(True)) if active is None else boxes.join(active.select("i", "j", (F.col("domain") != 0).alias("active")), ["i", "j"])
    around = near_cells(rows.where(odd).select("segnum", "geometry"), grid).join(boxes, ["i", "j"]).groupBy("segnum").agg(F.collect_list(F.struct("i", "j", "xmin", "xmax", "ymin", "ymax", "active")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(len(part)):
                yield cleaning.cleaned(part.iloc[k : k + 1], size)

    made = rows.where(odd).select("segnum", "geometry", "pieces", "reach").join(around, "segnum").mapInPandas(
        run, "segnum long, piece int, i int, j int, start double, stop double, length double, segndist double"
    )
    plain = pieces.join(rows.where(odd).select("segnum"), "segnum", "left_anti")
    return plain.select(*made.columns).unionByName(made)


def nearest_cell(points: DataFrame, grid: Grid, active: DataFrame | None = None) -> DataFrame:
    """``(id, i, j)``: the active cell nearest to each of ``points(id, x, y)``, that of smallest row and column where two are.

    Rings of cells around the one a point is in, or nearest to, are looked
    through, each twice as wide as the last, until a cell is found that no
    cell outside the ring can beat.
    """
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    rest = checkpointed(points.select("id", "x", "y", clamp(grid.row_of(F.col("y")), grid.nrow).alias("ci"), clamp(grid.col_of(F.col("x")), grid.ncol).alias("cj")).where("NOT isnan(x) AND NOT isnan(y) AND x IS NOT NULL AND y IS NOT NULL"))
    boxes = grid.cells(points.sparkSession)
    if active is not None:
        boxes = boxes.join(active.where("domain <> 0").select("i", "j"), ["i", "j"])
    boxes = checkpointed(boxes)
    least_side = min(*(grid.delr or (grid.dx,)), *(grid.delc or (grid.dy,)))
    found, r = None, 1
    while True:
        span = lambda c, n, r=r: F.explode(F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1))))
        asked = rest.withColumn("i", span("ci", grid.nrow)).withColumn("j", span("cj", grid.ncol)).join(boxes, ["i", "j"])
        dx = F.greatest(F.col("xmin") - F.col("x"), F.col("x") - F.col("xmax"), F.lit(0.0))
        dy = F.greatest(F.col("ymin") - F.col("y"), F.col("y") - F.col("ymax"), F.lit(0.0))
        best = asked.groupBy("id").agg(F.min(F.struct(F.sqrt(dx * dx + dy * dy).alias("dist"), "i", "j")).alias("b"))
        whole = r >= max(grid.nrow, grid.ncol)
        settled = checkpointed(best if whole else best.where(F.col("b.dist") <= r * least_side)).select("id", "b.i", "b.j")
        found = settled if found is None else found.unionByName(settled)
        rest = checkpointed(rest.join(settled.select("id"), "id", "left_anti"))
        if whole or not rest.limit(1).count():
            return found
        r *= 2


def rescued(pieces: DataFrame, network: Network, grid: Grid, active: DataFrame | None = None) -> DataFrame:
    """Pieces for segments beside the model that gather two or more segments in it: one each, no longer than a cell, in the active cell nearest to its start."""
    inside = pieces.select("segnum").distinct()
    out = network.segments.join(inside, "segnum", "left_anti").select("segnum", "geometry", F.explode("from_segnums").alias("from"))
    fed = out.join(inside.select(F.col("segnum").alias("from")), "from").groupBy("segnum").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("segnum")
    lines = checkpointed(network.segments.select("segnum", "geometry").join(fed, "segnum"))
    start = G.first(F.col("geometry"))
    cells = nearest_cell(lines.select(F.col("segnum").alias("id"), start["x"].alias("x"), start["y"].alias("y")), grid, active).withColumnRenamed("id", "segnum")
    length = F.least(G.length(F.col("geometry")), F.lit(grid.cell_size))
    return lines.join(cells, "segnum").select("segnum", F.lit(1).alias("piece"), "i", "j", F.lit(0.0).alias("start"), length.alias("stop"), length.alias("length"), F.lit(0.0).alias("segndist"))


def with_geometry(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Reaches with ``geometry``, the stretch of the segment's line with its heights; empty for those of no segment."""
    rows = found.drop("geometry").join(lines.select("segnum", F.col("geometry").alias("_line"), G.length(F.col("geometry")).alias("_total")), "segnum", "left")
    part = G.substring(F.col("_line"), F.col("start") / F.nullif("_total", F.lit(0.0)), F.col("stop") / F.nullif("_total", F.lit(0.0)))
    return rows.withColumn("geometry", F.when(F.col("_line").isNull() | F.col("start").isNull(), F.array().cast(G.LINE)).otherwise(part)).drop("_line", "_total")


def reaches(
    network: Network, grid: Grid, active: DataFrame | None = None, *, action: str = "freeze", reach_include_fraction: float | DataFrame | None = 0.2, rescue: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Reaches of a network over a grid, and the segments with ``in_model`` and ``inflow_segnums``.

    ``active(i, j, domain)``: with ``freeze`` pieces in cells of domain 0 are
    left out, with ``modify`` such cells take part. Pieces are cleaned, see
    ``clean``, unless ``reach_include_fraction`` is None. With ``freeze``, a
    segment beside the model that gathers several in it gets a reach as well
    unless ``rescue`` is off; it still counts as outside. A network's
    diversions that hang on segments with reaches come last.
    """
    if action not in ("freeze", "modify"):
        raise ValueError("domain_action must be one of freeze or modify")
    lines = network.segments.select("segnum", grid.to_local(F.col("geometry")).alias("geometry"))
    pieces = overlay(lines, grid)
    frozen = active if action == "freeze" else None
    if frozen is not None:
        pieces = pieces.join(frozen.where("domain <> 0").select("i", "j"), ["i", "j"])
    if reach_include_fraction is not None:
        pieces = clean(checkpointed(pieces), lines, grid, reach_include_fraction, frozen)
    pieces = checkpointed(pieces)
    inside = pieces.select("segnum").distinct().withColumn("_in", F.lit(True))
    if rescue and action == "freeze" and "from_segnums" in network.segments.columns:
        more = rescued(pieces, replace(network, segments=network.segments.withColumn("geometry", grid.to_local(F.col("geometry")))), grid, frozen)
        pieces = checkpointed(pieces.select(*more.columns).unionByName(more))
    found = checkpointed(number_reaches(pieces, network.segments))
    if network.diversions is not None:
        found = checkpointed(diversion_reaches(found, network.diversions, grid, end=network.end))
    marked = network.segments.join(inside, "segnum", "left").withColumn("in_model", F.coalesce("_in", F.lit(False))).drop("_in")
    outside = marked.where("NOT in_model").select(F.col("segnum").alias("from"))
    fed = marked.where("in_model").select("segnum", F.explode("from_segnums").alias("from")).join(outside, "from").groupBy("segnum").agg(F.array_sort(F.collect_set("from")).alias("inflow_segnums"))
    return found, marked.join(fed, "segnum", "left").withColumn("inflow_segnums", F.coalesce("inflow_segnums", F.array().cast("array<bigint>")))


def activated(active: DataFrame, found: DataFrame) -> DataFrame:
    """``(i, j, domain, prev_domain)``: inactive cells that reaches touch are switched on."""
    touched = found.select("i", "j").distinct().withColumn("_t", F.lit(True))
    return active.join(touched, ["i", "j"], "left").select("i", "j", F.when(F.col("_t") & (F.col("domain") == 0), 1).otherwise(F.col("domain")).alias("domain"), F.col("domain").alias("prev_domain"))


def reach_values(found: DataFrame, paired: DataFrame, *, log: bool = False) -> DataFrame:
    """``(ridx, value)``: segment values ``paired(segnum, top, bottom)`` interpolated at each reach, on a log scale if asked."""
    top, bottom = F.col("top").cast("double"), F.col("bottom").cast("double")
    line = (bottom - top) * F.col("segndist") + top
    if log:
        line = F.pow(F.lit(10.0), F.log10(top) + (F.log10(bottom) - F.log10(top)) * F.col("segndist"))
    return found.join(paired, "segnum", "left").select("ridx", F.when(top == bottom, top).otherwise(line).alias("value"))


def reach_array(found: DataFrame, array: DataFrame) -> DataFrame:
    """``(ridx, value)`` looked up in ``array(i, j, value)``."""
    return found.join(array, ["i", "j"], "left").select("ridx", "value")


def _rises(array: DataFrame, row_step: float, col_step: float) -> DataFrame:
    """``i, j`` and the rises ``gi`` and ``gj`` of ``array(i, j, value)`` a step along rows and columns: central inside, one-sided at the edges."""
    def side(part: str, order: str, step: float) -> Column:
        by = Window.partitionBy(part).orderBy(order)
        before, after, v = F.lag("value").over(by), F.lead("value").over(by), F.col("value")
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - v) / step).when(after.isNull(), (v - before) / step).otherwise((after - before) / (2 * step))

    return array.withColumn("gi", side("j", "i", row_step)).withColumn("gj", side("i", "j", col_step))


def gradient(array: DataFrame, row_step: float, col_step: float) -> DataFrame:
    """``(i, j, slope)``: magnitude of the gradient of ``array(i, j, value)``. The first spacing goes with rows, as given."""
    return _rises(array, row_step, col_step).select("i", "j", F.sqrt(F.col("gi") * F.col("gi") + F.col("gj") * F.col("gj")).alias("slope"))


def zcoords(found: DataFrame) -> DataFrame:
    """``(ridx, zcoord_count, zcoord_min, zcoord_avg, zcoord_max, zcoord_first, zcoord_last, raw)`` of reaches with ``geometry``: their heights and the fall per length."""
    z, g = G.z_coords(F.col("geometry")), F.col("geometry")
    n = F.size(z)
    of = lambda c: F.when(n > 0, c)
    first, last = F.get(z, F.lit(0)), F.get(z, n - 1)
    return found.select(
        "ridx", n.alias("zcoord_count"), of(F.array_min(z)).alias("zcoord_min"), of(F.aggregate(z, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))).alias("zcoord_avg"),
        of(F.array_max(z)).alias("zcoord_max"), of(first).alias("zcoord_first"), of(last).alias("zcoord_last"), of((first - last) / F.nullif(G.length(g), F.lit(0.0))).alias("raw"),
    )


def reach_slope(
    found: DataFrame, method: str = "auto", *, segments: DataFrame | None = None, top: DataFrame | None = None, grid: Grid | None = None, min_slope: float | DataFrame = 1e-3
) -> DataFrame:
    """``(ridx, slope)``, at least ``min_slope``: ``zcoord_ab`` from the heights at the ends of each reach (those of its
    segment where reaches have no geometry), ``grid_top`` from the gradient of the model top, ``rch_len`` from the step of
    the top across a cell over the reach's length; ``auto`` takes the first if all vertices of ``segments`` have heights, else the second.

    ``min_slope`` is a number or a frame ``(segnum, value)``; diversions take its smallest value.
    """
    if method not in ("auto", "zcoord_ab", "grid_top", "rch_len"):
        raise ValueError(f"method must be auto, zcoord_ab, grid_top or rch_len, not {method!r}")
    if method in ("auto", "zcoord_ab"):
        has_z = segments is not None and bool(segments.agg(F.bool_and(F.forall("geometry", lambda p: p["z"].isNotNull()))).first()[0])
        if method == "zcoord_ab" and not has_z:
            raise ValueError("method zcoord_ab requested, but surface water network does not contain Z coordinates")
        method = "zcoord_ab" if has_z else "grid_top"
    if isinstance(min_slope, DataFrame):
        limit = found.select("ridx", "segnum").join(min_slope.select("segnum", F.col("value").alias("_min")), "segnum", "left").drop("segnum")
        fallback = min_slope.join(found.select("segnum"), "segnum", "left_semi").agg(F.min("value")).first()[0]
        found = found.join(limit, "ridx")
        min_slope = F.coalesce(F.col("_min"), F.lit(fallback))
    else:
        min_slope = F.lit(float(min_slope))
    if method == "zcoord_ab":
        g = F.col("geometry")
        if "geometry" in found.columns:
            raw = found.join(zcoords(found).select("ridx", "raw"), "ridx")
        else:
            drop = segments.select("segnum", ((G.first(g)["z"] - G.last(g)["z"]) / G.length(g)).alias("raw"))
            raw = found.join(drop, "segnum", "left")
    elif method == "grid_top":
        raw = found.join(gradient(top, grid.dx, grid.dy).withColumnRenamed("slope", "raw"), ["i", "j"], "left")
    else:
        step = gradient(top, 1.0, 1.0).withColumnRenamed("slope", "step")
        raw = found.join(step, ["i", "j"], "left").withColumn("raw", F.col("step") / F.col("rlen"))
    return raw.select("ridx", F.when(F.col("raw").isNull() | F.isnan("raw") | (F.col("raw") < min_slope), min_slope).otherwise(F.col("raw")).alias("slope"))


def bilinear(points: DataFrame, array: DataFrame, grid: Grid) -> DataFrame:
    """``(loc, z)``: heights of ``points(loc, x, y)`` between cell centres, edges repeated; ValueError for points off the grid."""
    grid.geotransform()  # only straight grids of even cells
    u = (F.col("x") - grid.xmin) / grid.dx - 0.5
    v = (grid.ymax - F.col("y")) / grid.dy - 0.5
    off = points.where((F.col("x") < grid.xmin) | (F.col("x") > grid.xmin + grid.ncol * grid.dx) | (F.col("y") > grid.ymax) | (F.col("y") < grid.ymax - grid.nrow * grid.dy)).count()
    if off:
        raise ValueError(f"{off} coordinates are outside grid")
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    base = points.select("loc", u.alias("u"), v.alias("v")).withColumn("fu", F.col("u") - F.floor("u")).withColumn("fv", F.col("v") - F.floor("v"))
    corners = F.array(*[
        F.struct(clamp(F.floor("v") + a, grid.nrow).alias("i"), clamp(F.floor("u") + b, grid.ncol).alias("j"), ((F.col("fv") if a else 1 - F.col("fv")) * (F.col("fu") if b else 1 - F.col("fu"))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    rows = base.select("loc", F.explode(corners).alias("c")).select("loc", "c.i", "c.j", "c.w").join(array, ["i", "j"])
    return rows.groupBy("loc").agg(F.sum(F.col("w") * F.col("value")).alias("z"))


def reach_lookup(locations: DataFrame, found: DataFrame, lines: DataFrame, downstream_bias: float = 0.0) -> DataFrame:
    """``(loc, ridx, k, i, j, iseg, ireach, dist_to_reach)``: for each location the nearest reach of its segment, the later one where two are as near.

    ``locations(loc, segnum, x, y)`` are measured from their own place, those
    with ``seg_ndist`` in place of ``x`` and ``y`` (or without coordinates)
    from that place on the segment. ``found`` carries ``start`` and ``stop``
    along the line, or pieces of it are taken from ``segndist`` and ``rlen``.
    A ``downstream_bias`` shortens the reaches of segments that have several.
    """
    if not -1 <= downstream_bias <= 1:
        raise ValueError("downstream_bias must be between -1 and 1")
    total = G.length(F.col("geometry"))
    spans = found.drop("geometry").join(lines.select("segnum", "geometry"), "segnum").withColumn("total", total)
    half = F.col("rlen") / F.col("total") / 2
    low, high = F.greatest(F.col("segndist") - half, F.lit(0.0)), F.least(F.col("segndist") + half, F.lit(1.0))
    if {"start", "stop"} <= set(found.columns):
        low, high = F.coalesce(F.col("start") / F.col("total"), low), F.coalesce(F.col("stop") / F.col("total"), high)
    piece = G.substring(F.col("geometry"), low, high)
    spans = spans.select("ridx", "segnum", "k", "i", "j", "iseg", "ireach", "geometry", piece.alias("piece"))
    if downstream_bias:
        several = F.count(F.lit(1)).over(Window.partitionBy("segnum")) > 1
        spans = spans.withColumn("piece", F.when(several, G.bias_substring(F.col("piece"), downstream_bias)).otherwise(F.col("piece")))
    place = F.struct(*[F.col(c).cast("double").alias(c) if c in locations.columns else F.lit(None).cast("double").alias(c) for c in ("x", "y")])
    locations = locations.select("loc", "segnum", place.alias("_place"), (F.col("seg_ndist") if "seg_ndist" in locations.columns else F.lit(None).cast("double")).alias("_share"))
    # The edges of a reach are listed once, not for every location of its segment.
    rows = locations.join(spans.withColumn("edges", G.edges(F.col("piece"))).drop("piece"), "segnum")
    known = F.col("_place.x").isNotNull() & F.col("_place.y").isNotNull()
    on = G.let(G.interpolate(F.col("geometry"), F.col("_share")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = rows.withColumn("spot", F.when(known, F.col("_place")).otherwise(on))
    rows = rows.withColumn("dist", F.round(G.distance_to_edges(F.col("edges"), F.col("spot")), 9))
    by = Window.partitionBy("loc").orderBy("dist", F.desc("ridx"))
    return rows.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("loc", "ridx", "k", "i", "j", "iseg", "ireach", F.col("dist").alias("dist_to_reach"))


def diversion_reaches(found: DataFrame, diversions: DataFrame, grid: Grid | None = None, *, end: int = 0) -> DataFrame:
    """Reaches with those of ``diversions(divid, from_segnum [, x, y])`` added after all others, in order of ``divid``.

    Each is a copy of the last reach of its segment, with the sentinel as
    segment, ``segndist`` 0, no length but 1 and no segment numbers; with
    coordinates and a grid it lies in the cell nearest to the point, active
    or not. Those whose segment has no reach are left out. Adds ``diversion``
    and ``divid``.
    """
    own = found.select("*", F.lit(False).alias("diversion"), F.lit(None).cast("long").alias("divid"))
    last = found.groupBy(F.col("segnum").alias("from_segnum")).agg(F.max_by(F.struct("k", "i", "j"), "ridx").alias("cell"))
    rows = diversions.join(last, "from_segnum")
    total = found.agg(F.coalesce(F.max("ridx"), F.lit(0))).first()[0]
    i, j = F.col("cell.i"), F.col("cell.j")
    if grid is not None and {"x", "y"} <= set(diversions.columns):
        # The nearest cell is the one the point is in, or at the edge of the grid.
        clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
        known = F.col("x").isNotNull() & F.col("y").isNotNull()
        place = F.get(grid.to_local(F.array(G.xyz(F.col("x"), F.col("y")))), F.lit(0))
        i = F.when(known, clamp(grid.row_of(place["y"]), grid.nrow)).otherwise(i)
        j = F.when(known, clamp(grid.col_of(place["x"]), grid.ncol)).otherwise(j)
    made = rows.select("divid", F.col("cell.k").alias("k"), i.alias("i"), j.alias("j")).withColumn("one", F.lit(1).cast("long"))
    made = made.join(prefix_sums(made.select("divid", "one"), "divid", "one"), "divid")
    extra = made.select(
        (F.lit(total) + F.col("before") + 1).cast("long").alias("ridx"), F.lit(end).cast("long").alias("segnum"), "k", "i", "j", F.lit(0).alias("iseg"), F.lit(0).alias("ireach"),
        F.lit(0.0).alias("segndist"), F.lit(1.0).alias("rlen"), F.lit(True).alias("diversion"), F.col("divid").cast("long").alias("divid"),
    )
    return own.unionByName(extra, allowMissingColumns=True)
