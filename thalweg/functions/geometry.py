"""Geometry as Column expressions over ``array<struct<x, y, z>>``; lengths and distances are two-dimensional, Z rides along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"
LINE = f"array<{POINT}>"
RINGS = f"array<{LINE}>"


def xyz(x, y, z=None) -> Column:
    """One vertex; a null Z means two dimensions."""
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def from_wkt(text: Column) -> Column:
    """Vertices of a POINT or LINESTRING in well-known text, Z or not; EMPTY gives an empty array."""
    inner = F.regexp_extract(text, r"\(([^()]*)\)", 1)
    rows = F.when(F.upper(text).rlike(r"EMPTY\s*$") | text.isNull(), F.array().cast("array<string>")).otherwise(F.split(inner, r"\s*,\s*"))
    return F.transform(F.transform(rows, lambda v: F.split(F.trim(v), r"\s+")), lambda p: xyz(p[0], p[1], F.get(p, F.lit(2))))


def rings_from_wkt(text: Column) -> Column:
    """Rings of a POLYGON in well-known text."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: xyz(p[0], p[1], F.get(p, F.lit(2)))
    return F.transform(rings, lambda r: F.transform(F.transform(F.split(r, r"\s*,\s*"), lambda v: F.split(F.trim(v), r"\s+")), point))


def to_wkt(line: Column) -> Column:
    """LINESTRING text, with Z where the first vertex has one."""
    has_z = first(line)["z"].isNotNull()
    body = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))), ", ")
    return F.when(F.size(line) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.when(has_z, F.lit("LINESTRING Z (")).otherwise(F.lit("LINESTRING (")), body, F.lit(")")))


def first(line: Column) -> Column:
    return F.get(line, F.lit(0))


def last(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def gap(a: Column, b: Column) -> Column:
    """Distance between two points."""
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def edges(line: Column) -> Column:
    """Consecutive vertices as ``array<struct<a, b>>``."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: as the variable of a lambda it isn't written out again wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda acc, e: acc + gap(e["a"], e["b"]))


def measured(line: Column) -> Column:
    """Edges with the distance at which each begins and its length: ``array<struct<a, b, at, len>>``."""
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast(f"array<struct<a:{POINT},b:{POINT},at:double,len:double>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(
            (acc["at"] + gap(e["a"], e["b"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(e["a"].alias("a"), e["b"].alias("b"), acc["at"].alias("at"), gap(e["a"], e["b"]).alias("len")))).alias("out"),
        )

    return F.aggregate(edges(line), start, step, lambda acc: acc["out"])


def along(e: Column, t: Column) -> Column:
    """The point a share ``t`` of the way along an edge, Z included."""
    return F.struct(
        (e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * t).alias("x"), (e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t).alias("y"), (e["a"]["z"] + (e["b"]["z"] - e["a"]["z"]) * t).alias("z")
    )


def _edge_share(e: Column, p: Column) -> Column:
    """Where on an edge, from 0 to 1, a point is nearest."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    square = dx * dx + dy * dy
    t = ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / square
    return F.when(square > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def project(line: Column, point: Column) -> Column:
    """Nearest place of a line to a point: ``struct<dist, at, ndist>``, distance to it, distance along, and the latter as a share of the length.

    The first edge wins ties. Null for a line without an edge.
    """
    spot = lambda e, t: F.struct(gap(along(e, t), point).alias("dist"), (e["at"] + e["len"] * t).alias("at"))
    best = lambda parts: F.array_min(F.transform(parts, lambda e: let(_edge_share(e, point), lambda t: spot(e, t))))
    return let(measured(line), lambda parts: let(best(parts), lambda b: F.struct(b["dist"].alias("dist"), b["at"].alias("at"), (b["at"] / _total(parts)).alias("ndist"))))


def distance_to_edges(every: Column, point: Column) -> Column:
    """Distance of a point to the nearest of ``edges``, as ``project`` has it; null without an edge."""
    return F.array_min(F.transform(every, lambda e: let(_edge_share(e, point), lambda t: gap(along(e, t), point))))


def _total(parts: Column) -> Column:
    """The length of a measured line."""
    return let(last(parts), lambda e: F.coalesce(e["at"] + e["len"], F.lit(0.0)))


def _placed(line: Column, parts: Column, want: Column) -> Column:
    """The point at a distance along a measured line, its last beyond its end."""
    hit = F.get(F.filter(parts, lambda e: (e["len"] > 0) & (e["at"] + e["len"] >= want)), F.lit(0))
    return let(hit, lambda h: F.when(h.isNull(), last(line)).otherwise(along(h, (want - h["at"]) / h["len"])))


def _inside(share: Column) -> Column:
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def interpolate(line: Column, share: Column) -> Column:
    """The point at a share of the length, Z carried along; ends beyond 0 and 1."""
    return let(measured(line), lambda parts: let(_inside(share) * _total(parts), lambda want: _placed(line, parts, want)))


def substring(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two shares of its length, with the vertices between; equal shares give one point twice dropped to one."""
    def cut(parts: Column, w: Column) -> Column:
        inner = F.transform(F.filter(parts, lambda e: (e["at"] + e["len"] > w["a"] * w["total"]) & (e["at"] + e["len"] < w["b"] * w["total"])), lambda e: e["b"])
        point = lambda share: F.array(let(_inside(share) * w["total"], lambda want: _placed(line, parts, want)))
        return F.when(w["a"] >= w["b"], point(w["a"])).otherwise(F.concat(point(w["a"]), inner, point(w["b"])))

    wanted = lambda parts: F.struct(start.alias("a"), end.alias("b"), _total(parts).alias("total"))
    return let(measured(line), lambda parts: let(wanted(parts), lambda w: cut(parts, w)))


def bias_substring(line: Column, bias: float, end_cut: float = 1e-10) -> Column:
    """A line shortened for matching: a positive bias cuts the downstream end, another the upstream one; Z is dropped."""
    if not -1 <= bias <= 1:
        raise ValueError("downstream_bias must be between -1 and 1")
    low, high = (0.0, 1.0 - bias) if bias > 0 else (-bias, 1.0)
    low, high = (min(max(v, end_cut), 1.0 - end_cut) for v in (low, high))
    return force_2d(substring(line, F.lit(low), F.lit(high)))


def force_2d(line: Column) -> Column:
    return F.transform(line, lambda p: xyz(p["x"], p["y"], None))


def round_coords(line: Column, digits: int = 3) -> Column:
    return F.transform(line, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"), F.round(p["z"], digits).alias("z")))


def z_coords(line: Column) -> Column:
    return F.transform(F.filter(line, lambda p: p["z"].isNotNull()), lambda p: p["z"])


def ring_area(ring: Column) -> Column:
    """Shoelace area of one closed ring."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(rings: Column) -> Column:
    """Area of a polygon: its first ring less its holes."""
    sizes = F.transform(rings, ring_area)
    return F.when(F.size(rings) > 0, 2 * F.element_at(sizes, 1) - F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)


def contains(rings: Column, p: Column) -> Column:
    """Whether a point is in a polygon or on its border."""
    def held(every: Column) -> Column:
        crosses = F.aggregate(
            every, F.lit(0),
            lambda acc, e: acc + F.when(((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]), 1).otherwise(0),
        )
        return (crosses % 2 == 1) | F.exists(every, lambda e: _on(e, p))

    return let(ring_edges(rings), held)


def touches_middle(line: Column, p: Column) -> Column:
    """Whether a point lies on a line, exactly, by cross product and box of an edge."""
    def on(e: Column) -> Column:
        cross = (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])
        return (
            (cross == 0) & (p["x"] >= F.least(e["a"]["x"], e["b"]["x"])) & (p["x"] <= F.greatest(e["a"]["x"], e["b"]["x"]))
            & (p["y"] >= F.least(e["a"]["y"], e["b"]["y"])) & (p["y"] <= F.greatest(e["a"]["y"], e["b"]["y"]))
        )

    return F.exists(edges(line), on)


def merge_lines(lines: Column) -> Column:
    """Lines in flow order as one line, each repeated joint once."""
    return F.aggregate(
        lines, F.array().cast(LINE),
        lambda acc, x: F.concat(acc, F.when((F.size(acc) > 0) & (last(acc)["x"] == first(x)["x"]) & (last(acc)["y"] == first(x)["y"]), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)),
    )


def ring_edges(rings: Column) -> Column:
    """The edges of all rings of a polygon."""
    return F.flatten(F.transform(rings, edges))


def _sides(e: Column, p: Column) -> Column:
    """On which side of an edge a point lies: the sign of the cross product."""
    return F.signum((e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"]))


def edges_meet(e: Column, f: Column) -> Column:
    """Whether two edges cross or touch."""
    apart = (F.greatest(e["a"]["x"], e["b"]["x"]) < F.least(f["a"]["x"], f["b"]["x"])) | (F.greatest(f["a"]["x"], f["b"]["x"]) < F.least(e["a"]["x"], e["b"]["x"]))
    apart = apart | (F.greatest(e["a"]["y"], e["b"]["y"]) < F.least(f["a"]["y"], f["b"]["y"])) | (F.greatest(f["a"]["y"], f["b"]["y"]) < F.least(e["a"]["y"], e["b"]["y"]))
    return ~apart & (_sides(e, f["a"]) * _sides(e, f["b"]) <= 0) & (_sides(f, e["a"]) * _sides(f, e["b"]) <= 0)


def _any_meet(some: Column, others: Column) -> Column:
    return let(others, lambda o: F.exists(some, lambda e: F.exists(o, lambda f: edges_meet(e, f))))


def lines_meet(a: Column, b: Column) -> Column:
    return _any_meet(edges(a), edges(b))


def line_meets_polygon(line: Column, rings: Column) -> Column:
    """Whether a line crosses, touches or lies in a polygon."""
    return contains(rings, first(line)) | _any_meet(edges(line), ring_edges(rings))


def polygons_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: their borders meet or one holds the other."""
    return contains(b, first(F.get(a, F.lit(0)))) | contains(a, first(F.get(b, F.lit(0)))) | _any_meet(ring_edges(a), ring_edges(b))


def _edge_spots(p: Column, others: Column) -> Column:
    """For a point the distance to and the nearest point of each edge, as ``array<struct<dist, x, y>>``."""
    def spot(f: Column) -> Column:
        return let(along(f, _edge_share(f, p)), lambda q: F.struct(gap(q, p).alias("dist"), q["x"].alias("x"), q["y"].alias("y")))

    return F.transform(others, spot)


def _vertices(parts: Column) -> Column:
    """Both ends of all edges."""
    return F.flatten(F.transform(parts, lambda e: F.array(e["a"], e["b"])))


def edges_distance(a: Column, b: Column) -> Column:
    """Least distance between two sets of edges, 0 where any meet."""
    near = lambda some, others: F.array_min(F.transform(_vertices(some), lambda p: F.array_min(F.transform(_edge_spots(p, others), lambda s: s["dist"]))))
    return let(a, lambda x: let(b, lambda y: F.when(_any_meet(x, y), 0.0).otherwise(F.least(near(x, y), near(y, x)))))


def lines_distance(a: Column, b: Column) -> Column:
    """Least distance between two lines."""
    return edges_distance(edges(a), edges(b))


def line_polygon_distance(line: Column, rings: Column) -> Column:
    """Least distance between a line and a polygon, 0 where they meet."""
    return F.when(contains(rings, first(line)), 0.0).otherwise(edges_distance(edges(line), ring_edges(rings)))


def point_polygon_distance(point: Column, rings: Column) -> Column:
    return F.when(contains(rings, point), 0.0).otherwise(F.array_min(F.transform(_edge_spots(point, ring_edges(rings)), lambda s: s["dist"])))


def crossing_point(e: Column, f: Column) -> Column:
    """Where two edges that meet do so: the crossing, or for edges in one line an end that both have."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
    d = dx * fy - dy * fx
    t = ((f["a"]["x"] - e["a"]["x"]) * fy - (f["a"]["y"] - e["a"]["y"]) * fx) / F.nullif(d, F.lit(0.0))
    shared = F.when(_on(e, f["a"]), f["a"]).when(_on(e, f["b"]), f["b"]).otherwise(e["a"])
    return F.when(d != 0, xyz(e["a"]["x"] + t * dx, e["a"]["y"] + t * dy)).otherwise(xyz(shared["x"], shared["y"]))


def _on(e: Column, p: Column) -> Column:
    return let(along(e, _edge_share(e, p)), lambda q: gap(q, p)) == 0


def nearest_point(of: Column, to: Column) -> Column:
    """The point of the edges ``of`` that is nearest to the edges ``to``; the first crossing where they meet."""
    def between(a: Column, b: Column) -> Column:
        hits = F.flatten(F.transform(a, lambda e: F.transform(F.filter(b, lambda f: edges_meet(e, f)), lambda f: crossing_point(e, f))))
        own = F.transform(_vertices(a), lambda p: F.struct(F.array_min(F.transform(_edge_spots(p, b), lambda s: s["dist"])).alias("dist"), p["x"].alias("x"), p["y"].alias("y")))
        cast = F.transform(_vertices(b), lambda p: F.array_min(_edge_spots(p, a)))
        apart = let(F.array_min(F.concat(own, cast)), lambda s: xyz(s["x"], s["y"]))
        return let(F.get(hits, F.lit(0)), lambda h: F.when(h.isNotNull(), h).otherwise(apart))

    return let(of, lambda a: let(to, lambda b: between(a, b)))


def length_inside(line: Column, rings: Column) -> Column:
    """Length of the parts of a line that lie in a polygon: each edge is cut where it meets the border, and parts count whose middle is inside."""
    def cuts(border: Column, e: Column) -> Column:
        at = F.transform(F.filter(border, lambda f: edges_meet(e, f)), lambda f: let(crossing_point(e, f), lambda p: _edge_share(e, p)))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), at)))

    def parts(e: Column, c: Column) -> Column:
        inner = lambda a, b: let(along(e, (a + b) / 2), lambda p: F.when(contains(rings, p), b - a).otherwise(0.0))
        return F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), inner), F.lit(0.0), lambda acc, v: acc + v) * gap(e["a"], e["b"])

    inside = lambda border: F.aggregate(edges(line), F.lit(0.0), lambda acc, e: acc + let(cuts(border, e), lambda c: parts(e, c)))
    return let(ring_edges(rings), inside)


def shared_area(a: list, b: list) -> float:
    """Area that two polygons share, rings as lists of ``(x, y)``.

    The plane is cut into upright strips at every vertex and crossing; within
    a strip the borders don't cross, so the area there is its width times the
    length that both polygons cover on its middle line.
    """
    import numpy as np

    def sides(rings: list) -> np.ndarray:
        rows = [(*p, *q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)]
        return np.array(rows, dtype=float).reshape(-1, 4)

    one, two = sides(a), sides(b)
    if not len(one) or not len(two):
        return 0.0
    xs = [*one[:, 0], *two[:, 0]]
    for x1, y1, x2, y2 in one.tolist():
        d = (x2 - x1) * (two[:, 3] - two[:, 1]) - (y2 - y1) * (two[:, 2] - two[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((two[:, 0] - x1) * (two[:, 3] - two[:, 1]) - (two[:, 1] - y1) * (two[:, 2] - two[:, 0])) / d
            u = ((two[:, 0] - x1) * (y2 - y1) - (two[:, 1] - y1) * (x2 - x1)) / d
        hit = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        xs += (x1 + t[hit] * (x2 - x1)).tolist()
    cuts = np.unique(xs)

    def covered(rows: np.ndarray, x: float) -> list[tuple[float, float]]:
        over = rows[(np.minimum(rows[:, 0], rows[:, 2]) < x) & (np.maximum(rows[:, 0], rows[:, 2]) > x)]
        ys = np.sort(over[:, 1] + (x - over[:, 0]) / (over[:, 2] - over[:, 0]) * (over[:, 3] - over[:, 1]))
        return list(zip(ys[::2].tolist(), ys[1::2].tolist(), strict=False))

    total = 0.0
    for x0, x1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mid = (x0 + x1) / 2
        both = sum(max(0.0, min(b1, d1) - max(b0, d0)) for b0, b1 in covered(one, mid) for d0, d1 in covered(two, mid))
        total += both * (x1 - x0)
    return total
