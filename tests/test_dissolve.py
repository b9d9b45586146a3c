"""Outlines of polygons side by side, against a plain version that links sides one by one."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import rewrite


def dissolve(rings: list) -> list:
    """The outline of polygons that lie side by side, rings as lists of ``(x, y)``: sides that two of them share vanish, the rest are linked into rings.

    Sides are cut at vertices of other polygons that lie on them. The longest
    outer ring comes first; holes and further parts follow.
    """
    from collections import defaultdict

    points = sorted({tuple(p) for ring in rings for p in ring})
    count: dict[frozenset, int] = defaultdict(int)
    bins: dict[tuple[int, int], list] = defaultdict(list)
    spans = [max(abs(p[0] - q[0]), abs(p[1] - q[1])) for ring in rings for p, q in zip(ring, ring[1:], strict=False)]
    size = (sum(spans) / len(spans) if spans else 1.0) or 1.0
    for x, y in points:
        bins[int(x // size), int(y // size)].append((x, y))
    for ring in rings:
        for p, q in zip(ring, ring[1:], strict=False):
            p, q = tuple(p), tuple(q)
            dx, dy = q[0] - p[0], q[1] - p[1]
            on = {p, q}
            for bx in range(int(min(p[0], q[0]) // size), int(max(p[0], q[0]) // size) + 1):
                for by in range(int(min(p[1], q[1]) // size), int(max(p[1], q[1]) // size) + 1):
                    for r in bins.get((bx, by), ()):
                        if (r[0] - p[0]) * dy == (r[1] - p[1]) * dx and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1]):
                            on.add(r)
            path = sorted(on, key=lambda r: (r[0] - p[0]) * dx + (r[1] - p[1]) * dy)
            for a, b in zip(path, path[1:], strict=False):
                count[frozenset((a, b))] += 1
    links: dict[tuple, list] = defaultdict(list)
    for side, n in count.items():
        if n % 2 and len(side) == 2:
            a, b = side
            links[a].append(b)
            links[b].append(a)
    out = []
    for start in sorted(links):
        while links[start]:
            ring, at = [start], start
            while True:
                after = min(links[at])
                links[at].remove(after)
                links[after].remove(at)
                ring.append(after)
                at = after
                if at == start or not links[at]:
                    break
            out.append(ring)
    size_of = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))) / 2
    return sorted((r for r in out if len(r) > 3 and r[0] == r[-1]), key=size_of, reverse=True)


def box(x, y, w=1, h=1):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def area(ring):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))) / 2


def patches_of(spark, shapes):
    rows = [(k, [[(float(x), float(y), None) for x, y in ring]], patch) for k, (patch, ring) in enumerate(shapes)]
    frame = spark.createDataFrame(rows, f"segnum long, rings {G.RINGS}, patch long")
    return frame.select("segnum", "rings"), frame.select("segnum", "patch")


def sides_of(rings):
    return {frozenset((tuple(a), tuple(b))) for ring in rings for a, b in zip(ring, ring[1:], strict=False)}


def test_dissolve_equals_plain_version(spark):
    rng = random.Random(8)
    shapes = [(0, box(i, j)) for i in range(4) for j in range(4) if (i, j) not in ((1, 1), (3, 0))] + [(0, box(4, 0.5, 2, 1))]  # a hole, and a side cut by another's corners
    shapes += [(1, box(50, 50))]  # alone
    shapes += [(2, box(0, 20)), (2, box(1, 21))]  # corners that touch
    shapes += [(3, box(i, 30 + j)) for i in range(8) for j in range(8) if rng.random() < 0.7]
    shapes += [(4, [(0, 40), (3, 40), (3, 43), (0, 40)]), (4, [(0, 40), (3, 43), (0, 43), (0, 40)])]
    shapes += [(5, box(i * 0.5, 60 + 2 * (i % 2), 0.5, 2)) for i in range(9)]
    rng.shuffle(shapes)
    got = {r["segnum"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in rewrite.dissolved(*patches_of(spark, shapes)).collect()}
    assert set(got) == {p for p, _ in shapes}
    for patch, rings in got.items():
        plain = dissolve([[(float(x), float(y)) for x, y in ring] for p, ring in shapes if p == patch])
        assert sides_of(rings) == sides_of(plain) and all(r[0] == r[-1] for r in rings)
        assert [area(r) for r in rings] == sorted((area(r) for r in rings), reverse=True)
        assert sum(len(r) - 1 for r in rings) == len(sides_of(rings))  # every side once
    assert area(got[0][0]) - area(got[0][1]) == pytest.approx(16) and len(got[0]) == 2


def test_outline_of_many_boxes(spark):
    """One patch of thousands of boxes leaves its border, as one ring in order."""
    n = 60
    frame = spark.range(n * n).select(F.col("id").alias("segnum"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"))
    corner = lambda a, b: G.xyz(F.col("x") + a, F.col("y") + b, None)
    rings = frame.select("segnum", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("rings"))
    (row,) = rewrite.dissolved(rings, rings.select("segnum", F.lit(7).cast("long").alias("patch"))).collect()
    assert len(row["rings"]) == 1 and len(row["rings"][0]) == 4 * n + 1
    assert area([(p["x"], p["y"]) for p in row["rings"][0]]) == n * n
