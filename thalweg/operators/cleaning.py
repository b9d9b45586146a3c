"""What the overlay leaves over: pieces beside the grid, pieces too short to stand alone, pieces of one cell that meet.

All pieces of a segment are stretches of its line, told by distances along it,
so every step here works on a few numbers a segment; the decisions follow one
another within a segment and segments don't depend on each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Places nearer than this are the same place.
CLOSE = 1e-6


@dataclass
class Piece:
    """A stretch of the line and the cell it is given to; ``moved`` ones were not cut there by the overlay."""

    start: float
    stop: float
    cell: tuple[int, int]
    moved: bool = False

    @property
    def length(self) -> float:
        return self.stop - self.start


class Line:
    """Vertices of a line and the distances at which they lie."""

    def __init__(self, xy: np.ndarray):
        self.xy = xy
        self.at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])

    def part(self, start: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Vertices from ``start`` to ``stop``, the ends included, and their distances along the line."""
        eps = 1e-9 * max(1.0, self.at[-1])
        inner = (self.at > start + eps) & (self.at < stop - eps)
        at = np.concatenate([[start], self.at[inner], [stop]])
        return np.stack([np.interp(at, self.at, self.xy[:, k]) for k in (0, 1)], axis=1), at


def box_gap(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Distance of points to a box ``(xmin, xmax, ymin, ymax)``; 0 inside."""
    dx = np.maximum(np.maximum(box[0] - points[:, 0], points[:, 0] - box[1]), 0.0)
    dy = np.maximum(np.maximum(box[2] - points[:, 1], points[:, 1] - box[3]), 0.0)
    return np.hypot(dx, dy)


def point_line_gap(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Least distance of each point to a line of vertices."""
    a, step = line[:-1], np.diff(line, axis=0)
    square = (step**2).sum(axis=1)
    off = points[:, None, :] - a
    t = np.clip(np.divide((off * step).sum(axis=2), square, out=np.zeros(off.shape[:2]), where=square > 0), 0.0, 1.0)
    return np.linalg.norm(off - t[:, :, None] * step, axis=2).min(axis=1)


def crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any edge of one line crosses or touches any of the other."""
    p, r = a[:-1, None, :], np.diff(a, axis=0)[:, None, :]
    q, s = b[None, :-1, :], np.diff(b, axis=0)[None, :, :]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d = cross(r, s)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(q - p, s) / d, cross(q - p, r) / d
    return bool(((d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())


def line_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance between two lines of vertices."""
    if crossing(a, b):
        return 0.0
    return float(min(point_line_gap(a, b).min(), point_line_gap(b, a).min()))


def touches_box(line: np.ndarray, box: tuple[float, float, float, float]) -> bool:
    """Whether a line meets a box, its border included."""
    if (box_gap(line, box) <= CLOSE).any():
        return True
    x0, x1, y0, y1 = box
    return crossing(line, np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]))


def border_spots(line: np.ndarray, box: tuple[float, float, float, float]) -> int:
    """At how many places a line that lies in a box meets its border; -1 if it runs along it."""
    x0, x1, y0, y1 = box
    on = [np.abs(line[:, 0] - x0) <= CLOSE, np.abs(line[:, 0] - x1) <= CLOSE, np.abs(line[:, 1] - y0) <= CLOSE, np.abs(line[:, 1] - y1) <= CLOSE]
    if any((side[:-1] & side[1:]).any() for side in on):
        return -1
    touching = line[np.logical_or.reduce(on) & (box_gap(line, box) <= CLOSE)]
    return len(np.unique(np.round(touching / CLOSE).astype(np.int64), axis=0))


def _halves(line: Line, piece: tuple[float, float], gap_one: np.ndarray, gap_two: np.ndarray, at: np.ndarray) -> float:
    """Where a stretch between two cells is cut: at its last vertex that is nearer to the first, but at an inner vertex."""
    nearer = np.flatnonzero(gap_one < gap_two)
    k = int(nearer[-1]) if len(nearer) else 0
    return float(at[min(max(k, 1), len(at) - 2)])


def _with_middle(line: Line, start: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a stretch; one of two vertices gets a third in the middle."""
    xy, at = line.part(start, stop)
    if len(at) == 2:
        at = np.array([start, (start + stop) / 2, stop])
        xy = np.stack([np.interp(at, line.at, line.xy[:, k]) for k in (0, 1)], axis=1)
    return xy, at


def take_leftovers(line: Line, pieces: list[Piece], active: dict[tuple[int, int], tuple], cell_size: float, reach: float) -> None:
    """Gives stretches beside all active cells to the cell they touch, or to the two: none longer than two cells or farther off than ``reach``."""
    eps = 1e-9 * max(1.0, line.at[-1])
    covered = sorted((p.start, p.stop) for p in pieces)
    gaps, upto = [], 0.0
    for a, b in [*covered, (line.at[-1], line.at[-1])]:
        if a > upto + eps:
            gaps.append((upto, a))
        upto = max(upto, b)
    for start, stop in gaps:
        if stop - start > 2 * cell_size:
            continue
        xy, at = line.part(start, stop)
        near = [cell for cell, box in sorted(active.items()) if touches_box(xy, box)]
        if len(near) == 1:
            if box_gap(xy, active[near[0]]).max() <= reach:
                pieces.append(Piece(start, stop, near[0], True))
        elif len(near) == 2:
            xy, at = _with_middle(line, start, stop)
            if box_gap(xy[:1], active[near[1]])[0] <= CLOSE:
                near.reverse()
            one, two = (box_gap(xy, active[c]) for c in near)
            if np.minimum(one, two).max() > reach:
                continue
            cut = _halves(line, (start, stop), one, two, at)
            pieces += [Piece(start, cut, near[0], True), Piece(cut, stop, near[1], True)]


def move_short(line: Line, pieces: list[Piece], boxes: dict[tuple[int, int], tuple], reach: float) -> None:
    """Gives pieces of at most ``reach`` that only clip a cell to the neighbour they hang on, or to both, shortest first."""
    for piece in sorted((p for p in pieces if p.length < reach), key=lambda p: p.length):
        totals: dict[tuple[int, int], float] = {}
        for p in pieces:
            totals[p.cell] = totals.get(p.cell, 0.0) + p.length
        own = totals[piece.cell]
        if piece.length > reach or own > reach:
            continue
        xy, _ = line.part(piece.start, piece.stop)
        if border_spots(xy, boxes[piece.cell]) not in (1, 2):
            continue
        near = [p for p in pieces if p is not piece and not p.moved and own < totals[p.cell] and line_gap(line.part(p.start, p.stop)[0], xy) < CLOSE]
        if len(near) == 1:
            piece.cell, piece.moved = near[0].cell, True
        elif len(near) == 2:
            xy, at = _with_middle(line, piece.start, piece.stop)
            if point_line_gap(xy[:1], line.part(near[1].start, near[1].stop)[0])[0] < CLOSE:
                near.reverse()
            one, two = (point_line_gap(xy, line.part(p.start, p.stop)[0]) for p in near)
            cut = _halves(line, (piece.start, piece.stop), one, two, at)
            pieces.append(Piece(cut, piece.stop, near[1].cell, True))
            piece.stop, piece.cell, piece.moved = cut, near[0].cell, True


def join_neighbours(line: Line, pieces: list[Piece]) -> list[Piece]:
    """Pieces of one cell that follow one another become one."""
    eps = 1e-9 * max(1.0, line.at[-1])
    out: list[Piece] = []
    for p in sorted(pieces, key=lambda p: (p.start, p.stop)):
        if out and out[-1].cell == p.cell and abs(out[-1].stop - p.start) <= eps:
            out[-1].stop = max(out[-1].stop, p.stop)
        else:
            out.append(Piece(p.start, p.stop, p.cell, p.moved))
    return out


def cleaned(part: pd.DataFrame, cell_size: float) -> pd.DataFrame:
    """One segment: its line, pieces, near cells with their boxes and ``reach``, to its pieces put in order."""
    row = part.iloc[0]
    xy = np.array([(p["x"], p["y"]) for p in row["geometry"]], dtype=float)
    line = Line(xy)
    boxes = {(c["i"], c["j"]): (c["xmin"], c["xmax"], c["ymin"], c["ymax"]) for c in row["cells"]}
    active = {(c["i"], c["j"]) for c in row["cells"] if c["active"]}
    pieces = [Piece(p["start"], p["stop"], (p["i"], p["j"])) for p in row["pieces"]]
    if pieces:
        take_leftovers(line, pieces, {c: b for c, b in boxes.items() if c in active}, cell_size, row["reach"])
    move_short(line, pieces, boxes, row["reach"])
    total = line.at[-1]
    out = [
        (row["segnum"], k + 1, p.cell[0], p.cell[1], p.start, p.stop, p.length, (p.start + p.stop) / 2 / total if total else 0.0)
        for k, p in enumerate(join_neighbours(line, pieces))
    ]
    return pd.DataFrame(out, columns=["segnum", "piece", "i", "j", "start", "stop", "length", "segndist"])
