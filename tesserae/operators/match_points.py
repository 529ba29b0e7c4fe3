"""Stitching by match points: pairs of pixels (x, y, counted from 1) that show the same spot in two images.

Each image is faded linearly over the overlap and the two are added, as arrays of their row: nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import intervals, kernels, stitching

Point = tuple[tuple[int, int], tuple[int, int]]
Shape = tuple[int, int]


@dataclass(frozen=True)
class Overlap:
    """How two images lie: along the axis `depth` pixels are shared; across it, lines [a, a + n) and [b, b + n) are."""

    axis: str
    depth: int
    a: int
    b: int
    n: int
    shapes: tuple[Shape, Shape]

    @property
    def shape(self) -> Shape:
        k = 0 if self.axis == "y" else 1
        along = self.shapes[0][k] + self.shapes[1][k] - self.depth
        return (along, self.n) if self.axis == "y" else (self.n, along)

    @property
    def seam(self) -> float:
        """Middle of the overlap along the axis."""
        k = 0 if self.axis == "y" else 1
        return self.shapes[0][k] - self.depth + (self.depth - 1) / 2.0


def overlap(axis: str, shapes: tuple[Shape, Shape], point: Point) -> Overlap:
    """axis "x": the second image to the right of the first; "y": below it."""
    (xa, ya), (xb, yb) = point
    (ha, wa), (hb, wb) = shapes
    depth = wa - xa + xb if axis == "x" else ha - ya + yb
    across = yb - ya if axis == "x" else xb - xa
    na, nb = (ha, hb) if axis == "x" else (wa, wb)
    first, last = max(1 - across, 1), min(nb - across, na)
    if not 0 < depth <= (min(wa, wb) if axis == "x" else min(ha, hb)) or last < first:
        raise ValueError("the match point leaves no overlap")
    return Overlap(axis, depth, first - 1, max(1 + across, 1) - 1, last - first + 1, shapes)


def _joined(a: np.ndarray, b: np.ndarray, where: Overlap, match_brightness: bool) -> np.ndarray:
    """Two stacks faded by a ramp over the overlap and added; the ramp is one vector along the axis."""
    if where.axis == "x":
        turned = Overlap("y", where.depth, where.a, where.b, where.n, tuple((w, h) for h, w in where.shapes))
        return _joined(a.transpose(0, 2, 1), b.transpose(0, 2, 1), turned, match_brightness).transpose(0, 2, 1)
    d, after = where.depth, a.shape[1] - where.depth
    a, b = a[:, :, where.a : where.a + where.n], b[:, :, where.b : where.b + where.n]
    ramp = np.full(1, 0.5) if d == 1 else np.arange(d) / (d - 1)
    falling, rising = np.concatenate([np.ones(after), 1 - ramp]), np.concatenate([ramp, np.ones(b.shape[1] - d)])
    weight = np.ones(len(a))
    if match_brightness:
        ours, theirs = a[:, after:].mean(axis=(1, 2)), b[:, :d].mean(axis=(1, 2))
        np.divide(ours, theirs, out=weight, where=theirs != 0)
    out = np.zeros((len(a), *where.shape))
    out[:, : a.shape[1]] += a * falling[:, None]
    out[:, after:] += b * rising[:, None] * weight[:, None, None]
    return out


def pair(pairs: DataFrame, where: Overlap, match_brightness: bool = False) -> DataFrame:
    """(frame, h, w, data): both images of rows (frame, data, moving) faded and added, inside the row.

    With match_brightness the second is scaled to the first by the means of the overlap; it stays where its mean is 0.
    """
    return kernels.per_stack(pairs, lambda a, b: {"data": _joined(a, b, where, match_brightness)}, {"data": where.shapes[0], "moving": where.shapes[1]})


def mosaic(movie: DataFrame, shape: Shape, points: tuple[Point, Point, Point], match_brightness: bool = False) -> DataFrame:
    """(frame, h, w, data): upper quadrants side by side, lower quadrants side by side, then both below each other."""
    if shape[0] % 2 or shape[1] % 2:
        raise ValueError(f"height and width must be even, not {shape[0]} x {shape[1]}")
    quarter = (shape[0] // 2, shape[1] // 2)
    sides = [overlap("x", (quarter, quarter), p) for p in points[:2]]
    both = overlap("y", (sides[0].shape, sides[1].shape), points[2])

    def whole(d: np.ndarray) -> dict[str, np.ndarray]:
        rows = [_joined(*q, where, match_brightness) for q, where in zip(stitching.quadrants(d), sides)]
        return {"data": _joined(*rows, both, match_brightness)}

    return kernels.per_stack(movie, whole, {"data": shape})


def seam_lines(shape: Shape, points: tuple[Point, Point, Point], width: int) -> list[tuple[int, int, int, int]]:
    """Boxes (y0, y1, x0, x1) of the seams in the mosaic: between the rows, and inside the upper and the lower row."""
    if shape[0] % 2 or shape[1] % 2:
        raise ValueError("height and width must be even")
    quarter = (shape[0] // 2, shape[1] // 2)
    top, bottom = (overlap("x", (quarter, quarter), p) for p in points[:2])
    middle = overlap("y", (top.shape, bottom.shape), points[2])
    h, w = middle.shape
    split = max(0, min(int(middle.seam // 1) + 1, h))
    y0, y1 = intervals.stripe_about(middle.seam, h, width)
    a0, a1 = intervals.stripe_about(top.seam - (middle.a + 1), w, width)
    b0, b1 = intervals.stripe_about(bottom.seam - (middle.b + 1), w, width)
    return [b for b in ((y0, y1, 0, w), (0, split, a0, a1), (split, h, b0, b1)) if b[0] < b[1] and b[2] < b[3]]
