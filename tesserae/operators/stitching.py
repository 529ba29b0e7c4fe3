"""Stitching of shifted images, inside the row that holds them.

A pair is a row (frame, data, moving) of two images whose shapes and offset are the same for all rows; a mosaic is made of
the four quadrants of one frame. Images are moved and weighted as whole arrays, many rows at once, so a movie is stitched
without a shuffle, and what a task needs is a few canvases.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, movies

Shape = tuple[int, int]
Box = tuple[int, int, int, int]


def split_offset(offset: float) -> tuple[int, float]:
    whole = math.floor(offset)
    return whole, offset - whole


def _moved(image: np.ndarray, fy: float, fx: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stack moved down and to the right by less than a pixel, bilinear, and which of its rows and columns have a source."""
    rows, columns = np.ones(image.shape[1]), np.ones(image.shape[2])
    if fy:
        image = np.concatenate([np.zeros_like(image[:, :1]), (1 - fy) * image[:, 1:] + fy * image[:, :-1]], axis=1)
        rows[0] = 0
    if fx:
        image = np.concatenate([np.zeros_like(image[:, :, :1]), (1 - fx) * image[:, :, 1:] + fx * image[:, :, :-1]], axis=2)
        columns[0] = 0
    return image * rows[:, None] * columns, rows, columns


def shifted(movie: DataFrame, shape: Shape, dy: float, dx: float) -> DataFrame:
    """Frames moved by less than a pixel, bilinear: data, and support. A pixel whose source lies outside has 0 in both."""

    def shift(d: np.ndarray) -> dict[str, np.ndarray]:
        out, rows, columns = _moved(d, dy, dx)
        return {"data": out, "support": np.broadcast_to(rows[:, None] * columns, out.shape)}

    return kernels.per_stack(movie, shift, {"data": shape})


def canvas(reference: Shape, moving: Shape, offset: tuple[float, float]) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1) of the canvas that holds both, in coordinates of the reference."""
    iy, ix = math.floor(offset[0]), math.floor(offset[1])
    return min(0, iy), max(reference[0], iy + moving[0]), min(0, ix), max(reference[1], ix + moving[1])


def _stitch(r: np.ndarray, m: np.ndarray, offset: tuple[float, float], axis: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Canvases of two stacks, and their support; across their overlap averaged (axis None), or by a ramp along an axis."""
    shapes = r.shape[1:], m.shape[1:]
    y0, y1, x0, x1 = canvas(*shapes, offset)
    (iy, fy), (ix, fx) = split_offset(offset[0]), split_offset(offset[1])
    moved, rows, columns = _moved(m, fy, fx)
    here = slice(-y0, shapes[0][0] - y0), slice(-x0, shapes[0][1] - x0)
    there = slice(iy - y0, iy - y0 + shapes[1][0]), slice(ix - x0, ix - x0 + shapes[1][1])
    total, support = np.zeros((len(r), y1 - y0, x1 - x0)), np.zeros((y1 - y0, x1 - x0))
    support[here] += 1
    support[there] += rows[:, None] * columns
    total[:, *here] += r
    total[:, *there] += moved
    total /= np.maximum(support, 1)
    box = overlap_box(shapes, offset) if axis else None
    if box:
        a0, a1, b0, b1 = box
        n, line = (a1 - a0, (slice(None), None)) if axis == "vertical" else (b1 - b0, (None, slice(None)))
        alpha = (np.full(1, 0.5) if n == 1 else 1 - np.arange(n) / (n - 1))[line]
        first = r[:, a0 + y0 : a1 + y0, b0 + x0 : b1 + x0]
        second = moved[:, a0 + y0 - iy : a1 + y0 - iy, b0 + x0 - ix : b1 + x0 - ix]
        total[:, a0:a1, b0:b1] = first * alpha + second * (1 - alpha)
    return total, support


def _rows(pairs: DataFrame, shapes: tuple[Shape, Shape], offset: tuple[float, float], axis: str | None) -> DataFrame:
    def pair(r: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
        total, support = _stitch(r, m, offset, axis)
        return {"data": total, "support": np.broadcast_to(support, total.shape)}

    return kernels.per_stack(pairs, pair, {"data": shapes[0], "moving": shapes[1]})


def averaged(pairs: DataFrame, shapes: tuple[Shape, Shape], offset: tuple[float, float]) -> DataFrame:
    """Both images of each row on one canvas, averaged by support where they overlap; 0 where neither is."""
    return _rows(pairs, shapes, offset, None)


def supported(stitched: DataFrame) -> DataFrame:
    """(frame, y, x, v) of the pixels that any image supports."""
    both = F.zip_with("data", "support", lambda v, s: F.struct(v.alias("v"), s.alias("s")))
    return movies.pixels(stitched.withColumn("data", both)).where("v.s > 0").select("frame", "y", "x", F.col("v.v").alias("v"))


def overlap_box(shapes: tuple[Shape, Shape], offset: tuple[float, float]) -> tuple[int, int, int, int] | None:
    """Half-open box of the canvas where both have support. A fractional shift leaves no support in its first line."""
    y0, _, x0, _ = canvas(*shapes, offset)
    out = []
    for k, low in enumerate((y0, x0)):
        whole, part = split_offset(offset[k])
        a = max(-low, whole - low + (part > 0))
        b = min(-low + shapes[0][k], whole - low + shapes[1][k])
        if b <= a:
            return None
        out += [a, b]
    return tuple(out)


def blended(pairs: DataFrame, shapes: tuple[Shape, Shape], offset: tuple[float, float], axis: str) -> DataFrame:
    """Both images on one canvas; across their overlap the weight goes linearly from the reference to the moving image.

    axis: "vertical" ramps down the rows, "horizontal" along the columns. A ramp of one pixel is a half.
    """
    if axis not in ("vertical", "horizontal"):
        raise ValueError("axis must be vertical or horizontal")
    return _rows(pairs, shapes, offset, axis)


def _cut(image: np.ndarray, box: Box | None) -> np.ndarray:
    return image if box is None else image[:, box[0] : box[1], box[2] : box[3]]


def stitched(movie: DataFrame, shape: Shape, offsets: dict[str, tuple[float, float]], bounds: dict[str, Box | None] | None = None) -> DataFrame:
    """The mosaic of a movie's four quadrants, each turned by 180 degrees: left and right columns, then both; each cropped
    to its bounds. offsets: left, right and final (y, x) of the moving image against the reference.
    """
    bounds = bounds or {}
    if shape[0] % 2 or shape[1] % 2:
        raise ValueError(f"height and width must be even, not {shape[0]} x {shape[1]}")

    def whole(d: np.ndarray) -> dict[str, np.ndarray]:
        quarters = quadrants(d)
        sides = [_cut(_stitch(quarters[0][c], quarters[1][c], offsets[name], "vertical")[0], bounds.get(name)) for c, name in enumerate(("left", "right"))]
        return {"data": _cut(_stitch(*sides, offsets["final"], "horizontal")[0], bounds.get("final"))}

    return kernels.per_stack(movie, whole, {"data": shape})


def quadrants(d: np.ndarray) -> list[list[np.ndarray]]:
    """By row and column, the quarters of a stack, each turned by 180 degrees."""
    h, w = d.shape[1] // 2, d.shape[2] // 2
    return [[d[:, r * h : (r + 1) * h, c * w : (c + 1) * w][:, ::-1, ::-1] for c in (0, 1)] for r in (0, 1)]


def _rectangle(mask: np.ndarray) -> dict:
    """Largest box of true pixels of one image, by the boxes that end in each row; of equal ones the uppermost, then leftmost,
    then flattest. None in an image without a true pixel.
    """
    best, heights = None, np.zeros(mask.shape[1], int)
    for y, row in enumerate(mask != 0):
        heights = np.where(row, heights + 1, 0)
        open_: list[tuple[int, int]] = []  # (first column, height) of boxes that may go on, heights rising
        for x, n in enumerate([*heights.tolist(), 0]):
            first = x
            while open_ and open_[-1][1] >= n:
                first, tall = open_.pop()
                if tall:
                    box = (tall * (x - first), tall - y - 1, -first, -y)
                    best = box if best is None or box > best else best
            open_.append((first, n))
    if best is None:
        return {"y0": None, "y1": None, "x0": None, "x1": None}
    area, y0, x0, y = best[0], -best[1], -best[2], -best[3]
    return {"y0": y0, "y1": y + 1, "x0": x0, "x1": x0 + area // (y + 1 - y0)}


def largest_rectangle(masks: DataFrame) -> DataFrame:
    """(frame, y0, y1, x0, x1): the largest box of pixels other than 0 of each image, found in its row; images without one are left out."""
    found = kernels.per_image(masks, _rectangle, "frame int, y0 int, y1 int, x0 int, x1 int", "data")
    return found.where("y0 is not null")


def crop_bounds(shapes: tuple[Shape, Shape], offset: tuple[float, float], spark) -> Box:
    """The largest box of a stitched pair that the two images fill."""
    ones = [F.array_repeat(F.lit(1.0), h * w) for h, w in shapes]
    pair = spark.range(1).select(F.lit(0).alias("frame"), ones[0].alias("data"), ones[1].alias("moving"))
    filled = averaged(pair, shapes, offset).withColumn("data", F.transform("support", lambda s: (s > 1e-6).cast("float")))
    row = largest_rectangle(filled).first()
    return row.y0, row.y1, row.x0, row.x1


def brightness_ratio(reference: DataFrame, moving: DataFrame) -> DataFrame:
    """(frame, ratio) of the means of two overlapping regions; 1 where the second mean is 0."""
    a, b = (df.groupBy("frame").agg(F.avg(F.col("v").cast("double")).alias(n)) for df, n in ((reference, "a"), (moving, "b")))
    return a.join(b, "frame").select("frame", F.when(F.col("b") == 0, F.lit(1.0)).otherwise(F.col("a") / F.col("b")).alias("ratio"))
