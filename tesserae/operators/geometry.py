"""Boxes and points as columns: clamping, mirroring, fit windows, alignment offsets.

A box is struct<y0, y1, x0, x1>, half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = tuple[int, int]


def box(y0, y1, x0, x1) -> Column:
    return F.struct(y0.cast("int").alias("y0"), y1.cast("int").alias("y1"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))


def clamped(y0: Column, x0: Column, height: Column, width: Column, shape: Shape, least: int = 8) -> Column:
    """A box of a size, `least` at least and the image at most, moved inside the image; halves round to even."""
    h = F.least(F.greatest(F.rint(height), F.lit(float(least))), F.lit(float(shape[0])))
    w = F.least(F.greatest(F.rint(width), F.lit(float(least))), F.lit(float(shape[1])))
    y = F.least(F.greatest(F.rint(y0), F.lit(0.0)), F.greatest(shape[0] - h, F.lit(0.0)))
    x = F.least(F.greatest(F.rint(x0), F.lit(0.0)), F.greatest(shape[1] - w, F.lit(0.0)))
    return box(y, y + h, x, x + w)


def fit_window(window: Column, shape: Shape) -> Column:
    """A window with its ends in order, four pixels a side at least, inside the map."""
    y, x = F.least(window["y0"], window["y1"]), F.least(window["x0"], window["x1"])
    return clamped(y, x, F.abs(window["y1"] - window["y0"]), F.abs(window["x1"] - window["x0"]), shape, 4)


def window_about(y: Column, x: Column, shape: Shape, radius: int) -> Column:
    """A window of a radius about a point, cut off at the image."""
    r, py, px = max(radius, 1), F.rint(y), F.rint(x)
    zero = F.lit(0.0)
    return box(F.greatest(py - r, zero), F.least(py + r + 1, F.lit(float(shape[0]))), F.greatest(px - r, zero), F.least(px + r + 1, F.lit(float(shape[1]))))


def mirrored(roi: Column, source: Shape, target: Shape, axis: str) -> Column:
    """The box seen from the other side of the seam: turned over top to bottom (vertical) or side to side (horizontal)."""
    y0 = source[0] - roi["y1"] if axis == "vertical" else roi["y0"]
    x0 = source[1] - roi["x1"] if axis == "horizontal" else roi["x0"]
    return clamped(y0, x0, roi["y1"] - roi["y0"], roi["x1"] - roi["x0"], target)


def mirror_pair(reference: Column, moving: Column, shapes: tuple[Shape, Shape], axis: str) -> Column:
    """struct<reference, moving>: the missing box from the other; the reference wins where both are given."""
    held = lambda roi, shape: clamped(roi["y0"], roi["x0"], roi["y1"] - roi["y0"], roi["x1"] - roi["x0"], shape)
    a, b = held(reference, shapes[0]), held(moving, shapes[1])
    first = F.struct(a.alias("reference"), mirrored(a, shapes[0], shapes[1], axis).alias("moving"))
    second = F.struct(mirrored(b, shapes[1], shapes[0], axis).alias("reference"), b.alias("moving"))
    return F.when(reference.isNotNull(), first).when(moving.isNotNull(), second)


def in_roi(y: Column, x: Column, roi: Column) -> Column:
    """Inside the box with its border; no box holds nothing."""
    inside = (x >= roi["x0"]) & (x <= roi["x1"]) & (y >= roi["y0"]) & (y <= roi["y1"])
    return F.coalesce(inside, F.lit(False))


def in_window(y: Column, x: Column, window: Column) -> Column:
    return (y >= window["y0"]) & (y < window["y1"]) & (x >= window["x0"]) & (x < window["x1"])


def half_extents(major: Column, minor: Column, angle: Column, scale: float) -> Column:
    """struct<h, w>: half height and width of a turned ellipse (angle in degrees)."""
    a, b, t = F.greatest(major * scale, F.lit(1e-6)), F.greatest(minor * scale, F.lit(1e-6)), F.radians(angle)
    w = F.sqrt((a * F.cos(t)) ** 2 + (b * F.sin(t)) ** 2)
    h = F.sqrt((a * F.sin(t)) ** 2 + (b * F.cos(t)) ** 2)
    return F.struct(h.alias("h"), w.alias("w"))


def ellipse_fits(y: Column, x: Column, extents: Column, shape: Shape) -> Column:
    return (y - extents["h"] >= 0) & (y + extents["h"] <= shape[0] - 1) & (x - extents["w"] >= 0) & (x + extents["w"] <= shape[1] - 1)


def common_crop(reference: Column, moving: Column) -> Column:
    """struct<h, w, ry, rx, my, mx>: the common size of two patches (struct<h, w>) and where it starts in the middle of each."""
    h, w = F.least(reference["h"], moving["h"]), F.least(reference["w"], moving["w"])
    mid = lambda size, part: F.floor((size - part) / 2).cast("int")
    starts = {"ry": mid(reference["h"], h), "rx": mid(reference["w"], w), "my": mid(moving["h"], h), "mx": mid(moving["w"], w)}
    return F.struct(h.alias("h"), w.alias("w"), *(c.alias(n) for n, c in starts.items()))


def final_offset(base: Column, centre_y: Column, centre_x: Column, map_shape: Shape, reference: Shape, axis: str) -> Column:
    """struct<offset_y, offset_x, shift_y, shift_x>: base offset plus the fitted peak's distance from the middle of the map;
    the shift is against images that just touch along the axis.
    """
    y, x = base["y"] + (centre_y - map_shape[0] // 2), base["x"] + (centre_x - map_shape[1] // 2)
    dy, dx = (y - reference[0], x) if axis == "vertical" else (y, x - reference[1])
    return F.struct(y.alias("offset_y"), x.alias("offset_x"), dy.alias("shift_y"), dx.alias("shift_x"))
