"""Frames and images: scaling, contrast, cropping, projections.

A movie has a row for each frame (frame, h, w, data: row-major pixels). What looks at one frame stays inside its row, with
array functions and no shuffle; what looks across frames groups exploded pixels, which Spark sums before it shuffles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import kernels


def pixels(movie: DataFrame) -> DataFrame:
    """(frame, y, x, v) of every pixel."""
    return movie.select("frame", "w", F.posexplode("data").alias("i", "v")).select(
        "frame", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v"
    )


def movie_of(pixel: DataFrame) -> DataFrame:
    """Rows of frames from pixels; their frame must be full."""
    one = F.struct("y", "x", F.col("v").cast("float").alias("v"))
    rows = pixel.groupBy("frame").agg(F.sort_array(F.collect_list(one)).alias("p"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return rows.select("frame", "h", "w", F.col("p.v").alias("data"))


def value_range(movie: DataFrame) -> DataFrame:
    """One row (least, most) over all pixels that are no NaN: partial by frame, then final."""
    real = F.filter("data", lambda v: ~F.isnan(v))
    return movie.agg(F.min(F.array_min(real)).alias("least"), F.max(F.array_max(real)).alias("most"))


def normalize(movie: DataFrame) -> DataFrame:
    """All pixels scaled to 0..1 by the movie's range; zeros if it has none. The range is one row, whatever the movie."""
    joined = movie.crossJoin(F.broadcast(value_range(movie)))
    span = F.col("most") - F.col("least")
    data = F.transform("data", lambda v: F.when(span > 0, (v - F.col("least")) / span).otherwise(F.lit(0.0)).cast("float"))
    return joined.select("frame", "h", "w", data.alias("data"))


def scaled_image(movie: DataFrame) -> DataFrame:
    """Each frame scaled to 0..1 by its own range; zeros if it has none."""
    low, high = F.array_min("data"), F.array_max("data")
    data = F.transform("data", lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0)).cast("float"))
    return movie.select("frame", "h", "w", data.alias("data"))


def _limits(low, high) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def _between(movie: DataFrame, limits: Column, pixel) -> DataFrame:
    """Each frame's pixels by pixel(v, limits); the frame's limits are found once, not for every pixel."""
    return movie.select("frame", "h", "w", arrays.bound(limits, lambda s: F.transform("data", lambda v: pixel(v, s))).alias("data"))


def _unit(v: Column, low: Column, span: Column) -> Column:
    return F.greatest(F.least((v.cast("double") - low) / span, F.lit(1.0)), F.lit(0.0))


def clipped(movie: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    """Each frame held between two of its percentiles."""
    limits = _limits(*arrays.percentiles(F.col("data"), low / 100, high / 100))
    return _between(movie, limits, lambda v, s: F.greatest(F.least(v.cast("double"), s["high"]), s["low"]))


def percentile_view(movie: DataFrame, low: float = 1, high: float = 99.5) -> DataFrame:
    """Each frame mapped to 0..1 between two of its percentiles."""
    limits = _limits(*arrays.percentiles(F.col("data"), low / 100, high / 100))
    return _between(movie, limits, lambda v, s: _unit(v, s["low"], F.greatest(s["high"] - s["low"], F.lit(1e-6))))


def gray_levels(movie: DataFrame, low: float = 1, high: float = 99, cut: bool = True) -> DataFrame:
    """Bytes between two percentiles of the finite pixels; fractions cut off, or rounded half to even. No range: one is made."""

    def level(v: Column, s: Column) -> Column:
        span = F.when(s["high"] > s["low"], s["high"] - s["low"]).otherwise(F.lit(1.0))
        return F.when(arrays.finite(v), (F.floor if cut else F.rint)(_unit(v, s["low"], span) * 255.0)).otherwise(F.lit(0)).cast("int")

    return _between(movie, _limits(*arrays.percentiles(F.filter("data", arrays.finite), low / 100, high / 100)), level)


def saturated_levels(movie: DataFrame, saturated: float = 0.35) -> DataFrame:
    """Bytes with a share (per cent) saturated at each end; falls back to the range, then to zeros."""
    good = F.filter("data", arrays.finite)
    inner, whole = _limits(*arrays.percentiles(good, saturated / 100, 1 - saturated / 100)), _limits(F.array_min(good).cast("double"), F.array_max(good).cast("double"))
    limits = arrays.bound(inner, lambda s: F.when(s["high"] > s["low"], s).otherwise(whole))
    return _between(movie, limits, _byte)


def _byte(v: Column, s: Column) -> Column:
    """0..255 between limits, rounded half to even; 0 for what is not finite, and without a range."""
    return F.when(arrays.finite(v) & (s["high"] > s["low"]), F.rint(_unit(v, s["low"], s["high"] - s["low"]) * 255.0)).otherwise(F.lit(0)).cast("int")


def _automatic(image: np.ndarray) -> dict:
    """Limits of one image: bins of a 256-bin histogram with over a tenth of the pixels don't count; the first and last
    with over a 5000th part bound the range. Without such a bin the search ends at the far side: 255 from below, 0 from above.
    """
    v = image[np.isfinite(image)]
    if not v.size:
        return {"low": None, "high": None}
    a, b = float(v.min()), float(v.max())
    first, last, step = 255, 0, (b - a) / 256.0
    if b > a:
        n = np.bincount(np.minimum(np.floor((v - a) * (256 / (b - a))), 255).astype(int), minlength=256)
        good = np.flatnonzero((n <= v.size // 10) & (n > v.size // 5000))
        first, last = (int(good[0]), int(good[-1])) if good.size else (first, last)
    low, high = a + first * step, a + last * step
    return {"low": low, "high": high} if high > low else {"low": a, "high": b}


def display_range(movie: DataFrame) -> DataFrame:
    """(frame, low, high): the automatic display range of each frame, in its row; null without finite pixels."""
    return kernels.per_image(movie, _automatic, "frame int, low double, high double", "data")


def display_bytes(movie: DataFrame) -> DataFrame:
    """Bytes of each frame over its automatic display range; all 0 without a range."""

    def kernel(image: np.ndarray) -> dict:
        ends, out = _automatic(image), np.zeros(image.shape)
        if ends["low"] is not None and ends["high"] > ends["low"]:
            good = np.isfinite(image)
            unit = np.clip((image[good] - ends["low"]) / (ends["high"] - ends["low"]), 0, 1)
            out[good] = np.rint(unit * 255.0)
        return {"h": image.shape[0], "w": image.shape[1], "data": out.astype(np.int32).ravel()}

    return kernels.per_image(movie, kernel, "frame int, h int, w int, data array<int>", "data")


def peaks(movie: DataFrame) -> DataFrame:
    """(frame, y, x, v): the greatest pixel of each frame, the first of equal ones."""
    top = F.struct(F.array_max("data").alias("v"))
    at = arrays.bound(top, lambda s: F.struct(s["v"].alias("v"), (F.array_position("data", s["v"]) - 1).alias("i")))
    rows = movie.select("frame", "w", at.alias("m"))
    return rows.select("frame", F.expr("m.i div w").cast("int").alias("y"), (F.col("m.i") % F.col("w")).cast("int").alias("x"), F.col("m.v").alias("v"))


def _ends(data: Column) -> Column:
    good = F.filter(data, arrays.finite)
    low, high = F.array_min(good).cast("double"), F.array_max(good).cast("double")
    return F.struct(low.alias("low"), F.when(high > low, high).otherwise(low + 1e-6).alias("high"))


def display_limits(movie: DataFrame) -> DataFrame:
    """(frame, low, high): the finite range, never empty."""
    return movie.select("frame", _ends(F.col("data")).alias("m")).select("frame", "m.*")


def joint_limits(pairs: DataFrame, other: str = "moving") -> DataFrame:
    """(frame, low, high): display limits that serve two images of a row alike: the lower low and the higher high."""
    one, two = _ends(F.col("data")), _ends(F.col(other))
    return pairs.select("frame", F.least(one["low"], two["low"]).alias("low"), F.greatest(one["high"], two["high"]).alias("high"))


def frames_between(movie: DataFrame, start: int, end: int, whole: str = "below one") -> DataFrame:
    """Frames [start, end). Every end below one means all, or only -1 does (whole="minus one"); an empty range fails."""
    everything = end < 1 if whole == "below one" else end == -1
    if not everything and end <= start:
        raise ValueError(f"empty frame range [{start}, {end})")
    kept = movie.where(F.col("frame") >= start)
    return kept if everything else kept.where(F.col("frame") < end)


def cropped(pixel: DataFrame, box: tuple[int, int, int, int] | None) -> DataFrame:
    """Pixels of the half-open box (y0, y1, x0, x1), counted from its corner; no box: all."""
    if box is None:
        return pixel
    y0, y1, x0, x1 = box
    inside = pixel.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return inside.withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def quadrants(pixel: DataFrame, h: int, w: int) -> DataFrame:
    """Each quadrant turned by 180 degrees: quadrant_row and quadrant_col beside its own y and x."""
    if h % 2 or w % 2:
        raise ValueError(f"height and width must be even, not {h} x {w}")
    hh, hw = h // 2, w // 2
    return pixel.withColumns(
        {
            "quadrant_row": F.expr(f"y div {hh}").cast("int"),
            "quadrant_col": F.expr(f"x div {hw}").cast("int"),
            "y": hh - 1 - F.col("y") % hh,
            "x": hw - 1 - F.col("x") % hw,
        }
    )


def resized(pixel: DataFrame, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize: target row i takes source row min(i * h div h', h - 1); columns alike."""
    (h, w), (th, tw) = shape, target
    spark = pixel.sparkSession
    rows = spark.range(th).select(F.col("id").cast("int").alias("ty"), F.least(F.expr(f"id * {h} div {th}"), F.lit(h - 1)).cast("int").alias("y"))
    columns = spark.range(tw).select(F.col("id").cast("int").alias("tx"), F.least(F.expr(f"id * {w} div {tw}"), F.lit(w - 1)).cast("int").alias("x"))
    out = pixel.join(F.broadcast(rows), "y").join(F.broadcast(columns), "x")  # as long as the target's sides
    return out.select("frame", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def mirrored_index(i: Column, offset: int, n: int) -> Column:
    """Source index of position i when an axis of n is mirrored on both sides of `offset`."""
    m = F.pmod(i - offset, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def projection_sum(movie: DataFrame) -> DataFrame:
    """(y, x, v): the sum over time of every pixel, in double precision."""
    return pixels(movie).groupBy("y", "x").agg(F.sum(F.col("v").cast("double")).alias("v"))


def projection_stats(movie: DataFrame) -> DataFrame:
    """(y, x, mean, std): over time, population deviation from sums in which squares are rounded to single precision."""
    v = F.col("v").cast("double")
    square = (F.col("v").cast("float") * F.col("v").cast("float")).cast("double")
    sums = pixels(movie).groupBy("y", "x").agg(F.avg(v).alias("mean"), F.avg(square).alias("square"))
    return sums.select("y", "x", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def shape(movie: DataFrame) -> DataFrame:
    """One row: frames, h, w, read without pixels."""
    return movie.agg(F.count("*").alias("frames"), F.max("h").alias("h"), F.max("w").alias("w"))
