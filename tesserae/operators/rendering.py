"""Pictures as tables: colours, overlays, spatial fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

WHITE = (255, 255, 255)


def rgb(gray: DataFrame) -> DataFrame:
    """Gray pixels (frame, y, x, g) as colours."""
    return gray.select("frame", "y", "x", F.col("g").alias("r"), "g", F.col("g").alias("b"))


def narrowed(colour16: DataFrame) -> DataFrame:
    """16-bit colours as bytes, halves to even."""
    return colour16.select("frame", "y", "x", *(F.rint(F.col(c) / 257.0).cast("int").alias(c) for c in "rgb"))


def masked(picture: DataFrame, mask: DataFrame, colour: tuple[int, int, int] = WHITE) -> DataFrame:
    """The picture with the mask's pixels (y, x) in one colour."""
    marked = picture.join(mask.select("y", "x").distinct().withColumn("_m", F.lit(True)), ["y", "x"], "left")
    return marked.select("frame", "y", "x", *(F.when(F.col("_m"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", colour)))


def mask_picture(grid: DataFrame, mask: DataFrame, colour: tuple[int, int, int] = WHITE) -> DataFrame:
    """The mask alone, on black, over the pixels (frame, y, x) of a grid."""
    black = grid.select("frame", "y", "x", *(F.lit(0).alias(c) for c in "rgb"))
    return masked(black, mask, colour)


def overlaid(background: DataFrame, foreground: DataFrame) -> DataFrame:
    """Foreground pixels that are not black, over the background; one background serves all frames of a stack.

    background: (y, x, r, g, b); foreground: (frame, y, x, r, g, b).
    """
    back = background.select("y", "x", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    joined = back.crossJoin(F.broadcast(foreground.select("frame").distinct())).join(foreground, ["frame", "y", "x"], "left")
    shown = (F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)
    return joined.select("frame", "y", "x", *(F.when(shown, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in "rgb"))


def sigmas(spacing: float) -> tuple[float, float, float]:
    """Three widths from the typical spacing of the points, but six pixels at least: once, twice and four times as wide."""
    fine = max(6.0, spacing)
    return fine, 2 * fine, 4 * fine


def distance_to(points: np.ndarray) -> np.ndarray:
    """Exact distance of every pixel to the nearest true one, column by column and then across."""
    h, w = points.shape
    column = np.full((h, w), np.inf)
    for y in range(h):
        column[y] = np.where(points[y], 0, column[y - 1] + 1 if y else np.inf)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    gap = np.abs(np.arange(w)[:, None] - np.arange(w)[None, :]).astype(float) ** 2
    return np.sqrt(np.stack([(row[None, :] ** 2 + gap).min(axis=1) for row in column]))


def spatial_field(points: DataFrame, value: str, shape: tuple[int, int], spacing: float, key: str = "metric") -> DataFrame:
    """(key, h, w, data): a smooth field from scattered values for each key, blended over three widths by the distance to
    the nearest point. Values are summed by pixel first, so a task gets one image for each key, not its points.
    """
    fine, medium, coarse = sigmas(spacing)
    cells = points.groupBy(key, "y", "x").agg(F.sum(F.col(value).cast("double")).alias("total"), F.count("*").alias("n"))
    kind = points.schema[key].dataType.simpleString()

    def field(pdf: pd.DataFrame) -> pd.DataFrame:
        total, count = np.zeros(shape), np.zeros(shape)
        total[pdf["y"], pdf["x"]], count[pdf["y"], pdf["x"]] = pdf["total"], pdf["n"]
        away = distance_to(count > 0)
        near = np.clip(1 - away / max(medium, 1e-6), 0, 1)
        far = np.clip((away - medium) / max(coarse - medium, 1e-6), 0, 1)
        parts = [kernels.regression_field(total, count, s) for s in (fine, medium, coarse)]
        out = near * parts[0] + np.clip(1 - near - far, 0, 1) * parts[1] + far * parts[2]
        return pd.DataFrame([(pdf[key].iloc[0], *shape, out.astype(np.float32).ravel())], columns=[key, "h", "w", "data"])

    return cells.groupBy(key).applyInPandas(field, f"{key} {kind}, h int, w int, data array<float>")
