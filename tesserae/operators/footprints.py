"""Sparse footprints and traces: products as joins and sums, overlaps, peaks, outlines, model joins.

A footprint row is (patch, k, p, w) with p counted down the columns: y = p % h, x = p div h.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import durable
from . import alike, products, selection


def core_pixels(footprint: DataFrame, patches: DataFrame) -> DataFrame:
    """(patch, k, y, x, w) of the core area in mosaic coordinates.

    patches: name, h, w of the padded patch, and its core y0, y1, x0, x1; padding is half of what h and w exceed the core.
    """
    specs = patches.select(F.col("name").alias("patch"), "h", "y0", "y1", "x0", "x1", F.expr("(h - (y1 - y0)) div 2").alias("_py"), F.expr("(w - (x1 - x0)) div 2").alias("_px"))
    joined = footprint.join(specs, "patch")
    y, x = F.col("p") % F.col("h") - F.col("_py") + F.col("y0"), F.expr("p div h") - F.col("_px") + F.col("x0")
    out = joined.select("patch", "k", y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("w").cast("double").alias("w"), "y0", "y1", "x0", "x1")
    return out.where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("y0", "y1", "x0", "x1")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the left side without a partner; a total join has none."""
    return left.join(right, on, "left_anti")


def models_with_profiles(models: DataFrame, profiles: DataFrame, on: list[str]) -> DataFrame:
    """Models whose profile exists; the others are passed over."""
    return models.join(profiles.select(*on).distinct(), on, "left_semi")


def bad_padding(patches: DataFrame) -> DataFrame:
    """Patches whose dimensions exceed their core by less than nothing or by an odd number."""
    dy, dx = F.col("h") - (F.col("y1") - F.col("y0")), F.col("w") - (F.col("x1") - F.col("x0"))
    return patches.where((dy < 0) | (dx < 0) | (dy % 2 != 0) | (dx % 2 != 0))


def summed_traces(traces: DataFrame, residual: bool = False) -> DataFrame:
    """(patch, k, s): each trace summed over time, with its residual if asked for; a missing residual is zeros."""
    total = F.aggregate("c", F.lit(0.0), lambda s, v: s + v.cast("double"))
    if residual:
        total = total + F.coalesce(F.aggregate("yra", F.lit(0.0), lambda s, v: s + v.cast("double")), F.lit(0.0))
    return traces.select("patch", "k", total.alias("s"))


def product_image(footprint: DataFrame, traces: DataFrame, keep: DataFrame | None = None, residual: bool = False) -> DataFrame:
    """(patch, p, v): footprints times the traces' sums: time is summed first, so nothing is joined by frame."""
    sums = summed_traces(traces, residual)
    if keep is not None:
        sums = sums.join(keep, ["patch", "k"], "left_semi")
    return footprint.join(sums, ["patch", "k"]).groupBy("patch", "p").agg(F.sum(F.col("w").cast("double") * F.col("s")).alias("v"))


def product_movie(footprint: DataFrame, traces: DataFrame, keep: DataFrame | None = None, residual: bool = False) -> DataFrame:
    """(patch, p, t, v): footprints times traces, by frame."""
    series = F.col("c")
    if residual:
        rest = F.coalesce(F.col("yra"), F.transform("c", lambda v: F.lit(0.0).cast("float")))
        series = F.zip_with("c", rest, lambda a, b: a.cast("double") + b.cast("double"))
    if keep is not None:
        traces = traces.join(keep, ["patch", "k"], "left_semi")
    return products.of_traces(footprint.withColumnRenamed("k", "q"), traces.select("patch", F.col("k").alias("q"), series.alias("series")))


def ring_background(pixel: DataFrame, model: DataFrame, b0: DataFrame, ring: DataFrame, constant: bool = True) -> DataFrame:
    """(patch, p, t, v): ring weights times what movie, model and constant background leave; the constant added on demand.

    pixel: movie (patch, p, t, v); model: product_movie; b0: (patch, p, v); ring: (patch, p, q, w).
    """
    base = b0.select("patch", "p", F.col("v").alias("b"))
    ac = model.select("patch", "p", "t", F.col("v").alias("m"))
    rest = pixel.join(ac, ["patch", "p", "t"], "left").join(base, ["patch", "p"])
    out = products.of_pixels(ring, rest.select("patch", F.col("p").alias("q"), "t", (F.col("v") - F.coalesce("m", F.lit(0.0)) - F.col("b")).alias("v")))
    return out.join(base, ["patch", "p"]).select("patch", "p", "t", (F.col("v") + F.col("b")).alias("v")) if constant else out


def on_canvas(product: DataFrame, patches: DataFrame) -> DataFrame:
    """(t, y, x, v): patch products in mosaic coordinates, core area only, as many frames as the shortest patch has."""
    frames = product.groupBy("patch").agg((F.max("t") + 1).alias("n")).agg(F.min("n").alias("n"))
    placed = product.withColumn("k", F.lit(0)).withColumnRenamed("v", "w")
    core = core_pixels(placed.select("patch", F.col("t").alias("k"), "p", "w"), patches)
    return core.crossJoin(F.broadcast(frames)).where("k < n").select(F.col("k").alias("t"), "y", "x", F.col("w").alias("v"))


def canvas_size(patches: DataFrame) -> DataFrame:
    return patches.agg(F.max("y1").alias("h"), F.max("x1").alias("w"))


def peaks(footprint: DataFrame) -> DataFrame:
    """(patch, k, p, w): the pixel of greatest weight of each component, the first of equal ones."""
    return footprint.groupBy("patch", "k").agg(F.max_by(F.struct("p", "w"), F.struct("w", (-F.col("p")).alias("o"))).alias("m")).select("patch", "k", "m.p", "m.w")


ALIKE = 512  # vectors of a block that is compared with another at once


def dot_products(vectors: DataFrame, key: str, vector: str, group: list[str], least: float) -> DataFrame:
    """(group, a, b, cosine) of pairs of one group over a threshold.

    A group's vectors are dealt to blocks, and a task multiplies two blocks as matrices; so no task has a whole group, and
    only pairs over the threshold become rows. Null vectors, those of zeros and those with a null have no cosine.
    """
    own = vectors.select(*group, F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_key is not null and size(_v) > 0")
    sizes = own.groupBy(*group).agg(F.ceil(F.count("*") / ALIKE).cast("int").alias("_n")).select(*(F.col(g).alias(f"_{g}") for g in group), "_n")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    dealt = own.join(sizes, same).withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least("_part", k).alias("_i"), F.greatest("_part", k).alias("_j")))
    tasks = dealt.withColumn("_task", F.explode(pairs)).select(*group, "_task._i", "_task._j", "_part", "_key", "_v")
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in group)

    def alike(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = names[len(group) :]
        found = []
        for size in pdf["_v"].map(len).unique():  # vectors of different length have no product
            rows = pdf[pdf["_v"].map(len) == size]
            x = np.stack([np.asarray(v, np.float64) for v in rows["_v"]])
            norm = np.sqrt((x * x).sum(axis=1))
            rows, x = rows[norm > 0], x[norm > 0] / norm[norm > 0, None]
            here = rows["_part"].to_numpy()
            left, right = np.flatnonzero(here == i), np.flatnonzero(here == j)
            cosine = x[left] @ x[right].T
            p, q = np.nonzero(cosine > least)
            keys = rows["_key"].to_numpy()
            a, b = keys[left[p]], keys[right[q]]
            use = a < b if i == j else a != b
            first = np.where(a < b, a, b)
            found.append(pd.DataFrame({"a": first[use], "b": np.where(a < b, b, a)[use], "cosine": cosine[p, q][use]}))
        out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "cosine": []})
        for c, value in zip(group, names):
            out[c] = value
        return out[[*group, "a", "b", "cosine"]]

    kind = vectors.schema[key].dataType.simpleString()
    return tasks.groupBy(*group, "_i", "_j").applyInPandas(alike, f"{kinds}, a {kind}, b {kind}, cosine double")


def overlaps(footprint: DataFrame) -> DataFrame:
    """(patch, i, j, v): cosine overlap of components that share a pixel, from the sparse product of footprints."""
    return alike.overlaps(footprint)


def joint_only(footprint: DataFrame, active: DataFrame, least: float = 0.1) -> DataFrame:
    """(patch, k, joint_only): whether a component has no active frame of its own, without its overlapping neighbours'.

    active: (patch, k, t), the frames of each component's activity intervals.
    """
    private = active.join(alike.frames_of_others(footprint, active, least), ["patch", "k", "t"], "left_anti").select("patch", "k").distinct().withColumn("own", F.lit(True))
    return footprint.select("patch", "k").distinct().join(private, ["patch", "k"], "left").select("patch", "k", F.col("own").isNull().alias("joint_only"))


def spacing(distances: DataFrame) -> DataFrame:
    """One row (sigma, median): the median nearest-neighbour distance, and the smoothing width max(24, 2 * median).

    distances: neighbours.nearest(); fewer than two points have none: (24, 0).
    """
    median = selection.percentiles(durable(distances.select("distance")), [], "distance", {"median": 0.5})
    median = median.agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("median"))  # one row, whether or not there is a distance
    return median.select(F.greatest(F.lit(24.0), 2 * F.col("median")).alias("sigma"), "median")


def scattered(points: DataFrame, value: str) -> DataFrame:
    """(y, x, total, n): values and counts added up at each pixel."""
    return points.groupBy("y", "x").agg(F.sum(F.col(value).cast("double")).alias("total"), F.count("*").alias("n"))


def overlaid(foreground: DataFrame, background: DataFrame) -> DataFrame:
    """(y, x, v): the foreground where it is set, else the background."""
    return background.select("y", "x", F.col("v").alias("_b")).join(foreground.select("y", "x", F.col("v").alias("_f")), ["y", "x"], "left").select("y", "x", F.coalesce("_f", "_b").alias("v"))


def painted(outlines: DataFrame, order: str, colour: str) -> DataFrame:
    """(y, x, colour): where outlines cross, the last component's colour stays."""
    return outlines.groupBy("y", "x").agg(F.max_by(colour, order).alias(colour))


def _border(pdf: pd.DataFrame, share: float) -> np.ndarray:
    """(y, x) of the border of one component's core, from its pixels."""
    w = pdf["w"].to_numpy(np.float64)
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    on = (w >= share * w.max()) & (w > 0)
    if not on.any():
        return np.zeros((0, 2), np.int64)
    y, x, w = y[on], x[on], w[on]
    top = np.lexsort((y, x, -w))[0]
    y0, x0 = y.min() - 1, x.min() - 1
    left = np.zeros((y.max() - y0 + 2, x.max() - x0 + 2), bool)
    left[y - y0, x - x0] = True
    part, new = np.zeros_like(left), [(y[top] - y0, x[top] - x0)]
    left[new[0]] = False
    while new:
        i, j = new.pop()
        part[i, j] = True
        for n in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if left[n]:
                left[n] = False
                new.append(n)
    inner = part.copy()
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            inner &= np.roll(part, (dy, dx), (0, 1))  # a rim of empty pixels is all that goes round
    return np.argwhere(part & ~inner) + (y0, x0)


def outlines(core: DataFrame, share: float = 0.2) -> DataFrame:
    """(patch, k, y, x): the border of each component's core.

    The core is the 4-connected part, about the peak, of pixels with at least a share of the greatest weight; its border
    is what a 3 x 3 erosion takes away. Each component is labelled by itself, in time with its bounding box.
    """
    kinds = {c: core.schema[c].dataType.simpleString() for c in ("patch", "k")}

    def outline(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = _border(pdf, share)
        return pd.DataFrame({"patch": [key[0]] * len(at), "k": [key[1]] * len(at), "y": at[:, 0], "x": at[:, 1]})

    rows = core.where("w is not null").select("patch", "k", "y", "x", "w")
    return rows.groupBy("patch", "k").applyInPandas(outline, f"patch {kinds['patch']}, k {kinds['k']}, y int, x int")
