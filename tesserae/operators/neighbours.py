"""The nearest other point, however far, over a grid that is fine where points are dense.

Equal places are counted first and become one. The square that holds all places is cut into quarters again and again until
a tile has `TILE` places at most; how often is known from counts by cell, which are summed up level by level, so that
places are counted once (and once more where they lie thousands of times denser than on average). Tasks then search each
tile by itself. That settles every place whose nearest one is nearer than the border of its tile. The others ask the tiles
that their circle meets, as the tiles' bounding boxes tell; a place that is alone in its tile takes its circle from the
boxes as well. So each place is searched once, and those at borders once more for each tile they meet; nothing depends on
how far the farthest point is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import durable, few

TILE = 1024  # places of a tile
DEPTH = 6  # levels that are counted at once beyond the first time
DEEPEST = 48  # levels; places that it does not part stay together
BOXES = 100_000  # boxes of tiles that tasks look through at once
PAIRS = 1 << 22  # distances that are held at once


def _cell(column: str, level) -> F.Column:
    return F.floor(F.col(column) * F.pow(F.lit(2.0), level)).cast("long")


def _levels(places: DataFrame, first: int, last: int) -> DataFrame:
    """(cy, cx, level): for each cell of the last level the coarsest level from the first on where it has few enough places."""
    cells = durable(places.groupBy(_cell("uy", F.lit(last)).alias("cy"), _cell("ux", F.lit(last)).alias("cx")).agg(F.count("*").alias("n")))
    above = cells.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    shift = F.pow(F.lit(2.0), F.lit(last) - F.col("level"))
    above = above.withColumns({"ay": F.floor(F.col("cy") / shift), "ax": F.floor(F.col("cx") / shift)})
    fits = above.groupBy("level", "ay", "ax").agg(F.sum("n").alias("n")).where((F.col("n") <= TILE) | (F.col("level") >= DEEPEST))
    return above.drop("n").join(fits.drop("n"), ["level", "ay", "ax"]).groupBy("cy", "cx").agg(F.min("level").alias("level"))


def tiled(places: DataFrame, n: int) -> DataFrame:
    """(y, x, uy, ux, level): the level of the tile of each place. uy and ux: the place in the unit square."""
    first, last, out = 0, max(1, math.ceil(math.log(max(n / TILE, 1), 4)) + 2), None
    while True:
        last = min(last, DEEPEST)
        levels = few(_levels(places, first, last))
        marked = places.withColumns({"cy": _cell("uy", F.lit(last)), "cx": _cell("ux", F.lit(last))}).join(levels, ["cy", "cx"], "left").drop("cy", "cx")
        done = marked.where("level is not null")
        out = done if out is None else out.unionByName(done)
        places = durable(marked.where("level is null").drop("level"))
        if last == DEEPEST or places.isEmpty():
            return out
        first, last = last + 1, last + DEPTH


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Sorted rows by (level, ty, tx), each tile whole."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("level", "ty", "tx")])
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            own = tuple(keys[:, s].tolist())
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def _least(y: np.ndarray, x: np.ndarray, py: np.ndarray, px: np.ndarray, same: bool) -> np.ndarray:
    """Distance of each (y, x) to the nearest of (py, px); same: to another one, both being the same list."""
    out = np.full(len(y), np.inf)
    step = max(1, PAIRS // max(len(py), 1))
    for s in range(0, len(y) if len(py) else 0, step):
        gap = np.hypot(y[s : s + step, None] - py, x[s : s + step, None] - px)
        if same:
            gap[np.arange(len(gap)), np.arange(s, s + len(gap))] = np.inf
        out[s : s + step] = gap.min(axis=1)
    return out


def _inside(origin: tuple[float, float], side: float):
    """Adds the nearest of the own tile (infinite: none), and whether no other tile can have a nearer one."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level, ty, tx), t in _groups(batches):
            y, x = t["y"].to_numpy(), t["x"].to_numpy()
            best = _least(y, x, y, x, True)
            width = side / 2.0**level
            edge = np.full(len(y), np.inf)
            for at, low in ((y, origin[0] + ty * width), (x, origin[1] + tx * width)):
                edge = np.minimum(edge, np.minimum(at - low, low + width - at))
            settled = best < edge - 1e-9 * side  # what rounding does to a border
            columns = [pa.array(np.full(len(y), k, np.int64)) for k in (level, ty, tx)]
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), *columns, pa.array(best), pa.array(settled)], ["y", "x", "level", "ty", "tx", "best", "settled"])

    return search


def _gaps(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along one axis: the least and the greatest distance of each place to each interval."""
    below, above = low - at[:, None], at[:, None] - high
    return np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))


def _look(boxes: np.ndarray, ask: bool):
    """Places at borders against the boxes of tiles (level, ty, tx, least and greatest y and x).

    Not ask: their reach, held to what any other tile's farthest corner promises. Ask: a row for each tile within reach.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["level", "ty", "tx", "y", "x", "reach"]
        for b in batches:
            step = max(1, PAIRS // max(len(boxes), 1))
            for s in range(0, b.num_rows, step):
                own = b.slice(s, step)
                y, x, reach = (own.column(c).to_numpy() for c in ("y", "x", "reach"))
                (ny, fy), (nx, fx) = _gaps(boxes[:, 3], boxes[:, 4], y), _gaps(boxes[:, 5], boxes[:, 6], x)
                other = np.zeros((len(y), len(boxes)), bool)
                for k, name in enumerate(names[:3]):
                    other |= own.column(name).to_numpy()[:, None] != boxes[:, k]
                if ask:
                    i, j = np.nonzero(other & (np.hypot(ny, nx) <= reach[:, None] * (1 + 1e-12)))
                    target = [pa.array(boxes[j, k].astype(np.int64)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*target, pa.array(y[i]), pa.array(x[i]), pa.array(reach[i])], names)
                else:
                    far = np.where(other, np.hypot(fy, fx), np.inf).min(axis=1, initial=np.inf)
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names[:5]), pa.array(np.minimum(reach, far))], names)

    return look


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile: what asks it, with the nearest of its places."""
    for _, t in _groups(batches):
        y, x, asks = t["y"].to_numpy(), t["x"].to_numpy(), t["asks"].to_numpy()
        best = _least(y[asks], x[asks], y[~asks], x[~asks], False)
        yield pa.RecordBatch.from_arrays([pa.array(y[asks]), pa.array(x[asks]), pa.array(best)], ["y", "x", "other"])


def nearest(points: DataFrame, key: str) -> DataFrame:
    """(key, distance) to the nearest other point of (key, y, x).

    Points at one place are 0 apart. A point that is alone has no row. Points without a finite place or a key are left out.
    """
    rows = points.select(F.col(key).alias("id"), (F.col("y").cast("double") + 0.0).alias("y"), (F.col("x").cast("double") + 0.0).alias("x"))
    rows = rows.where("id is not null").where((F.abs("y") < math.inf) & (F.abs("x") < math.inf))
    found = _of_places(durable(rows.groupBy("y", "x").agg(F.count("*").alias("n"))))
    return rows.join(found, ["y", "x"]).select(F.col("id").alias(key), "distance")


def _of_places(counted: DataFrame) -> DataFrame:
    """(y, x, distance) of different places, with how many points each has."""
    least = counted.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"), F.count("*")).first()
    if not least[4]:
        return counted.select("y", "x", F.lit(0.0).alias("distance"))
    origin, n = (least[0], least[2]), least[4]
    side = (max(least[1] - least[0], least[3] - least[2]) or 1.0) * (1 + 1e-9)
    unit = counted.select("y", "x", ((F.col("y") - origin[0]) / side).alias("uy"), ((F.col("x") - origin[1]) / side).alias("ux"))
    tile = tiled(unit, n).select("y", "x", F.col("level").cast("long").alias("level"), _cell("uy", F.col("level")).alias("ty"), _cell("ux", F.col("level")).alias("tx"))
    by, order = ["level", "ty", "tx"], ["level", "ty", "tx", "asks"]
    own = tile.repartition(*by).sortWithinPartitions(*by).mapInArrow(_inside(origin, side), "y double, x double, level long, ty long, tx long, best double, settled boolean")
    own = durable(own)
    boxes = own.groupBy(*by).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"))
    shape = "level long, ty long, tx long, y double, x double, reach double"
    border = own.where("not settled").select(*by, "y", "x", F.col("best").alias("reach"))
    parts = list(_chunks(boxes))
    for part in parts:
        border = border.mapInArrow(_look(part, False), shape)
    asks = None
    for part in parts:
        one = border.mapInArrow(_look(part, True), shape)
        asks = one if asks is None else asks.unionByName(one)
    asks = asks.select(*by, "y", "x", F.lit(True).alias("asks"))
    both = own.join(asks.select(*by).distinct(), by, "left_semi").select(*by, "y", "x", F.lit(False).alias("asks")).unionByName(asks)
    answers = both.repartition(*by).sortWithinPartitions(*order).mapInArrow(_asked, "y double, x double, other double")
    answers = answers.groupBy("y", "x").agg(F.min("other").alias("other"))
    out = own.select("y", "x", "best").join(answers, ["y", "x"], "left").join(counted, ["y", "x"])
    distance = F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.least("best", "other"))
    return out.select("y", "x", distance.alias("distance")).where(F.col("distance") < math.inf)


def _chunks(boxes: DataFrame) -> Iterator[np.ndarray]:
    """The boxes of tiles, some at a time; there is one for several hundred places."""
    held = []
    for r in boxes.toLocalIterator():
        held.append(tuple(r))
        if len(held) == BOXES:
            yield np.array(held, np.float64)
            held = []
    if held:
        yield np.array(held, np.float64)
