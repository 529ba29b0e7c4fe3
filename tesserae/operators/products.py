"""Sparse weights times series of values, in packed blocks.

    weights (patch, p, q, w)  x  series (patch, q, t, v)  ->  (patch, p, t, sum of w * v)

Pixels and frames are cut into blocks. Weights travel as one table of packed cells by block of p, once for the whole movie;
values as packed cells by block of q and block of frames, to those blocks of p alone that have weights for them. A task gets
its blocks sorted: first the weights of a block of p, then block after block of frames, so it holds one block of weights
and one of frames, however large the patch and however long the movie. No row for a weight and a frame is ever made, and
the sums need no shuffle of their own.

A result exists where any value meets a weight. Null weights and values count as absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXELS = 8192  # p or q of a block
FRAMES = 32
ENTRIES = 65_536  # weights that are multiplied at once, times the frames of a block

WEIGHT = np.dtype([("p", "<u2"), ("q", "<u2"), ("w", "<f8")])
VALUE = np.dtype([("q", "<u2"), ("t", "u1"), ("v", "<f8")])


def _block(column: str, size: int = PIXELS) -> Column:
    return F.floor(F.col(column) / size).cast("int")


def _pack(kind: np.dtype, keys: list[str]):
    """Rows to packed cells by patch and keys, within each batch; a cell's values may be an array by frame."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            patch = b.column("patch").dictionary_encode()
            columns = [patch.indices.to_numpy(), *(b.column(k).to_numpy() for k in keys)]
            cells = np.empty(b.num_rows, kind)
            if "vs" in b.schema.names:
                lists = b.column("vs")
                sizes = np.diff(lists.offsets.to_numpy())
                cells = np.empty(int(sizes.sum()), kind)
                first = np.cumsum(sizes) - sizes
                cells["q"], cells["t"] = np.repeat(b.column("q").to_numpy(), sizes), np.arange(len(cells)) - np.repeat(first, sizes)
                cells["v"] = lists.flatten().to_numpy(zero_copy_only=False)
                columns = [np.repeat(c, sizes) for c in columns]
            else:
                for name in kind.names:
                    cells[name] = b.column(name).to_numpy()
            order = np.lexsort(columns[::-1])
            columns, cells = [c[order] for c in columns], cells[order]
            edges = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(cells) else np.zeros(0, int)
            raw = [cells[s:e].tobytes() for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)])]
            out = [patch.dictionary.take(pa.array(columns[0][edges])), *(pa.array(c[edges].astype(np.int32)) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([*out, pa.array(raw, pa.binary())], ["patch", *keys, "cells"])

    return pack


class _Weights:
    """The weights of one block of p, sorted by p, with their q as places among those that are used."""

    def __init__(self, blocks: list[tuple[int, bytes]]):
        parts = [(qb, np.frombuffer(raw, WEIGHT)) for qb, raw in blocks]
        p, w = (np.concatenate([c[name] for _, c in parts]) for name in ("p", "w"))
        q = np.concatenate([qb * PIXELS + c["q"].astype(np.int64) for qb, c in parts])
        order = np.argsort(p, kind="stable")
        self.w, p = w[order], p[order]
        self.sources, at = np.unique(q[order], return_inverse=True)
        self.at = at.astype(np.int32)
        self.starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        self.pixels = p[self.starts].astype(np.int64)

    def times(self, blocks: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums (pixel, frame) of a block of frames, and where there is any value to sum."""
        values, there = np.zeros((len(self.sources), FRAMES)), np.zeros((len(self.sources), FRAMES), bool)
        for qb, raw in blocks:
            cells = np.frombuffer(raw, VALUE)
            q = qb * PIXELS + cells["q"].astype(np.int64)
            k = np.searchsorted(self.sources, q)
            k[k == len(self.sources)] = 0
            used = self.sources[k] == q
            values[k[used], cells["t"][used]] = cells["v"][used]
            there[k[used], cells["t"][used]] = True
        out = np.empty((len(self.pixels), FRAMES))
        found = np.tile(there.any(axis=0) & there.all(axis=0), (len(self.pixels), 1))
        gaps = not (there.all(axis=0) | ~there.any(axis=0)).all()  # else each frame has all values or none
        ends = np.append(self.starts[1:], len(self.w))
        s = 0
        while s < len(self.pixels):
            e = max(int(np.searchsorted(ends, self.starts[s] + ENTRIES, side="right")), s + 1)
            own, edges = slice(self.starts[s], ends[e - 1]), self.starts[s:e] - self.starts[s]
            out[s:e] = np.add.reduceat(self.w[own, None] * values[self.at[own]], edges, axis=0)
            if gaps:
                found[s:e] = np.logical_or.reduceat(there[self.at[own]], edges, axis=0)
            s = e
        return out, found


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (patch, pb, tb, qb, cells) to (patch, p, t, v); rows of weights have tb -1 and come first."""
    key, weights, held, frames, kind = None, None, [], None, None

    def results() -> Iterator[pa.RecordBatch]:
        if weights is None or not held:
            return
        sums, found = weights.times(held)
        i, j = np.nonzero(found)
        columns = [pa.array(weights.pixels[i] + key[1] * PIXELS), pa.array((j + frames * FRAMES).astype(np.int32)), pa.array(sums[i, j])]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], kind), len(i)), *columns], ["patch", "p", "t", "v"])

    for b in batches:
        kind = b.schema.field("patch").type
        for patch, pb, tb, qb, cells in zip(*(c.to_pylist() for c in b.columns)):
            if (patch, pb) != key or tb != frames:
                if frames is not None and frames >= 0:
                    yield from results()
                elif frames == -1 and (patch, pb) == key:
                    weights = _Weights(held)
                if (patch, pb) != key:
                    key, weights = (patch, pb), None
                frames, held = tb, []
            held.append((qb, cells))
    if frames is not None and frames >= 0:
        yield from results()


def _by_weights(weights: DataFrame, values: DataFrame) -> DataFrame:
    """weights (patch, p, q, w) times packed values (patch, qb, tb, cells)."""
    kind = weights.schema["patch"].dataType.simpleString()
    rows = weights.where("p is not null and q is not null and w is not null").select(
        "patch", _block("p").alias("pb"), _block("q").alias("qb"), (F.col("p") % PIXELS).cast("int").alias("p"), (F.col("q") % PIXELS).cast("int").alias("q"), F.col("w").cast("double").alias("w")
    )
    packed = rows.mapInArrow(_pack(WEIGHT, ["pb", "qb"]), f"patch {kind}, pb int, qb int, cells binary")
    pairs = rows.select("patch", "pb", "qb").distinct()  # few: blocks that meet, not pixels
    sent = values.join(pairs, ["patch", "qb"]).select("patch", "pb", "tb", "qb", "cells")
    both = packed.select("patch", "pb", F.lit(-1).alias("tb"), "qb", "cells").unionByName(sent)
    return both.repartition("patch", "pb").sortWithinPartitions("patch", "pb", "tb").mapInArrow(_multiplied, f"patch {kind}, p long, t int, v double")


def of_traces(weights: DataFrame, traces: DataFrame) -> DataFrame:
    """(patch, p, t, v). traces: (patch, q, series): an array of values by frame; it is cut into blocks of frames as it is."""
    kind = traces.schema["patch"].dataType.simpleString()
    rows = traces.where("q is not null").select("patch", "q", "series", F.explode(F.sequence(F.lit(0), F.floor((F.size("series") - 1) / FRAMES).cast("int"))).alias("tb"))
    cut = F.slice("series", F.col("tb") * FRAMES + 1, FRAMES).cast("array<double>")
    rows = rows.where("size(series) > 0").select("patch", _block("q").alias("qb"), "tb", (F.col("q") % PIXELS).cast("int").alias("q"), cut.alias("vs"))
    return _by_weights(weights, rows.mapInArrow(_pack(VALUE, ["qb", "tb"]), f"patch {kind}, qb int, tb int, cells binary"))


def of_pixels(weights: DataFrame, series: DataFrame) -> DataFrame:
    """(patch, p, t, v). series: (patch, q, t, v), a row for each value; they are packed by block where they meet."""
    kind = series.schema["patch"].dataType.simpleString()
    rows = series.where("q is not null and t is not null and v is not null").select(
        "patch", _block("q").alias("qb"), _block("t", FRAMES).alias("tb"), (F.col("q") % PIXELS).cast("int").alias("q"), (F.col("t") % FRAMES).cast("int").alias("t"), F.col("v").cast("double").alias("v")
    )
    rows = rows.repartition("patch", "qb", "tb").sortWithinPartitions("patch", "qb", "tb")
    return _by_weights(weights, rows.mapInArrow(_pack(VALUE, ["qb", "tb"]), f"patch {kind}, qb int, tb int, cells binary"))
