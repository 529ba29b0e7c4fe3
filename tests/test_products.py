"""Sparse products in blocks against dense ones."""

import tracemalloc

import numpy as np
import pytest

from tesserae.operators import footprints, products


def dense(weights, series):
    """(patch, p, t) to the sum, where any value meets a weight."""
    by = {}
    for patch, q, t, v in series:
        if None not in (q, t, v):
            by.setdefault((patch, q), []).append((t, v))
    out = {}
    for patch, p, q, w in weights:
        if None not in (p, q, w):
            for t, v in by.get((patch, q), ()):
                out[patch, p, t] = out.get((patch, p, t), 0.0) + w * v
    return out


@pytest.mark.parametrize("blocks", [(8192, 32), (5, 3)])
def test_products_of_gaps_and_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(products, "PIXELS", blocks[0])
    monkeypatch.setattr(products, "FRAMES", blocks[1])
    monkeypatch.setattr(products, "ENTRIES", 7)
    pick = np.random.default_rng(6)
    weights = {(str(pick.integers(3)), int(p), int(q)): float(pick.normal()) for p, q in pick.integers(0, 23, (150, 2))}
    weights = [(*k, w) for k, w in weights.items()] + [("0", 1, 1, None), ("0", None, 1, 1.0), ("9", 1, 1, 1.0)]
    series = {(str(pick.integers(3)), int(q), int(t)): float(pick.normal()) for q, t in pick.integers(0, 19, (300, 2))}
    series = [(*k, v) for k, v in series.items()] + [("0", 3, 99, None), ("1", None, 2, 1.0), ("8", 1, 1, 1.0)]
    weights = list({k[:3]: k for k in weights}.values())
    w = spark.createDataFrame(weights, "patch string, p long, q long, w double").repartition(3)
    s = spark.createDataFrame(series, "patch string, q long, t int, v double").repartition(3)
    want = dense(weights, series)
    # FRAMES and PIXELS live in the tasks as well
    products_of = products.of_pixels(w, s) if blocks == (8192, 32) else local(weights, series)
    got = {(r.patch, r.p, r.t): r.v for r in products_of.collect()} if blocks == (8192, 32) else products_of
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def local(weights, series):
    """The packing and the multiplication in this process, in the order that the shuffle gives."""
    import pyarrow as pa

    n, m = products.PIXELS, products.FRAMES
    weights = [r for r in weights if None not in r]
    series = [r for r in series if None not in r]
    batch = lambda rows, names: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))
    left = batch([(a, p // n, q // n, p % n, q % n, w) for a, p, q, w in weights], ["patch", "pb", "qb", "p", "q", "w"])
    right = batch([(a, q // n, t // m, q % n, t % m, v) for a, q, t, v in series], ["patch", "qb", "tb", "q", "t", "v"])
    (own,) = products._pack(products.WEIGHT, ["pb", "qb"])([left])
    (values,) = products._pack(products.VALUE, ["qb", "tb"])([right])
    rows = [(r["patch"], r["pb"], -1, r["qb"], r["cells"]) for r in own.to_pylist()]
    pairs = {(r["patch"], r["pb"], r["qb"]) for r in own.to_pylist()}
    rows += [(a, pb, r["tb"], qb, r["cells"]) for r in values.to_pylist() for a, pb, qb in pairs if (a, qb) == (r["patch"], r["qb"])]
    rows.sort(key=lambda r: r[:3])
    names = ["patch", "pb", "tb", "qb", "cells"]
    batches = [batch(rows[k : k + 4], names) for k in range(0, len(rows), 4)]
    return {(r["patch"], r["p"], r["t"]): r["v"] for b in products._multiplied(iter(batches)) for r in b.to_pylist()}


def test_series_as_arrays(spark):
    pick = np.random.default_rng(7)
    footprint = [("a", int(k), int(p), float(pick.random())) for k in range(5) for p in range(0, 20_000, 997)]
    traces = [("a", k, pick.random(70 + k).astype(np.float32).tolist(), None if k % 2 else pick.random(70 + k).astype(np.float32).tolist()) for k in range(5)]
    traces.append(("a", 9, [], []))
    f = spark.createDataFrame(footprint, "patch string, k int, p long, w float")
    c = spark.createDataFrame(traces, "patch string, k int, c array<float>, yra array<float>")
    for residual in (False, True):
        series = [("a", k, t, v + (y[t] if residual and y else 0.0)) for _, k, own, y in traces for t, v in enumerate(own)]
        want = dense([(a, p, k, float(np.float32(w))) for a, k, p, w in footprint], series)
        got = {(r.patch, r.p, r.t): r.v for r in footprints.product_movie(f, c, residual=residual).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_a_large_patch_needs_a_block_at_a_time():
    """Of a 540 x 540 patch with a ring of 60 pixels: what one block of pixels takes for block after block of frames."""
    h, ring = 540, 60
    pick = np.random.default_rng(8)
    p = np.repeat(np.arange(products.PIXELS), ring)
    q = np.clip(p + h * pick.integers(-18, 19, len(p)) + pick.integers(-18, 19, len(p)), 0, h * h - 1)
    qb = q // products.PIXELS
    blocks = []
    for k in np.unique(qb):
        cells = np.zeros((qb == k).sum(), products.WEIGHT)
        cells["p"], cells["q"], cells["w"] = p[qb == k], q[qb == k] % products.PIXELS, 1.0 / ring
        blocks.append((int(k), cells.tobytes()))
    values = []
    for k in np.unique(qb):
        cells = np.zeros(products.PIXELS * products.FRAMES, products.VALUE)
        cells["q"], cells["t"] = np.repeat(np.arange(products.PIXELS), products.FRAMES), np.tile(np.arange(products.FRAMES), products.PIXELS)
        cells["v"] = 2.0
        values.append((int(k), cells.tobytes()))
    tracemalloc.start()
    own = products._Weights(blocks)
    sums, found = own.times(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(sums, 2.0) and found.all()
    assert peak < 300 << 20


@pytest.mark.parametrize("block", [512, 5])
def test_alike_vectors_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(footprints, "ALIKE", block)
    pick = np.random.default_rng(9)
    base = pick.normal(size=(6, 4))
    rows = [(int(k), "x" if k % 3 else None, (base[k % 6] + 0.2 * pick.normal(size=4)).tolist()) for k in range(40)]
    rows += [(90, "x", [0.0] * 4), (91, "x", None), (92, "x", [1.0, None, 0.0, 0.0]), (93, "x", [1.0, 2.0]), (94, "x", [2.0, 4.0]), (95, "y", [])]
    df = spark.createDataFrame(rows, "k int, g string, v array<double>").repartition(3)
    want = {}
    whole = [(k, g, np.array(v)) for k, g, v in rows if v and None not in v and any(v)]
    for k, g, v in whole:
        for j, h, w in whole:
            if k < j and g == h and len(v) == len(w):
                cosine = v @ w / np.linalg.norm(v) / np.linalg.norm(w)
                if cosine > 0.9:
                    want[k, j] = cosine
    got = {(r.a, r.b): r.cosine for r in footprints.dot_products(df, "k", "v", ["g"], 0.9).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
