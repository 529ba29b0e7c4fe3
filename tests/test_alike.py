"""Overlaps of components by blocks against all pairs of rows."""

import math
import time

import numpy as np
import pytest

from tesserae.operators import alike, footprints


def shuffled_rows(spark) -> int:
    time.sleep(0.5)  # the status store is told a little later
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def by_pairs(rows):
    """(patch, i, j) to the sum over pixels that both hold."""
    norms, cells = {}, {}
    for patch, k, p, w in rows:
        norms[patch, k] = norms.get((patch, k), 0.0) + w * w
        cells.setdefault((patch, p), []).append((k, w))
    out = {}
    for (patch, _), own in cells.items():
        for i, v in own:
            for j, u in own:
                a, b = norms[patch, i] ** 0.5, norms[patch, j] ** 0.5
                if i != j and not (a == 0 or b == 0):
                    out[patch, i, j] = out.get((patch, i, j), 0.0) + v / a * (u / b)
    return out


def components(pick):
    rows = [(str(n), k, int(p), float(v)) for n in range(2) for k in range(40) for p, v in zip(pick.integers(0, 4000, 12) // (1 + 9 * (k % 3)), pick.normal(size=12))]
    rows += [("0", k, 700 + p, float(v)) for k in range(40, 90) for p, v in enumerate(pick.random(9))]  # all at the same first pixel
    rows += [("0", 200, 3, 0.0), ("0", 201, 3, 1.0), ("0", 202, 3, -2.0), ("0", 203, 3, 5.0), ("0", 203, 3, -5.0), ("0", 204, 4, math.inf), ("0", 204, 3, 1.0), ("0", 205, 4, 1.0)]
    rows += [("1", 300, 5, math.nan), ("1", 300, 6, 1.0), ("1", 301, 6, 1.0), ("1", 302, 7, 1.0)]
    return rows


@pytest.mark.parametrize("entries, most", [(alike.ENTRIES, alike.COMPONENTS), (96, 8)])
def test_overlaps_of_all_pairs(spark, monkeypatch, entries, most):
    monkeypatch.setattr(alike, "ENTRIES", entries)
    monkeypatch.setattr(alike, "COMPONENTS", most)
    rows = components(np.random.default_rng(8))
    want = by_pairs(rows)
    df = spark.createDataFrame([*rows, (None, 1, 3, 1.0), ("0", None, 3, 1.0), ("0", 1, None, 0.0), ("0", 400, 3, None)], "patch string, k int, p long, w double").repartition(3)
    got = footprints.overlaps(df).collect()
    assert len(got) == len(want) and {(r.patch, r.i, r.j) for r in got} == want.keys()
    for r in got:
        assert np.isclose(r.v, want[r.patch, r.i, r.j], rtol=1e-9, atol=1e-12, equal_nan=True), r


def test_pairs_do_not_cross_a_shuffle(spark):
    df = spark.range(400).selectExpr("'a' as patch", "cast(id as int) as k", "explode(sequence(0L, 9L)) as p", "1.0D + id % 7 as w")
    before = shuffled_rows(spark)
    assert footprints.overlaps(df).count() == 400 * 399
    assert shuffled_rows(spark) - before < 20_000


@pytest.mark.parametrize("entries, most", [(alike.ENTRIES, alike.COMPONENTS), (96, 8)])
def test_frames_that_no_neighbour_has(spark, monkeypatch, entries, most):
    monkeypatch.setattr(alike, "ENTRIES", entries)
    monkeypatch.setattr(alike, "COMPONENTS", most)
    pick = np.random.default_rng(9)
    rows = components(pick)
    active = {(patch, int(k), int(t)) for patch, k in {r[:2] for r in rows} for t in pick.integers(0, 600, 30)} | {("0", 1000, 3), ("1", 302, 9)}
    frames = {}
    for patch, k, t in active:
        frames.setdefault((patch, k), set()).add(t)
    rest = {key: set(own) for key, own in frames.items()}
    for (patch, i, j), v in by_pairs(rows).items():
        if not v <= 0.2:
            rest[patch, i] -= frames[patch, j]
    want = {(patch, k): not rest[patch, k] for patch, k in {r[:2] for r in rows}}
    f = spark.createDataFrame(rows, "patch string, k int, p long, w double").repartition(3)
    a = spark.createDataFrame(sorted(active), "patch string, k int, t int").repartition(3)
    got = footprints.joint_only(f, a, 0.2).collect()
    assert len(got) == len(want) and {(r.patch, r.k): r.joint_only for r in got} == want
    assert 0 < sum(want.values()) < len(want)


def test_neighbours_do_not_cross_a_shuffle(spark):
    f = spark.range(400).selectExpr("'a' as patch", "cast(id as int) as k", "explode(sequence(0L, 9L)) as p", "1.0D + id % 7 as w")
    before = shuffled_rows(spark)
    assert footprints.joint_only(f, f.selectExpr("patch", "k", "k % 5 as t").distinct(), 0.2).where("joint_only").count() == 400
    assert shuffled_rows(spark) - before < 20_000
