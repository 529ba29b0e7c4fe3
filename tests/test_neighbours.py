"""Nearest neighbours over an adaptive grid against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import neighbours


def brute(points):
    out = {}
    for k, y, x in points:
        rest = [np.hypot(y - b, x - a) for j, b, a in points if j != k]
        if rest:
            out[k] = min(rest)
    return out


def got(spark, points):
    df = spark.createDataFrame([(int(k), float(y), float(x)) for k, y, x in points], "k long, y double, x double").repartition(3)
    return {r.k: r.distance for r in neighbours.nearest(df, "k").collect()}


def clusters(kind):
    pick = np.random.default_rng(9)
    if kind == "uniform":
        places = pick.random((400, 2)) * 50
    elif kind == "outliers":
        places = np.concatenate([pick.random((300, 2)), [[1e6, 0], [1e6, 5], [-3e5, 2e5]]])
    elif kind == "dense":  # a thousandfold denser spot, and spots of their own scale
        places = np.concatenate([pick.random((80, 2)) * 1000, 500 + pick.random((200, 2)) * 1e-3, 20 + pick.normal(size=(60, 2)) * 1e-7])
    elif kind == "line":
        places = np.stack([np.zeros(150), np.cumsum(pick.random(150))], axis=1)
    elif kind == "copies":
        places = pick.integers(0, 6, (100, 2)) * 7.5
    elif kind == "pair":
        places = np.array([[1.0, 2.0], [4.0, 6.0]])
    else:
        places = np.full((5, 2), 3.0)
    return [(k, y, x) for k, (y, x) in enumerate(places)]


@pytest.mark.parametrize("kind", ["uniform", "outliers", "dense", "line", "copies", "pair", "one place"])
def test_as_by_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "TILE", 12)
    monkeypatch.setattr(neighbours, "DEPTH", 4)
    monkeypatch.setattr(neighbours, "BOXES", 40)
    points = clusters(kind)
    want, out = brute(points), got(spark, points)
    assert out.keys() == want.keys() and all(abs(out[k] - want[k]) <= 1e-12 * max(1, want[k]) for k in want)


def test_tiles_hold_few_places_and_an_outlier_costs_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 50)
    pick = np.random.default_rng(2)
    places = np.concatenate([pick.random((3000, 2)) * 100, [[1e6, 1e6]]])
    side = 1e6
    df = spark.createDataFrame([(float(y), float(x), float(y / side) * 0.999, float(x / side) * 0.999) for y, x in places], "y double, x double, uy double, ux double")
    tiles = neighbours.tiled(df, len(places)).withColumns({"ty": neighbours._cell("uy", F.col("level")), "tx": neighbours._cell("ux", F.col("level"))})
    sizes = [r["count"] for r in tiles.groupBy("level", "ty", "tx").count().collect()]
    assert sum(sizes) == 3001 and max(sizes) <= 50 and len(sizes) < 400


def test_odd_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 1.0), (None, 0.0, 0.5), (4, 0.0, 3.0), (5, None, 1.0), (6, -0.0, 0.0)], "k long, y double, x double")
    assert {r.k: r.distance for r in neighbours.nearest(df, "k").collect()} == {1: 0.0, 6: 0.0, 4: 3.0}
    assert neighbours.nearest(df.where("k = 1"), "k").count() == 0 and neighbours.nearest(df.where("k = 99"), "k").count() == 0
