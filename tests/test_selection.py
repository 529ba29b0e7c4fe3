"""Percentiles by counting against numpy."""

import math

import numpy as np
import pytest

from tesserae import checkpoints
from tesserae.operators import selection, traces


def got(spark, rows, shares, keys=("k",)):
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    out = selection.percentiles(df, list(keys), "v", {f"s{k}": q for k, q in enumerate(shares)})
    return {r[0] if keys else None: list(r)[len(keys) :] for r in out.collect()}


@pytest.mark.parametrize("most", [selection.SORTED, 3])
def test_groups_of_all_kinds(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "SORTED", most)
    monkeypatch.setattr(selection, "BUCKETS", 16)
    pick = np.random.default_rng(3)
    groups = {
        "one": [5.0], "equal": [-2.5] * 40, "wide": (10.0 ** pick.integers(-300, 300, 60) * pick.choice([-1, 1], 60)).tolist(),
        "near": (1e6 + pick.random(80) * 1e-6).tolist(), "signs": pick.normal(size=101).tolist(), "zeros": [0.0, -0.0, 5e-324, -5e-324, 0.0, 1.0],
        None: pick.normal(size=20).tolist(),
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("one", None), ("none", None)]
    shares = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    out = got(spark, rows, shares)
    assert out.keys() == groups.keys()
    for k, own in groups.items():
        assert np.allclose(out[k], np.quantile(own, shares), rtol=1e-12, atol=0), k


def test_ends_that_are_not_finite(spark):
    rows = [("a", math.inf), ("a", -math.inf), ("a", 1.0), ("b", math.nan), ("b", 2.0), ("b", 1.0)]
    out = got(spark, rows, [0.0, 0.5, 1.0])
    assert out["a"] == [-math.inf, 1.0, math.inf] and out["b"][:2] == [1.0, 2.0] and math.isnan(out["b"][2])


def test_one_group_without_keys(spark):
    pick = np.random.default_rng(4)
    values = np.round(pick.lognormal(3, 2, 20_000), 3)
    out = got(spark, [("x", float(v)) for v in values], [0.01, 0.5, 0.999], keys=())
    assert np.allclose(out[None], np.quantile(values, [0.01, 0.5, 0.999]), rtol=1e-12)
    assert got(spark, [("x", None)], [0.5], keys=()) == {}


def test_sample_statistics_of_null_keys(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)]
    out = {r.k: tuple(r)[1:] for r in traces.sample_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert out[None][:2] == (2.0, 1.0) and abs(out[None][2] - 1.1) < 1e-12 and out["a"] == (2.0, 0.0, 2.0, 2.0)
    assert out["b"] == (None, None, None, None)


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    rows = spark.range(1000).selectExpr("id", "repeat('x', 2000) as text")
    assert "broadcast" in plan(checkpoints.few(rows.limit(10)))
    assert "broadcast" not in plan(checkpoints.few(rows, most_mb=1))
