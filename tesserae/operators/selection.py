"""Exact percentiles of large groups, by counting.

A value of a given rank is found by histograms: values are counted by power of two, the bucket that holds the rank is cut
into finer ones, and so on, until a bucket has one value or so few that they can be sorted. What tasks exchange are counts,
least and greatest values of buckets; no task sees a whole group, whether there is one group or millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import durable, few

BUCKETS = 4096
SORTED = 4096  # values of a bucket that are put in order at once


def _power(v: Column) -> Column:
    """A number that never falls as v grows: its sign and power of two. Infinities and NaN are powers of their own."""
    size = F.abs(v)
    power = F.when(size == math.inf, 1025).otherwise(F.greatest(F.floor(F.log2(size)), F.lit(-1075))) + 1076
    return F.when(F.isnan(v), 3000).when(v == 0, 0).when(v > 0, power).otherwise(-power).cast("int")


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    """b with its keys renamed, and the condition that all keys are equal, nulls too."""
    renamed = b
    for k in on:
        renamed = renamed.withColumnRenamed(k, f"_other_{k}")
    same = F.lit(True)
    for k in on:
        same = same & a[k].eqNullSafe(renamed[f"_other_{k}"])
    return renamed, same


def _holding(counts: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """For each wanted rank the bucket that holds it: its count and bounds, and the rank inside."""
    before = F.coalesce(F.sum("n").over(W.partitionBy(*on).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before)  # at most as many rows in a window as there are buckets
    other, same = _same(placed, wanted, on)
    held = placed.join(other, same & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    return held.select(*on, "share", "upper", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each share): percentiles between the two nearest values, in proportion; null values are left out.

    shares: the name of a column to its share, 0 to 1. Without keys there is one group; a group without values has no row.
    """
    on = [*keys, "_group"]
    data = rows.select(*keys, F.lit(0).alias("_group"), (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where("_v is not null")
    bounds = (F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    counts = data.groupBy(*on, _power(F.col("_v")).alias("bucket")).agg(*bounds)
    counts = durable(counts)
    totals = counts.groupBy(*on).agg(F.sum("n").alias("total"))
    at = lambda q: (F.col("total") - 1) * F.lit(float(q))
    ranks = [F.struct(F.lit(name).alias("share"), F.lit(up).alias("upper"), f(at(q)).cast("long").alias("rank")) for name, q in shares.items() for up, f in ((False, F.floor), (True, F.ceil))]
    wanted = totals.select(*on, F.explode(F.array(*ranks)).alias("one")).select(*on, "one.*")
    held = durable(_holding(counts, wanted, on))
    found = held.where("not low < high").select(*on, "share", "upper", F.col("low").alias("v"))
    while not (wide := held.where("low < high")).isEmpty():
        spans = few(wide.select(*on, "n", "low", "high").distinct())
        other, same = _same(data, spans, on)
        inside = data.join(other, same & (data["_v"] >= other["low"]) & (data["_v"] <= other["high"])).select(*on, "_v", "n", "low", "high")
        edges = [*on, "low", "high"]
        short = wide.where(F.col("n") <= SORTED)
        lists = inside.where(F.col("n") <= SORTED).groupBy(*edges).agg(F.sort_array(F.collect_list("_v")).alias("vs"))
        other, same = _same(short, lists, edges)
        done = short.join(other, same).select(*on, "share", "upper", F.get("vs", F.col("rank").cast("int")).alias("v"))
        step = (F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS
        finer = inside.where(F.col("n") > SORTED).groupBy(*edges, F.least(F.floor(step), F.lit(BUCKETS - 1)).alias("bucket"))
        finer = finer.agg(F.count("*").alias("m"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        finer = finer.withColumnsRenamed({"low": "_low", "high": "_high", "m": "n", "least": "low", "most": "high"})
        long = wide.where(F.col("n") > SORTED).select(*on, "share", "upper", "rank", F.col("low").alias("_low"), F.col("high").alias("_high"))
        held = durable(_holding(finer, long, [*on, "_low", "_high"]))
        found = durable(found.unionByName(done).unionByName(held.where("not low < high").select(*on, "share", "upper", F.col("low").alias("v"))))
    pick = lambda name, up: F.max(F.when((F.col("share") == name) & (F.col("upper") == up), F.col("v")))
    ends = [pick(name, up).alias(f"_{k}_{int(up)}") for k, name in enumerate(shares) for up in (False, True)]
    paired = found.groupBy(*on).agg(*ends)
    other, same = _same(paired, totals, on)
    out = paired.join(other, same)
    part = lambda q: at(q) - F.floor(at(q))
    values = []
    for k, (name, q) in enumerate(shares.items()):
        low, high = F.col(f"_{k}_0"), F.col(f"_{k}_1")
        values.append(F.when(low.eqNullSafe(high), low).otherwise(low * (1 - part(q)) + high * part(q)).alias(name))
    return out.select(*keys, *values)
