"""Traces and regions for viewing: statistics, layouts, memberships."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from . import selection

COLOURS = 6  # default colours that regions take in turn


def trace_stats(traces: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, mean, std, p05, p95) of each trace, inside its row."""
    v = F.col(values)
    return traces.select(*keys, arrays.mean(v).alias("mean"), arrays.std(v).alias("std"), arrays.percentile(v, 0.05).alias("p05"), arrays.percentile(v, 0.95).alias("p95"))


def sample_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same from a row for each sample. Percentiles are found by counting, so a trace may be of any length."""
    v = F.col(value).cast("double")
    moments = samples.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    ends = selection.percentiles(samples, keys, value, {"p05": 0.05, "p95": 0.95})
    named = [F.col(k).alias(f"_{k}") for k in keys]
    ends = ends.select(*named, "p05", "p95")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return moments.join(ends, same, "left").select(*keys, "mean", "std", "p05", "p95")


def heat_levels(samples: DataFrame, stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """z-scores held to -2.5..4.5; a mean that is not finite is 0, such a deviation is 1."""
    mean = F.when(arrays.finite(F.col("mean")), F.col("mean")).otherwise(F.lit(0.0))
    std = F.when(arrays.finite(F.col("std")), F.col("std")).otherwise(F.lit(1.0))
    z = (F.col(value).cast("double") - mean) / F.greatest(std, F.lit(1e-6))
    level = F.greatest(F.least(z, F.lit(4.5)), F.lit(-2.5))
    return samples.join(stats.select(*keys, "mean", "std"), keys).withColumn("z", level).drop("mean", "std")


def layout(neurons: DataFrame, step: float = 1.08, gap: float = 0.9) -> DataFrame:
    """Adds offset: rows (roi, id, x, y) lie `step` apart by x, then y, with a gap between regions."""
    within = W.partitionBy("roi").orderBy("x", "y", "id")
    rows = neurons.withColumn("_r", F.row_number().over(within) - 1)
    sizes = rows.groupBy("roi").agg(F.count("*").alias("_n"))
    before = F.sum(F.col("_n") * step + gap).over(W.orderBy("roi").rowsBetween(W.unboundedPreceding, -1))  # a row for each region
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0.0))).drop("_n")
    return rows.join(starts, "roi").withColumn("offset", F.col("_start") + F.col("_r") * step).drop("_r", "_start")


def laid_out(samples: DataFrame, stats: DataFrame, offsets: DataFrame, value: str) -> DataFrame:
    """Samples scaled by their trace's 5th to 95th percentile and moved down by its offset."""
    joined = samples.join(stats.select("id", "p05", "p95"), "id").join(offsets.select("id", "offset"), "id")
    scaled = (F.col(value).cast("double") - F.col("p05")) / F.greatest(F.col("p95") - F.col("p05"), F.lit(1e-6))
    return joined.withColumn("level", scaled - F.col("offset")).drop("p05", "p95", "offset")


def dense_ids(components: DataFrame, keys: list[str]) -> DataFrame:
    """Adds id: 0.. in the order of the keys.

    Ranges of the keys are numbered side by side and shifted by the sizes of the ranges before, so no task sees all rows.
    """
    parts = int(components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = components.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select(F.col("_part"), F.coalesce(before, F.lit(0)).alias("_start"))
    rows = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*keys)))
    return rows.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_r") - 1).drop("_part", "_start", "_r")


def region_styles(regions: DataFrame, order: str) -> DataFrame:
    """Adds ordinal, default name and colour number of each region; there are few regions."""
    n = F.row_number().over(W.orderBy(order))
    return regions.withColumn("ordinal", n).withColumn("name", F.concat(F.lit("ROI "), F.col("ordinal").cast("string"))).withColumn("colour", F.pmod(F.col("ordinal") - 1, F.lit(COLOURS)))


def with_regions(neurons: DataFrame, members: DataFrame, default: str = "unassigned") -> DataFrame:
    """Neurons with their region, or the default."""
    return neurons.join(members.select(F.col("neuron_id").alias("id"), F.col("roi_id").alias("roi")), "id", "left").withColumn("roi", F.coalesce("roi", F.lit(default)))


def valid_members(stored: DataFrame, neurons: DataFrame, order: str) -> DataFrame:
    """Stored members that still exist; a neuron in several regions stays in the first."""
    alive = stored.join(neurons.select(F.col("id").alias("neuron_id")), "neuron_id", "left_semi")
    first = alive.withColumn("_r", F.row_number().over(W.partitionBy("neuron_id").orderBy(order, "roi_id")))
    return first.where("_r = 1").drop("_r")


def toggled(members: DataFrame, neuron_id: int, roi: str) -> DataFrame:
    """A click: out of the region if the neuron is in it, else into it alone."""
    inside = members.where((F.col("neuron_id") == neuron_id) & (F.col("roi_id") == roi)).limit(1)
    rest = members.where(F.col("neuron_id") != neuron_id)
    one = members.sparkSession.range(1).select(F.lit(roi).alias("roi_id"), F.lit(neuron_id).cast("long").alias("neuron_id"))
    return rest.select("roi_id", "neuron_id").unionByName(one.join(inside.select(F.lit(1)), F.lit(True), "left_anti"))


def top_peaks(samples: DataFrame, keys: list[str], time: str, value: str, n: int = 10, least: float = 0.3) -> DataFrame:
    """The n highest samples over a threshold of each trace, with their rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), time))
    return samples.where(F.col(value) > least).withColumn("rank", rank).where(F.col("rank") <= n)


def packed(traces: DataFrame) -> DataFrame:
    """(id, data): each trace (id, v) as the bytes of its single-precision values, as a raw buffer holds them, row after row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v is None else np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["id", "data"])

    return traces.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(pack, "id long, data binary")


def buffer_size(buffers: DataFrame) -> DataFrame:
    """One row (n, length, complete): traces, values in each, and whether the buffer holds n times length of them."""
    size = F.octet_length("data") / 4
    sums = buffers.agg(F.count("*").alias("n"), F.max(size).alias("length"), F.coalesce(F.sum(size), F.lit(0.0)).alias("total"))
    length = F.coalesce("length", F.lit(0.0))
    return sums.select("n", length.cast("long").alias("length"), (F.col("total") == F.col("n") * length).alias("complete"))


def active_source(available: F.Column, wanted: F.Column, order: tuple[str, ...] = ("c", "c_plus_yra")) -> F.Column:
    """The wanted trace source if it is available, else the first that is, else the wanted one."""
    there = F.filter(F.array(*map(F.lit, order)), lambda s: F.array_contains(available, s))
    return F.when(F.array_contains(there, wanted) | (F.size(there) == 0), wanted).otherwise(F.get(there, F.lit(0)))


def pending(requested: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is asked for and not there yet."""
    return requested.join(done, on, "left_anti")
