"""Quality control of components: fits of metrics, z-score predicates, threshold sweeps, summaries.

A metric is (column, scale); a bound is (lower_z, upper_z), either may be None. Fits are one row for each metric, so they
are broadcast to the profile, which is never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


@dataclass(frozen=True)
class Metric:
    key: str
    scale: str = "linear"
    lower_z: float | None = None
    upper_z: float | None = None
    high_is_bad: bool = False

    def __post_init__(self):
        if self.scale not in ("linear", "log", "boolean"):
            raise ValueError(f"unknown scale {self.scale}")
        if self.scale == "boolean" and (self.lower_z is not None or self.upper_z is not None):
            raise ValueError("a flag has no z-score to bound")


def qc_space(value: Column, scale: str) -> Column:
    """The metric as it is judged: as it is, or its logarithm to base 10, minus infinity where there is none."""
    v = value.cast("double")
    if scale == "linear":
        return v
    return F.when(arrays.finite(v) & (v > 0), F.log10(v)).otherwise(F.lit(float("-inf")))


def fit(profile: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(metric, scale, mean, std): a normal fit of each metric over its finite (for log: positive) values; a std of 0 is 1.

    Flags have no fit: bool_counts counts them.
    """
    parts, metrics = [], [m for m in metrics if m.scale != "boolean"]
    for m in metrics:
        v = F.col(m.key).cast("double")
        good = arrays.finite(v) & (v > 0) if m.scale == "log" else arrays.finite(v)
        x = F.when(good, F.log10(v) if m.scale == "log" else v)
        std = F.stddev_pop(x)
        parts += [F.avg(x).alias(f"mean_{m.key}"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"std_{m.key}")]
    row = profile.agg(*parts)
    one = [F.struct(F.lit(m.key).alias("metric"), F.lit(m.scale).alias("scale"), F.col(f"mean_{m.key}").alias("mean"), F.col(f"std_{m.key}").alias("std")) for m in metrics]
    return row.select(F.inline(F.array(*one)))


def specs(stats: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Fits joined with bounds (key, scale, mean, std, lower_z, upper_z); metrics without a bound are left out.

    A bounded metric without a finite fit fails.
    """
    bounded = [m for m in metrics if m.lower_z is not None or m.upper_z is not None]
    spark = stats.sparkSession
    rows = [(m.key, m.lower_z, m.upper_z) for m in bounded]
    bounds = spark.createDataFrame(rows, "key string, lower_z double, upper_z double")
    out = bounds.join(stats, bounds["key"] == stats["metric"], "left").select("key", "scale", "mean", "std", "lower_z", "upper_z")
    good = arrays.finite(F.col("mean")) & arrays.finite(F.col("std")) & (F.col("std") > 0)
    return out.withColumn("std", F.when(good, F.col("std")).otherwise(F.raise_error(F.concat(F.lit("no fit for "), "key"))))


def rejected(z: Column, lower: Column, upper: Column) -> Column:
    """Whether a z-score is out of bounds; null bounds don't bind, and NaN is kept."""
    out = (lower.isNotNull() & (z < lower)) | (upper.isNotNull() & (z > upper))
    return F.coalesce(~F.isnan(z) & out, F.lit(False))


def with_keep(profile: DataFrame, stats: DataFrame, metrics: list[Metric]) -> DataFrame:
    """The profile and keep: whether every bounded metric is within its bounds."""
    metrics = [m for m in metrics if m.scale != "boolean"]
    wide = stats.agg(*[F.max(F.when(F.col("metric") == m.key, F.struct("mean", "std"))).alias(f"_{m.key}") for m in metrics])
    joined = profile.crossJoin(F.broadcast(wide))  # one row
    keep = F.lit(True)
    for m in metrics:
        z = (qc_space(F.col(m.key), m.scale) - F.col(f"_{m.key}.mean")) / F.col(f"_{m.key}.std")
        keep = keep & ~rejected(z, F.lit(m.lower_z).cast("double"), F.lit(m.upper_z).cast("double"))
    return joined.withColumn("keep", keep).drop(*(f"_{m.key}" for m in metrics))


def summary(judged: DataFrame, patch: str) -> DataFrame:
    """(patch, n_before, n_after) of a profile with keep."""
    return judged.groupBy(patch).agg(F.count("*").alias("n_before"), F.count_if("keep").alias("n_after"))


def bool_counts(profile: DataFrame, flag: str) -> DataFrame:
    return profile.agg(F.count_if(~F.col(flag)).alias("false_count"), F.count_if(flag).alias("true_count"))


def truth(text: Column) -> Column:
    """Text as a flag: 1, true, t, yes and y hold in any case; all else does not."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def render_values(profile: DataFrame, metric: Metric, keys: list[str]) -> DataFrame:
    """(keys, value): the metric for display: log with non-positive values at the least positive one, what is not finite at
    the mean, held to three deviations about the mean; a flag as 0 or 1."""
    v = F.col(metric.key).cast("double")
    if metric.scale == "boolean":
        return profile.select(*keys, F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).alias("value"))
    if metric.scale == "log":
        positive = F.when(arrays.finite(v) & (v > 0), v)
        floor = profile.agg(F.min(positive).alias("_floor"))
        raised = F.when(arrays.finite(v), F.log10(F.greatest(v, F.col("_floor")))).otherwise(F.lit(float("nan")))
        space = profile.crossJoin(F.broadcast(floor)).select(*keys, raised.alias("x"), F.log10(positive).alias("f"))
    else:
        space = profile.select(*keys, v.alias("x"), F.when(arrays.finite(v), v).alias("f"))
    std = F.stddev_pop("f")
    fitted = space.agg(F.avg("f").alias("_m"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("_s"))
    out = space.crossJoin(F.broadcast(fitted))
    x = F.when(arrays.finite(F.col("x")), F.col("x")).otherwise(F.col("_m"))
    return out.select(*keys, F.greatest(F.least(x, F.col("_m") + 3 * F.col("_s")), F.col("_m") - 3 * F.col("_s")).alias("value"))


def sweep(profile: DataFrame, stats: DataFrame, metric: Metric) -> DataFrame:
    """(cut, n_rejected, n_kept) for 61 cuts from -3 to 3 deviations; z is turned round where high values are bad.

    A flag has one row, without a cut: what it marks is rejected, what is null too little known to be.
    """
    if metric.scale == "boolean":
        marked = F.coalesce(F.col(metric.key).cast("boolean"), F.lit(False))
        return profile.agg(F.lit(None).cast("double").alias("cut"), F.count_if(marked).alias("n_rejected"), F.count_if(~marked).alias("n_kept"))
    one = stats.where(F.col("metric") == metric.key).select("mean", "std")
    z = (qc_space(F.col(metric.key), metric.scale) - F.col("mean")) / F.col("std")
    z = -z if metric.high_is_bad else z
    # each value falls between two cuts: count by that place, then sum over the cuts, instead of a row for each cut
    place = F.when(F.isnan(z), F.lit(61)).otherwise(F.least(F.greatest(F.floor(z * 10 + 30) + 1, F.lit(0)), F.lit(61)))
    edge = F.when(place.between(1, 61) & ~F.isnan(z) & (z < (place - 1 - 30) / 10.0), place - 1).when((place < 61) & (z >= (place - 30) / 10.0), place + 1).otherwise(place)
    counts = profile.crossJoin(F.broadcast(one)).groupBy(edge.cast("int").alias("place")).agg(F.count("*").alias("n"))
    cuts = profile.sparkSession.range(61).select(F.col("id").cast("int").alias("i"), ((F.col("id") - 30) / 10.0).alias("cut"))
    rows = cuts.crossJoin(F.broadcast(counts))  # 61 by at most 62
    return rows.groupBy("cut").agg(F.coalesce(F.sum(F.when(F.col("place") <= F.col("i"), F.col("n"))), F.lit(0)).alias("n_rejected"), F.coalesce(F.sum(F.when(F.col("place") > F.col("i"), F.col("n"))), F.lit(0)).alias("n_kept"))


def threshold_label(value: Column, kind: str = "value", decimals: int | None = None) -> Column:
    """How a threshold is written: a fixed number of decimals; else scientific from 100 on and below 0.01, else trimmed."""
    if decimals is not None:
        text = F.format_string(f"%.{decimals}f", value)
    else:
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")
        big = (F.abs(value) >= 100) | ((F.abs(value) < 0.01) & (value != 0))
        text = F.when(big, F.format_string("%.6e", value)).otherwise(plain)
    return F.concat(F.lit(f"reject: {kind} < "), text)


def map_label(value: Column, key: str, scale: str = "linear") -> Column:
    """How a value is written on a map: a flag as 1 or 0, a time with one decimal, else with two; scientific from 100 on
    and below 0.01.
    """
    if scale == "boolean":
        return F.when(value.cast("boolean"), F.lit("1")).otherwise(F.lit("0"))
    v = value.cast("double")
    if key in ("t_peak", "t_half"):
        return F.format_string("%.1f", v)
    far = (F.abs(v) >= 100) | ((F.abs(v) > 0) & (F.abs(v) < 0.01))
    return F.when(far, F.format_string("%.2e", v)).otherwise(F.format_string("%.2f", v))


def counts_by(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, n): how many rows of each kind, such as the anchors of a mosaic."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def incomplete_profiles(profile: DataFrame, components: DataFrame, patch: str = "patch", k: str = "component_index") -> DataFrame:
    """(patch, rows, n, least, most) of patches whose profile has not one row for each component 0..n-1."""
    own = profile.groupBy(patch).agg(F.count("*").alias("rows"), F.min(k).alias("least"), F.max(k).alias("most"))
    out = components.select(patch, "n").join(own, patch, "full")
    bad = F.col("rows").isNull() & (F.col("n") > 0) | F.col("n").isNull() | (F.col("rows") != F.col("n")) | (F.col("least") < 0) | (F.col("most") >= F.col("n"))
    return out.where(bad).select(patch, "rows", "n", "least", "most")


def profiles_of_models(models: DataFrame, profile: DataFrame, patch: str = "patch", k: str = "component_index") -> DataFrame:
    """The profile rows of the models (patch, n components) that have a profile; the others are passed over.

    A profile that has not one row for each component 0..n-1 of its model fails, naming the patch.
    """
    own = profile.groupBy(patch).agg(F.count("*").alias("_rows"), F.countDistinct(k).alias("_different"), F.min(k).alias("_least"), F.max(k).alias("_most"))
    sized = models.select(patch, F.col("n").alias("_n")).join(own, patch)
    whole = (F.col("_rows") == F.col("_n")) & (F.col("_different") == F.col("_n")) & (F.col("_least") == 0) & (F.col("_most") == F.col("_n") - 1)
    said = F.concat(F.lit("profile of patch "), F.col(patch).cast("string"), F.lit(" does not fit its model"))
    checked = sized.withColumn("_ok", F.when(whole, True).otherwise(F.raise_error(said).cast("boolean"))).where("_ok")
    return profile.join(checked.select(patch), patch)


def metric_histogram(profile: DataFrame, key: str, bins: int = 80) -> DataFrame:
    """(bin, n, density) of the finite values; the top edge belongs to the last bin."""
    good = profile.where(arrays.finite(F.col(key))).select(F.col(key).cast("double").alias("v"))
    ends = good.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("total"))
    rows = good.crossJoin(F.broadcast(ends)).where("b > a")
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(at.alias("bin"), "total", width.alias("width")).agg(F.count("*").alias("n"))
    return out.select("bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def kernel_means(profile: DataFrame) -> DataFrame:
    """One row: mean autoregressive coefficients and mean times over the components that have them."""
    keys = ("g_0", "g_1", "t_peak", "t_half")
    return profile.agg(*[F.avg(F.when(arrays.finite(F.col(c)), F.col(c))).alias(c) for c in keys])
