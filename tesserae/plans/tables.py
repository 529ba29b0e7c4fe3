"""The standard tables in the roles of this package's data: frames, profiles, traces, patches, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8  # vectors of 64 values are frames of 8 x 8 pixels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a frame of 8 x 8 for each vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("frame"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.col("embedding").alias("data")
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: metrics of components, a patch for each supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("patch"), F.col("l_extendedprice").alias("snr"), F.col("l_quantity").alias("r_value"),
        F.col("l_tax").alias("t_peak"), (F.col("l_returnflag") == "R").alias("flag"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer: a metric that is not always positive."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("patch"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("snr"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: samples of one trace for each user, by hour."""
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), hour.alias("t"), F.col("value").alias("v"), "event_id")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a component for each vector with its values above 0.1, a patch for each label; pixels counted down columns."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("patch"), F.col("vec_id").cast("int").alias("k"), F.posexplode("embedding").alias("p", "w"))
    return rows.where("w > 0.1").withColumn("p", F.col("p").cast("long"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings again: the trace of a component is its first 16 values, its residual the next 16 (none for even ids)."""
    residual = F.when(F.col("vec_id") % 2 == 1, F.slice("embedding", 17, 16))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("patch"), F.col("vec_id").cast("int").alias("k"), F.slice("embedding", 1, 16).alias("c"), residual.alias("yra"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten patches of 6 x 6 in two rows, each with one pixel of padding: h = w = 8."""
    n = F.col("id").cast("int")
    y0, x0 = F.expr("cast(id div 5 * 6 as int)"), (n % 5 * 6).cast("int")
    return spark.range(10).select(n.cast("string").alias("name"), F.lit(8).alias("h"), F.lit(8).alias("w"), y0.alias("y0"), (y0 + 6).alias("y1"), x0.alias("x0"), (x0 + 6).alias("x1"))
