"""Projections and statistics over arriving frames: the batch aggregates as streaming queries. An extension of the batch stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import movies


def frames(spark, path: str, per_batch: int = 8) -> DataFrame:
    """Movie files as they arrive in a folder."""
    from ..schemas import MOVIE

    return spark.readStream.schema(MOVIE).option("maxFilesPerTrigger", per_batch).parquet(path)


def running_projection(movie: DataFrame) -> DataFrame:
    """(y, x, n, total, mean, std) so far, for output mode complete or update. State: a row for each pixel."""
    v = F.col("v").cast("double")
    square = (F.col("v").cast("float") * F.col("v").cast("float")).cast("double")
    sums = movies.pixels(movie).groupBy("y", "x").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.avg(square).alias("_q"))
    return sums.withColumn("std", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_q")


def running_range(movie: DataFrame) -> DataFrame:
    return movies.value_range(movie)


def windowed_stats(samples: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """(window, keys, n, mean, std) of samples by event time; what is later than the watermark allows is left out."""
    v = F.col(value).cast("double")
    return samples.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
