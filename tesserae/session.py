"""A Spark session with the settings that the plans of this package are written for."""

from pyspark.sql import SparkSession


def session(name: str = "tesserae", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.python.filterPushdown.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
