"""Cutting the lineage of tables that later steps read again."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_MB = 64  # of a table that is broadcast at most, on an executor with a gigabyte or more


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the folder that spark.checkpoint.dir names.

    Only a session on one machine (tests) gets a temporary folder where that setting is absent. The shuffle files of
    plans that a checkpoint has finished go when the driver's JVM collects its garbage; a driver with much memory seldom
    does, so on a cluster it is asked to here. With spark.cleaner.referenceTracking.cleanCheckpoints, checkpoints that
    nothing refers to any more go likewise.
    """
    sc = df.sparkSession.sparkContext
    one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    out = df.checkpoint()
    if not one_machine:
        del df
        gc.collect()
        sc._jvm.System.gc()
    return out


def row_bytes(df: DataFrame) -> F.Column:
    """About how large a row is in a broadcast: its values as text or bytes, and what a row costs besides."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) for name in df.columns]
    return sum(sizes, F.lit(64 + 16 * len(sizes)))


def small(df: DataFrame, most_mb: int = FEW_MB) -> bool:
    """Whether a written table is small enough to be broadcast, by the bytes of its rows."""
    return (df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0) <= most_mb << 20


def few(df: DataFrame, most_mb: int = FEW_MB) -> DataFrame:
    """The table written once; broadcast if it has few bytes, else left to a shuffled join."""
    df = durable(df)
    return F.broadcast(df) if small(df, most_mb) else df
