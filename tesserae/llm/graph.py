"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow, durable


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, batch by batch, reduced to (node, smallest node it reaches there)."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


TASK = 100_000  # links of a task: link tables are far smaller than what they come from


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v. Large star: neighbours above a node move to its smallest one; small star: those below it do.

    A window per node, which spills, so that a hub needs no memory; every link gives one link, so they never grow more.
    moved: whether any of the two steps so far changed the link.
    """
    near = links
    if large:
        near = links.withColumn("moved", F.lit(False)).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("moved")))
    near = near.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
    first = F.col("v") == F.col("m")
    return near.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~first).alias("moved"))


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component): every node of links with the smallest node it reaches. Nodes without links are absent.

    Nulls and self-links are ignored; repeated and reversed links count once. An empty table gives an empty table.
    """
    start = links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u > v")
    links = durable(start.transform(arrow, _forest, "u long, v long").where("u > v"))
    tasks = links.count() // TASK + 4
    moved = True
    while moved:
        links = durable(_star(_star(links.select("u", "v").coalesce(tasks), True), False).coalesce(tasks))
        moved = links.agg(F.max("moved")).first()[0]
    links = links.select("u", "v").distinct()
    ids = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
