"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key, 64 sign bits of random projections; vectors of one label and dimension are ordered by
it, range-partitioned over the cluster, and each is compared with its next `window` neighbours. Verified pairs of all
passes are joined into components. A pass can part a near pair, so recall comes from the number of passes; the tests
measure it against brute force. Links are then counted inside each component, in blocks, as counts and not as pairs.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, or whose label is null,
link with nothing; vectors of different dimension don't link; equal vectors are compared once and link with each other;
rows that repeat an id are vectors of their own within one component; a null id has a null component and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, by_key, durable, partitions
from .graph import components

BITS = 64


def planes(run: int, dim: int) -> np.ndarray:
    return np.random.default_rng((run, dim, 2027)).standard_normal((dim, BITS))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one dimension as unit rows in double precision; kind: how they are packed, as the table has them."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(kind: str):
    """Rows that can link: label, id, packed vector, its dimension."""

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for label, key, vector in zip(*(b.column(c).to_pylist() for c in ("label", "vec_id", "embedding"))):
                if label is None or key is None or not vector or None in vector:
                    continue
                x = np.array(vector, kind)
                if np.isfinite(x).all() and x.any():
                    rows.append((label, key, (x + x.dtype.type(0)).tobytes(), len(x)))  # no negative zero
            if rows:
                types = [b.schema.field("label").type, pa.int64(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["label", "vec_id", "vector", "dim"])

    return valid


def _keys(passes: int, kind: str):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                x = unit(own.column("vector").to_pylist(), kind)
                for run in range(passes):
                    key = np.packbits(x @ planes(run, dim) > 0, axis=1)
                    columns = [pa.array(np.full(len(x), run, np.int32)), own.column("label"), own.column("dim")]
                    columns += [pa.array([k.tobytes() for k in key], pa.binary()), own.column("vec_id"), own.column("vector")]
                    yield pa.RecordBatch.from_arrays(columns, ["run", "label", "dim", "key", "vec_id", "vector"])

    return keys


def _neighbours(window: int, least: float, kind: str):
    """Over one sorted partition: pairs within the window that reach the cosine, as a forest."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = b if held is None else pa.concat_batches([held, b])
            held = t.slice(max(0, t.num_rows - window))
            group = list(zip(t.column("run").to_pylist(), t.column("label").to_pylist(), t.column("dim").to_pylist()))
            edges = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            ids, us, vs = t.column("vec_id").to_numpy(), [], []
            raw = t.column("vector").to_pylist()
            for s, e in zip(edges, edges[1:]):
                if e - s < 2:
                    continue
                x = unit(raw[s:e], kind)
                for shift in range(1, min(window, e - s - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[:-shift], x[shift:]) >= least)
                    us.append(ids[s:e][near])
                    vs.append(ids[s:e][near + shift])
            if us:
                u, v = _forest(np.concatenate(us), np.concatenate(vs))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return neighbours


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    return nodes, [find(x) for x in nodes]


def pairs(vectors: DataFrame, least: float, passes: int, window: int, kind: str) -> DataFrame:
    """(u, v): pairs found in any pass, as forests. vectors: label, dim, vec_id, vector."""
    parts = partitions(vectors.sparkSession)
    keyed = vectors.transform(arrow, _keys(passes, kind), f"run int, label {vectors.schema['label'].dataType.simpleString()}, dim int, key binary, vec_id long, vector binary")
    order = ["run", "label", "dim", "key", "vec_id"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = durable(ranged)
    # the first rows of each range also follow the range before, so no window ends at a border
    firsts = ranged.transform(arrow, _firsts(window), ranged.schema).withColumn("part", F.col("part") - 1).where("part >= 0")
    dealt = ranged.unionByName(firsts).repartition(parts, "part").sortWithinPartitions("part", *order)
    return dealt.transform(arrow, _neighbours(window, least, kind), "u long, v long")


def _firsts(window: int):
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = window
        for b in batches:
            if left:
                head = b.slice(0, left)
                left -= head.num_rows
                yield head

    return firsts


def _counts(least: float, kind: str):
    """Rows of (component, i, j) blocks: how many vectors, copies counted, each row of block i links with in block j."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = by_key(batches)
        if t is None:
            return
        keys = np.stack([t[c].to_numpy() for c in ("component", "i", "j")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), keys.shape[1]]
        raw, ids, copies, part = (t[c].to_pylist() for c in ("vector", "vec_id", "copies", "part"))
        order = order.tolist()
        for s, e in zip(edges, edges[1:]):
            own = order[s:e]
            x = unit([raw[k] for k in own], kind)
            here = np.array([part[k] for k in own])
            i, j = int(keys[1, s]), int(keys[2, s])
            rows, columns = np.flatnonzero(here == i), np.flatnonzero(here == j)
            weight = np.array([copies[k] for k in own], np.int64)
            near = x[rows] @ x[columns].T >= least
            near |= rows[:, None] == columns[None, :]
            out = pa.array((near * weight[columns]).sum(axis=1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([ids[own[k]] for k in rows.tolist()], pa.int64()), out], ["vec_id", "n"])

    return counts


def near_duplicates(
    embeddings: DataFrame, least: float = 0.98, passes: int = 16, window: int = 40, block: int = 256
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    packed = "<f4" if single else "<f8"
    own = embeddings["embedding"] if single else embeddings["embedding"].cast("array<double>")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), "label", own.alias("embedding"))
    kind = rows.schema["label"].dataType.simpleString()
    valid = rows.transform(arrow, _valid(packed), f"label {kind}, vec_id long, vector binary, dim int")
    classes = durable(valid.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    found = durable(pairs(classes.drop("copies"), least, passes, window, packed).distinct())
    named = components(found, "u", "v").withColumnRenamed("id", "vec_id")
    grouped = durable(classes.join(named, "vec_id"))
    sizes = grouped.groupBy("component", "label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = grouped.join(sizes, ["component", "label", "dim"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("part").alias("i"), k.alias("j")))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("i"), F.col("part").alias("j")))
    tasks = dealt.withColumn("task", F.explode(F.array_distinct(F.concat(every, other))))
    tasks = tasks.select("component", "task.i", "task.j", "part", "vec_id", "copies", "vector").repartition(partitions(embeddings.sparkSession), "component", "i", "j")
    linked = tasks.transform(arrow, _counts(least, packed), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_class = classes.join(linked, "vec_id", "left").join(named, "vec_id", "left")
    of_class = of_class.select(
        "label", "dim", "vector", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    linkable = valid.join(of_class, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.transform(arrow, _invalid, "vec_id long")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linkable.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _invalid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the rows that _valid leaves out."""
    for b in batches:
        ids = []
        for label, key, vector in zip(*(b.column(c).to_pylist() for c in ("label", "vec_id", "embedding"))):
            if label is None or key is None or not vector or None in vector:
                ids.append(key)
                continue
            x = np.array(vector, "<f8")
            if not (np.isfinite(x).all() and x.any()):
                ids.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["vec_id"])
