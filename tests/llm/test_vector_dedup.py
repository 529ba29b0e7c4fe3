import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import vector_dedup


def brute(rows, least=0.98):
    """vec_id, n_links, component by all pairs."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {i: set() for i in range(len(rows))}
    by = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and ok(v):
            by.setdefault((label, len(v)), []).append(i)
    for own in by.values():
        x = np.array([rows[i][1] for i in own], "f8")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[own[a]].add(own[b])
    component = list(range(len(rows)))
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[i] = min(rows[j][0] for j in seen)
    return {r[0]: (len(links[i]), component[i]) for i, r in enumerate(rows)}


def test_recall_and_precision(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    pick = np.random.default_rng(4)
    base = pick.standard_normal((40, 64))
    extra = [b + 0.1 * pick.standard_normal(64) * (k > 0) for b in base for k in range(12)]
    rows += [(10_000 + i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(extra)]
    want = brute(rows)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=8).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] and r.component_id >= want[r.vec_id][1] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n for n, _ in want.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1)]
    rows += [(8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e200, 1e-200], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, [1.0, 0.0], 1, 0)], "vec_id long, embedding array<double>, label int, part int")
    df = df.withColumn("component", F.lit(1)).withColumn("copies", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    for k in (1, 2, 11, 13):
        assert got[k] == (3, 1, k == 1)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert got[k] == (0, k, True)
    assert got[None] == (0, None, False)
    assert vector_dedup.near_duplicates(df.where("vec_id > 99")).count() == 0
