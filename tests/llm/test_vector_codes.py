import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import vector_codes


def brute(rows, entries=256, rounds=4):
    """vec_id to (code, error, label_error), and the digest, by all distances."""
    rows = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: r[0])
    x = np.array([[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows], np.int64)
    parts, out, books = np.split(x, 4, axis=1), [], []
    for part in parts:
        book = part[:entries].copy()
        for k in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            if k < rounds:
                for e in np.unique(near):
                    book[e] = part[near == e].sum(axis=0) // (near == e).sum()
        out.append((near, d.min(axis=1)))
        books.append(book)
    error = sum(d for _, d in out)
    labels = {}
    for r, e in zip(rows, error.tolist()):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    codes = ["".join(f"{near[i]:02x}" for near, _ in out) for i in range(len(rows))]
    return {r[0]: (codes[i], int(error[i]), labels[r[2]]) for i, r in enumerate(rows)}, digest


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = vector_codes.compress(df, **options).collect()
    want, digest = brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for k, v, n in rows], **options)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(spark, rows)


def test_few_entries_ties_and_odd_rows(spark):
    pick = np.random.default_rng(3)
    rows = [(i, (pick.integers(-3, 4, 8) / 1024).tolist(), int(i) % 3 if i % 5 else None) for i in range(300)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 1), (1004, [None] + [0.0] * 7, 1)]
    same(spark, rows, entries=7, rounds=3)
    same(spark, rows, entries=1)
    same(spark, rows[:5])


@pytest.mark.parametrize("dense", [0.0, 0.2, 2.0])
@pytest.mark.parametrize("spread", [1, 40, 1 << 24])
def test_bounds_leave_out_no_nearest_entry(monkeypatch, spread, dense):
    monkeypatch.setattr(vector_codes, "DENSE", dense)
    pick = np.random.default_rng(spread)
    for dim in (1, 3, 16):
        centres = pick.integers(-spread, spread + 1, (20, dim))
        x = centres[pick.integers(0, 20, 500)] + pick.integers(-(spread // 20) - 1, spread // 20 + 2, (500, dim))
        book = vector_codes.Codebook(x[pick.integers(0, 500, 100)].astype(np.int64))
        entry, distance, left = book.nearest(x.astype(np.int64))
        d = ((x[:, None].astype(object) - book.entries[None].astype(object)) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert left == sorted(left, reverse=True)
        if dim == 16 and spread > 1:
            assert left[-1] < 0.5 * d.size


def test_awkward_tables(spark):
    rows = [(1, [0.5, -0.5], 1), (1, [0.25, 0.5], 1), (None, [1e30, -1e30], None), (2, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("part", F.lit("x")).withColumn("error", F.lit(0))
    got = vector_codes.compress(df, entries=2).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "None"]
    assert all(len(r.code) == 8 for r in got)
    none = vector_codes.compress(df.where("vec_id > 9"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_many_labels_are_joined_with_a_salt(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "small", lambda df: False)
    same(spark, [(i, [float(i % 7), 0.0, 1.0, float(i)], None if i % 2 else i % 3) for i in range(50)])


def test_decoded_vectors_are_near(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows, dim = vector_codes.whole_vectors(df)
    books = vector_codes.fit(rows, dim)
    back = {r.vec_id: r for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect()}
    for r in df.limit(40).collect():
        d = (np.floor(1024 * np.array(r.embedding)) - np.round(1024 * np.array(back[r.vec_id].embedding))) ** 2
        assert d.sum() == back[r.vec_id].error
