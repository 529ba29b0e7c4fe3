import hashlib
import random

import numpy as np

from tesserae.llm import suffix_dedup

from .helpers import awkward, documents


def brute(rows, length=100):
    """Documents (doc_id, text), ids distinct, by a dictionary of all windows."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    got = suffix_dedup.dedup(documents(spark, rows).repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(rows)


def test_shared_passages_copies_and_periods(spark):
    pick = random.Random(1)
    prose = lambda n: " ".join("".join(pick.choice("abcdeé ") for _ in range(pick.randint(2, 9))) for _ in range(n))
    passages = [prose(60) for _ in range(4)] + ["ab" * 200, "x" * 300, prose(3)]
    texts = []
    for i in range(60):
        parts = [prose(pick.randint(5, 60)) for _ in range(3)]
        for k in range(2):
            p = pick.choice(passages)
            s = pick.randrange(len(p))
            parts.insert(pick.randrange(len(parts)), p[s // 3 :])
        texts.append("\n".join(parts))
    texts += [texts[3], texts[7], texts[3][:150], texts[5][40:], "y" * 99, "y" * 100, "y" * 101, None, "", texts[9] * 2]
    near = texts[11].split(" ")
    for k in range(10):
        near[pick.randrange(len(near))] = "edit"
        texts.append(" ".join(near))
    ids = list(range(len(texts)))
    pick.shuffle(ids)
    check(spark, list(zip(ids, texts)))


def test_long_documents_in_stretches(spark, monkeypatch):
    pick = random.Random(8)
    long = "".join(pick.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long), (2, "z" + long[4000:] + long[:500]), (3, long[100:7000])]
    small = suffix_dedup._send(8, 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows], pa.binary())], ["doc_id", "text"])

    def places(batches):
        out = set()
        for b in batches:
            for r in b.to_pylist():
                docs = np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32))
                numbers = [np.frombuffer(r[c], k).tolist() for c, k in (("high", "u4"), ("low", "u2"), ("around_high", "u4"), ("around_low", "u4"))]
                out |= set(zip(docs.tolist(), np.frombuffer(r["places"], np.int32).tolist(), *numbers))
        return out

    cut = places(small(iter([batch])))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400_000)
    assert cut == places(small(iter([batch])))
    check(spark, rows)


def test_deep_shallow_groups_equal_strings():
    pick = np.random.default_rng(3)
    rows = pick.integers(0, 2, (400, 6)).astype(np.uint64)
    order, group = suffix_dedup.deep_shallow(lambda s, i: rows[s, i], 400, 6)
    got = {}
    for s, g in zip(order.tolist(), group.tolist()):
        got.setdefault(g, []).append(s)
    want = {}
    for s in range(400):
        want.setdefault(tuple(rows[s]), []).append(s)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = suffix_dedup.dedup(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed))
    assert by[0] == by[1] == {(0, 0)} and by[None] == {(len(PROSE.encode()), 0)}
    assert by[4] == {(len(PROSE.encode()), len(PROSE.encode()))} and by[3] == {(len(PROSE.encode()), 0)}
    assert by[6] == {(3000, 2999)}
    assert suffix_dedup.dedup(documents(spark, [])).count() == 0


from .helpers import PROSE  # noqa: E402
