"""Words of whole blocks: the same tokens as text by text, each different word hashed once."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash

from tesserae.llm import lm

ODD = ["", " ", None, "\x0b a\x0cB \x1c c\x85 f", "İSTANBUL ß É a", "\x00x\x00", "...", " ...a,, B", "x" * 5000 + "  y", None, "\ta\t"]


def encoded(texts):
    leaves = lm.Leaves([(lm.number_of(b"a"), 5)], np.full((2, lm.CODES), 100.0), 10)
    raw = pa.array([x if x is None else x.encode() for x in texts], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), raw], ["doc_id", "text"])
    rows = [r for b in lm._encode(leaves, 3, 7, 2)([batch]) for r in b.to_pylist()]
    return leaves, raw.to_pylist(), rows


def test_leaves_of_odd_texts(monkeypatch):
    for size in (1, 60, 1 << 20):
        monkeypatch.setattr(lm, "TEXT", size)
        leaves, texts, rows = encoded(ODD)
        want = [[*(leaves.of(lm.number_of(w)) for w in lm.tokens_of(x)), len(leaves) - 1] for x in texts]
        assert [r["doc_id"] for r in rows] == list(range(len(ODD)))
        assert [np.frombuffer(r["ids"], np.int16).tolist() for r in rows] == want


def test_words_of_a_block_are_hashed_once(monkeypatch):
    calls = []
    counted = lambda word: calls.append(1) or xxhash.xxh3_64_intdigest(word)
    monkeypatch.setattr(lm, "xxhash", SimpleNamespace(xxh3_64_intdigest=counted))
    encoded([" ".join(f"w{k}" for k in range(210_000))] * 3)
    assert len(calls) < 250_000  # by words remembered up to a bound: over a million
