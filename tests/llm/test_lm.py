import zlib
from collections import Counter
from math import log10

import numpy as np

from tesserae.llm import lm

from .helpers import awkward, documents


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for (d, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (d, t), h in zip(rows, held):
        own = tokens(t)
        out.append((d, h, len(own), sum(c[w] > 0 for w in own), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in own), 6)))
    return sorted(out, key=str)


def test_counts_and_base_score(spark, sf_dir):
    for df in (awkward(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = lm.score(df).collect()
        got = sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in rows], key=str)
        assert got == brute([(r.doc_id, r.text) for r in df.collect()])
        assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > (1 - 0.066) * sum(r.base_score for r in rows)  # both below zero; 6.89 % measured
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_partitions_do_not_change_the_score(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = ({r.doc_id: r.score for r in lm.score(df.repartition(k)).collect()} for k in (1, 64))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 1e-6 * abs(one[k]) for k in one)


def small(counts, codes=1):
    """Leaves of words with these counts, the last one the end's."""
    tokens, words = np.zeros(lm.CODES), np.zeros(lm.CODES)
    top = [(k + 1 if k < len(counts) - 1 else lm.END, n) for k, n in enumerate(counts)]
    for number, n in top:
        tokens[number % lm.CODES] += n
        words[number % lm.CODES] += 1
    return top, np.stack([tokens, words])


def test_leaves_hold_every_word_once():
    top, codes = small([50, 20, 10, 5, 30, 12])
    codes[0, 77] += 9
    codes[1, 77] += 4
    leaves = lm.Leaves(top, codes, 3)  # two words are left to the leaves of spelling
    assert len(leaves.numbers) == 3 and leaves.counts.sum() == codes[0].sum() and leaves.counts[-1] == 12
    assert leaves.others.sum() == 2 + 4 and leaves.others[77 % leaves.spelled] >= 4
    assert all(0 <= leaves.of(number) < len(leaves) - 1 for number in (1, 5, 2**64 - 1))
    assert lm.number_of(b"(going),") % lm.CODES == lm.number_of(b"being") % lm.CODES != lm.number_of(b"gone") % lm.CODES


def test_probabilities_add_up_to_one():
    counts = np.array([50.0, 20, 10, 5, 30, 12, 3])
    model = lm.LogBilinear(counts)
    pick = np.random.default_rng(3)
    target = pick.integers(0, 7, 5000).astype(np.int16)
    before = np.stack([np.roll(target, k + 1) for k in range(model.context)], axis=1)
    model.train(before, target, 1, 0.1)
    total = sum(np.exp(model.log_probabilities(before[:50], np.full(50, k))) for k in range(7))
    assert np.allclose(total, 1, atol=1e-4)


def test_score_is_that_of_the_model(spark):
    """A model that was never trained gives its start: counts of leaves, and shares of the words inside."""
    docs = [(k, "aa bb aa cc zz") for k in range(40) if not lm.held_out(k, 7, 2)] + [(k, "aa qq zz") for k in range(40) if lm.held_out(k, 7, 2)]
    rows = lm.score(documents(spark, docs)).collect()
    for r in rows:
        assert r.score < 0 and r.n_tokens == (4 if r.held_out else 6)
    # the probabilities of all next words, an unknown one of each leaf of spelling included, add up to one
    assert 10 ** max(r.score / r.n_tokens for r in rows) < 1


def test_contrastive_training_learns_the_context():
    # the next leaf is the last one plus one
    target = (np.arange(60_000) % 5).astype(np.int16)
    model = lm.LogBilinear(np.full(7, 100.0))
    before = np.stack([np.roll(target, k + 1) for k in range(model.context)], axis=1)
    first = model.log_probabilities(before[10:500], target[10:500]).mean()
    for k in range(4):
        model.train(before[10:], target[10:], k, 0.2)
    assert model.log_probabilities(before[10:500], target[10:500]).mean() > first + 0.7


def test_empty_table(spark):
    assert lm.score(documents(spark, [])).count() == 0
    own = next(k for k in range(9) if not lm.held_out(k, 7, 2))
    rows = lm.score(documents(spark, [(own, None), (own, "")])).collect()
    assert [(r.n_tokens, r.train_tokens) for r in rows] == [(1, 2), (1, 2)]
