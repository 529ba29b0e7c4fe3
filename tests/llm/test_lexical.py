import math
import re
from collections import Counter, defaultdict

import numpy as np

from tesserae.llm import lexical

from .helpers import awkward, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=10):
    """(item, rank, doc, score) of all documents for each item."""
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            asked[item] |= set(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c, n in own:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, unknown, d) in enumerate(sorted(scored)[:most], 1):
            out.append((item, rank, None if unknown else d, -score))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_whole_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert rows_of(lexical.search(docs.repartition(3), items)) == want
    assert rows_of(lexical.search(docs.repartition(7), items, size=20_000, most_words=500)) == want


def test_ties_go_by_id_across_shards(spark):
    texts = [(i, "alpha beta" if i % 2 else "alpha beta gamma") for i in range(60)][::-1] + [(None, "alpha beta"), (7, "alpha beta")]
    docs, items = documents(spark, texts).repartition(4), spark.createDataFrame([(1, "beta"), (2, "gamma delta"), (3, "delta")], "item_id long, text string")
    got = rows_of(lexical.search(docs, items, size=30))
    assert got == brute(texts, pairs(items, "item_id", "text"))
    assert [d for i, _, d, _ in sorted(got) if i == 1] == [1, 3, 5, 7, 7, 9, 11, 13, 15, 17]


def test_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART", 50)
    docs = awkward(spark)
    texts = [(1, "the quick Fox"), (1, "mill"), (1, "mill"), (2, None), (None, "fox"), (3, ""), (4, "w7x7 w8x8 aé ÀÉ É é"), (5, "zzz"), (6, "the " * 50)]
    items = spark.createDataFrame(texts, "item_id long, text string")
    got = lexical.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == brute(pairs(docs, "doc_id", "text"), texts)
    for none in (lexical.search(docs.where("doc_id > 99"), items), lexical.search(docs, items.where("item_id > 99"))):
        assert none.count() == 0


def test_selection_keeps_what_equals_the_last():
    pick = np.random.default_rng(1)
    for _ in range(200):
        n = pick.integers(1, 40)
        scores, ids, known = pick.integers(0, 4, n), pick.permutation(n), pick.random(n) < 0.8
        want = sorted((-s, not k, i, at) for at, (s, i, k) in enumerate(zip(scores, ids, known)) if s > 0)[:5]
        assert lexical.top(scores, ids, known, 5).tolist() == [w[3] for w in want]


def test_norms_beyond_64_bits():
    n = np.array([1, 10**9, 5 * 10**9])
    assert lexical.norms(n, 10**10, 10**13).tolist() == [10 + 90 * int(x) * 10**10 // 10**13 for x in n.tolist()]
