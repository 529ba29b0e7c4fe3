import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import ngram_join

from .helpers import awkward, documents


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """doc_id, n_shingles, component of every row."""
    sets = [shingle_set(t) for _, t in rows]
    place, parent = defaultdict(set), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            place[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in place[g] if j < i}:
            shared = len(s & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted({(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)}, key=str)


def test_random_families(spark):
    pick, vocabulary = random.Random(9), [f"w{i}" for i in range(400)]
    texts = []
    passage = [pick.choice(vocabulary) for _ in range(40)]
    for _ in range(30):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(6, 120))]
        for k in range(pick.choice([1, 2, 12])):
            own = base[:]
            for _ in range(pick.randint(0, 5)):
                own[pick.randrange(len(own))] = pick.choice(vocabulary)
            texts.append(" ".join(own))
        texts.append(" ".join(base[:8] + passage))
        texts.append(" ".join(passage + base[:3]))
    texts += ["one two", "One  two", "one two three", "x", "x"]
    rows = list(enumerate(texts))
    got = sorted([tuple(r) for r in ngram_join.join(documents(spark, texts)).collect()], key=str)
    assert got == brute(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = ngram_join.join(df).collect()
    assert len(rows) == df.count()
    assert sorted({tuple(r) for r in rows}, key=str) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_divide_skip_is_exact():
    pick = np.random.default_rng(5)
    for _ in range(200):
        pool = np.arange(1, 61, dtype=np.uint64)
        query = pick.permutation(pool)[: pick.integers(5, 50)]
        cells = [np.append(pick.permutation(query)[: pick.integers(1, len(query) + 1)], pick.permutation(pool[50:])[:2]) for _ in range(30)]
        cells = [np.unique(c) for c in cells]
        want = []
        for k, c in enumerate(cells):
            shared = len(np.intersect1d(query, c))
            if 100 * shared >= 75 * (len(query) + len(c) - shared):
                want.append(k)
        assert ngram_join.divide_skip(query, len(query), cells, [len(c) for c in cells]) == want


def test_one_document_of_each_component_stays(spark):
    text = "a text of more than five words stands here"
    df = documents(spark, [(5, text), (3, text), (9, "some other text that is not the same"), (7, None), (8, "")])
    assert sorted(r.doc_id for r in ngram_join.distinct_documents(df).collect()) == [3, 7, 8, 9]


def test_rows_go_by_id_and_text(spark):
    a, b = "a text of more than five words stands here", "another one of at least five words that is alone"
    rows = [(1, a), (5, a), (5, b), (7, a), (7, a), (9, b + " too"), (2, b), (2, b), (3, None), (3, None), (None, a)]
    df = documents(spark, rows).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.distinct_documents(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, None), (3, None), (None, a)], key=str)
    assert ngram_join.distinct_documents(df).columns == df.columns


def test_an_id_of_several_texts_keeps_the_others(spark):
    a, b = "a text of more than five words stands here", "quite other words are said in this one of that id"
    df = documents(spark, [(1, a), (5, a), (5, b), (7, a), (7, a)])
    assert sorted((r.doc_id, r.text) for r in ngram_join.distinct_documents(df).collect()) == [(1, a), (5, b)]
