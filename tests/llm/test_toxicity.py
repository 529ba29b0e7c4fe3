import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import toxicity

from .helpers import awkward, documents


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_viterbi_finds_the_best_path(learned):
    model, pick = learned[0].model, random.Random(2)

    def value(path):
        out, total, word = "", 0.0, "  "
        for c, cost in path:
            total += cost
            if c:
                total += model[toxicity._code(word[-2]), toxicity._code(word[-1]), toxicity._code(c)]
                word, out = word + c, out + c
        return total + (model[toxicity._code(word[-2]), toxicity._code(word[-1]), 0] if out else 0), out

    for _ in range(60):
        token = "".join(pick.choice("aelt1!$0.é3") for _ in range(pick.randint(1, 6)))
        best = max(value(p)[0] for p in product(*toxicity.lattice(token)))
        out = toxicity.decode(token, model)
        assert abs(max(v for p in product(*toxicity.lattice(token)) for v, o in [value(p)] if o == out) - best) < 1e-9


def test_skeletons_survive_the_channel():
    pick = random.Random(6)
    for _ in range(300):
        word = "".join(pick.choice("abcdefgilorstz") for _ in range(7))
        signs = {c: [s for s, to in toxicity.LEET.items() if c in to] for c in word}
        written = "".join(pick.choice([c, *signs[c]]) * pick.randint(1, 3) + pick.choice(["", ".", " "]) for c in word)
        assert toxicity.skeleton(written) == toxicity.skeleton(word)


def test_obfuscated_words_are_found(learned):
    restorer, weights, bias = learned
    worst = max((m for m in weights if m.endswith("$") and m[:-1].isascii()), key=weights.get)[:-1]
    leet = worst.translate(str.maketrans("oieas", "01345"))
    prose = "It was then that the other one came to be with them and "
    clean = toxicity._score_texts(restorer, weights, bias, [prose, "", None, "a b c d e f", "12345 !!! $$$ @@@"])
    assert max(clean) < 0.3 and clean[0] == clean[1] == clean[2]
    for form in (worst, worst.upper(), leet, " ".join(worst), ".".join(worst), worst[0] * 4 + worst[1:], f"({worst}!)", "y o u " + " ".join(worst)):
        assert restorer(prose + form) & {worst + "$", worst}, form


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.9


def test_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity.score(df, labels.where("toxic > 5")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.score(documents(spark, []), labels).count() == 0
    kept = toxicity.accepted(df, labels)
    assert kept.columns == df.columns


def test_logistic_regression_is_at_its_minimum():
    pick = np.random.default_rng(1)
    x = (pick.random((300, 6)) < 0.3).astype(float)
    y = (pick.random(300) < 1 / (1 + np.exp(2 - x @ np.arange(6)))).astype(float)
    w, b = toxicity.logistic(x, y, decay=0.5)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) + 0.5 * w
    assert np.abs(gradient).max() < 1e-2


def test_training_texts_that_begin_alike_all_count(spark):
    head = "One header that opens every page: "
    df = documents(spark, [*(f"{head}body {k}" for k in range(30)), *[head + "labelled both ways"] * 4])
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0 or k == 33)) for k in range(34)], "doc_id long, quality int, toxic int")
    rows = {bytes(r.text).decode(): r.toxic for r in toxicity.training_rows(df, labels, 4, 9, 100).collect()}
    assert len(rows) == 31 and rows.pop(head + "labelled both ways") == 0.5
    assert sorted(rows.values()) == [0] * 27 + [1] * 3
    assert toxicity.training_rows(df, labels, 4, 9, 31).count() == 31


def test_rare_and_only_obfuscated_words_become_marks(spark):
    pick = random.Random(5)
    prose = "the river old mill stone night boat lamp field road winter garden".split()
    forms = ["l4mpn1ght", "lampn1ght", "l4mpnight", "l.a.m.p.n.i.g.h.t", "lam.pnight", "l a m p n i g h t", "lampn!ght"]
    text = lambda *more: " ".join([*pick.sample(prose, 8), *more])
    rows = [text(str(k)) for k in range(1500)]
    rows += [text("grolmish", f"a{k}") for k in range(6)] + [text(w) for w in forms] + [text("tovarek") for _ in range(60)]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k >= 1500)) for k in range(len(rows))], "doc_id long, quality int, toxic int")
    restorer, weights, bias = toxicity.learn(df, labels, folds=4, held=9)  # nothing is held out; half a percent of the rows is 7
    assert weights["grolmish$"] > 0
    scores = toxicity._score_texts(restorer, weights, bias, [text("grolmish"), text("gr0lm1sh"), text("l4mpn1ght"), text("lampnight"), text()])
    assert min(scores[:4]) > 0.3 > scores[4]
