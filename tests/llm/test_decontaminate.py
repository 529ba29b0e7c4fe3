import hashlib
import re

from tesserae.llm import decontaminate

from .helpers import PROSE, awkward, documents


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, own in items:
            own = words(own)
            n = min(width, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, extra int")


ITEMS = [(2, PROSE, 1), (10, "lazy DOGS", 1), (10, "lazy dogs", 1), (3, None, 1), (4, "", 1), (None, "the quick", 1), (5, "!!!", 1)]


def test_matches_brute_force_on_awkward_rows(spark):
    df = awkward(spark)
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(i, t) for i, t, _ in ITEMS if i is not None])
    got = sorted([tuple(r) for r in decontaminate.report(df, items(spark, ITEMS)).collect()], key=str)
    assert got == want


def test_blocks_give_the_same_rows(spark):
    df = awkward(spark)
    whole = sorted([tuple(r) for r in decontaminate.report(df, items(spark, ITEMS)).collect()], key=str)
    split = sorted([tuple(r) for r in decontaminate.report(df, items(spark, ITEMS), most_words=20).collect()], key=str)
    assert whole == split


def test_clean_cuts_passages_and_keeps_clean_documents(spark):
    texts = [f"Before it all. {PROSE} " + "After words go on and on here. " * 5, PROSE, "Nothing to see", None, ""]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in decontaminate.clean(df, items(spark, [(1, PROSE, 0)])).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert got[0].text == "Before it all. After words go on and on here. " + "After words go on and on here. " * 4
    assert got[0].n_chars == len(got[0].text)
    assert got[2].text == "Nothing to see" and got[3].text is None


def test_clean_does_not_depend_on_the_blocks(spark):
    """Two items of 12 words in a document of 44: over half is covered, whichever block finds them."""
    word = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    bench = items(spark, [(1, word("x", 12), 0), (2, word("y", 12), 0)])
    texts = [f"{word('a', 10)} {word('x', 12)} {word('b', 10)} {word('y', 12)}", f"{word('a', 10)} {word('x', 12)} {word('b', 20)}", word("c", 30), None]
    df = documents(spark, texts).selectExpr("*", "0 as hits", "1 as items")
    rows = lambda **how: sorted(map(tuple, decontaminate.clean(df, bench, **how).collect()), key=str)
    assert rows() == rows(most_words=1) and {r[0] for r in rows()} == {1, 2, 3}
    assert next(r for r in rows() if r[0] == 1)[1] == f"{word('a', 10)} {word('b', 20)}"


def test_empty_tables(spark):
    assert decontaminate.report(documents(spark, []), items(spark, ITEMS)).count() == 0
    rows = decontaminate.report(documents(spark, ["a b"]), items(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)]
