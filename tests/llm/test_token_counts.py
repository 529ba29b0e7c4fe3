import random
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from tesserae.llm import token_counts
from tesserae.llm.common import tokenizer_path

from .helpers import awkward, documents

TOKENIZER = Tokenizer.from_file(tokenizer_path())


@lru_cache(1)
def counter():
    return token_counts.Counter(tokenizer_path(), token_counts.classes(tokenizer_path()))


def want(texts):
    return [len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) for t in texts]


def got(texts):
    return counter().count([None if t is None else t.encode() for t in texts]).tolist()


PARTS = [
    " ", "  ", "\n", " \n", "a", "Bé", "'s", "'t", "'r", "'re", "'l", "'ll", "l", "12", " ", "\x1c", "!", "<|endoftext|>", "<|endof",
    "　", "日本", "x" * 70, "'", "r", "e", "\x00", "Ᲊ", "😀",
]


def fuzz(n, most):
    pick = random.Random(5)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(1, most))) for _ in range(n)]


def test_texts_of_odd_parts():
    texts = fuzz(3000, 40)
    assert got(texts) == want(texts)


def test_windows_and_chunks_of_a_few_characters(monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 48)
    monkeypatch.setattr(token_counts, "LANE", 5)
    texts = fuzz(300, 25)
    assert got(texts) == want(texts)


def test_table_made_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_BITS", 10)
    monkeypatch.setattr(token_counts, "LANE", 32)
    counter().merger.clear()
    texts = fuzz(200, 40)
    assert got(texts) == want(texts)
    assert got([texts[0] * 50, "xyz" * 3000]) == want([texts[0] * 50, "xyz" * 3000])
    monkeypatch.undo()
    counter().merger.clear()


def test_pieces_longer_than_a_window():
    pick = np.random.default_rng(1)
    letters = "".join(map(chr, pick.integers(97, 123, 60_000)))
    texts = ["x" * 60_000, " " * 60_000 + "a", "日本語" * 20_000, letters, letters.upper() + " \n" * 9000, "é" * 700_000]
    assert got(texts) == want(texts)


def test_every_character_has_the_class_of_the_library():
    firsts = [chr(c) for c, _ in token_counts.classes(tokenizer_path())]
    texts = [f"a{x}1{x}!{x} {x}\n{x}" for x in firsts]
    assert got(texts) == want(texts)


def test_maps_of_chunks_compose():
    pick = np.random.default_rng(2)
    rows = pick.integers(0, 2 * token_counts.CLASSES, (23, 7)).astype(np.uint8)
    maps, _ = token_counts.chunk_maps(rows)
    state, before = token_counts.START, []
    for row in rows:
        before.append(state)
        for x in row:
            state = token_counts.FOLLOWS[x, state]
    assert token_counts.scan(maps).tolist() == before
    for row, own in zip(rows, maps):
        for start in range(token_counts.STATES):
            state = start
            for x in row:
                state = token_counts.FOLLOWS[x, state]
            assert own[start] == state


def test_neighbours_stay_as_merging_says():
    merger, pick = counter().merger, random.Random(7)
    tokens = sorted(merger.bytes)
    for _ in range(4000):
        a, b = pick.choice(tokens), pick.choice(tokens[:3000])
        ids = [merger.single[x] for x in merger.bytes[a] + merger.bytes[b]]
        while True:
            rank, i = min(((merger.rank.get(p, token_counts.NEVER), i) for i, p in enumerate(zip(ids, ids[1:]))), default=(token_counts.NEVER, 0))
            if rank == token_counts.NEVER:
                break
            ids[i : i + 2] = [merger.by_bytes(merger.bytes[ids[i]] + merger.bytes[ids[i + 1]])]
        assert merger.follow(a, b) == (ids == [a, b])


def test_tables(spark, sf_dir):
    for df in (awkward(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        out = token_counts.count(df, tokenizer_path())
        assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        tokens = want([r.text for r in rows])
        expected = [(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, tokens)]
        assert sorted(map(key, out.collect())) == sorted(map(key, expected))
    assert token_counts.count(documents(spark, []), tokenizer_path()).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, b"ab\xff cd")], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    (row,) = token_counts.count(df, tokenizer_path()).collect()
    assert row.n_bytes == 6 and row.n_tokens == want(["ab� cd"])[0]
