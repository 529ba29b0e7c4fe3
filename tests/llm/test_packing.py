import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tesserae.llm import packing
from tesserae.llm.queries import tokenizer_path

from .helpers import awkward, documents


TOKENIZER = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, size):
    """Pieces rebuild their documents; sequences are gapless and within the size."""
    want = defaultdict(int)
    for doc, text in docs:
        ids = ids_of(text)
        for k, (s, n) in enumerate(packing.cuts(len(ids), size)):
            want[doc, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), sum(r.length for r in rows)


def test_awkward_documents(spark):
    df = awkward(spark)
    rows = packing.pack(df, tokenizer_path(), size=64).collect()
    check(rows, [(r.doc_id, r.text) for r in df.collect()], 64)


def test_whole_table_is_packed_tightly(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(df, tokenizer_path(), emit_ids=True).collect()
    bins, total = check(rows, [(r.doc_id, r.text) for r in df.collect()], 2048)
    assert bins <= -(-total // 2048) + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows[:50])


def test_odd_spaces_split_as_the_tokenizer_does():
    pick = random.Random(5)
    parts = [" ", "  ", "\n", " \n", "a", "Bé", "'s", "'t", "12", "\u00a0", "\x1c", "!", "<|endoftext|>", "\u3000", "日本", "x" * 700]
    for _ in range(400):
        text = "".join(pick.choice(parts) for _ in range(30))
        assert packing.ids_of(tokenizer_path(), text, 0).tolist() == ids_of(text), text


def test_very_long_runs_of_white_space():
    for blank in (" " * 30_000, "\n" * 25_000, " \u3000" * 12_000):
        for text in (blank, f"a{blank}", f"a{blank}b", f"a{blank}<|endoftext|>{blank}'s c", f"{blank}. d"):
            assert packing.ids_of(tokenizer_path(), text, 0).tolist() == ids_of(text)
    assert len(packing.ids_of(tokenizer_path(), "a" + " " * 2_000_000 + "b", 0)) > 3


def test_two_pieces_replace_the_smallest():
    # 60 + 30 leaves 10; instead of 30, 25 + 15 fill the gap of 40
    assert packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [60, 25, 15])


def test_plan_uses_every_piece_once():
    pick = random.Random(3)
    for _ in range(30):
        lengths = [pick.randint(1, 50) for _ in range(pick.randint(1, 200))]
        histogram = {x: lengths.count(x) for x in lengths}
        used = [x for times, own in packing.plan(histogram, 50) for x in own * times]
        assert sorted(used) == sorted(lengths)


def test_empty_table(spark):
    got = packing.pack(documents(spark, []), tokenizer_path())
    assert got.count() == 0 and got.columns[-2:] == ["sequence_id", "offset"]
