"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Documents become token ids plus an end id; longer ones are cut into full pieces, a shorter one first. Sequences are filled
greedily with the largest pieces that fit; then the smallest piece of a sequence gives way to two unpacked pieces if they
fit the widened gap more tightly. Pieces of one length are interchangeable, so the plan is made on the histogram of
lengths alone (at most `size` rows, whatever the corpus): a list of patterns and how often each is used. Every piece then
finds its place from its rank among the pieces of its length, which is counted by partition and length.

Defined results: null text is empty (its end id alone); repeated ids are packed as rows of their own; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow, doc_texts, durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: How byte-level vocabularies of this kind split a text before merging; a fixed value of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in such a file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file; ids of plain tokens are the merge ranks. Raises if that, or how the
    text is split before merging, is not what the file says.
    """
    spec, byte = json.loads(Path(path).read_text()), _byte_of()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: control strings that are matched in another way than as they stand")
    raw = lambda token: bytes(byte[c] for c in token)
    ranks = {raw(token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    made = [ranks[raw(a + b)] for a, b in merges]
    if spec["model"]["type"] != "BPE" or made != sorted(made) or len(ranks) != 256 + len(set(made)):
        raise ValueError(f"{path}: the order of its merges is not that of its ids")
    before = spec["pre_tokenizer"]
    if spec.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
        raise ValueError(f"{path}: it does not split texts as byte-level files of this kind do")
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Runs of white space that the pattern's look-ahead would need too deep a stack for; the characters are those of \s in it.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def ids_of(path: str, text: str | None, end_id: int) -> np.ndarray:
    """Ids of the text, control strings in it as their own ids, and the end id.

    A very long run of white space is one piece, as the pattern has it: all of the run at the end of a text or before a
    control string, all but its last character elsewhere.
    """
    tokens, text, parts, last = encoder(path), text or "", [], 0
    for m in BLANK.finditer(text) if len(text) >= 20_000 else ():
        stop = m.end() - (m.end() < len(text) and not text.startswith(tuple(tokens.special_tokens_set), m.end()))
        parts += [tokens.encode_to_numpy(text[last : m.start()], allowed_special="all"), tokens._encode_single_piece(text[m.start() : stop])]
        last = stop
    return np.concatenate([*parts, tokens.encode_to_numpy(text[last:], allowed_special="all"), [end_id]]).astype("<u4")


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, with what is over first."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _pieces(path: str, end_id: int, size: int, emit: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = ids_of(path, text, end_id)
                    for k, (start, length) in enumerate(cuts(len(ids), size)):
                        own = ids[start : start + length]
                        rows.append((doc, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if emit else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns[: 5 + emit], names[: 5 + emit])

    return pieces


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths in the sequence) for all pieces of the histogram, by best-two-fit."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n

    def largest(most: int, used: dict[int, int]) -> int:
        """The greatest length up to most that is still there; 0 if none."""
        for length in np.flatnonzero(count[: most + 1] > 0)[::-1].tolist():
            if count[length] > used.get(length, 0):
                return length
        return 0

    patterns = []
    while count.any():
        used: dict[int, int] = {}
        bin_, gap = [], size
        while gap and (length := largest(gap, used)):
            bin_.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length
        if gap and len(bin_) > 1:
            small, wide = bin_[-1], gap + bin_[-1]
            used[small] -= 1
            there = [x for x in np.flatnonzero(count[: wide + 1] > 0).tolist() if count[x] > used.get(x, 0)]
            best, lo, hi = (small, ()), 0, len(there) - 1
            while lo <= hi:
                x, y = there[lo], there[hi]
                if x + y > wide:
                    hi -= 1
                    continue
                if x + y > best[0] and (lo < hi or count[x] > used.get(x, 0) + 1):
                    best = (x + y, (y, x))
                lo += 1
            pair = best[1] or (small,)
            bin_[-1:] = pair
            for x in pair:
                used[x] = used.get(x, 0) + 1
        times = int(min(count[x] // n for x, n in used.items() if n))
        for x, n in used.items():
            count[x] -= times * n
        patterns.append((times, bin_))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go, by rank."""
    out, sequence, taken = [], 0, {}
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            r = taken.get(x, 0)
            out.append((x, r, r + times, sequence, offset))
            taken[x] = r + times
            offset += x
        sequence += times
    return out


def _place(table: list[tuple[int, int, int, int, int]]):
    """Rank within the length, to sequence and offset; the table is as long as the plan, which size bounds."""
    rows: dict[int, list] = {}
    for length, *own in table:
        rows.setdefault(length, []).append(own)
    by = {length: np.array(sorted(own), np.int64) for length, own in rows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                own = by[length]
                k = np.searchsorted(own[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = own[k, 2] + ranks[rows] - own[k, 0]
                offset[rows] = own[k, 3]
            keep = [i for i, n in enumerate(b.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"]
            )

    return place


def pack(documents: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, emit_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    docs = doc_texts(documents).withColumn("text", F.col("text").cast("string"))
    kinds = PIECES + ", ids array<int>" * emit_ids
    pieces = durable(docs.transform(arrow, _pieces(tokenizer, end_id, size, emit_ids), kinds).withColumn("part", F.spark_partition_id()))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    if not histogram:
        return pieces.drop("part").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = slots(plan(histogram, size))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * emit_ids]
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (
        pieces.withColumn("within", within)
        .join(offsets, ["length", "part"])
        .select(*names, (F.col("before") + F.col("within") - 1).alias("rank"))
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema) + ", sequence_id long, offset long"
    return ranked.transform(arrow, _place(table), kinds)
