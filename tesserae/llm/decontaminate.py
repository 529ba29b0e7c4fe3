"""Benchmark decontamination: windows of benchmark words, broadcast as a hash set, looked up in every document.

A word is a run of 0-9, a-z (A-Z lower-cased) and characters above U+007F. A window is `width` consecutive words of a
benchmark item; an item with fewer words (but some) is one window. The table of windows (packed arrays, some 60 bytes a
word; Spark broadcasts what a task needs beyond a megabyte) is made for `most_words` words at most. A larger benchmark is
split by item into blocks of that size: the documents pass by one block after the other, each adding its hits to the row,
with a checkpoint between, so the driver holds one block at a time. Hits are judged when all blocks have been by, so no
answer depends on the bound.

Defined results: null or empty text has no words and is clean; null item ids and null item texts are ignored; repeated
items count once; every input row gives one output row, repeated ids included; further columns pass through `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, doc_texts, durable, odd_numbers, small_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CHUNK = 400_000  # words looked up at once
MOST_WORDS = 2_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; bytes.lower changes A-Z only."""
    return WORD.findall(text.lower()) if text else []


class Windows:
    """The windows of some items: word numbers, and by window length the windows in the order of their hashes."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.words: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)], np.int32)
            n = min(width, len(ids))
            if n:
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[item]))
        self.by_length = {}
        for n, own in found.items():
            keys = np.concatenate([k for k, _ in own])
            who = np.repeat(np.array([i for _, i in own], np.int32), [len(k) for k, _ in own])
            h = self.hashes(keys.ravel().astype(np.uint64), np.arange(len(keys)) * n, n)
            order = np.argsort(h, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
            self.by_length[n] = (h[order][starts], np.append(starts, len(order)), keys[order], who[order])

    def hashes(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j, m in enumerate(odd_numbers(n, 17)):
            h += ids[at + j] * m
            h ^= h >> np.uint64(29)
        return h

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence in a line of word numbers (0: in no item): starts, lengths, items."""
        out = [(np.zeros(0, np.int64),) * 3]
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        wide = ids.astype(np.uint64)
        for n, (hashes, edges, keys, who) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            h = self.hashes(wide, at, n)
            k = np.searchsorted(hashes, h)
            k[k == len(hashes)] = 0
            hit = hashes[k] == h
            at, k = at[hit], k[hit]
            many = edges[k + 1] - edges[k]
            at = np.repeat(at, many)
            row = np.repeat(edges[k], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            same = np.ones(len(at), bool)
            for j in range(n):  # hits are verified word by word
                same &= ids[at + j] == keys[row, j]
            out.append((at[same], np.full(same.sum(), n), who[row[same]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def find(self, texts: list[bytes | None]) -> tuple[list[int], list[list[str]], list[list[int]]]:
        """Of each text: how many words, the items with a window in it, and the positions of the words they cover."""
        get, counts = self.words.get, []
        items, hits = [[] for _ in texts], [[] for _ in texts]
        lines, starts, total, first = [], [], 0, 0
        for k, text in enumerate(texts):
            found = words_of(text)
            counts.append(len(found))
            starts.append(total)
            lines.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
            lines.append(np.zeros(1, np.int32))  # no window crosses documents
            total += len(found) + 1
            if total < CHUNK and k < len(texts) - 1:
                continue
            at, n, who = self.scan(np.concatenate(lines))
            if len(at):
                begin = np.array(starts)
                step = np.zeros(total + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + n, -1)
                covered = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                doc = np.searchsorted(begin, covered, side="right") - 1
                for d in np.unique(doc).tolist():
                    hits[first + d] = (covered[doc == d] - begin[d]).tolist()
                for d, i in np.unique(np.stack([np.searchsorted(begin, at, side="right") - 1, who], axis=1), axis=0).tolist():
                    items[first + d].append(self.names[i])
            lines, starts, total, first = [], [], 0, k + 1
        return counts, items, hits


ADDED = (("n_words", T.LongType()), ("items", T.ArrayType(T.StringType())), ("hits", T.ArrayType(T.IntegerType())))


def _marked(windows: Windows, text_at: int, before: bool):
    """Rows with three more columns at the end, as ADDED; before: they are there already, from other blocks."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, items, hits = windows.find(b.column(text_at).cast(pa.binary()).to_pylist())
            columns, names = list(b.columns), list(b.schema.names)
            if before:
                items, hits = ([sorted({*x, *y}) for x, y in zip(c.to_pylist(), own)] for c, own in zip(columns[-2:], (items, hits)))
                columns, names = columns[:-3], names[:-3]
            added = [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, *added], [*names, *(f"_{k}" for k in range(3))])

    return marked


def blocks(benchmark: DataFrame, most_words: int, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The benchmark as tables of about most_words words at most each, split by item."""
    items = benchmark.select(
        benchmark[item_col].cast("string").alias("item_id"), benchmark[text_col].cast("string").cast("binary").alias("text")
    ).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # a word takes two bytes at least
    n = int(size // most_words) + 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def _past(documents: DataFrame, benchmark: DataFrame, width: int, most_words: int, text_at: int, end=None, schema: T.StructType | None = None) -> DataFrame:
    """The rows past all blocks, with the columns of ADDED at their end; end: what the last task does with them, giving schema."""
    plain, parts = documents.schema.fields, blocks(benchmark, most_words)
    full = T.StructType([*(T.StructField(f"_c{k}", f.dataType) for k, f in enumerate(plain)), *(T.StructField(*x) for x in ADDED)])
    small_batches(documents)
    out = documents
    for k, block in enumerate(parts):
        one = _marked(Windows([(r.item_id, bytes(r.text)) for r in block.toLocalIterator()], width), text_at, k > 0)
        if k < len(parts) - 1:
            out = durable(out.transform(arrow, one, full))
        elif end:
            out = out.transform(arrow, lambda batches: end(one(batches)), schema)  # noqa: B023
        else:
            out = out.transform(arrow, one, full)
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, items (ids of items with a window in the document), hits (positions of the words they cover)."""
    return _past(doc_texts(documents), benchmark, width, most_words, 1).select(F.col("_c0").alias("doc_id"), "n_words", "items", "hits")


def report(documents: DataFrame, benchmark: DataFrame, width: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: how many words, how many are covered by benchmark windows, and which items they come from."""
    found = leaks(documents, benchmark, width, most_words)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _cut(names: list[str], text_at: int, chars_at: int, least_words: int, most_share: float):
    """Spans of covered words leave the text, up to the next word; documents left with too little go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, counts, hits = b.column(text_at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new, keep = [], []
            for text, own, n in zip(raw, hits, counts):
                keep.append(not own or (len(own) <= most_share * n and n - len(own) >= least_words))
                new.append(remove_words(text, set(own)) if own and keep[-1] else text)
            text = pa.array([None if t is None else t.decode("utf-8", "replace") for t in new], pa.string())
            columns = list(b.columns[:-3])
            columns[text_at] = text
            if chars_at >= 0:
                changed = pa.array([bool(own) for own in hits])
                lengths = pa.array([None if t is None else len(t) for t in text.to_pylist()], columns[chars_at].type)
                columns[chars_at] = pyarrow.compute.if_else(changed, lengths, columns[chars_at])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return cut


def remove_words(text: bytes, positions: set[int]) -> bytes:
    """The text without the words at these positions and without what stands between such neighbours."""
    out, last, gone = [], 0, False
    for i, m in enumerate(WORD.finditer(text.lower())):
        if i in positions:
            if not gone:
                out.append(text[last : m.start()])
            gone = True
        elif gone:
            last, gone = m.start(), False
    if not gone:
        out.append(text[last:])
    return b"".join(out)


def clean(
    documents: DataFrame, benchmark: DataFrame, width: int = 10, most_words: int = MOST_WORDS, least_words: int = 1, most_share: float = 0.5
) -> DataFrame:
    """The documents, in their own columns, without benchmark passages.

    Covered words are cut out. A document goes when more than most_share of its words are covered, or fewer than
    least_words remain. Documents without a hit, empty and null texts included, stay as they are. n_chars, if there,
    follows the new text.
    """
    names = documents.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    cut = _cut(names, text_at, chars_at, least_words, most_share)
    return _past(documents, benchmark, width, most_words, text_at, cut, documents.schema)
