"""Ranked lexical search over shards of documents.

The index has one row per shard: its documents in the order they were read, and postings of all their terms as CSR arrays,
sorted by term, with an integer impact for each posting that already holds everything but the weight of the term. A first
pass counts terms (the length norm needs the means of the whole table), a second builds the shards; neither shuffles. A
search sums how many documents hold each of its terms, which gives the weights, and then takes, in each shard and for each
item, one term at a time into a dense array of sums. The best of a shard are found by argpartition; all that equal the last
of them stay until ids decide. Tasks merge their shards' best, and a window per item merges the tasks'.

A search passes the index once for each block of items of `most_words` words at most; the driver holds one block's words and
weights, so no answer and no memory depends on how many items there are.

Terms are runs of 0-9, a-z (A-Z lower-cased) and characters above U+007F of the whole text. Sums are exact: the norm is
computed with Python integers where 64 bits would not hold it.

Defined results: null or empty text has no terms; such documents are not counted and never found. Rows that repeat an id
are documents of their own. Documents without an id count like others and come last among equal scores. Items without an id
or text are ignored; several texts of one item are read as one. Items without a hit have no rows. Further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow, doc_texts, durable
from .decontaminate import blocks

SHARD = 8 << 20  # bytes of text of a shard; a longer document is a shard of its own
PART = 1 << 20  # bytes of text whose words are listed at once
MOST_WORDS = 1_000_000

#: What the bytes of UTF-8 become: terms in lower case, all else a space.
PLAIN = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in bytes(range(256)).lower())

INDEX = "ids binary, known binary, terms binary, edges binary, docs binary, impacts binary"


def term_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, some at a time."""
    plain, at = (text or b"").translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + PART)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for b in batches:
        for text in b.column("text").to_pylist():
            n = sum(map(len, term_parts(text)))
            documents += n > 0
            terms += n
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The length norm of documents with so many terms: ten, and ninety times the length over the mean length."""
    if int(lengths.max(initial=0)) * 90 * documents < 1 << 63:
        return 10 + 90 * lengths * documents // max(terms, 1)
    return np.array([10 + 90 * n * documents // terms for n in lengths.tolist()], np.int64)


class Shard:
    """Postings of some documents while they are read."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.lengths, self.keys, self.times, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n, doc = 0, len(self.ids)
        for words in term_parts(text):
            own, times = np.unique(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), return_counts=True)
            self.keys.append(own << 32 | doc)
            self.times.append(times)
            n += len(words)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
        self.size += len(text)

    def row(self, documents: int, terms: int) -> pa.RecordBatch:
        """The shard as a row of the index."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))  # a long document gives a term once for each part
        keys, times = keys[first], np.add.reduceat(times, first)
        docs = (keys & 0xFFFFFFFF).astype(np.int32)
        edges = np.searchsorted(keys >> 32, np.arange(len(self.number) + 1)).astype(np.int64)
        m = norms(np.array(self.lengths, np.int64), documents, terms)
        impacts = (1_000_000_000 * times // (1000 * times + 8 * m[docs])).astype(np.int32)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        known = np.array([i is not None for i in self.ids])
        cells = [ids.tobytes(), known.tobytes(), b" ".join(self.number), edges.tobytes(), docs.tobytes(), impacts.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], [x.split()[0] for x in INDEX.split(", ")])


def _shards(documents: int, terms: int, size: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    if shard.ids and shard.size + len(text) > size:
                        yield shard.row(documents, terms)
                        shard = Shard()
                    shard.add(doc_id, text)
        if shard.ids:
            yield shard.row(documents, terms)

    return shards


class Index:
    """A written index: its shards, how many documents have terms, and how many terms they have."""

    def __init__(self, documents: DataFrame, size: int = SHARD):
        texts = doc_texts(documents)
        total = texts.transform(arrow, _lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
        self.documents, self.terms = total[0] or 0, total[1] or 0
        self.shards = durable(texts.transform(arrow, _shards(self.documents, self.terms, size), INDEX))

    def weights(self, terms: list[bytes]) -> np.ndarray:
        """The integer weight of each term, from the number of documents that hold it."""
        holders = self.shards.select("terms", "edges").transform(arrow, _holders(terms), "term int, n long")
        held = dict(holders.groupBy("term").agg(F.sum("n")).toLocalIterator())
        top = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(top / (2 * held.get(k, 0) + 1))) for k in range(len(terms))], np.int64)

    def search(self, items: DataFrame, most: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
        """item_id, rank, doc_id, score: the documents of the greatest scores above 0. items: item_id, text."""
        kind = items.schema["item_id"].dataType
        out = None
        for block in blocks(items, most_words):
            number: dict[bytes, int] = defaultdict(count().__next__)
            queries: dict[str, set[int]] = defaultdict(set)
            for r in block.toLocalIterator():
                for words in term_parts(bytes(r.text)):
                    queries[r.item_id].update(map(number.__getitem__, words))
            names = sorted(queries)
            wanted = [np.array(sorted(queries[name]), np.int64) for name in names]
            best = self.shards.transform(
                arrow, _best(list(number), self.weights(list(number)), names, wanted, most), "item_id string, doc_id long, score long"
            )
            order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            own = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            out = own if out is None else out.unionByName(own)
        return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def places(terms: bytes, wanted: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The wanted terms that a shard has: their numbers in the search, and their rows in the shard."""
    asked, rows = [], []
    for row, term in enumerate(terms.split(b" ")):
        k = wanted.get(term)
        if k is not None:
            asked.append(k)
            rows.append(row)
    return asked, rows


def _holders(terms: list[bytes]):
    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n = {t: k for k, t in enumerate(terms)}, np.zeros(len(terms), np.int64)
        for b in batches:
            for own, cell in zip(b.column("terms").to_pylist(), b.column("edges").to_pylist()):
                asked, rows = places(own, wanted)
                n[asked] += np.diff(np.frombuffer(cell, np.int64))[rows]
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["term", "n"])

    return holders


def top(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Places of the greatest scores above 0, equal ones by ascending id, unknown ids last."""
    found = np.flatnonzero(scores > 0)
    if len(found) > most:
        last = scores[found[np.argpartition(-scores[found], most - 1)[most - 1]]]
        found = found[scores[found] >= last]  # all that equal the last one, until ids decide
    return found[np.lexsort((ids[found], ~known[found], -scores[found]))[:most]]


def _best(terms: list[bytes], weights: np.ndarray, names: list[str], wanted: list[np.ndarray], most: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(terms)}
        kept: dict[int, tuple] = {}
        for b in batches:
            for row in range(b.num_rows):
                ids, known, own, edges, docs, impacts = (c[row].as_py() for c in b.columns)
                ids, known, edges = np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(edges, np.int64)
                docs, impacts = np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int32)
                asked, rows = places(own, number)
                at = np.full(len(terms), -1, np.int64)
                at[asked] = rows
                for item, query in enumerate(wanted):
                    sums = np.zeros(len(ids), np.int64)
                    for term, r in zip(query.tolist(), at[query].tolist()):
                        if r >= 0:
                            span = slice(edges[r], edges[r + 1])
                            sums[docs[span]] += weights[term] * impacts[span]
                    found = top(sums, ids, known, most)
                    if len(found):
                        new = (sums[found], ids[found], known[found])
                        if item in kept:
                            new = tuple(np.concatenate(x) for x in zip(kept[item], new))
                            found = top(*new, most)
                            new = tuple(x[found] for x in new)
                        kept[item] = new
        for item, (scores, ids, known) in kept.items():
            columns = [pa.array([names[item]] * len(ids), pa.string()), pa.array(ids, mask=~known), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return best


def search(documents: DataFrame, items: DataFrame, most: int = 10, size: int = SHARD, most_words: int = MOST_WORDS) -> DataFrame:
    """The best documents of each item. documents: doc_id, text; items: item_id, text."""
    return Index(documents, size).search(items, most, most_words)
