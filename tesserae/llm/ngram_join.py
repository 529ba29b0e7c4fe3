"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Words are runs of what is no ASCII white space, A-Z lower-cased; a document's set is its distinct five-word shingles. Two
documents link when 100 * shared >= 75 * union. The join is set-based and leaves no pair out; overlaps are counted on 48
bits of the shingles' numbers, so within one pair of documents a false one has a chance of about 1e-9:

1. Every shingle gets a number; numbers travel packed, by range, and those of one document only are left out (they cannot
   be shared). A document that keeps less than 75 % of its set links with nothing and is done. Sizes and the test for
   equal sets use 64 bits of the numbers, overlaps 48.
2. Documents of equal sets become one. The others are ordered rare shingle first; two that link share one of the first
   size - ceil(0.75 size) + 1 shingles (the prefix), so only those are indexed.
3. Inverted lists propose pairs in rounds: first each set with the centres of its two most frequent lists, then every
   member with its list's centre, the set likest to be the original. Sets that are already joined need no pair, so a
   group of copies costs its size, not its square. What the lists still tie together is searched as a whole, by blocks,
   so no link between components is lost, and tasks give links, not pairs.
4. The candidates of a query document are searched in blocks: inverted lists over the query's shingles, the short ones
   merged by a heap, the long ones probed by bisection (DivideSkip), keeping those that reach the required overlap.

Defined results: null, empty and blank texts have empty sets and link with nothing; fewer than five words are one shingle,
the whole sequence; rows that repeat a doc_id are documents of their own, a row each; rows with a null doc_id get a null
component; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHash, arrow, blob_arrays, by_key, by_value, doc_texts, durable, few, mix, odd_numbers, partitions, text_ranges
from .graph import components

WIDTH = 5
SHARE = 75  # per cent
BLOCK = 100_000  # shingles of candidates searched at once


def shingles(words: np.ndarray, width: int, multipliers: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers of the shingles of a sequence of word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += words[j : n - k + 1 + j] * multipliers[j]
    return np.unique(mix(h))


EMITTED = "bucket int, block long, docs binary, counts binary, high binary, low binary, home binary"
EMITTED_NAMES = [x.split()[0] for x in EMITTED.split(", ")]
HOME = np.dtype([("doc_id", "<i8"), ("copy", "<i8"), ("mark", "<u8"), ("size", "<i4")])


def _emit(buckets: int, width: int):
    """Per block of documents and range of numbers: which documents have how many of them, and the numbers' first 48 bits.

    One more row of a block has its documents' ids, numbers of their texts, marks (sums of their shingles' numbers, the same
    for equal sets) and sizes.
    """
    multipliers = odd_numbers(width, 5)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = WordHash(100_000), TaskContext.get().partitionId() << 32
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                sets = [shingles(known.of((t or b"").lower().split()), width, multipliers) for t in part.column(1).to_pylist()]
                home = np.zeros(len(sets), HOME)
                home["doc_id"] = part.column(0).to_numpy(zero_copy_only=False)
                home["copy"] = part.column(2).to_numpy(zero_copy_only=False)
                home["mark"] = [s.sum(dtype=np.uint64) if len(s) else 0 for s in sets]
                home["size"] = [len(s) for s in sets]
                every = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint16), home["size"])
                bucket = (every >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")
                every, doc, bucket = every[order], doc[order], bucket[order]
                high, low = (every >> np.uint64(32)).astype(np.uint32), (every >> np.uint64(16)).astype(np.uint16)
                edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                rows = [(block % buckets, block, None, None, None, None, home.tobytes())]
                for k, (s, e) in enumerate(zip(edges, edges[1:])):
                    if s < e:
                        starts = np.flatnonzero(np.append(True, doc[s + 1 : e] != doc[s : e - 1]))
                        counts = np.diff(np.append(starts, e - s)).astype(np.uint32)
                        rows.append((k, block, *(x.tobytes() for x in (doc[s:e][starts], counts, high[s:e], low[s:e])), None))
                block += 1
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], EMITTED_NAMES)

    return emit


KEPT = "block long, docs binary, counts binary, high binary, low binary, dfs binary, home binary"
KEPT_NAMES = [x.split()[0] for x in KEPT.split(", ")]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of numbers: those in several documents, with how many (65535 for more), by block; and the home rows."""
    t = by_key(batches)
    if t is None:
        return
    own = t.filter(pc.is_valid(t["home"]))
    rows = [(b, *[None] * 5, h) for b, h in zip(own["block"].to_pylist(), own["home"].to_pylist())]
    t = t.filter(pc.is_null(t["home"]))
    if t.num_rows:
        numbers, sizes = _whole(t["high"], t["low"])
        counts, _ = blob_arrays(t["counts"], np.uint32)
        docs = np.repeat(blob_arrays(t["docs"], np.uint16)[0], counts)
        row = np.repeat(np.arange(t.num_rows, dtype=np.int32), sizes)
        blocks = t["block"].to_pylist()
        del t
        order = np.argsort(numbers, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(numbers[order]) != 0))
        df = np.diff(np.append(starts, len(order)))
        dfs = np.empty(len(numbers), np.uint16)
        dfs[order] = np.repeat(np.minimum(df, 65535), df)
        many = dfs > 1
        numbers, docs, row, dfs = numbers[many], docs[many], row[many], dfs[many]
        edges = np.searchsorted(row, np.arange(len(blocks) + 1)).tolist()
        for k, (s, e) in enumerate(zip(edges, edges[1:])):
            if s < e:
                first = np.flatnonzero(np.append(True, docs[s + 1 : e] != docs[s : e - 1]))
                n = np.diff(np.append(first, e - s)).astype(np.uint32)
                rows.append((blocks[k], docs[s:e][first].tobytes(), n.tobytes(), *(x.tobytes() for x in (*_halves(numbers[s:e]), dfs[s:e])), None))
    types = [pa.int64()] + [pa.binary()] * 6
    for s in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 5000]), types)], KEPT_NAMES)


def _halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 48 bits of numbers, as 32 and 16."""
    return (numbers >> np.uint64(32)).astype(np.uint32), (numbers >> np.uint64(16)).astype(np.uint16)


def _whole(high: pa.ChunkedArray, low: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from cells of their halves, and how many each cell has."""
    a, _ = blob_arrays(high, np.uint32)
    b, counts = blob_arrays(low, np.uint16)
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) << np.uint64(16), counts


OWN = "key long, doc_id long, copy long, mark long, size int, able boolean, high binary, low binary"
OWN_NAMES = [x.split()[0] for x in OWN.split(", ")]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole blocks, one row per document: whether its shared numbers are enough for any link, and if so these numbers,
    rare ones first. Of equal sets in this partition only the first row has them. Equal sets have the same key.
    """
    seen: set[int] = set()
    for _, rows in by_value(batches, "block"):
        home = np.frombuffer(next(h for h in rows["home"].to_pylist() if h is not None), HOME)
        rows = rows.filter(pc.is_null(rows["home"]))
        n = len(home)
        able, high, low = np.zeros(n, bool), [None] * n, [None] * n
        if rows.num_rows:
            docs = np.repeat(blob_arrays(rows["docs"], np.uint16)[0], blob_arrays(rows["counts"], np.uint32)[0])
            numbers, dfs = _whole(rows["high"], rows["low"])[0], blob_arrays(rows["dfs"], np.uint16)[0]
            able = (100 * np.bincount(docs, minlength=n) >= SHARE * home["size"].astype(np.int64)) & (home["size"] > 0)
            fresh = able.copy()
            for k in np.flatnonzero(able).tolist():
                mark = int(home["mark"][k])
                fresh[k] = mark not in seen
                seen.add(mark)
            pick = fresh[docs]
            docs, numbers, dfs = docs[pick], numbers[pick], dfs[pick]
            order = np.lexsort((numbers, dfs, docs))
            a, b = _halves(numbers[order])
            edges = np.searchsorted(docs[order], np.arange(n + 1)).tolist()
            for k in np.flatnonzero(fresh).tolist():
                high[k], low[k] = a[edges[k] : edges[k + 1]].tobytes(), b[edges[k] : edges[k + 1]].tobytes()
        marks = home["mark"].astype(np.int64)
        key = np.where(able, marks, mix(home["doc_id"].astype(np.uint64)).view(np.int64))
        columns = [pa.array(key), pa.array(home["doc_id"]), pa.array(home["copy"]), pa.array(marks), pa.array(home["size"]), pa.array(able), pa.array(high, pa.binary()), pa.array(low, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, OWN_NAMES)


SETS = "doc_id long, copy long, mark long, size int, able boolean, first long, high binary, low binary"
SETS_NAMES = [x.split()[0] for x in SETS.split(", ")]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the smallest id of those with an equal set; a row of its own has the set, its doc_id null."""
    t = by_key(batches)
    if t is None:
        return
    docs, copies, marks, sizes, able = (t[c].to_numpy() for c in ("doc_id", "copy", "mark", "size", "able"))
    first = docs.copy()
    at = np.flatnonzero(able)
    at = at[np.lexsort((docs[at], sizes[at], marks[at]))]
    new = np.flatnonzero(np.append(True, (np.diff(marks[at]) != 0) | (np.diff(sizes[at]) != 0))) if len(at) else at
    first[at] = np.repeat(docs[at][new], np.diff(np.append(new, len(at))))
    none = pa.nulls(len(docs), pa.binary())
    columns = [pa.array(docs), pa.array(copies), pa.array(marks), pa.array(sizes), pa.array(able), pa.array(first), none, none]
    yield pa.RecordBatch.from_arrays(columns, SETS_NAMES)
    full = np.flatnonzero(t["high"].is_valid().to_numpy())
    full = full[np.unique(marks[full], return_index=True)[1]]
    for s in range(0, len(full), 2000):
        k = full[s : s + 2000]
        own = t.take(pa.array(k)).combine_chunks()
        none = pa.nulls(len(k), pa.int64())
        columns = [none, none, pa.array(marks[k]), pa.array(sizes[k]), pa.array(able[k]), pa.array(first[k]), own["high"].chunk(0), own["low"].chunk(0)]
        yield pa.RecordBatch.from_arrays(columns, SETS_NAMES)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inverted index: a row for each number of a set's prefix. tail counts from the prefix's end, most frequent first;
    lone is how many shingles the set shares with no other: an original has fewer than its edited copies.
    """
    for b in batches:
        marks, sizes = b.column("mark").to_numpy(), b.column("size").to_numpy()
        numbers, counts = _whole(b.column("high"), b.column("low"))
        # numbers of this document alone come first in its order and are not here any more
        take = np.maximum(sizes - (SHARE * sizes.astype(np.int64) + 99) // 100 + 1 - (sizes - counts), 0)
        place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        at = np.repeat(np.cumsum(counts) - counts, take) + place
        tail = (np.repeat(take, take) - 1 - place).astype(np.int32)
        lone = np.repeat(sizes - counts, take).astype(np.int32)
        columns = [pa.array(numbers[at].view(np.int64)), pa.array(np.repeat(marks, take)), pa.array(np.repeat(sizes, take)), pa.array(tail), pa.array(lone)]
        yield pa.RecordBatch.from_arrays(columns, ["token", "mark", "size", "tail", "lone"])


class Inverted:
    """Inverted lists over some sets: for every number, in order, which sets have it."""

    def __init__(self, cells: list[np.ndarray], sizes: list[int]):
        every = np.concatenate(cells) if cells else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        order = np.argsort(every, kind="stable")
        self.owner, every = owner[order], every[order]
        self.starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        self.numbers, self.ends = every[self.starts], np.append(self.starts[1:], len(every))
        self.sizes = np.array(sizes, np.int64)

    def search(self, query: np.ndarray, size: int, able: np.ndarray | None = None) -> list[int]:
        """Which sets share enough with the query: T-occurrence search. able: which of them are asked about.

        query: distinct numbers that may be shared; size, sizes: of the whole sets.
        """
        able = np.ones(len(self.sizes), bool) if able is None else able
        able = able & (100 * np.minimum(self.sizes, size) >= SHARE * np.maximum(self.sizes, size))
        if not able.any() or not len(self.numbers):
            return []
        need = -(-SHARE * (size + self.sizes) // (100 + SHARE))  # shared >= share / (1 + share) * both sizes
        at = np.searchsorted(self.numbers, query)
        at[at == len(self.numbers)] = 0
        at = at[self.numbers[at] == query]
        lists = sorted((self.owner[s:e].tolist() for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())), key=len)
        least = int(need[able].min())
        if len(lists) < least:
            return []
        long = min(int(least / (0.0085 * log2(len(lists[-1]) + 1) + 1)), least - 1)
        short, long_lists = lists[: len(lists) - long], lists[len(lists) - long :]
        asked, need, out = able.tolist(), need.tolist(), []
        for k, same in groupby(heapq.merge(*short)):
            if not asked[k]:
                continue
            shared = sum(1 for _ in same)
            if shared < need[k] - long:
                continue
            for i, own in enumerate(long_lists):
                if shared >= need[k] or shared + long - i < need[k]:
                    break
                p = bisect_left(own, k)
                shared += p < len(own) and own[p] == k
            if shared >= need[k]:
                out.append(k)
        return out


def divide_skip(query: np.ndarray, size: int, cells: list[np.ndarray], sizes: list[int]) -> list[int]:
    """Which of the candidate sets link with the query."""
    return Inverted(cells, sizes).search(query, size)


def _numbers(high: bytes, low: bytes) -> np.ndarray:
    return np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint16).astype(np.uint64) << np.uint64(16)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of candidates, each with its query among them, to links."""
    for b in batches:
        us, vs = [], []
        for centre, block in zip(b.column("centre").to_pylist(), b.column("block")):
            own = block.as_py()
            query = next(x for x in own if x["mark"] == centre)
            own = [x for x in own if x["mark"] != centre]
            cells = [_numbers(x["high"], x["low"]) for x in own]
            for k in divide_skip(_numbers(query["high"], query["low"]), query["size"], cells, [x["size"] for x in own]) if own else ():
                us.append(centre)
                vs.append(own[k]["mark"])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (centre, mark, size) that link. A centre's candidates are dealt to blocks of about BLOCK shingles."""
    pairs = durable(pairs.groupBy("centre", "mark").agg(F.max("size").alias("size")))
    loads = pairs.groupBy("centre").agg((F.floor(F.sum("size") / BLOCK) + 1).cast("int").alias("blocks"))
    dealt = pairs.join(loads, "centre").select("centre", "mark", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int").alias("part"))
    queries = dealt.select("centre", F.col("centre").alias("mark"), "part").distinct()
    wanted = few(dealt.unionByName(queries))
    full = sets.join(wanted, "mark").groupBy("centre", "part").agg(F.collect_list(F.struct("mark", "size", "high", "low")).alias("block"))
    return full.select("centre", "block").transform(arrow, _search, "u long, v long")


def _near(size, other) -> F.Column:
    """Sizes that a link allows."""
    return (100 * F.least(size, other) >= SHARE * F.greatest(size, other))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Index rows with the components of the links so far, of lists whose members are in several; of equal lists one."""
    named = few(components(found, "u", "v").withColumnRenamed("id", "mark"))
    rows = rows.drop("component").join(named, "mark", "left").withColumn("component", F.coalesce("component", "mark"))
    members = F.sum(F.xxhash64("mark").cast("decimal(20,0)"))
    lists = rows.groupBy("token").agg((F.min("component") < F.max("component")).alias("mixed"), F.count("*").alias("n"), members.alias("members"))
    mixed = lists.where("mixed").groupBy("n", "members").agg(F.min("token").alias("token")).select("token")
    return durable(rows.join(few(mixed), "token", "left_semi"))


ORIGINAL = ("lone", "size", "mark")  # what comes first is likest to be what the others are copies of


def _with_centres(rows: DataFrame) -> DataFrame:
    """Each list's members with its first one by ORIGINAL, its centre, where that is in another component."""
    pick = F.struct(*ORIGINAL, "component")
    centres = rows.groupBy("token").agg(F.min(pick).alias("c"), F.count("*").alias("n")).where("n > 1")
    centres = centres.select("token", F.col("c.mark").alias("centre"), F.col("c.size").alias("centre_size"), F.col("c.component").alias("centre_component"))
    pairs = rows.join(centres, "token").where((F.col("component") != F.col("centre_component")) & _near(F.col("size"), F.col("centre_size")))
    return pairs.select("centre", "mark", "size")


def _without_first(rows: DataFrame) -> DataFrame:
    """Lists without the component of their centre, where two components are left."""
    first = rows.groupBy("token").agg(F.min(F.struct(*ORIGINAL, "component")).alias("c")).select("token", F.col("c.component").alias("first"))
    return rows.join(first, "token").where("component <> first").drop("first")


def links(sets: DataFrame, rounds: int = 1) -> DataFrame:
    """Links (u, v) enough to join all that link, among different sets (mark, size, high, low: numbers, rare first)."""
    index = sets.select("mark", "size", "high", "low").transform(arrow, _prefixes, "token long, mark long, size int, tail int, lone int")
    # first each set meets the centres of its two most frequent lists: families of copies join here
    often = durable(index.where("tail < 2").withColumn("component", F.col("mark")))
    found = durable(_links(_with_centres(often), sets))
    # then the centres of all lists that are still mixed, and the centres of what they leave
    rows = _joined(index, found)
    for k in range(rounds):
        left = rows
        for _ in range(k):
            left = _without_first(left)
        found = durable(found.unionByName(_links(_with_centres(left), sets)))
        rows = _joined(rows, found)
    # and then all of different components, family by family: sets that any of the lists still tie together
    return found.unionByName(_within_families(rows, sets))


FAMILY = 512  # sets of a block


def _within_families(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of a family, block against block; what leaves a task is links, not pairs.

    A component of a block's size or more has blocks of its own, and two blocks of one component never meet: its sets go
    out as often as there are blocks of others, not of itself. Smaller components share blocks.
    """
    one = rows.groupBy("token").agg(F.min("mark").alias("v"))
    family = components(rows.join(one, "token").select("mark", "v"), "mark", "v").select(F.col("id").alias("mark"), F.col("component").alias("family"))
    members = durable(rows.select("mark", "component").distinct().join(family, "mark"))
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n")).withColumn("large", F.col("n") >= FAMILY)
    rest = F.sum(F.when(F.col("large"), 0).otherwise(F.col("n"))).over(W.partitionBy("family"))
    n = F.ceil(F.when(F.col("large"), F.col("n")).otherwise(rest) / FAMILY)
    own = few(sizes.select("family", "component", F.when(F.col("large"), F.col("component")).alias("owner"), n.cast("int").alias("blocks")))
    number = F.xxhash64(F.when(F.col("owner").isNull(), F.col("component")).otherwise(F.col("mark")))
    dealt = members.join(own, ["family", "component"]).select("family", "component", "mark", "owner", F.pmod(number, F.col("blocks")).cast("int").alias("k"))
    dealt = durable(dealt.withColumn("block", F.xxhash64("owner", "k")))
    blocks = dealt.select("family", "owner", "block").distinct()
    other = blocks.select("family", F.col("owner").alias("other"), F.col("block").alias("with"))
    meet = blocks.join(other, "family").where((F.col("block") <= F.col("with")) & ~F.coalesce(F.col("owner") == F.col("other"), F.lit(False)))
    meet = meet.withColumn("task", F.xxhash64("family", "block", "with"))
    asks = meet.select("family", "block", "task", F.lit(True).alias("asks"), (F.col("block") == F.col("with")).alias("answers"))
    answers = meet.where("block <> with").select("family", F.col("with").alias("block"), "task", F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    tasks = dealt.join(few(asks.unionByName(answers)), ["family", "block"]).select("mark", "component", "family", "task", "asks", "answers")
    one = F.struct("mark", "size", "component", "asks", "answers", "high", "low")
    full = sets.join(few(tasks), "mark").groupBy("family", "task").agg(F.collect_list(one).alias("block"))
    return full.select("block").transform(arrow, _search_blocks, "u long, v long")


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two blocks of a family to links between sets that are in different components there.

    The largest component of the answering block has an index of its own, which its own queries need not read.
    """
    for b in batches:
        for block in b.column("block"):
            own = block.as_py()
            queries, cells = ([x for x in own if x[side]] for side in ("asks", "answers"))
            joined: dict[int, int] = {}

            def find(x: int) -> int:
                while joined.setdefault(x, x) != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            most = Counter(x["component"] for x in cells).most_common(1)[0][0]
            parts = []
            for some in ([x for x in cells if x["component"] == most], [x for x in cells if x["component"] != most]):
                parts.append((some, Inverted([_numbers(x["high"], x["low"]) for x in some], [x["size"] for x in some])))
            us, vs = [], []
            for q in queries:
                numbers = _numbers(q["high"], q["low"])
                for some, index in parts:
                    root = find(q["component"])
                    able = np.array([find(x["component"]) != root for x in some], bool)
                    for k in index.search(numbers, q["size"], able) if able.any() else ():
                        us.append(q["mark"])
                        vs.append(some[k]["mark"])
                        a, c = find(root), find(some[k]["component"])
                        joined[max(a, c)] = min(a, c)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _copy(text) -> F.Column:
    return F.xxhash64(text.cast("string").cast("binary"))


def _classified(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of documents with an id (doc_id, copy, mark, size, able, first), the different sets, and (id, component) of marks."""
    parts = partitions(docs.sparkSession)
    emitted = docs.where("doc_id is not null").withColumn("copy", _copy(F.col("text"))).transform(arrow, _emit(text_ranges(docs), width), EMITTED)
    kept = emitted.repartitionById(parts, "bucket").transform(arrow, _shared, KEPT)
    own = kept.repartition(parts, "block").transform(arrow, _candidates, OWN)
    both = durable(own.repartition(parts, "key").transform(arrow, _classes, SETS))
    sets, rows = both.where("doc_id is null"), both.where("doc_id is not null").drop("high", "low")
    return rows, sets, durable(components(links(sets), "u", "v"))


def join(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included): one row per document."""
    docs = doc_texts(documents)
    rows, sets, named = _classified(docs, width)
    least = named.join(sets.select(F.col("mark").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("least"))
    least = named.join(least, "component").select(F.col("id").alias("mark"), "least")
    out = rows.join(least, "mark", "left").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("least", "first").alias("component_id"))
    nameless = docs.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long")).transform(arrow, _sizes(width), "n_shingles long")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(width: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, multipliers = WordHash(), odd_numbers(width, 5)
        for b in batches:
            n = [len(shingles(known.of((t or b"").lower().split()), width, multipliers)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_shingles"])

    return sizes


def distinct_documents(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in their own columns, one row of each component: that of the smallest id, then number of its text.

    Rows are told apart by id and text, so an id that stands for several texts loses only those that are copies; of rows
    with one id and text one stays. Rows that link with nothing all stay: null ids, and texts without words.
    """
    rows, _, named = _classified(doc_texts(documents.select("doc_id", "text")), width)
    rows = rows.where("able").select("doc_id", "copy", "mark", F.struct("doc_id", "copy").alias("row"))
    rows = rows.join(named.withColumnRenamed("id", "mark"), "mark", "left").withColumn("group", F.coalesce("component", "mark"))
    rows = durable(rows.select("doc_id", "copy", "row", "group"))
    judged = rows.join(rows.groupBy("group").agg(F.min("row").alias("least")), "group")
    gone = judged.where("row <> least").select("doc_id", "copy").distinct()
    repeated = durable(judged.where("row = least").groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    names = documents.columns
    keyed = documents.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names)), documents["doc_id"].cast("long").alias("doc_id"), _copy(documents["text"]).alias("copy"))
    kept = keyed.join(gone, ["doc_id", "copy"], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
        kept = kept.join(repeated, ["doc_id", "copy"], "left_anti").unionByName(once)
    return kept.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(names)))
