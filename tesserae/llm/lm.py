"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation, normalised exactly when it scores.

Counts come from all training documents: word numbers travel packed, by range, each range counts its words and answers
with sums for every document, so no vocabulary is collected. The whole vocabulary is factored into leaves, about twice the
square root of its size: the most frequent words are leaves of their own, all others share the leaves of their spelling
(the word's end, in CODES codes), and one leaf is the end of the text. A word costs its group of leaves, its leaf in the
group, and its smoothed share of the leaf's counts: P(w | h) = P(group | h) P(leaf | group, h) P(w | leaf). The first two
are log-bilinear in the vectors of the last `context` leaves and are normalised by batched matrix products.

Training documents are dealt to shards of about SHARD tokens by a hash of the document, and lie there in the order of
their hashes, as leaf numbers of two bytes. In each of ROUNDS rounds every shard trains on its part of that round from the
same start, and the parameters are averaged by tokens; shards, parts and order follow from the documents, so the model
does not depend on how the table is partitioned. Parameters are some thousand short vectors.

Tokens are runs of what is no ASCII white space, A-Z lower-cased, then one end for each text. Training documents are those
whose crc32 of the id as text has not the remainder `held` modulo `folds`; a null id counts as the empty text.

Defined results: null text is empty, its end its only token; rows that repeat an id and a text count as often as they
come and give as many rows; extra columns are ignored; with no training document the counts are zero and the model is
its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2, log10, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blob_arrays, by_key, doc_texts, durable, partitions, text_ranges

CODES = 8192  # codes of spelling; the last bits of a word's number
CODE = np.uint64(CODES - 1)
FREQUENT = 4096  # leaves of single words at most
DIM, CONTEXT, NOISE, BATCH, SCORED = 16, 4, 32, 8192, 16384
SHARD, ROUNDS = 2_000_000, 3
TOGETHER = 4  # shards that a task trains one after the other, so that it sends their sum
DOCS = 2000  # documents of a block
TEXT = 8 << 20  # bytes of text that are split at once
SOME = 200  # blocks whose sums are made at once
RANGE = 64 << 20  # bytes of text behind a range of words: a document has sums for each range it has words of
EDGES = b".,;:!?\"'()[]{}<>|-_*"


def number_of(word: bytes) -> int:
    """51 bits of the word's hash, and as the last ones the code of its spelling: its last three bytes without signs."""
    return xxhash.xxh3_64_intdigest(word) & ~(CODES - 1) | xxhash.xxh3_64_intdigest((word.strip(EDGES) or word)[-3:]) & (CODES - 1)


END = number_of(b"\n")  # no word holds a line end


class Remembered(dict):
    """Numbers of words, remembered up to a bound; forgetting costs time only."""

    def __init__(self, number, most: int = 200_000):
        super().__init__()
        self.number, self.most = number, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.number(word)
        return n


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def held_out(doc: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == held


def _key(doc: int | None, text: bytes | None) -> int:
    """Number of a document row: rows that repeat an id are told apart by their texts."""
    return xxhash.xxh3_64_intdigest(b"%d\0" % (doc if doc is not None else -1) + (b"n" if doc is None else b"") + (text or b""))


def _tails() -> Remembered:
    """Codes of spelling by the last three bytes."""
    return Remembered(lambda tail: xxhash.xxh3_64_intdigest(tail) & (CODES - 1))


def _numbers(tails: Remembered, words: list[bytes]) -> np.ndarray:
    """number_of() each word."""
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return whole & ~CODE | np.fromiter(map(tails.__getitem__, [(w.strip(EDGES) or w)[-3:] for w in words]), np.uint64, len(words))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about TEXT bytes, with the place of the first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = np.flatnonzero(np.append(True, np.diff(sizes // TEXT) > 0)).tolist() if len(sizes) else []
    return ((i, texts.slice(i, j - i)) for i, j in zip(edges, [*edges[1:], len(texts)]))


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, for each token its word, for each token its text): tokens_of() all texts, as places in lists."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    words = lists.flatten()
    coded, used = words.dictionary_encode(), pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[used], text[used]


COUNTED = "bucket int, block long, words binary, spans binary, docs binary, times binary, trains binary, keys binary"
COUNTED_NAMES = [x.split()[0] for x in COUNTED.split(", ")]


def _emit(buckets: int, folds: int, held: int):
    """Per block of documents and range of word numbers: the words, each once, with the documents that hold it and how often.

    Each row also says which documents of the block are for training. One more row of a block has the keys of its documents.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, block = _tails(), TaskContext.get().partitionId() << 32
        for b in batches:
            for first in range(0, b.num_rows, DOCS):
                part = b.slice(first, DOCS)
                ids = part.column(0).to_pylist()
                keys = [_key(doc, text) for doc, text in zip(ids, part.column(1).to_pylist())]
                trains = [not held_out(doc, folds, held) for doc in ids]
                # each document has its end once, and its words
                words, docs, times = [np.full(len(ids), END, np.uint64)], [np.arange(len(ids))], [np.ones(len(ids), np.int64)]
                for at, texts in _slices(part.column(1)):
                    distinct, word, text = _split(texts)
                    numbers, place = np.unique(_numbers(tails, distinct), return_inverse=True)
                    pair, n = np.unique(place[word] * DOCS + text, return_counts=True)
                    words.append(numbers[pair // DOCS])
                    docs.append(pair % DOCS + at)
                    times.append(n)
                every, doc, times = np.concatenate(words), np.concatenate(docs).astype(np.uint16), np.concatenate(times).astype(np.uint32)
                order = np.argsort(every)  # the documents of a word in any order
                every, doc, times = every[order], doc[order], times[order]
                starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                spans, every = np.diff(np.append(starts, len(doc))).astype(np.uint16), every[starts]
                bucket = (every >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # ranges of numbers, so it rises with them
                edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                starts = np.append(starts, len(doc)).tolist()
                train = np.packbits(np.array(trains, bool)).tobytes()
                rows = [(block % buckets, block, *[None] * 5, np.array(keys, np.uint64).tobytes())]
                for k, (s, e) in enumerate(zip(edges, edges[1:])):
                    if s < e:
                        own = slice(starts[s], starts[e])
                        rows.append((k, block, every[s:e].tobytes(), spans[s:e].tobytes(), doc[own].tobytes(), times[own].tobytes(), train, None))
                block += 1
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], COUNTED_NAMES)

    return emit


ANSWERS = "kind string, block long, docs binary, logs binary, knowns binary, keys binary, word long, n long, codes binary"
ANSWER_NAMES = [x.split()[0] for x in ANSWERS.split(", ")]


def _answer(top: int):
    """Of some ranges of words: the most frequent ones, tokens and distinct words by code, and for each document its sums."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = by_key(batches)
        if t is None:
            return
        home = t.filter(pc.is_valid(t["keys"]))
        rows = [("home", b, None, None, None, k, None, None, None) for b, k in zip(home["block"].to_pylist(), home["keys"].to_pylist())]
        t = t.filter(pc.is_null(t["keys"])).sort_by("block")
        words, held = blob_arrays(t["words"], np.uint64)
        spans, _ = blob_arrays(t["spans"], np.uint16)
        docs, pairs = blob_arrays(t["docs"], np.uint16)
        times, _ = blob_arrays(t["times"], np.uint32)
        block = t["block"].to_numpy()
        trains = [np.unpackbits(np.frombuffer(raw, np.uint8)) for raw in t["trains"].to_pylist()]
        del t
        if len(words):
            order = np.argsort(words, kind="stable")
            fresh = np.flatnonzero(np.append(True, np.diff(words[order]) != 0))
            cell = np.repeat(np.arange(len(pairs)), pairs)
            wide = max(map(len, trains))
            table = np.zeros((len(trains), wide), bool)
            for k, own in enumerate(trains):
                table[k, : len(own)] = own
            starts = np.cumsum(spans, dtype=np.int64) - spans
            counted = np.add.reduceat(np.where(table[cell, docs], times, 0).astype(np.int64), starts)  # of one word and block
            per_word = np.add.reduceat(counted[order], fresh)
            count = np.empty(len(words), np.int64)
            count[order] = np.repeat(per_word, np.diff(np.append(fresh, len(order))))
            distinct = words[order][fresh]
            del order, counted
            code, seen = (distinct & CODE).astype(np.int64), per_word > 0
            codes = np.stack([np.bincount(code, per_word, CODES), np.bincount(code[seen], minlength=CODES)])
            rows.append(("codes", *[None] * 7, codes.tobytes()))
            best = np.lexsort((distinct, -per_word))[: top + 1]
            rows += [("word", *[None] * 5, w, n, None) for w, n in zip(distinct[best].view(np.int64).tolist(), per_word[best].tolist()) if n]
            # each document's sums over all ranges that this task has, some blocks at a time
            log, known = np.log10(count + 1), count > 0
            word_ends, pair_ends = np.append(0, np.cumsum(held)), np.append(0, np.cumsum(pairs))
            firsts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for s in range(0, len(firsts), SOME):
                i, j = firsts[s], firsts[s + SOME] if s + SOME < len(firsts) else len(block)
                ours, own = slice(pair_ends[i], pair_ends[j]), slice(word_ends[i], word_ends[j])
                names, which = np.unique(block[i:j], return_inverse=True)
                place, size, n = which[cell[ours] - i] * DOCS + docs[ours], len(names) * DOCS, times[ours]
                logs = np.bincount(place, n * np.repeat(log[own], spans[own]), size).reshape(-1, DOCS)
                knowns = np.bincount(place, n * np.repeat(known[own], spans[own]), size).reshape(-1, DOCS)
                there = (np.bincount(place, minlength=size) > 0).reshape(-1, DOCS)
                for b, has, x, k in zip(names.tolist(), there, logs, knowns):
                    at = np.flatnonzero(has).astype(np.uint16)
                    rows.append(("sums", b, at.tobytes(), x[at].tobytes(), k[at].astype(np.uint32).tobytes(), *[None] * 4))
        types = [pa.string(), pa.int64()] + [pa.binary()] * 4 + [pa.int64()] * 2 + [pa.binary()]
        for s in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 5000]), types)], ANSWER_NAMES)

    return answer


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole blocks, their sums in one partition: each document's over all ranges of words."""
    keys, logs, knowns = {}, {}, {}
    for b in batches:
        for block, d, x, n, k in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "logs", "knowns", "keys"))):
            if k is not None:
                keys[block] = np.frombuffer(k, np.int64)
                continue
            if block not in logs:
                logs[block], knowns[block] = np.zeros(DOCS), np.zeros(DOCS, np.int64)
            at = np.frombuffer(d, np.uint16)
            logs[block][at] += np.frombuffer(x)
            knowns[block][at] += np.frombuffer(n, np.uint32)
    for block, own in keys.items():
        columns = [pa.array(own), pa.array(logs[block][: len(own)]), pa.array(knowns[block][: len(own)])]
        yield pa.RecordBatch.from_arrays(columns, ["key", "logs", "n_known"])


class Leaves:
    """Which leaf a word number belongs to, and the counts of the leaves.

    Leaves 0..f-1 are words, then k of spelling, then the end; after it comes what stands before the beginning, which is
    never predicted. A leaf of spelling holds `others` known words.
    """

    def __init__(self, top: list[tuple[int, int]], codes: np.ndarray, most: int):
        """top: (number, count) of the most frequent words; codes: tokens and distinct words by code, the end included."""
        tokens, words = codes[0].copy(), codes[1].copy()
        size = 1 << max(6, round(log2(max(words.sum(), 1)) / 2))
        self.spelled = min(size, CODES)
        ends = dict(top).get(END, 0)
        top = [x for x in top if x[0] != END][: min(size, most)]
        for number, n in [*top, (END, ends)]:
            tokens[number % CODES] -= n
            words[number % CODES] -= n > 0
        self.numbers = {number: k for k, (number, _) in enumerate(top)}
        fold = lambda x: x.reshape(-1, self.spelled).sum(axis=0)
        self.others = fold(words)
        self.counts = np.array([*(n for _, n in top), *fold(tokens), ends], np.float64)

    def __len__(self) -> int:
        return len(self.counts)

    def of(self, number: int) -> int:
        return self.numbers.get(number, len(self.numbers) + number % CODES % self.spelled)

    def of_all(self, numbers: np.ndarray) -> np.ndarray:
        """of() each number."""
        out = (len(self.numbers) + (numbers & CODE).astype(np.int64) % self.spelled).astype(np.int16)
        known = np.array(sorted(self.numbers), np.uint64)
        if len(known):
            at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
            same = known[at] == numbers
            out[same] = np.array([self.numbers[n] for n in known.tolist()], np.int16)[at[same]]
        return out


class LogBilinear:
    """Probabilities of leaves given the leaves before, by groups.

    A prediction is the sum of the context's vectors, each scaled by its position. A leaf scores by its product with the
    prediction plus a bias, and so does a group. Leaf l is number l // groups of group l % groups.
    """

    def __init__(self, counts: np.ndarray, dim: int = DIM, context: int = CONTEXT):
        n, pick = len(counts), np.random.default_rng(8)
        self.n, self.groups, self.context = n, ceil(sqrt(n)), context
        self.noise = (counts + 1) / (counts + 1).sum()
        self.group_noise = np.bincount(np.arange(n) % self.groups, self.noise, self.groups)
        some = lambda *shape: (0.1 * pick.standard_normal(shape)).astype(np.float32)
        self.p = {
            "r": some(n + 1, dim),
            "t": some(n, dim),
            "u": some(self.groups, dim),
            "c": np.full((context, dim), 0.5, np.float32),
            "b": np.log(self.noise).astype(np.float32),
            "a": np.log(self.group_noise).astype(np.float32),
        }
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def predicted(self, before: np.ndarray) -> np.ndarray:
        q = self.p["r"][before[:, 0]] * self.p["c"][0]
        for i in range(1, self.context):
            q += self.p["r"][before[:, i]] * self.p["c"][i]
        return q

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all groups, and over the leaves of the target's group."""
        size = -(-self.n // self.groups)
        leaf = np.full((size * self.groups, len(self.p["t"][0]) + 1), 0, np.float32)
        leaf[:, -1] = -1e30  # places without a leaf
        leaf[: self.n, :-1], leaf[: self.n, -1] = self.p["t"], self.p["b"]
        leaf = leaf.reshape(size, self.groups, -1)
        group = np.hstack([self.p["u"], self.p["a"][:, None]]).T
        out = np.empty(len(target), np.float32)
        for s in range(0, len(target), SCORED):
            own = target[s : s + SCORED].astype(np.int64)
            q = self.predicted(before[s : s + SCORED])
            q = np.hstack([q, np.ones((len(q), 1), np.float32)])
            g, at = own % self.groups, own // self.groups
            logs = _normalised(q @ group, g)
            order = np.argsort(g, kind="stable")
            edges = np.searchsorted(g[order], np.arange(self.groups + 1)).tolist()
            for k, (i, j) in enumerate(zip(edges, edges[1:])):
                if i < j:
                    rows = order[i:j]
                    logs[rows] += _normalised(q[rows] @ np.ascontiguousarray(leaf[:, k].T), at[rows])
            out[s : s + SCORED] = logs
        return out

    def train(self, before: np.ndarray, target: np.ndarray, seed: int, rate: float) -> None:
        """One pass of noise-contrastive estimation with Adagrad; the noise of a batch is shared by its tokens."""
        pick, p = np.random.default_rng(seed), self.p
        order = pick.permutation(len(target))
        batch = int(min(BATCH, max(256, len(target) // 200)))
        levels = []
        for vectors, bias, noise in (("t", "b", self.noise), ("u", "a", self.group_noise)):
            levels.append((vectors, bias, np.log(NOISE * noise).astype(np.float32), np.cumsum(noise) / noise.sum()))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            w, h = target[own].astype(np.int64), before[own]
            around = p["r"].take(h.T.ravel(), axis=0).reshape(self.context, len(own), -1)  # looked up once for all that needs it
            q = np.einsum("ijk,ik->jk", around, p["c"])
            dq, g = np.zeros_like(q), {}
            for (vectors, bias, shift, steps), true in zip(levels, (w, w % self.groups)):
                v, b = p[vectors], p[bias]
                false = np.minimum(np.searchsorted(steps, pick.random(NOISE)), len(b) - 1)
                mine, theirs = v.take(true, axis=0), v[false]
                up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, mine) + (b - shift)[true]))  # 1 - P(true)
                down = q @ theirs.T
                down += b[false] - shift[false]
                np.negative(down, out=down)
                np.exp(down, out=down)
                down += 1
                np.divide(-1, down, out=down)
                mine *= up[:, None]
                dq += mine
                dq += down @ theirs
                g[vectors] = _summed(true, up[:, None] * q, len(b))
                g[bias] = np.bincount(true, up, len(b)).astype(np.float32)
                np.add.at(g[vectors], false, down.T @ q)  # a few rows
                np.add.at(g[bias], false, down.sum(axis=0))
            g["c"] = np.einsum("ijk,jk->ik", around, dq)
            np.multiply(dq[None], p["c"][:, None], out=around)
            g["r"] = _summed(h.T.ravel(), around.reshape(-1, dq.shape[1]), self.n + 1)
            for k, v in p.items():
                step = g[k] / np.float32(len(own))
                self.squares[k] += step * step
                v += np.float32(rate) * step / np.sqrt(self.squares[k])

    def packed(self, times: float) -> np.ndarray:
        return np.concatenate([(v.astype(np.float64) * times).ravel() for d in (self.p, self.squares) for v in d.values()])

    def unpack(self, numbers: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.squares):
            for k, v in d.items():
                d[k] = numbers[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size


def _normalised(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log probabilities of one column a row."""
    most = scores.max(axis=1, keepdims=True)
    scores -= most
    picked = scores[np.arange(len(scores)), own]
    np.exp(scores, out=scores)
    return picked - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, values.shape[1]), np.float32)
    for d, own in enumerate(np.ascontiguousarray(values.T, np.float64)):
        out[:, d] = np.bincount(rows, own, n)
    return out


ENCODED = "shard int, doc_id long, key long, trains boolean, ids binary"


def _encode(leaves: Leaves, shards: int, folds: int, held: int):
    """Documents as leaf numbers, with their shard."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, end = _tails(), len(leaves) - 1
        for b in batches:
            for at, texts in _slices(b.column(1)):
                distinct, word, text = _split(texts)
                sizes = np.bincount(text, minlength=len(texts)) + 1
                ends = np.cumsum(sizes)
                ids = np.full(ends[-1], end, np.int16)
                ids[np.arange(len(word)) + text] = leaves.of_all(_numbers(tails, distinct))[word]
                raw, rows = ids.tobytes(), []
                for doc, own, i, j in zip(b.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                    key = _key(doc, own)
                    rows.append((key * shards >> 64, doc, key - (key >> 63 << 64), not held_out(doc, folds, held), raw[2 * i : 2 * j]))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in ENCODED.split(", ")])

    return encode


def sequences(ids: list[np.ndarray], start: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context leaves, target leaves, where each text begins); the context starts afresh with each text."""
    lines = [x for own in ids for x in (np.full(context, start, np.int16), own)]
    flat, sizes = np.concatenate(lines), np.array([len(x) for x in ids])
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(context * np.arange(1, len(sizes) + 1), sizes)
    return np.stack([flat[at - 1 - i] for i in range(context)], axis=1), flat[at], begins


def _trainer(state: np.ndarray | None, counts: np.ndarray, turn: int, rate: float):
    """A shard's part of a round: every ROUNDS-th of its training documents in the order of their keys."""

    def trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = by_key(batches)
        if t is None:
            return
        t = t.filter(t["trains"])
        shard, keys = t["shard"].to_numpy(), t["key"].to_numpy()
        n, sums = 0, 0.0
        for k in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == k)
            rows = rows[np.argsort(keys[rows], kind="stable")][turn::ROUNDS]
            if len(rows):
                model = LogBilinear(counts)
                if state is not None:
                    model.unpack(state)
                own = [np.frombuffer(x, np.int16) for x in t["ids"].take(pa.array(rows)).to_pylist()]
                before, target, _ = sequences(own, len(counts), model.context)
                model.train(before, target, k * ROUNDS + turn, rate)
                n, sums = n + len(target), sums + model.packed(len(target))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])

    return trainer


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, 0
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, sums = n + k, sums + np.frombuffer(raw)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "sums"])


def _total(rows: DataFrame) -> tuple[int, np.ndarray | None]:
    """The sums of a table (n, sums), added up in sixteen tasks and then one; a row is a model or a table of codes."""
    kind = "n long, sums binary"
    found = rows.repartition(16).transform(arrow, _merge, kind).coalesce(1).transform(arrow, _merge, kind).collect()
    return (found[0].n, np.frombuffer(found[0].sums)) if found else (0, None)


def fit(encoded: DataFrame, counts: np.ndarray, rate: float = 0.04) -> LogBilinear:
    """Parameters averaged over the shards by tokens, round by round."""
    model, state = LogBilinear(counts), None
    for turn in range(ROUNDS):
        n, sums = _total(encoded.transform(arrow, _trainer(state, counts, turn, rate), "n long, sums binary"))
        if n:
            state = sums / n
    if state is not None:
        model.unpack(state)
    return model


def _scorer(state: dict, leaves: Leaves):
    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, f = LogBilinear(leaves.counts), len(leaves.numbers)
        model.p = state
        logs = np.log10(leaves.counts + 1.0)  # what frequent words and the end put into the sums of logs
        logs[f:-1] = 0
        shares = np.zeros(len(leaves))  # what a word of a leaf of spelling divides its count by
        shares[f:-1] = np.log10(leaves.counts[f:-1] + leaves.others + 1)
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part = b.slice(first, 500)
                own = [np.frombuffer(x, np.int16) for x in part.column("ids").to_pylist()]
                before, target, starts = sequences(own, len(leaves), model.context)
                each = model.log_probabilities(before, target).astype(np.float64) / np.log(10) - logs[target] - shares[target]
                columns = [part.column("doc_id"), pc.invert(part.column("trains")), part.column("key"), pa.array([len(x) for x in own], pa.int64()), pa.array(np.add.reduceat(each, starts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "key", "n_tokens", "model"])

    return scorer


def score(documents: DataFrame, folds: int = 7, held: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document, logarithms to base 10."""
    spark, docs = documents.sparkSession, doc_texts(documents)
    parts = partitions(spark)
    emitted = docs.transform(arrow, _emit(text_ranges(docs, size=RANGE), folds, held), COUNTED).repartitionById(parts, "bucket")
    answers = durable(emitted.transform(arrow, _answer(frequent), ANSWERS))
    del emitted
    _, codes = _total(answers.where("kind = 'codes'").select(F.lit(1).cast("long").alias("n"), F.col("codes").alias("sums")))
    codes = (codes if codes is not None else np.zeros(2 * CODES)).reshape(2, CODES)
    n, v = int(codes[0].sum()), int(codes[1].sum())
    top = answers.where("kind = 'word'").orderBy(F.desc("n"), "word").limit(frequent + 1).collect()
    leaves = Leaves([(r.word % (1 << 64), r.n) for r in top], codes, frequent)
    shards = n // SHARD + 1
    encoded = docs.transform(arrow, _encode(leaves, shards, folds, held), ENCODED)
    encoded = durable(encoded.withColumn("task", F.expr(f"shard div {TOGETHER}").cast("int")).repartitionById(-(-shards // TOGETHER), "task").drop("task"))
    model = fit(encoded, leaves.counts)
    scored = encoded.transform(arrow, _scorer(model.p, leaves), "doc_id long, held_out boolean, key long, n_tokens long, model double")
    packed = answers.where("kind in ('sums', 'home')").select("block", "docs", "logs", "knowns", "keys")
    # rows that repeat a document have the same key and the same sums
    sums = packed.repartition(parts, "block").transform(arrow, _sums, "key long, logs double, n_known long").dropDuplicates(["key"])
    base = F.col("logs") - F.col("n_tokens") * F.lit(log10(n + v + 1))
    return scored.join(sums, "key").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("logs")).alias("score")
    )
