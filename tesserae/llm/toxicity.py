"""Toxicity by noisy-channel deobfuscation: character lattices, Viterbi decoding, and a score of the restored text.

A written token is read as the output of a channel that swaps letters for signs (leetspeak), repeats letters and puts
separators between them. Its lattice holds, for every sign, the letters it may stand for, or nothing; a character trigram
model, counted over all documents, picks the likeliest path. Words of the restored text are scored by a logistic
regression over marks, whole words (written `word$`) and word beginnings, chosen and weighed from labelled training rows:
all marks, of plain and of restored words, that `least_rows` rows hold and that toxic rows hold clearly more often than
others do. The support asked for is fixed, so a word that few rows hold counts however many rows there are.

Only tokens that can be restored to a word with a mark are decoded. That loses nothing: every edit of the channel keeps
the token's skeleton (signs mapped to one letter of their kind, separators gone, runs single), so a token whose skeleton
begins otherwise has no path to the word; and a token of plain letters without runs has one path, itself.

Training rows are labelled rows whose crc32 of the id as text has not the remainder `held` modulo `folds`; of more than
`most_rows` different texts, those with the smallest hashes are used. Rows with the same whole text count once, toxic by
the share of them that are: a text that was labelled both ways keeps both labels by their weight.

Defined results: null and empty texts get the score of a text without scored words; every input row gives one output row,
repeated and null ids included (a null id counts as the empty text); rows without a label are not learned from; without
training rows all scores are 0; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, crc_of_id, doc_texts, durable, small_batches

#: Signs and the letters they may stand for; fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .,-_*~^'\"`:;/\\()[]{}<>=#%&?\u200b\u00ad\u00b7\u2022"
SWAP, DROP, STRAY = log(0.05), log(0.1), log(1e-5)

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
RUNS = re.compile(r"(.)\1+")
SKELETON = {ord(c): to[0].replace("l", "i") for c, to in LEET.items()} | {ord("l"): "i"} | {ord(c): None for c in SEPARATORS}


@lru_cache(50_000)
def skeleton(token: str) -> str:
    return RUNS.sub(r"\1", token.translate(SKELETON))


# ---- the character model


SIZE = 28  # 0: no letter, 1-26: a-z, 27: other letters


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[128:] = 27
    return table


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _classes(), np.zeros(SIZE**3, np.int64)
    for b in batches:
        for first in range(0, b.num_rows, 500):
            text = b"  ".join(t for t in b.column(0).slice(first, 500).to_pylist() if t)
            c = table[np.frombuffer(b"  " + text + b"  ", np.uint8)]
            total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_model(documents: DataFrame) -> np.ndarray:
    """log P(character | two before), counted over all documents: SIZE**3 numbers, whatever the input."""
    rows = doc_texts(documents).select("text").transform(arrow, _trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for r in rows:
        counts[r.gram] = r.n
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pairs, single = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (single + 1) / (single.sum() + SIZE)
    p2 = (pairs + 10 * p1) / (pairs.sum(axis=1, keepdims=True) + 10)
    return np.log((counts + 10 * p2) / (counts.sum(axis=2, keepdims=True) + 10))


def _code(c: str) -> int:
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every written character, what it may have been ("" for nothing), with log probabilities."""
    out, last = [], ""
    for c in token:
        if c in LEET:
            options = [(x, SWAP) for x in LEET[c]] + [("", STRAY)]
        elif c in SEPARATORS or c.isspace():
            options = [("", 0.0)]
        else:
            options = [(c, 0.0)]
        if c == last and not (c in SEPARATORS or c.isspace()):
            options.append(("", DROP))
        out.append(options)
        last = c
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest clean text behind a written token, by Viterbi over its lattice; a state is the last two characters."""
    states = {(" ", " "): (0.0, None)}
    for options in lattice(token):
        new: dict = {}
        for (a, b), (total, path) in states.items():
            i, j = _code(a), _code(b)
            for c, cost in options:
                if c == "":
                    key, value, way = (a, b), total + cost, path
                else:
                    key, value, way = (b, c), total + cost + model[i, j, _code(c)], (path, c)
                if key not in new or value > new[key][0]:
                    new[key] = (value, way)
        states = new
    ends = [(total + (model[_code(a), _code(b), 0] if b != " " else 0), way) for (a, b), (total, way) in states.items()]
    way, out = max(ends, key=lambda x: x[0])[1], []
    while way:
        way, c = way
        out.append(c)
    return "".join(reversed(out))


# ---- marks of a text


def plain_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


BEGINNINGS = range(3, 9)
NONE: frozenset = frozenset()


def marks_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def hides(token: str) -> bool:
    """Whether a token may stand for another word than WORD reads in it; others have one path, themselves."""
    bare = token.strip(SEPARATORS)
    return not bare.isalpha() or RUNS.search(bare) is not None


class Tokens(dict):
    """What is known of tokens, remembered up to a bound; forgetting costs time only."""

    def __init__(self, find, most: int = 200_000):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, token: str) -> frozenset:
        if len(self) >= self.most:
            self.clear()
        got = self[token] = self.find(token)
        return got

    def __reduce__(self):
        return Tokens, (self.find, self.most)  # tasks start with nothing known


class Restorer:
    """The marks that a text holds, written plainly or not."""

    def __init__(self, marks: list[str], model: np.ndarray):
        self.marks, self.model = frozenset(marks), model
        self.heads = {m[:3] for m in marks}
        self.skeletons = {skeleton(m.rstrip("$")) for m in marks}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.inside = re.compile("|".join(map(re.escape, sorted(self.skeletons, key=len, reverse=True)))) if marks else None
        self.plain: dict[str, frozenset] = {}
        self.known = Tokens(self.of_token)

    def of_word(self, word: str) -> frozenset:
        """Marks of a clean word."""
        got = self.plain.get(word)
        if got is None:
            if len(self.plain) > 50_000:
                self.plain = {}
            got = self.plain[word] = self.marks.intersection(marks_of(word)) or NONE
        return got

    def reachable(self, bones: str) -> bool:
        return any(bones[:k] in self.skeletons for k in self.lengths)

    def restored(self, token: str) -> frozenset:
        """Marks of the decoded token."""
        return self.of_word(decode(token, self.model)) if self.reachable(skeleton(token)) else NONE

    def of_token(self, token: str) -> frozenset:
        """Marks of a written token: of the words in it, and of what it decodes to."""
        found = NONE.union(*(self.of_word(w) for w in WORD.findall(token) if w[:3] in self.heads))
        return (found | self.restored(token) if hides(token) else found) or NONE

    def __call__(self, text: str) -> set[str]:
        found: set[str] = set()
        if not self.marks:
            return found
        low = text.lower()
        tokens = set(low.split())
        found.update(*map(self.known.__getitem__, tokens))
        if sum(len(t) == 1 for t in tokens) >= min(2, self.lengths[0]):  # a spelled word of two letters has two different ones
            for m in SPACED.finditer(low):
                for part in self.spelled(m[0]):
                    found |= self.restored(part)
        return found

    def spelled(self, token: str) -> list[str]:
        """The stretches of a spaced-out token that have the skeleton of a mark."""
        places, runs = [], []  # each letter of the skeleton, and the written characters it stands for
        for k, c in enumerate(token):
            s = c.translate(SKELETON)
            if s and s != (runs[-1] if runs else ""):
                runs.append(s)
                places.append([k, k + 1])
            elif s:
                places[-1][1] = k + 1
        whole = "".join(runs)
        return [token[places[m.start()][0] : places[m.end() - 1][1]] for m in self.inside.finditer(whole)]


# ---- learning


def _held(doc: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == held


def training_rows(documents: DataFrame, labels: DataFrame, folds: int, held: int, most_rows: int) -> DataFrame:
    """doc_id, text, toxic of the training texts, most_rows at most, by hash; toxic is the share of toxic rows among equal texts."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) != held)
    texts = doc_texts(documents).where("text is not null").withColumn("copy", F.xxhash64("text"))
    classes = texts.select("doc_id", "copy").join(own, "doc_id").groupBy("copy").agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    # copies are one row before most_rows is counted, which bounds what is broadcast
    chosen = classes.orderBy(F.xxhash64("copy"), "copy").limit(most_rows)
    return durable(texts.join(F.broadcast(chosen), ["doc_id", "copy"]).dropDuplicates(["copy"]).select("doc_id", "text", "toxic"))


def _hidden(low: str) -> Iterator[str]:
    """Written tokens that may stand for another word than WORD reads in them."""
    yield from filter(hides, set(low.split()))
    for m in SPACED.finditer(low):
        yield m[0]


def _mark_rows(model: np.ndarray):
    def mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = lru_cache(50_000)(lambda token: decode(token, model))
        for b in batches:
            n, bad = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                low = text.decode("utf-8", "replace").lower()
                words = plain_words(low) | {w for w in map(restored, _hidden(low)) if w}
                own = {m for w in words for m in marks_of(w)}
                n.update(own)
                if toxic:
                    bad.update(dict.fromkeys(own, toxic))
            columns = [pa.array(list(n), pa.string()), pa.array([float(bad[m]) for m in n], pa.float64()), pa.array(list(n.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "bad", "n"])

    return mark_rows


def _feature_rows(restorer: Restorer, place: dict[str, int]):
    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in b.column("text").to_pylist()]
            own = [sorted(place[m] for m in restorer(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.list_(pa.int32()))], ["toxic", "marks"])

    return feature_rows


class Marked:
    """Which rows hold which marks, as pairs, and a last column of ones."""

    def __init__(self, rows: np.ndarray, marks: np.ndarray, shape: tuple[int, int]):
        self.rows, self.marks, self.shape = rows, marks, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.marks], self.shape[0]) + w[-1]

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.marks, v[self.rows], self.shape[1]), v.sum())


def _solved(x: Marked, curve: np.ndarray, keep: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The Newton step by conjugate gradients, scaled by the diagonal: no matrix of marks by marks."""
    scale = x.back(curve) + keep
    s, r = np.zeros_like(g), g.copy()
    z = r / scale
    d, size = z, r @ z
    for _ in range(500):
        if size < 1e-20 or np.abs(r).max() < 1e-9:
            break
        q = x.back(curve * x.times(d)) + keep * d
        a = size / (d @ q)
        s, r = s + a * d, r - a * q
        z = r / scale
        size, last = r @ z, size
        d = z + size / last * d
    return s


def logistic(x: np.ndarray | Marked, y: np.ndarray, decay: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with halved steps; the weights are held by a quadratic penalty. x holds 0 and 1."""
    x = x if isinstance(x, Marked) else Marked(*np.nonzero(x), x.shape)
    keep = np.append(np.full(x.shape[1], decay), 1e-6)

    def loss(w):
        z = x.times(w)
        return (np.logaddexp(0, z) - y * z).sum() + (keep * w * w).sum() / 2

    w = np.zeros(x.shape[1] + 1)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        step, size = _solved(x, p * (1 - p), keep, x.back(p - y) + keep * w), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-7:
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def learn(
    documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most_rows: int = 16_000, least_rows: int = 5
) -> tuple[Restorer, dict[str, float], float | None]:
    """The restorer, the weights of its marks, and the bias (None: there was nothing to learn from)."""
    model = character_model(documents)
    rows = training_rows(documents, labels, folds, held, most_rows)
    marked = rows.select("text", "toxic").transform(arrow, _mark_rows(model), "mark string, bad double, n long")
    counts = marked.groupBy("mark").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    texts = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not texts[1]:
        return Restorer([], model), {}, None
    share = max(texts[0], 1) / texts[1]
    excess = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share)
    names = [r.mark for r in counts.where((F.col("n") >= least_rows) & (excess >= 4)).orderBy(F.desc(excess), "mark").collect()]
    restorer, place = Restorer(names, model), {w: k for k, w in enumerate(names)}
    data = rows.select("text", "toxic").transform(arrow, _feature_rows(restorer, place), "toxic double, marks array<int>").collect()
    held_by = np.repeat(np.arange(len(data)), [len(r.marks) for r in data])
    x = Marked(held_by, np.array([m for r in data for m in r.marks], np.int64), (len(data), len(names)))
    weights, bias = logistic(x, np.array([r.toxic for r in data], np.float64))
    return restorer, dict(zip(names, weights.tolist())), bias


def _score_texts(restorer: Restorer, weights: dict[str, float], bias: float | None, texts: list[str | None]) -> list[float]:
    if bias is None:
        return [0.0] * len(texts)
    return [float(1 / (1 + np.exp(-(bias + sum(weights[m] for m in restorer(t or "")))))) for t in texts]


def _scorer(restorer, weights, bias, folds, held, threshold):
    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                scores = _score_texts(restorer, weights, bias, part.column(1).to_pylist())
                out = [pa.array([_held(d, folds, held) for d in part.column(0).to_pylist()]), pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], ["doc_id", "held_out", "score", "predicted"])

    return scorer


def score(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, **how: int) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    learned = learn(documents, labels, folds, held, **how)
    docs = doc_texts(documents).selectExpr("doc_id", "cast(text as string) as text")
    return docs.transform(arrow, _scorer(*learned, folds, held, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _accepts(learned: tuple, text_at: int, threshold: float):
    def accepts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1000):
                part = b.slice(first, 1000)
                scores = _score_texts(*learned, part.column(text_at).to_pylist())
                yield part.filter(pa.array([s < threshold for s in scores]))

    return accepts


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **how: int) -> DataFrame:
    """The documents, in their own columns, whose score stays below the threshold."""
    learned = learn(documents, labels, **how)
    small_batches(documents)
    return documents.transform(arrow, _accepts(learned, documents.columns.index("text"), threshold), documents.schema)
