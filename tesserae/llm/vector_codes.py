"""Vector code compression: a small codebook for each part of the vectors, searched through lower bounds of segment means.

Components become integers, floor(1024 x); vectors are cut into equal parts, each with a codebook that starts as that part
of the vectors of the smallest ids and moves to the means of what is nearest to it, for a few rounds. A round is one pass:
tasks sum what they assign by entry, so that at most one row for each entry and task is shuffled, and the driver gets one
row for each entry. Codebooks are as large as entries and dimension say, whatever the number of vectors.

The nearest entry is found by filtering. A part is cut into segments, at first one, then two, then four. For each segment,
the difference of means and that of the residual norms (what a vector is beyond its mean) bound the squared distance from
below. Entries whose bound, less a margin for rounding, is above the best exact distance so far are left out; the next, finer
bound looks at the rest only; survivors get exact integer distances, and of equal ones the lower entry is taken.

Defined results: vectors that are null or empty, or hold null or non-finite components, are left out, and so are those of
another dimension than the vector of the smallest id. Ids that are null sort last; of rows with one id the smaller packed
vector comes first. Integers are held within 2^25 either way. A dimension that the parts don't divide gives the first
parts one component more. With fewer vectors than entries the codebook has as many entries as there are. Null labels are
one label. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, durable, small

SCALE, BOUND = 1024, 1 << 25
SEGMENTS = (1, 2, 4)
ROWS = 2000  # vectors that are compared at once
DENSE = 0.2  # of all pairs: if more are left, they are taken as a matrix
SALTS = 16


def edges(n: int, parts: int) -> list[int]:
    """Where parts of nearly equal size begin and end."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(n), parts)]).tolist()]


def means_and_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment of each row: its mean and its residual norm, scaled so that squared differences bound distances."""
    out = []
    for s, e in zip(own := edges(x.shape[1], segments), own[1:]):
        if e > s:
            m, part = e - s, x[:, s:e]
            total = part.sum(axis=1)
            rest = (m * part - total[:, None]).astype(np.float64) / m  # integers until here, so nothing cancels
            out += [total / np.sqrt(m), np.sqrt((rest * rest).sum(axis=1))]
    return np.stack(out or [np.zeros(len(x))], axis=1)


@dataclass
class Codebook:
    """The entries of one part, as integers, and their features for every level of the bounds."""

    entries: np.ndarray
    levels: list[np.ndarray] = field(init=False)
    largest: float = field(init=False)

    def __post_init__(self):
        self.levels = [means_and_norms(self.entries, s) for s in SEGMENTS]
        self.largest = float((self.entries.astype(np.float64) ** 2).sum(axis=1).max())

    def exact(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[entry]
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of each row: its entry and the exact squared distance. Also how many pairs were left after each level.

        While many pairs are left, bounds and distances are taken for whole matrices, by products; when few are, pair by
        pair. Both give the same: bounds have a margin that is wider than what rounding does to either.
        """
        margin = 1e-9 * ((x.astype(np.float64) ** 2).sum(axis=1) + self.largest)
        best, left, pairs = np.full(len(x), np.inf), [], None
        alive = np.ones((len(x), len(self.entries)), bool)
        for k, segments in enumerate(SEGMENTS):
            mine, theirs = means_and_norms(x, segments), self.levels[k]
            if pairs is None:
                low = np.where(alive, squares(mine, theirs), np.inf)
                probe, at = np.arange(len(x)), low.argmin(axis=1)
            else:
                row, entry = pairs
                low = ((mine[row] - theirs[entry]) ** 2).sum(axis=1)
                first = np.lexsort((low, row))[np.flatnonzero(np.diff(row, prepend=-1))]
                probe, at = row[first], entry[first]
            best[probe] = np.minimum(best[probe], self.exact(x[probe], at) + margin[probe])
            if pairs is None:
                alive &= low <= best[:, None]
                if alive.sum() < DENSE * alive.size:
                    pairs = np.nonzero(alive)
            else:
                stays = low <= best[row]
                pairs = row[stays], entry[stays]
            left.append(int(alive.sum()) if pairs is None else len(pairs[0]))
        if pairs is None and (np.abs(x).max(initial=0) + np.abs(self.entries).max(initial=0)) ** 2 * x.shape[1] < 1 << 51:
            exact = np.where(alive, squares(x.astype(np.float64), self.entries.astype(np.float64)), np.inf)  # integers that a double holds
            entry = exact.argmin(axis=1)
            return entry, exact[np.arange(len(x)), entry].astype(np.int64), left
        row, entry = np.nonzero(alive) if pairs is None else pairs
        distance = self.exact(x[row], entry)
        order = np.lexsort((entry, distance, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return entry[first], distance[first], left


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, by one matrix product."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors without null or non-finite components, as packed integers."""
    for b in batches:
        vectors = b.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes a NaN
        good = sizes > 0
        good[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)]] = False
        whole = np.clip(np.floor(SCALE * np.where(np.isfinite(values), values, 0)), -BOUND, BOUND).astype(np.int32)
        ends = np.cumsum(sizes)
        cells = [whole[e - n : e].tobytes() for e, n, ok in zip(ends.tolist(), sizes.tolist(), good.tolist()) if ok]
        kept = b.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays(
            [kept.column("vec_id"), kept.column("label"), pa.array(sizes[good].astype(np.int32)), pa.array(cells, pa.binary())],
            ["vec_id", "label", "dim", "vector"],
        )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def _blocks(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for s in range(0, b.num_rows, ROWS):
        own = b.slice(s, ROWS)
        yield own, _matrix(own.column("vector"), dim)


def _sums(books: list[Codebook], cuts: list[int]):
    """Of each entry that is nearest to something: how many, and the sums of their components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(k.entries), np.int64) for k in books]
        totals = [np.zeros(k.entries.shape, np.int64) for k in books]
        for b in batches:
            for _, x in _blocks(b, cuts[-1]):
                for part, book in enumerate(books):
                    own = x[:, cuts[part] : cuts[part + 1]]
                    entry, _, _ = book.nearest(own)
                    counts[part] += np.bincount(entry, minlength=len(counts[part]))
                    np.add.at(totals[part], entry, own)
        for part, (n, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return sums


def _coded(books: list[Codebook], cuts: list[int]):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in _blocks(b, cuts[-1]):
                code, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
                for part, book in enumerate(books):
                    code[:, part], distance, _ = book.nearest(x[:, cuts[part] : cuts[part + 1]])
                    error += distance
                text = pa.array(["".join(f"{k:02x}" for k in c) for c in code.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return coded


def whole_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, dim, vector (packed integers) of the rows that are kept, written once; and their dimension."""
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["label"].alias("label"), embeddings["embedding"].cast("array<double>").alias("embedding")
    )
    kind = rows.schema["label"].dataType.simpleString()
    rows = durable(rows.transform(arrow, _whole, f"vec_id long, label {kind}, dim int, vector binary"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("dim").first()
    dim = first.dim if first else 0
    return rows.where(F.col("dim") == dim), dim


def fit(rows: DataFrame, dim: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[Codebook]:
    """The codebooks of whole vectors."""
    cuts = edges(dim, parts)
    if not dim:
        return []
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = np.array([np.frombuffer(r.vector, np.int32) for r in first], np.int64).reshape(len(first), dim)
    books = [Codebook(start[:, s:e]) for s, e in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        sums = rows.transform(arrow, _sums(books, cuts), "part int, entry int, n long, total array<long>")
        widest = max(e - s for s, e in zip(cuts, cuts[1:]))
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(widest))).alias("total"))
        moved = [k.entries.copy() for k in books]
        for r in added.toLocalIterator():
            moved[r.part][r.entry] = np.array([x for x in r.total if x is not None], np.int64) // r.n
        books = [Codebook(k) for k in moved]
    return books


def codebooks_text(books: list[Codebook]) -> str:
    return ",".join(str(x) for k in books for x in k.entries.ravel().tolist())


def encode(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code, error of whole vectors. A code has two hex digits for each part, so 256 entries at most."""
    cuts = np.cumsum([0, *(k.entries.shape[1] for k in books)]).tolist()
    kind = rows.schema["label"].dataType.simpleString()
    return rows.transform(arrow, _coded(books, cuts), f"vec_id long, label {kind}, code string, error long")


def decode(coded: DataFrame, books: list[Codebook]) -> DataFrame:
    """The rows of encode with the vector that the code stands for, scaled back: embedding array<double>."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [[int(c[k : k + 2], 16) for k in range(0, len(c), 2)] for c in b.column("code").to_pylist()]
            x = [np.concatenate([k.entries[i] for k, i in zip(books, c)]) / SCALE for c in codes]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.list_(pa.float64()))], [*b.schema.names, "embedding"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.transform(arrow, vectors, f"{kinds}, embedding array<double>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the error summed over their label, nulls together.

    Sums are made before the shuffle; few labels are broadcast, more are joined with a salt, so that a label with many
    rows is many tasks' work.
    """
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    if small(sums):
        return coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["of"])).drop("of")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows["label"].eqNullSafe(salted["of"]) & (rows["salt"] == salted["salt"])).select(*coded.columns, "label_error")


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each kept vector."""
    rows, dim = whole_vectors(embeddings)
    books = fit(rows, dim, parts, entries, rounds)
    coded = durable(encode(rows, books))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
