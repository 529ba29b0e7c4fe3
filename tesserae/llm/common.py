"""Helpers shared by the training-data operators: checkpoint folder, word hashing, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import durable, few, small  # noqa: F401

MASK = 0xFFFFFFFFFFFFFFFF


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


RANGE = 4 << 20  # bytes of text behind a range of numbers


def text_ranges(docs: DataFrame, least: int = 48, size: int = RANGE) -> int:
    """How many ranges the packed numbers of these texts are dealt to: by bytes, so that cells stay full however many
    partitions there are. doc_texts' columns.
    """
    return max(least, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 2000) -> None:
    """Texts can be long: Arrow batches of fewer rows than the session's default bound the memory of a Python worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > rows:
        conf.set(name, str(rows))


def doc_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id long and text binary (UTF-8), whatever else the table holds."""
    small_batches(documents)
    return documents.select(
        documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").cast("binary").alias("text")
    )


def _release() -> None:
    """Give freed memory back: Python workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, task: Callable, schema) -> DataFrame:
    """df.mapInArrow with small batches, and memory given back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _release()

    small_batches(df)
    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound; forgetting costs time only."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def by_key(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The batches of a partition as one table; None if there are no rows."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def by_value(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a partition by the value of an integer column: copied once, then sliced."""
    t = by_key(batches)
    if t is None:
        return
    order = np.argsort(t[column].to_numpy(), kind="stable")
    t = t.combine_chunks().take(pa.array(order)).combine_chunks()
    values = t[column].to_numpy()
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for s, e in zip(edges, edges[1:]):
        yield int(values[s]), t.slice(s, e - s)


def blob_arrays(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Binary cells that hold packed numbers: all numbers in order, and how many each cell has."""
    cells = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(cells), dtype), np.fromiter((len(c) // size for c in cells), np.int64, len(cells))


def crc_of_id(col) -> F.Column:
    return F.crc32(col.cast("string").cast("binary"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a file; any other path to such a file does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)
