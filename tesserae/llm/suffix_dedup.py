"""Suffix-array dedup by deep-shallow sorting: bytes of long strings that stand earlier too are removed.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a smaller doc_id or earlier in the same
document. Sorting every suffix of the corpus would move a hundred times its size, so the suffixes are first thinned out
by anchors, without loss:

1. Of the hashes of all 32-byte grams, a gram that is the least in some window of `length` bytes is an anchor. Equal
   windows have the same least gram at the same place, so they meet at an anchor of the same number. Numbers of anchors
   and of their surroundings (all windows over the anchor) travel packed, by range. Surroundings that are equal as a
   whole need no sorting: all but the first occurrence go. Different surroundings of one anchor are asked for.
2. By document, texts meet these answers. Documents with no question are finished; of the others the surroundings go on.
3. The suffixes that start in the surroundings are sorted to `length` bytes: multikey quicksort over 8-byte characters to a
   shallow depth, then blind tries, which skip what a group has in common and branch where it differs. Suffixes that end
   in one leaf are equal strings; all but the first one's bytes go.
4. By document, the spans are united and cut out.

Anchors are told apart by 48 bits of their numbers, which costs time only: places of two anchors in one are sorted
together. Surroundings are told apart by 64 bits within one anchor: of a million different ones the chance that any two
are taken for equal is about 3e-8. All else is compared byte by byte.

Defined results: null text is empty; texts under `length` bytes lose nothing; rows that repeat doc_id and text count as
one document and give a row each; rows of one doc_id with different texts are documents ordered by the texts' CRC-32;
rows with a null doc_id neither lose bytes nor take them from others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blob_arrays, by_key, by_value, doc_texts, durable, mix, odd_numbers, partitions, text_ranges

LENGTH, GRAM = 100, 32
SHALLOW = 2  # 8-byte characters that multikey quicksort looks at before blind tries take over
CHUNK = 400_000  # bytes hashed at once; longer documents are hashed in stretches
BASE, SCRAMBLE = (int(x) for x in odd_numbers(2, 77))
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, x in (("up", BASE), ("down", inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of documents in one line: places of the anchors, numbers of gram and surroundings, and the ends of these."""
    n, width = len(flat), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64))
    up, down = powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[flat] * down[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * up[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(SCRAMBLE)
    h ^= h >> np.uint64(29)
    least = _slide(h, width, np.minimum)
    step = np.zeros(n + 2, np.int32)
    long = sizes >= length
    np.add.at(step, starts[long], 1)
    np.add.at(step, (starts + sizes - length + 1)[long], -1)
    least[np.cumsum(step)[: len(least)] == 0] = 0  # no window crosses documents
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((h == most) & (most > 0))
    doc = np.searchsorted(starts, at, side="right") - 1
    left, right = np.maximum(at - (width - 1), starts[doc]), np.minimum(at + length, starts[doc] + sizes[doc])
    around = (total[right] - total[left]) * up[left]
    around = mix(around + (at - left).astype(np.uint64) * np.uint64(BASE) + (right - left).astype(np.uint64) * np.uint64(SCRAMBLE))
    return at, h[at], around


SENT = "bucket int, docs binary, marks binary, counts binary, places binary, high binary, low binary, around_high binary, around_low binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Lists of (doc_id, mark, size, first place, bytes) of about CHUNK bytes; long documents overlap so far that no window is lost."""
    out, total = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if doc is None or not text or len(text) < length:
                continue
            mark = zlib.crc32(text)
            for s in range(0, max(len(text) - length, 0) + 1, CHUNK):
                first = max(0, s - length)
                part = text[first : s + CHUNK + 2 * length]
                out.append((doc, mark, len(text), first, part))
                total += len(part)
                if total >= CHUNK:
                    yield out
                    out, total = [], 0
    if out:
        yield out


def _send(buckets: int, length: int):
    """Anchors of the documents by range of their numbers, of which 48 bits go."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, n = Powers(), [], 0
        for own in _stretches(batches, length):
            sizes = np.array([len(x[4]) for x in own])
            starts = np.cumsum(sizes) - sizes
            at, gram, around = anchors(np.frombuffer(b"".join(x[4] for x in own), np.uint8), starts, sizes, length, powers)
            k = np.searchsorted(starts, at, side="right") - 1
            whole, first = np.array([x[2] for x in own]), np.array([x[3] for x in own])
            place = at - starts[k] + first[k]
            # surroundings that a stretch cuts short belong to the next or the last stretch
            full = (at - starts[k] >= np.minimum(length - GRAM, place)) & (at - starts[k] + np.minimum(length, whole[k] - place) <= sizes[k])
            docs, marks = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.uint32)
            held.append(tuple(x[full] for x in (docs[k], marks[k], place.astype(np.int32), gram, around)))
            n += len(at)
            if n > max(300_000, 8 * buckets):
                yield _sent(held, buckets)
                held, n = [], 0
        if held:
            yield _sent(held, buckets)

    return send


def _sent(held: list[tuple], buckets: int) -> pa.RecordBatch:
    docs, marks, places, grams, arounds = (np.concatenate(x) for x in zip(*held))
    bucket = _gram_range(grams, buckets)
    order = np.argsort(bucket, kind="stable")
    docs, marks, places, grams, arounds = (x[order] for x in (docs, marks, places, grams, arounds))
    high, low = (grams >> np.uint64(32)).astype(np.uint32), (grams >> np.uint64(16)).astype(np.uint16)
    around_high, around_low = (arounds >> np.uint64(32)).astype(np.uint32), arounds.astype(np.uint32)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    rows = []
    for k, (s, e) in enumerate(zip(edges, edges[1:])):
        if s < e:
            new = np.flatnonzero(np.append(True, (np.diff(docs[s:e]) != 0) | (marks[s + 1 : e] != marks[s : e - 1]))) + s
            counts = np.diff(np.append(new, e)).astype(np.uint32)
            packed = (docs[new], marks[new], counts, *(x[s:e] for x in (places, high, low, around_high, around_low)))
            rows.append((k, *(x.tobytes() for x in packed)))
    types = [pa.int32()] + [pa.binary()] * 8
    columns = zip(*rows) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SENT_NAMES)


def _range(numbers: np.ndarray, n: int) -> np.ndarray:
    return ((numbers >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _gram_range(grams: np.ndarray, n: int) -> np.ndarray:
    """The range of an anchor. Anchors are least numbers, so these are spread before they are dealt."""
    return _range(mix(grams >> np.uint64(16)), n)


def _dest(docs: np.ndarray, n: int) -> np.ndarray:
    """The range of documents that a doc_id belongs to."""
    return _range(mix(docs.view(np.uint64)), n)


WAY = "dest int, kind string, docs binary, marks binary, places binary, grams binary, text binary"
WAY_NAMES = [x.split()[0] for x in WAY.split(", ")]


def _ways(kind: str, dests: int, docs: np.ndarray, marks: np.ndarray, places: np.ndarray, grams: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Items for documents, one row for each range of documents."""
    if not len(docs):
        return
    dest = _dest(docs, dests)
    order = np.lexsort((places[:, 0] if places.ndim > 1 else places, marks, docs, dest))
    docs, marks, places, dest = docs[order], marks[order], places[order], dest[order]
    edges = [0, *(np.flatnonzero(np.diff(dest)) + 1).tolist(), len(dest)]
    rows = []
    for s, e in zip(edges, edges[1:]):
        own = None if grams is None else grams[order][s:e].tobytes()
        rows.append((int(dest[s]), kind, docs[s:e].tobytes(), marks[s:e].tobytes(), np.ascontiguousarray(places[s:e]).tobytes(), own, None))
    types = [pa.int32(), pa.string()] + [pa.binary()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], WAY_NAMES)


def _meet(length: int, dests: int):
    """Anchors of one range: places whose surroundings stand earlier, and places that are asked for."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = by_key(batches)
        if t is None:
            return
        counts, _ = blob_arrays(t["counts"], np.uint32)
        docs, marks = (np.repeat(blob_arrays(t[c], k)[0], counts) for c, k in (("docs", np.int64), ("marks", np.uint32)))
        places, _ = blob_arrays(t["places"], np.int32)
        wide = lambda name: blob_arrays(t[name], np.uint32)[0].astype(np.uint64)
        grams = wide("high") << np.uint64(32) | blob_arrays(t["low"], np.uint16)[0].astype(np.uint64) << np.uint64(16)
        arounds = wide("around_high") << np.uint64(32) | wide("around_low")
        del t
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        docs, marks, places, grams, arounds = (x[order] for x in (docs, marks, places, grams, arounds))
        order = np.lexsort((places, marks, docs, arounds, grams))
        docs, marks, places, grams, arounds = (x[order] for x in (docs, marks, places, grams, arounds))
        if not len(docs):
            return
        new_gram = np.append(True, grams[1:] != grams[:-1])
        new_around = new_gram | np.append(True, arounds[1:] != arounds[:-1])
        repeat = ~new_around & np.append(False, (docs[1:] == docs[:-1]) & (marks[1:] == marks[:-1]) & (places[1:] == places[:-1]))
        gone = np.flatnonzero(~new_around & ~repeat)
        begin = np.flatnonzero(new_gram)
        kinds = np.add.reduceat(new_around.astype(np.int64), begin)
        asked = np.flatnonzero(new_around & (np.repeat(kinds, np.diff(np.append(begin, len(grams)))) > 1))
        yield from _ways("gone", dests, docs[gone], marks[gone], places[gone])
        yield from _ways("asked", dests, docs[asked], marks[asked], places[asked], grams[asked])

    return meet


def _texts(dests: int):
    """The documents, packed by range, on their way to the answers."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids, own = b.column(0), [t or b"" for t in b.column(1).to_pylist()]
            docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks, sizes = np.array([zlib.crc32(t) for t in own], np.uint32), np.array([len(t) for t in own], np.int32)
            named, dest = ids.is_valid().to_numpy(zero_copy_only=False), _dest(docs, dests)
            dest[~named] = np.arange((~named).sum()) % dests
            rows = []
            for kind, pick in (("text", named), ("nameless", ~named)):
                at = np.flatnonzero(pick)
                at = at[np.argsort(dest[at], kind="stable")]
                for k in np.split(at, np.flatnonzero(np.diff(dest[at])) + 1) if len(at) else ():
                    packed = press.compress(b"".join(own[i] for i in k.tolist()))
                    rows.append((int(dest[k[0]]), kind, docs[k].tobytes(), marks[k].tobytes(), sizes[k].tobytes(), None, packed))
            types = [pa.int32(), pa.string()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], WAY_NAMES)

    return texts


STATE = (
    "kind string, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "bucket int, docs binary, marks binary, places binary, highs binary, counts binary, spans binary, text binary"
)
STATE_NAMES = [x.split()[0] for x in STATE.split(", ")]
STATE_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _state(rows: list[dict]) -> pa.RecordBatch:
    kinds = [STATE_TYPES[x.split()[1]] for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(STATE_NAMES, kinds)], STATE_NAMES)


def cut(text: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal runs removed, SHA-256 of what stays) for spans [low, high)."""
    kept, runs, last, gone = [], 0, 0, 0
    low, high = -1, -1
    for s, e in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist() if len(spans) else ():
        if s > high:
            if high > low >= 0:
                kept.append(text[last:low])
                last, gone, runs = high, gone + high - low, runs + 1
            low, high = s, e
        else:
            high = max(high, e)
    if high > low >= 0:
        kept.append(text[last:low])
        last, gone, runs = high, gone + high - low, runs + 1
    kept.append(text[last:])
    return gone, runs, hashlib.sha256(b"".join(kept)).hexdigest()


def _result(doc: int | None, text: bytes, spans: np.ndarray) -> dict:
    gone, runs, sha = cut(text, spans)
    return {"kind": "done", "doc_id": doc, "n_bytes": len(text), "n_removed": gone, "n_spans": runs, "kept_sha256": sha}


def _items(rows: pa.Table, *columns: tuple[str, str]) -> dict[tuple[int, int], list[np.ndarray]]:
    """Arrays of items by document; columns: (name, dtype), in the order of docs and marks."""
    docs, marks = blob_arrays(rows["docs"], np.int64)[0], blob_arrays(rows["marks"], np.uint32)[0]
    if not len(docs):
        return {}
    order = np.lexsort((marks, docs))
    docs, marks = docs[order], marks[order]
    values = [blob_arrays(rows[c], k)[0].reshape(len(order), -1)[order] for c, k in columns]
    new = np.flatnonzero(np.append(True, (np.diff(docs) != 0) | (marks[1:] != marks[:-1])))
    edges = [*new.tolist(), len(docs)]
    return {(int(docs[s]), int(marks[s])): [v[s:e] for v in values] for s, e in zip(edges, edges[1:])}


def _kind(rows: pa.Table, *kinds: str) -> pa.Table:
    return rows.filter(pc.is_in(rows["kind"], pa.array(kinds)))


def _unpacked(rows: pa.Table) -> Iterator[tuple[str, int, int, bytes]]:
    """(kind, doc_id, mark, text) of packed rows."""
    open_ = zstandard.ZstdDecompressor()
    for kind, d, m, n, raw in zip(*(rows[c].to_pylist() for c in ("kind", "docs", "marks", "places", "text"))):
        whole, at = open_.decompress(raw), 0
        for doc, mark, size in zip(np.frombuffer(d, np.int64).tolist(), np.frombuffer(m, np.uint32).tolist(), np.frombuffer(n, np.int32).tolist()):
            yield kind, doc, mark, whole[at : at + size]
            at += size


def _advance(length: int, buckets: int):
    """Documents with their answers: finished ones, and of the others the surroundings that are asked for."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        around, n = [], 0
        for dest, rows in by_value(batches, "dest"):
            gone, asked = _items(_kind(rows, "gone"), ("places", "<i4")), _items(_kind(rows, "asked"), ("places", "<i4"), ("grams", "<u8"))
            out, left = [], []
            for kind, doc, mark, text in _unpacked(_kind(rows, "text", "nameless")):
                key = (doc, mark) if kind == "text" else None
                place = gone[key][0][:, 0] if key in gone else np.zeros(0, np.int32)
                spans = np.stack([np.maximum(place - (length - GRAM), 0), np.minimum(place, len(text) - length) + length], axis=1).astype(np.int32)
                if key not in asked:
                    out.append(_result(doc if key else None, text, spans))
                    continue
                left.append((doc, mark, text, spans))
                places, grams = (x[:, 0].tolist() for x in asked[key])
                for p, gram in zip(places, grams):
                    low, high = max(p - (length - GRAM), 0), min(p, len(text) - length)
                    around.append((gram, doc, mark, low, high, text[low : high + length]))
                    n += 1
            if left:
                counts = np.array([len(x[3]) for x in left], np.uint32)
                packed = {"docs": np.array([x[0] for x in left], np.int64), "marks": np.array([x[1] for x in left], np.uint32), "places": np.array([len(x[2]) for x in left], np.int32)}
                packed |= {"counts": counts, "spans": np.concatenate([x[3] for x in left])}
                out.append({"kind": "open", "bucket": dest, "text": press.compress(b"".join(x[2] for x in left))} | {k: v.tobytes() for k, v in packed.items()})
            if out:
                yield _state(out)
            if n > 30_000:
                yield _state(_packed_around(around, buckets, press))
                around, n = [], 0
        if around:
            yield _state(_packed_around(around, buckets, press))

    return advance


def _packed_around(around: list[tuple], buckets: int, press) -> list[dict]:
    """Surroundings by range of grams; those of one gram stand together and are much alike."""
    bucket = _gram_range(np.array([x[0] for x in around], np.uint64), buckets)
    order = np.lexsort((np.array([x[0] for x in around], np.uint64), bucket))
    around, bucket = [around[k] for k in order.tolist()], bucket[order]
    edges, out = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(around)], []
    for s, e in zip(edges, edges[1:]):
        own = around[s:e]
        packed = {"docs": (1, np.int64), "marks": (2, np.uint32), "places": (3, np.int32), "highs": (4, np.int32)}
        out.append({"kind": "around", "bucket": int(bucket[s]), "text": press.compress(b"".join(x[5] for x in own))} | {c: np.array([x[i] for x in own], k).tobytes() for c, (i, k) in packed.items()})
    return out


# ---- deep-shallow sorting


def _split(order: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes of each group by a character; groups part where it differs. Returns order and group starts flags."""
    k = np.lexsort((value, group))
    order, group, value = order[k], group[k], value[k]
    return order, np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))


def _tied(order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the groups of two and more: their suffixes, and numbers of the groups."""
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1 if len(group) else first
    return order[many], group[many]


def deep_shallow(character, n: int, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal strings among n suffixes of `depth` characters: suffix numbers, and the group of each.

    character(suffixes, i): the i-th 8-byte characters of these suffixes. Suffixes that equal no other are left out as
    soon as they stand alone.
    """
    order, group = np.arange(n), np.zeros(n, np.int64)
    for i in range(min(shallow, depth)):  # multikey quicksort: what ties on a character goes on to the next
        order, group = _tied(*_split(order, group, character(order, i)))
    # blind tries, all groups at a time: a node is a group, and its branching character the first that differs
    i = min(shallow, depth)
    while i < depth and len(order):
        value = character(order, i)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        branches = np.minimum.reduceat(value, starts) != np.maximum.reduceat(value, starts)
        on = np.repeat(branches, sizes)
        if on.any():  # the others skip this character unread
            parted, first = _split(order[on], group[on], value[on])
            parted, parts = _tied(parted, first)
            number = parts + (group[-1] + 1)
            order, group = np.concatenate([order[~on], parted]), np.concatenate([group[~on], number])
        i += 1
    return order, group


def _sort(length: int, dests: int):
    """Surroundings of some anchors to spans that go: all suffixes of `length` bytes in them but the first of each kind."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_value(batches, "bucket"):
            yield from sort_range(rows)

    def sort_range(t: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, marks, low, high = (blob_arrays(t[c], k)[0] for c, k in (("docs", np.int64), ("marks", np.uint32), ("places", np.int32), ("highs", np.int32)))
        open_ = zstandard.ZstdDecompressor()
        flat = np.frombuffer(b"".join(open_.decompress(x) for x in t["text"].to_pylist()) + b"\0" * 8, np.uint8)
        del t
        sizes = high - low + length
        eight = np.zeros(len(flat) - 7, np.uint64)  # 8-byte characters at every place
        for j in range(8):
            eight = (eight << np.uint64(8)) | flat[j : len(flat) - 7 + j]
        windows = high - low + 1
        own = np.repeat(np.arange(len(docs), dtype=np.int32), windows)
        offset = (np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
        at = (np.cumsum(sizes, dtype=np.int64) - sizes)[own] + offset
        where = [min(8 * i, length - 8) for i in range(-(-length // 8))]
        order, group = deep_shallow(lambda s, i: eight[at[s] + where[i]], len(at), len(where))
        start = low[own[order]] + offset[order]
        d, m = docs[own[order]], marks[own[order]]
        k = np.lexsort((start, m, d, group))
        d, m, start, group = d[k], m[k], start[k], group[k]
        later = np.append(False, group[1:] == group[:-1])
        # a place that is asked for twice is the first one again
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(d)))) if len(d) else later.astype(int)
        pick = np.flatnonzero(later[: len(d)] & ~((d == d[head]) & (m == m[head]) & (start == start[head])))
        pick = pick[np.lexsort((start[pick], m[pick], d[pick]))]
        d, m, start = d[pick], m[pick], start[pick]
        if not len(d):
            return
        fresh = np.append(True, (np.diff(d) != 0) | (m[1:] != m[:-1]) | (np.diff(start) > length))
        begin = np.flatnonzero(fresh)
        spans = np.stack([start[begin], start[np.append(begin[1:], len(d)) - 1] + length], axis=1).astype(np.int32)
        yield from _ways("span", dests, d[begin], m[begin], spans)

    return sort


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in by_value(batches, "dest"):
        more, out = _items(_kind(rows, "span"), ("places", "<i4")), []
        left = _kind(rows, "open")
        counts, spans = blob_arrays(left["counts"], np.uint32)[0], blob_arrays(left["spans"], np.int32)[0].reshape(-1, 2)
        ends = np.cumsum(counts).tolist()
        for (_, doc, mark, text), n, e in zip(_unpacked(left), counts.tolist(), ends):
            own = [spans[e - n : e], *([more[doc, mark][0]] if (doc, mark) in more else [])]
            out.append(_result(doc, text, np.concatenate(own)))
        if out:
            yield _state(out)


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    parts, docs = partitions(documents.sparkSession), doc_texts(documents)
    ranges = text_ranges(docs)
    dests = ranges // 2  # ranges of documents, of which a task holds one at a time
    sent = docs.where(F.octet_length("text") >= length).transform(arrow, _send(ranges, length), SENT)
    answers = sent.repartitionById(parts, "bucket").transform(arrow, _meet(length, dests), WAY)
    both = answers.unionByName(docs.transform(arrow, _texts(dests), WAY))
    state = durable(both.repartitionById(parts, "dest").transform(arrow, _advance(length, ranges), STATE))
    around = state.where("kind = 'around'").select("bucket", "docs", "marks", "places", "highs", "text")
    spans = around.repartitionById(parts, "bucket").transform(arrow, _sort(length, dests), WAY).select("dest", "kind", "docs", "marks", "places", "text")
    spans = spans.withColumns({"counts": F.lit(None).cast("binary"), "spans": F.lit(None).cast("binary")})
    left = state.where("kind = 'open'").select(F.col("bucket").alias("dest"), "kind", "docs", "marks", "places", "text", "counts", "spans")
    rest = left.unionByName(spans).repartitionById(parts, "dest").transform(arrow, _finish, STATE)
    return state.where("kind = 'done'").unionByName(rest).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
