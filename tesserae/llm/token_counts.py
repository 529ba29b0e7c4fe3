"""Token counts by finite-state transducers compiled from a byte-level vocabulary file.

Two deterministic transducers in a row give the number of tokens without making any. The splitter reads classes of
characters; its transitions say where the pieces begin that merging never crosses. The merger reads bytes of a piece; its
transitions are annotated with the change of the number of tokens (a merge may take tokens back).

The splitter is small and compiled whole. A text is cut into chunks of equal length wherever that falls; each chunk's map
(the state it ends in, for every state it may start in) is made without knowing the chunk before, and a prefix scan composes
the maps, doubling the reach in each step, so that all chunks then know their start. The merger's states are made when a
text first needs them, up to a bound; beyond it they are made anew. A state lists the ends of the text so far that a token
could still grow from: their place in the trie of tokens, the last token before them, and the difference in counts. Chunks
of the merger begin where a piece begins, so all start in its first state. All chunks advance together, one table look-up
each.

Both rest on the file: what is a letter, a number or a space is asked of the tokenizer once, with all characters in a row.
Control strings in a text are one token each and part the text, as the library has it.

Defined results: null text is empty: 0 bytes and no tokens; every row gives a row, repeated and null ids included; bytes
that are no UTF-8 count as U+FFFD, but n_bytes counts them as they are; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, doc_texts
from .packing import _byte_of, encoder

WINDOW = 1 << 21  # bytes of text that are read together
LANE = 512  # characters or bytes of a chunk
MOST_BITS = 19  # transitions that are held at once, as a power of two
NEVER = 1 << 40

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, S_T_M_D, R_V, E, L = range(10)
CLASSES, PAD = 10, 20  # the first character of a text has its class plus 10; PAD changes nothing
#: States: nothing read; in a run of letters, numbers, others; after an opening quote, with r or v, with l, with a whole
#: contraction; after one space, one other blank, and a run of several blanks that ends so.
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_L, CONTRACTED, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before it


def _opened(c: int) -> int:
    """The state after the first character of a piece."""
    return {NUMBER: NUMBERS, OTHER: OTHERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: QUOTED}.get(c, LETTERS)


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and where pieces begin: contractions, runs with one leading space, blanks but for the last before a run."""
    letter = c in (LETTER, S_T_M_D, R_V, E, L)
    if state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
        if c in (SPACE, BLANK):
            return (MORE_SPACE if c == SPACE else MORE_BLANK), 0
        begins = BEFORE if state in (MORE_SPACE, MORE_BLANK) else 0
        if state in (ONE_SPACE, MORE_SPACE):
            return (OTHERS if c == QUOTE else _opened(c)), begins
        return _opened(c), begins | HERE
    if state == LETTERS and letter:
        return LETTERS, 0
    if state == NUMBERS and c == NUMBER:
        return NUMBERS, 0
    if state in (OTHERS, QUOTED) and c in (OTHER, QUOTE):
        return OTHERS, 0
    if state == QUOTED and c in (S_T_M_D, R_V, L):
        return {S_T_M_D: CONTRACTED, R_V: QUOTED_R, L: QUOTED_L}[c], 0
    if (state, c) in ((QUOTED_R, E), (QUOTED_L, L)):
        return CONTRACTED, 0
    if state in (QUOTED_R, QUOTED_L):  # the quote stands alone; a run of letters began after it
        return (LETTERS, BEFORE) if letter else (_opened(c), BEFORE | HERE)
    return _opened(c), HERE


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables by [symbol, state]: next state, and where pieces begin."""
    follows, begins = np.zeros((PAD + 1, STATES), np.uint8), np.zeros((PAD + 1, STATES), np.uint8)
    for c in range(CLASSES):
        for state in range(STATES):
            follows[c, state], begins[c, state] = _step(state, c)
            follows[c + CLASSES, state] = _opened(c)
            begins[c + CLASSES, state] = HERE | (BEFORE if state in (QUOTED_R, QUOTED_L) else 0)
    follows[PAD] = np.arange(STATES)
    return follows, begins


FOLLOWS, BEGINS = splitter()


def chunk_maps(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each row of symbols: the state it ends in for every start; and how many symbols tell all starts apart no more."""
    now = np.tile(np.arange(STATES, dtype=np.uint8), (len(symbols), 1))
    for t in range(symbols.shape[1]):
        if (now == now[:, :1]).all():
            one = now[:, 0]
            for u in range(t, symbols.shape[1]):
                one = FOLLOWS[symbols[:, u], one]
            return np.repeat(one[:, None], STATES, axis=1), t
        now = FOLLOWS[symbols[:, t, None], now]
    return now, symbols.shape[1]


def scan(maps: np.ndarray) -> np.ndarray:
    """The states before each chunk: maps composed with those 1, 2, 4, ... chunks before."""
    reach, maps = 1, maps.copy()
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return np.append(np.uint8(START), maps[:-1, START])


def piece_starts(symbols: np.ndarray, whole: bool) -> np.ndarray:
    """Whether a piece begins, for each symbol of a row of texts; whole: the last text ends with them."""
    n = len(symbols)
    rows = np.full((-(-n // LANE), LANE), PAD, np.uint8)
    rows.ravel()[:n] = symbols
    state = scan(chunk_maps(rows)[0])
    marks = np.empty(rows.shape, np.uint8)
    for t in range(LANE):
        own = rows[:, t]
        marks[:, t] = BEGINS[own, state]
        state = FOLLOWS[own, state]
    marks = marks.ravel()[:n]
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    if whole and state[-1] in (QUOTED_R, QUOTED_L):
        starts[-1] = True
    return starts


class Table:
    """Numbers by number, looked up many at once: open addressing in two arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; 0 for those that are not there."""
        at = self.slots(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            there = self.keys[at[open_]]
            found[open_] = np.where(there == keys[open_], self.values[at[open_]], 0)
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are new and distinct."""
        at = self.slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys  # of several keys for a slot one has won
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], at[~here] + 1 & self.mask


class Merger:
    """The merging transducer of a vocabulary, with states made on demand.

    A state is a tuple of ends, the longest first, each packed into a number: node of the trie, last token before it (plus
    one; 0: the piece begins there), and the count before it less the count now (plus 128).
    """

    def __init__(self, path: str):
        spec, byte = json.loads(Path(path).read_text()), _byte_of()
        number = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {token: bytes(byte[c] for c in token) for token in number if token not in special}
        self.bytes = {number[token]: b for token, b in raw.items()}
        self.single = {b[0]: number[token] for token, b in raw.items() if len(b) == 1}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (number[x] for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[a, b] = rank
            self.parts.setdefault(number["".join(m.split(" ") if isinstance(m, str) else m)], (a, b))
        self.child: dict[int, int] = {}  # node << 8 | byte
        self.token: dict[int, int] = {}
        nodes = 1
        for k, b in sorted(self.bytes.items()):
            at = 0
            for x in b:
                to = self.child.get(at << 8 | x)
                if to is None:
                    to = self.child[at << 8 | x] = nodes
                    nodes += 1
                at = to
            self.token[at] = k
        self.inner = {key >> 8 for key in self.child}
        self.edges: dict[int, tuple] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table, self.made_of = Table(MOST_BITS + 1), 0  # state << 8 | byte: next state << 8 | change of the count + 128
        self.intern((128,))

    def intern(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def stays(self, token: int) -> bool:
        """Whether the merges of the token's own bytes, the earliest of the file first and from the left, end in it."""
        ids = [self.single[x] for x in self.bytes[token]]
        while len(ids) > 1:
            rank, i = min((self.rank.get(pair, NEVER), i) for i, pair in enumerate(pairwise(ids)))
            if rank == NEVER:
                break
            left, right = ids[i : i + 2]
            ids[i : i + 2] = [self.by_bytes(self.bytes[left] + self.bytes[right])]
        return ids == [token]

    def by_bytes(self, b: bytes) -> int:
        at = 0
        for x in b:
            at = self.child[at << 8 | x]
        return self.token[at]

    def edge(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """What stands at the left (0) or right (1) end of a token while it is made: ids, and the rank that takes each away."""
        own = self.edges.get(token << 1 | side)
        if own is None:
            ids, gone = [token], [NEVER]
            while ids[-1] in self.parts:
                gone.append(self.rank[self.parts[ids[-1]]])
                ids.append(self.parts[ids[-1]][side])
            own = self.edges[token << 1 | side] = (ids[::-1], gone[::-1])
        return own

    def follow(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are side by side; a = -1: whether b stays as it is.

        They do unless, while both are made, their inner ends could merge before either is taken away. Of equal merges the
        left one comes first.
        """
        if a < 0:
            return self.stays(b)
        (left, left_gone), (right, right_gone), i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            rank = self.rank.get((left[i], right[j]), NEVER)
            if rank < left_gone[i] and rank <= right_gone[j] and rank < NEVER:
                return False
            if left_gone[i] == right_gone[j] == NEVER:
                return True
            if left_gone[i] <= right_gone[j]:
                i += 1
            else:
                j += 1

    def made(self, key: int) -> int:
        """The transition of state << 8 | byte. The last token of a text is the one that stays beside the last before it."""
        byte, token, change, left = key & 255, -1, 0, []
        child, fits = self.child.get, self.fits
        for end in self.states[key >> 8]:
            to = child(end >> 26 << 8 | byte)
            if to is None:
                continue
            if token < 0 and to in self.token:
                pair = ((end >> 8 & 0x3FFFF) - 1, self.token[to])
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= 1 << MOST_BITS:
                        fits.clear()
                    ok = fits[pair] = self.follow(*pair)
                if ok:
                    token, change = pair[1], (end & 255) - 127
            if to in self.inner:
                left.append(to << 26 | end & 0x3FFFFFF)
        left = [end - change for end in left]
        left.append(token + 1 << 8 | 128)
        self.made_of += 1
        return self.intern(tuple(left)) << 8 | change + 128

    def full(self, more: int) -> bool:
        return self.made_of + more > 1 << MOST_BITS

    def fill(self, keys: np.ndarray) -> np.ndarray:
        """Look-ups of state << 8 | byte; what is missing is made, and all anew if that would be too much."""
        found = self.table.get(keys)
        missing = np.flatnonzero(found == 0)
        if not len(missing):
            return found
        if self.full(len(missing)):
            live = [self.states[key >> 8] for key in keys.tolist()]
            self.clear()
            keys = np.fromiter(map(self.intern, live), np.int64, len(live)) << 8 | keys & 255
            missing = np.arange(len(keys))
        new, which = np.unique(keys[missing], return_inverse=True)
        values = np.array([self.made(key) for key in new.tolist()], np.int32)
        self.table.put(new, values)
        found[missing] = values[which]
        return found

    def changes(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The change of the count at each byte. starts: where pieces begin, the first byte included."""
        n = len(text)
        edges = starts[np.unique(np.searchsorted(starts, np.arange(0, n, LANE)).clip(max=len(starts) - 1))]
        lengths = np.diff(np.append(edges, n))
        order = np.argsort(-lengths, kind="stable")
        edges, lengths = edges[order], lengths[order]
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        out, state, t = np.empty(n, np.int16), np.zeros(len(edges), np.int64), 0
        active = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")  # lanes longer than t
        while t < lengths[0] and active[t] >= 4:
            at = edges[: active[t]] + t
            found = self.fill(np.where(fresh[at], 0, state[: active[t]]) << 8 | text[at])
            out[at] = (found & 255) - 128
            state = (found >> 8).astype(np.int64)
            t += 1
        for lane in range(active[t] if t < lengths[0] else 0):  # few are left: pieces far longer than a lane
            first, last = int(edges[lane]) + t, int(edges[lane] + lengths[lane])
            out[first:last] = self.line(int(state[lane]) if t else 0, text[first:last].tolist(), fresh[first:last].tolist())
        return out

    def line(self, state: int, text: list[int], fresh: list[bool]) -> list[int]:
        got, known = [], {}
        live = self.states[state]
        for x, begin in zip(text, fresh):
            key = x if begin else self.intern(live) << 8 | x
            value = known.get(key)
            if value is None:
                if self.full(1):
                    self.clear()
                    known.clear()
                    key = x if begin else self.intern(live) << 8 | x
                value = int(self.table.get(np.array([key]))[0])
                if not value:
                    value = self.made(key)
                    self.table.put(np.array([key]), np.array([value], np.int32))
                known[key] = value
            live = self.states[value >> 8]
            got.append((value & 255) - 128)
        return got


def classes(path: str) -> list[tuple[int, int]]:
    """(first code point, class): runs of characters of a class, as the tokenizer tells them apart."""
    from tokenizers import Tokenizer

    encoder(path)  # raises unless the file splits texts and merges as the transducers do
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    plain = [chr(c) for c in range(1, 0x110000) if c != 0x20 and not 0xD800 <= c < 0xE000]  # a space would join what follows
    firsts = [at for _, (at, _) in split("".join(plain))]
    probe = "".join(f"\n{x}{plain[at]}" for at in firsts for x in "a1!")
    begins = {at for _, (at, _) in split(probe)}
    runs = [(0, OTHER)]
    for k, at in enumerate(firsts):
        kind = [x for x, c in enumerate((LETTER, NUMBER, OTHER)) if 9 * k + 3 * x + 2 not in begins]
        runs.append((ord(plain[at]), kind[0] if kind else BLANK))
    return runs


def class_table(runs: list[tuple[int, int]]) -> np.ndarray:
    """The class of every code point; ASCII letters of contractions, the quote and the space have their own."""
    firsts, kinds = np.array(runs).T
    table = np.repeat(kinds.astype(np.uint8), np.diff(np.append(firsts, 0x110000)))
    for c, own in ((" ", SPACE), ("'", QUOTE), ("e", E), ("l", L), *((c, S_T_M_D) for c in "stmd"), *((c, R_V) for c in "rv")):
        table[ord(c)] = own
    return table


class Counter:
    """Numbers of tokens of texts in one process."""

    def __init__(self, path: str, runs: list[tuple[int, int]]):
        self.classes, self.merger = class_table(runs), Merger(path)
        special = sorted((t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)).encode()) if special else None

    def window(self, text: bytes, firsts: np.ndarray, whole: bool) -> tuple[np.ndarray, int]:
        """Changes of the count at the bytes of texts that lie side by side and begin at firsts, and how many bytes that is:
        all of them if the last text is whole, otherwise as many as end with a piece.
        """
        raw = np.frombuffer(text, np.uint8)
        chars = np.flatnonzero((raw & 0xC0) != 0x80)
        points = raw if len(chars) == len(raw) else np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
        symbols = self.classes[points]
        symbols[np.searchsorted(chars, firsts)] += CLASSES
        starts = chars[piece_starts(symbols, whole)]
        end = len(raw) if whole else int(starts[-1])
        return (self.merger.changes(raw[:end], starts[starts < end]) if end else np.zeros(0, np.int16)), end

    def long(self, text: bytes) -> int:
        """Tokens of one text, read by windows that begin where a piece begins."""
        at, size, total = 0, WINDOW, 0
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            changes, read = self.window(text[at:end], np.zeros(1, np.int64), end == len(text))
            total += int(changes.sum(dtype=np.int64))
            at += read
            size = WINDOW if read else 2 * size  # a piece longer than the window
        return total

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0

        def read() -> None:
            if held:
                lengths = np.fromiter(map(len, held), np.int64, len(held))
                firsts = np.cumsum(lengths) - lengths
                changes, _ = self.window(b"".join(held), firsts, True)
                np.add.at(out, owners, np.add.reduceat(changes, firsts, dtype=np.int64))

        for k, text in enumerate(texts):
            if not text:
                continue
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            parts, last = [], 0
            for m in self.special.finditer(text) if self.special else ():
                out[k] += 1
                parts.append(text[last : m.start()])
                last = m.end()
            for part in (*parts, text[last:]) if last else (text,):
                if len(part) > WINDOW:
                    out[k] += self.long(part)
                elif part:
                    held.append(part)
                    owners.append(k)
                    size += len(part)
                    if size >= WINDOW:
                        read()
                        held, owners, size = [], [], 0
        read()
        return out


@lru_cache(1)
def counter(path: str, runs: tuple) -> Counter:
    return Counter(path, runs)


def count(documents: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document, from one pass without a shuffle."""
    runs = tuple(classes(tokenizer))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer, runs)
        for b in batches:
            texts = b.column("text")
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(own.count(texts.to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])

    rows = doc_texts(documents).transform(arrow, counted, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
