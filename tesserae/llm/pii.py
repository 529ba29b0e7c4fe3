"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, digits and cue words in one pass;
a local parser at each anchor expands to the boundaries and validates what it has.

Base kinds, leftmost and non-overlapping per kind: email, ip, card, phone. The parsers give what a regular expression
scan would, in time linear in the text. Kinds the method adds: url, address (IPv6 after a bracket or cue), iban, ssn,
account and secret after a cue word.

Defined results: null and empty texts have no spans; every input row gives one output row, repeated and null ids included;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, doc_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "address", "iban", "ssn", "account", "secret")
KINDS = BASE + ADDED

#: Cue words and what follows them; fixed values.
CUES = {
    "ssn": ("ssn", "social security"),
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
    "secret": ("password", "passwd", "pwd", "token", "api_key", "apikey", "secret"),
    "address": ("ipv6", "inet6"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"[ ().0-9-]++")
URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]++")
SSN = re.compile(r"[ :#=]{0,4}(?:number|no\.?)?[ :#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
IBAN = re.compile(r"[ :#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){2,8})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[ :#=]{0,4}(?:number|no\.?|nr\.?)?[ :#=]{0,4}([0-9](?:-?[0-9]){6,17})(?![0-9])", re.I)
SECRET = re.compile(r"[ ]?[:=][ ]?[\"']?([A-Za-z0-9+/_.-]{8,}+)")
ADDRESS = re.compile(r"[ :=\[]{0,4}([0-9A-Fa-f:]{3,39}+)")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, str] = {"@": "email", "://": "url", "AKIA": "key"}
    for d in "0123456789":
        words[f"+{d}"] = "phone"
        words[f".{d}"] = "ip"
        for e in "0123456789":
            for gap in ("", " ", "-"):
                words[f"{d}{gap}{e}"] = "card"
    for kind, own in CUES.items():
        for w in own:
            for form in (w, w.upper(), w.capitalize()):
                words[form] = kind
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def email_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The address around the at-sign; it can't begin before `after`."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def ips_at(text: str, digit: int, after: int) -> tuple[list[tuple[int, int]], int]:
    """Fours of the run of numbers joined by dots around the digit, and the run's end."""
    start = digit
    while start > after and (text[start - 1] in DIGITS or text[start - 1] == "." and start - 1 > after and text[start - 2] in DIGITS):
        start -= 1
    end = DOTTED.match(text, start).end()
    parts, out, at = text[start:end].split("."), [], start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        to = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
            out.append((at, to))
        at = to + 1
    return out, end


def card_at(text: str, digit: int, after: int) -> tuple[tuple[int, int] | None, int]:
    """The run of digits, with single blanks or hyphens between, around the digit; and the run's end."""
    start = digit
    while start > after and (text[start - 1] in DIGITS or text[start - 1] in " -" and start - 1 > after and text[start - 2] in DIGITS):
        start -= 1
    m = CARD.match(text, start)
    digits = m[0].replace(" ", "").replace("-", "")
    return ((start, m.end()) if 16 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def phone_at(text: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """The number from the plus sign on: its last digit stands two characters after the first, at least."""
    m = DIALLED.match(text, plus + 2)
    if not m:
        return None, plus + 1
    end = m.end()
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None, plus + 1
    n = sum(c in DIGITS for c in text[plus:end])
    return ((plus, end) if 8 <= n <= 15 else None), end


def _after_cue(kind: str, text: str, at: int) -> tuple[int, int] | None:
    if kind == "ssn":
        m = SSN.match(text, at)
        ok = m and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000"
    elif kind == "iban":
        m = IBAN.match(text, at)
        ok = m and iban_ok(m[1])
    elif kind == "account":
        m = ACCOUNT.match(text, at)
        ok = bool(m)
    elif kind == "secret":
        m = SECRET.match(text, at)
        ok = m and any(c in DIGITS for c in m[1])
    else:
        m = ADDRESS.match(text, at)
        try:
            ok = bool(m) and ipaddress.IPv6Address(m[1].strip(":") if m[1].count("::") == 0 else m[1]) is not None
        except ValueError:
            ok = False
    return m.span(1) if ok else None


def spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each kind from left to right without overlaps."""
    out: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)  # where the next span of a kind can begin
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        found = None
        if kind == "email":
            found = email_at(text, at, done["email"])
        elif kind == "ip":
            if last >= done["ip"] and at and text[at - 1] in DIGITS and at - 1 >= done["ip"]:
                got, done["ip"] = ips_at(text, last, done["ip"])
                out.setdefault("ip", []).extend(got)
            continue
        elif kind == "card":
            if at >= done["card"]:
                found, done["card"] = card_at(text, at, done["card"])
                if found:
                    out.setdefault("card", []).append(found)
            continue
        elif kind == "phone":
            if at >= done["phone"]:
                found, done["phone"] = phone_at(text, at)
                if found:
                    out.setdefault("phone", []).append(found)
            continue
        elif kind == "url":
            start = at
            while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = URL.match(text, last + 1) if start < at else None
            if m:
                found = start, last + 1 + len(m[0].rstrip(".,;:!?'"))
        elif kind == "key":
            m = KEY_ID.match(text, at)
            kind, found = "secret", m and m.span()
        else:
            found = _after_cue(kind, text, last + 1)
        if found and found[0] >= done[kind]:
            out.setdefault(kind, []).append(found)
            done[kind] = found[1]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = spans(text, anchors) if text else {}
            named = {k: [f"{k}:{s}:{e}" for s, e in found[k]] for k in KINDS if k in found}
            base = ",".join(x for k in BASE for x in named.get(k, ()))
            whole = ",".join(x for k in KINDS for x in named.get(k, ()))
            rows.append((doc, *(len(named.get(k, ())) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), whole))
        types = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per document."""
    docs = doc_texts(documents).selectExpr("doc_id", "cast(text as string) as text")
    return docs.transform(arrow, _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _mask(text_at: int):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            new = [redact(t, anchors) if t else t for t in b.column(text_at).to_pylist()]
            columns = list(b.columns)
            columns[text_at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return mask


def redact(text: str, anchors) -> str:
    """The text with every span as its kind in angle brackets; where spans overlap, the earlier kind names the stretch."""
    out, last = [], 0
    for start, end, kind in sorted((s, e, k) for k, own in spans(text, anchors).items() for s, e in own):
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def mask(documents: DataFrame) -> DataFrame:
    """The documents in their own columns with personal data masked in text."""
    return documents.transform(arrow, _mask(documents.columns.index("text")), documents.schema)
