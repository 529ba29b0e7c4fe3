"""Chat formatting: records of many layouts become canonical turns, then one marked and reversible text with a loss mask.

A layout is known by its fingerprint: the SHA-256 of its nested field paths (sorted, one a line; `[]` for "each of"),
fields that no layout uses left aside. For a typed table the paths are those of its schema, so one mapping is chosen when
the plan is made; for JSON records they are found in every record. Everything is DataFrame functions.

Defined results: a null text or role is empty; rows of equal turn follow role, then text; repeated rows are turns of their
own; rows with a null conversation id form one conversation; an empty table gives an empty table; JSON records that no
mapping fits, or that do not parse, are left to `unmapped`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """How one layout maps to turns: a row is a turn; or each element of an array is; or named fields are, in order."""

    name: str
    row: tuple[str, str, str] | None = None  # turn, role, text
    each: tuple[str, str, str] | None = None  # array, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by an empty line
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        if self.row:
            return sorted(self.row)
        if self.each:
            array, role, text = self.each
            return sorted([array, f"{array}[].{role}", f"{array}[].{text}"])
        return sorted(f for _, own in self.fields for f in own)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _both(name: str, *turns: tuple[str, tuple[str, ...]]) -> list[Layout]:
    """The layout as it is, and with a system field before it."""
    return [Layout(name, fields=turns), Layout(f"{name}+system", fields=(("system", ("system",)), *turns))]


LAYOUTS = [
    Layout("turn rows", row=("turn", "role", "text")),
    Layout("messages", each=("messages", "role", "content")),
    Layout("conversations", each=("conversations", "from", "value"), roles=SPEAKERS),
    *_both("prompt and response", ("user", ("prompt",)), ("assistant", ("response",))),
    *_both("prompt and completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    *_both("question and answer", ("user", ("question",)), ("assistant", ("answer",))),
    *_both("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    *_both("instruction with input", ("user", ("instruction", "input")), ("assistant", ("output",))),
]
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        own = f"{at}.{f.name}" if at else f.name
        out += [own, *schema_paths(f.dataType, own)]
    return out


def _text(*columns) -> F.Column:
    """Several fields as one text: empty ones are left out."""
    full = [F.when(c.cast("string") != "", c.cast("string")) for c in columns]
    return F.concat_ws("\n\n", *full)


def _speaker(role, roles: dict[str, str]) -> F.Column:
    out = role
    for old, new in roles.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _turn_array(layout: Layout, get, each) -> F.Column:
    """The turns of a record as array<struct<role, text>>."""
    if layout.each:
        array, role, text = layout.each
        return F.transform(each(array), lambda m: F.struct(_speaker(get(m, role), layout.roles).alias("role"), get(m, text).alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), _text(*(get(None, f) for f in own)).alias("text")) for role, own in layout.fields])


def turns_of_table(table: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a typed table, by the mapping its schema's fingerprint selects."""
    mark = fingerprint(schema_paths(table.schema))
    if mark not in BY_FINGERPRINT:
        raise ValueError(f"no mapping for the field paths {sorted(set(schema_paths(table.schema)) & set(KNOWN))}")
    layout = BY_FINGERPRINT[mark]
    conv = table[conv_col].cast("long").alias("conv_id")
    if layout.row:
        turn, role, text = (table[c] for c in layout.row)
        return table.select(conv, turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    array = _turn_array(layout, lambda m, f: (table[f] if m is None else m[f]).cast("string"), lambda name: table[name])
    return _exploded(table.select(conv, array.alias("turns")))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("turns").alias("turn", "one")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("one.role").alias("role"), F.col("one.text").alias("text")
    )


def _marked(records: DataFrame, conv_col: str, payload_col: str) -> DataFrame:
    """conv_id, the parsed record, and the fingerprint of the paths it has (in arrays: of the first element)."""
    df = records.select(records[conv_col].cast("long").alias("conv_id"), records[payload_col].alias("payload")).withColumn(
        "v", F.try_parse_json("payload")
    )
    there = [F.when(F.try_variant_get("v", f"$.{p.replace('[]', '[0]')}", "variant").isNotNull(), F.lit(p)) for p in KNOWN]
    return df.withColumn("mark", F.sha2(F.concat_ws("\n", *there), 256))


def turns_of_json(records: DataFrame, conv_col: str = "conv_id", payload_col: str = "payload") -> DataFrame:
    """Canonical turns of JSON records; each record's own fingerprint selects its mapping."""

    def get(m, name):
        return F.try_variant_get(F.col("v") if m is None else m, f"$.{name}", "string")

    def each(name):
        return F.try_variant_get("v", f"$.{name}", "array<variant>")

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, layout in BY_FINGERPRINT.items():
        if not layout.row:
            turns = F.when(F.col("mark") == mark, _turn_array(layout, get, each)).otherwise(turns)
    rows = _marked(records, conv_col, payload_col)
    single = next(m for m, x in BY_FINGERPRINT.items() if x.row)
    alone = rows.where(F.col("mark") == single).select(
        "conv_id", F.try_variant_get("v", "$.turn", "long").alias("turn"), get(None, "role").alias("role"), get(None, "text").alias("text")
    )
    return _exploded(rows.select("conv_id", turns.alias("turns"))).unionByName(alone)


def unmapped(records: DataFrame, conv_col: str = "conv_id", payload_col: str = "payload") -> DataFrame:
    """The JSON records that turns_of_json has no mapping for."""
    return _marked(records, conv_col, payload_col).where(~F.col("mark").isin(list(BY_FINGERPRINT))).select("conv_id", "payload")


def escape(text, line: bool = False) -> F.Column:
    """Text without control strings; line: without line ends too."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text, line: bool = False) -> F.Column:
    out = F.regexp_replace(text, r"\\([\\|])", "$1")
    if line:  # a line end is told from an escaped backslash by reading from the left
        out = F.regexp_replace(F.regexp_replace(text, r"\G((?:[^\\]|\\[\\|])*+)\\n", "$1\n"), r"\\([\\|])", "$1")
    return F.when(F.instr(text, "\\") > 0, out).otherwise(text)


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and losses: per turn the code points [start, end) to learn, or null."""
    text, role = F.coalesce(turns["text"], F.lit("")), F.coalesce(turns["role"], F.lit(""))
    head = F.concat(F.lit(START), escape(role, True), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size").cast("long")).over(order), F.lit(0).cast("long")))
    begin = F.col("start") + F.length("head")
    loss = F.when(F.col("role") == learn, F.struct(begin.alias("start"), (begin + F.length("body")).alias("end")))
    piece = F.struct("start", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return whole.select("conv_id", F.array_join("pieces.piece", "").alias("formatted"), F.col("pieces.loss").alias("losses"))


def read_back(chats: DataFrame, *keep: str) -> DataFrame:
    """The turns again, from the formatted text and its mask alone: conv_id, turn, role, text, loss (text under the mask, or null).

    keep: further columns of chats to repeat beside each turn.
    """
    marked = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.arrays_zip(F.slice(marked, F.lit(1), F.size(marked) - 1).alias("piece"), F.col("losses").alias("loss"))
    rows = chats.select("conv_id", *keep, F.posexplode(pieces).alias("turn", "one")).select("conv_id", *keep, "turn", "one.piece", "one.loss")
    order = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum((F.length("piece") + len(END)).cast("long")).over(order), F.lit(0).cast("long")))
    head = F.instr("piece", "\n")
    text = F.substring(F.col("piece"), head + 1, F.length("piece"))
    role = F.substring(F.col("piece"), F.lit(len(START) + 1), head - len(START) - 1)
    begin, size = (F.col("loss.start") - F.col("start") + 1).cast("int"), (F.col("loss.end") - F.col("loss.start")).cast("int")
    learned = unescape(F.substring(F.col("piece"), begin, size))
    return rows.select("conv_id", *keep, "turn", unescape(role, True).alias("role"), unescape(text).alias("text"), learned.alias("loss"))


def digest(turns: DataFrame) -> DataFrame:
    """Format, read back, and sum up each conversation."""
    chats = format_chats(turns).withColumn("formatted_chars", F.length("formatted").cast("long"))
    again = read_back(chats, "formatted_chars")
    one = F.struct("turn", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), "loss")
    rows = again.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("own"), F.first("formatted_chars").alias("formatted_chars"))
    learned = F.array_join("own.loss", "")
    return rows.select(
        "conv_id",
        F.size("own").cast("long").alias("n_turns"),
        F.sha2(F.array_join("own.said", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
