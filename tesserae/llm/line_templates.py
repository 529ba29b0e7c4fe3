"""Line dedup by a log-template tree: lines of the same template that recur across documents are dropped.

The tree has a fixed depth. A line first goes by its number of tokens (parts between single spaces; a token with a digit
is a variable and reads `<*>`), then by its `depth` leading tokens. A node that few documents reach is left at once, and
most lines end there. In the leaves that remain a template is the whole line, or the line with variable fields open:
of lines with many tokens one or two of `blocks` stretches behind the leading tokens, of shorter ones one such token.
So a field may be of any words within its stretch, but lines of different numbers of tokens never share a template, nor
do lines that differ in a leading token without a digit. Templates are told apart by their text, not by a hash of it. A
line belongs to every template it fits; it goes if one of them recurs.

A template recurs if `least_docs` different documents have it. Copies are not different documents, and show by what else
they hold: a line that `least_docs` documents hold as a whole is shared, and a document counts for a template only if a
third at least of the tokens of its other lines (`least_tokens` and more each) is not shared. So a passage that lives in
copies of one document stays, as does a document whose only line it is; neither a thousand copies nor a long header can
hide a passage of three other documents, and edited copies, whose other lines are still shared, do not count. Documents
that stand alone with one copy count as two.

Everything is DataFrame functions. Defined results: null text has no lines and stays null; lines of under `least_tokens`
tokens always stay; equal lines of one document count once; rows that repeat an id are judged by their own text; documents
whose lines all go keep an empty text; extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, few

DIGITS = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
OPEN = "\n"  # no line holds one


def masked(line) -> F.Column:
    """The line with its digit-bearing tokens as variables."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGITS, "<*>")).otherwise(line)


def _tokens(line) -> F.Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def _node(line, n, depth: int) -> F.Column:
    """Number of a line's node, masked or not. It only says what is worth a look, so it need not be unique."""
    return F.xxhash64(n, masked(F.call_function("substring_index", line, F.lit(" "), F.lit(depth))))


def _copy(documents: DataFrame) -> tuple[F.Column, F.Column]:
    """The text, and its number: ids may repeat."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    return text, F.xxhash64(text).alias("copy")


def leaf_lines(documents: DataFrame, depth: int, least_tokens: int, least_docs: int, share: int) -> DataFrame:
    """doc_id, copy, line, n, counts: the lines of nodes that enough documents reach, and whether the document counts."""
    text, copy = _copy(documents)
    long = F.filter(F.split(text, "\n"), lambda x: _tokens(x) >= least_tokens)
    own = F.array_distinct(F.transform(long, lambda x: _node(x, _tokens(x), depth)))
    nodes = documents.select(F.explode(own).alias("node")).groupBy("node").agg(F.count("*").alias("docs"))
    busy = few(nodes.where(F.col("docs") >= least_docs).select("node"))
    # different lines as they are masked, with their tokens; what repeats for each line is a column before explode
    lines = F.transform(F.array_distinct(F.transform(long, masked)), lambda x: F.struct(x.alias("line"), _tokens(x).alias("n")))
    rows = documents.select("doc_id", copy, lines.alias("own"))
    lines = rows.select("doc_id", "copy", F.aggregate("own.n", F.lit(0), lambda s, n: s + n).alias("total"), F.explode("own").alias("one"))
    lines = lines.select("doc_id", "copy", "total", "one.line", "one.n").withColumn("node", _node(F.col("line"), F.col("n"), depth)).join(busy, "node", "left_semi")
    # rows that repeat a document are one; all that follows stays with the document but for the counts of whole lines
    lines = durable(lines.repartition("doc_id", "copy").dropDuplicates(["doc_id", "copy", "line"]).select("doc_id", "copy", "total", "line", "n"))
    shared = few(lines.groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("line", F.lit(True).alias("shared")))
    marked = lines.join(shared, "line", "left")
    common = F.sum(F.when(F.col("shared"), F.col("n")).otherwise(0)).over(W.partitionBy("doc_id", "copy"))
    others = F.col("total") - F.col("n")
    rest = F.col("total") - common - F.when(F.col("shared"), 0).otherwise(F.col("n"))  # of other lines, what is not shared
    return marked.select("doc_id", "copy", "line", "n", ((rest > 0) & (share * rest >= others)).alias("counts"))


def _templates(depth: int, blocks: int) -> F.Column:
    """The templates that a line fits, as text, from columns line and n. Its parts are made once, outside the templates."""
    n = F.col("n")
    edges = [(F.lit(depth) + F.floor((n - depth) * j / blocks)).cast("int") for j in range(blocks + 1)]
    ways = [set(c) for k in range(3) for c in combinations(range(blocks), k)]

    def parts(t):
        text = lambda lo, hi: F.array_join(F.slice(t, lo + 1, hi - lo), " ")
        return F.array(text(F.lit(0), F.lit(depth)), *(text(a, b) for a, b in zip(edges, edges[1:])))

    def long(p):
        return F.array(*(F.concat_ws(" ", p[0], *(F.lit(OPEN) if j in c else p[j + 1] for j in range(blocks))) for c in ways))

    def short(t):
        one = F.transform(F.sequence(F.lit(depth), n - 1), lambda i: F.array_join(F.transform(t, lambda x, k: F.when(k == i, F.lit(OPEN)).otherwise(x)), " "))
        return F.concat(F.array("line"), one)

    once = lambda value, body: F.transform(F.array(value), body)[0]
    t = F.split("line", " ")
    return F.when(n >= depth + 2 * blocks, once(once(t, parts), long)).otherwise(once(t, short))


def recurring(lines: DataFrame, depth: int, blocks: int, least_docs: int) -> DataFrame:
    """n, template: those that recur, of leaf lines."""
    rows = lines.where("counts").select("n", F.explode(_templates(depth, blocks)).alias("template"))
    return rows.groupBy("n", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("n", "template")


def dropped(documents: DataFrame, depth: int = 3, blocks: int = 4, least_tokens: int = 5, least_docs: int = 3, share: int = 3) -> DataFrame:
    """doc_id, copy, gone: the masked lines that go, for documents that lose any."""
    lines = durable(leaf_lines(documents.select("doc_id", "text"), depth, least_tokens, least_docs, share))
    found = few(recurring(lines, depth, blocks, least_docs))
    rows = lines.select("doc_id", "copy", "line", "n", F.explode(_templates(depth, blocks)).alias("template"))
    return rows.join(found, ["n", "template"], "left_semi").groupBy("doc_id", "copy").agg(F.collect_set("line").alias("gone"))


def _judged(documents: DataFrame, **how: int) -> DataFrame:
    """The documents' columns, and _gone: the masked lines that go (null: none)."""
    found = dropped(documents, **how).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), F.col("gone").alias("_gone"))
    keyed = documents.withColumn("_text_number", F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_text_number"] == found["_copy"])
    return keyed.join(found, same, "left").drop("_id", "_copy", "_text_number")


def _stays() -> F.Column:
    """The lines that stay, of a document that loses some."""
    return F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x: ~F.array_contains("_gone", masked(x)))


def _kept() -> F.Column:
    return F.when(F.col("_gone").isNull(), F.col("text").cast("string")).otherwise(F.array_join(_stays(), "\n"))


def strip(documents: DataFrame, **how: int) -> DataFrame:
    """The documents in their own columns, without recurring lines; n_chars, if there, follows the new text."""
    changed = {"text": _kept().alias("text")}
    if "n_chars" in documents.columns:
        length = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length(_kept()).cast(documents.schema["n_chars"].dataType))
        changed["n_chars"] = length.alias("n_chars")
    return _judged(documents, **how).select(*(changed.get(c, F.col(f"`{c}`")) for c in documents.columns))


def report(documents: DataFrame, **how: int) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_chars, kept_sha256 (of the text that stays)."""
    kept = F.coalesce(_kept(), F.lit(""))
    return _judged(documents.select("doc_id", "text"), **how).select(
        "doc_id",
        F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(F.split(F.col("text").cast("string"), "\n")) - F.size(_stays())).cast("long").alias("n_dropped"),
        F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )
