"""Small awkward tables that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PROSE = "The quick brown fox, it jumps over 12 lazy dogs; then Élan sleeps near the old stone mill by the river at night."


def documents(spark, texts):
    """texts: texts (numbered from 0), or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    df = documents(spark, [(0, None), (1, ""), (2, " \n\t "), (3, PROSE), (4, PROSE), (4, PROSE), (5, long), (None, PROSE), (6, "a" * 3000), (7, "😀 ÀÉ\x00z")])
    from pyspark.sql import functions as F

    for name in ("n", "rank", "token", "u", "v", "part", "hits", "items", "component_id", "label", "salt", "line"):
        df = df.withColumn(name, F.lit(1))
    return df
