"""Odd rows that every operator has to take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Column names that operators use inside.
CLASHING = ("row", "node", "keys", "key", "line", "line_no", "host", "n", "w", "t", "label", "score", "kept", "prior", "bucket", "rank", "h", "g", "first", "root", "spans", "piece", "length", "toxic", "quality", "blocked", "_id", "id")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_docs(spark):
    """Nulls, blanks, odd characters, a long text, one very long word, repeated rows, and a null id."""
    return docs(spark, [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\r\x0b\x0c ", None), (4, "é́   \x00 \U0001f600 ß", "a"), (5, "word " * 30_000, "b"), (6, "x" * 200_000, "b"),
        (7, "one two three four five six seven eight nine ten eleven twelve", "c"), (7, "one two three four five six seven eight nine ten eleven twelve", "c"), (7, "another text of the same id", "c"), (None, "no id here", "c"),
    ])


def clashing(df):
    """The table with more columns whose names operators use."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])


def plain(df):
    return sorted([tuple(r) for r in df.collect()], key=str)
