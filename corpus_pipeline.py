"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet into the
shared folder and gives what it reads back to the next. All but the last return the columns of ``docs``, with their types,
whatever other columns it has; an empty table gives an empty one. A null or empty text is not toxic, has no line to drop,
is like no other document, holds no benchmark item, and is packed as one token. A row is its doc_id and its text: rows of
one doc_id, or of none, that differ in text are judged apart.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import contaminated
from quillspan.llm.line_dedup import drop_duplicate_lines
from quillspan.llm.ngram_join import ngram_components
from quillspan.llm.packing import pack
from quillspan.llm.toxicity import train, without_toxic
from quillspan.scratch import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express the classifier, string tiling or packing; the stages are tested against planted and brute-force cases.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic; the chain learns from ``labels``.

    Repeated rows are judged alike; without labelled rows nothing is dropped.
    """
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that copy earlier ones, up to an edit from five words on; documents with no line left go.

    Earlier is by (doc_id, line); a null doc_id comes first. n_chars follows the text. Rows that repeat doc_id and text are treated alike.
    """
    return drop_duplicate_lines(docs, min_words=5, exact_words=1)


def _rows(table: DataFrame) -> DataFrame:
    """The table's (doc_id, row), renamed so that they clash with no column; row is the hash of the text."""
    return table.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))


def _same_row(docs: DataFrame) -> Column:
    """Whether a row of ``docs`` has the text and doc_id of a row of ``_rows``."""
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (text == F.col("__row"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group linked by similarity 0.8 on 5-word shingles.

    A null doc_id comes last. Different texts of one doc_id, or of none, are judged apart; of those that are linked the one with the least hash of its
    text stays. Of rows that repeat both one stays. Texts without words all stay.
    """
    groups = save(ngram_components(docs, k=5, num=4, den=5), "groups")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = groups.where("class is not null").groupBy("class").agg(F.min(place).alias("first"))
    linked = groups.join(first, "class").withColumn("is_first", place == F.col("first"))
    again = save(linked.where("is_first").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    drops = linked.where(~F.col("is_first")).select("doc_id", "row").distinct()
    kept = docs.join(_rows(drops.unionByName(again.drop("n"))), _same_row(docs), "left_anti")
    repeated = docs.join(_rows(again), _same_row(docs))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = repeated.groupBy("__id", "__row").agg(F.min_by(row, F.xxhash64(row)).alias("__kept")).select("__kept.*")
    return kept.unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item's tokens in common stretches of five or more.

    Rows that repeat doc_id and text go together; other texts of a doc_id, or of none, are judged apart. Without
    benchmark items nothing is dropped.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=5, num=1, den=2)
    return docs.join(_rows(found).distinct(), _same_row(docs), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a sequence, for every row there is."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
    return docs
