"""The queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import quality_gam
from quillspan.llm.ball_kmeans import ball_kmeans
from quillspan.llm.chat_format import chat_digests, format_chats
from quillspan.llm.decontaminate import contaminated
from quillspan.llm.fill_in_middle import fill_in_middle, fim_digests
from quillspan.llm.host_quality import host_quality
from quillspan.llm.line_dedup import duplicate_lines
from quillspan.llm.ngram_join import ngram_components
from quillspan.llm.oracles import ORACLES  # noqa: F401
from quillspan.llm.packing import pack
from quillspan.llm.pii import find_pii
from quillspan.llm.toxicity import toxicity, train
from quillspan.llm.url_filter import judge_urls
from quillspan.llm.voronoi_topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, _table(spark, sf_dir, "labels"))).drop("row")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.quality_scores(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10).drop("row", "class")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return chat_digests(format_chats(turns.unionByName(extra)))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=5, num=1, den=2).drop("row")


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_table(spark, sf_dir, "documents"), min_words=5, exact_words=1).drop("row")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).drop("score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(fill_in_middle(_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20))


def op12_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64, seed=1)


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_host_quality": op2_host_quality,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_gam": op5_quality_gam,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_decontamination": op7_decontamination,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_voronoi_topk": op12_voronoi_topk,
    "op13_ball_kmeans": op13_ball_kmeans,
}
