"""The queries of the ten operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup as lines
from . import exact_topk as topk
from .bpe import bpe_digests
from .decontaminate import find_contaminated
from .kd_shards import kd_shards
from .language import fit_language, identify_language
from .parity_join import ngram_join
from .quality import fit_quality, score_quality
from .suffix_index import suffix_dedup
from .toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(5) == 0, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(3) == 1, F.lit(False))
    model = fit_language(docs, ~held)
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(3) == 1, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words_=4, num=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_decontamination, op3_suffix_dedup, op4_language, op5_toxicity, op6_topk, op7_ngram_join, op8_bpe, op9_line_dedup, op10_kd_shards)
}

ORACLES: dict[str, str] = {"op6_topk": topk.ORACLE, "op9_line_dedup": lines.ORACLE}
