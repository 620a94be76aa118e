"""A training corpus from ``documents``: quality, boilerplate lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of documents, and every decision takes effect on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.bpe import bpe_encode
from sievegate.llm.decontaminate import drop_contaminated
from sievegate.llm.line_dedup import line_dedup
from sievegate.llm.parity_join import ngram_join
from sievegate.llm.quality import fit_quality, score_quality
from sievegate.llm.queries import fold, table, vocabulary
from sievegate.llm.store import Store

#: Documents with a lower score are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as label 0 go; null and empty texts get the score of an empty text, repeated rows are rows like others."""
    learn = ~F.coalesce(fold(5) == 0, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn)
    return score_quality(docs, model).where(F.col("score") >= QUALITY).select(*docs.columns)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; a null text stays null, a null source is a host of its own, repeated rows count as pages."""
    return line_dedup(docs, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows without an id stay."""
    groups = ngram_join(docs, words_=5, num=80)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts are clean, null items say nothing, repeated rows go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text; a null text is empty, repeated rows are rows like others."""
    return bpe_encode(docs, vocabulary())


STAGES = [("quality classifier", quality), ("line dedup", boilerplate), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("BPE encoding", tokens)]

#: SQL has no classifier, near-copy components, alignment or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = store.put(f"stage{i}", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
