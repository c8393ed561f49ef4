"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last keeps the columns of documents; a stage that rejects documents
anti-joins the rejected ids, which are far fewer than the texts.  Documents with a null id are
never rejected.  The last stage writes token files and returns what their reader finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.decontaminate import contaminated
from refrain.llm.mixing import mix
from refrain.llm.quality import classify_quality
from refrain.llm.registry import table
from refrain.llm.similar import similar_groups
from refrain.llm.token_output import token_files
from refrain.operators.settle import settle


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less those whose doc_id is in ``rejected``; sorted on either side at every size, as the ids have no bound."""
    ids = settle(rejected.select("doc_id").distinct())
    return docs.join(ids.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, rejects go."""
    judged = classify_quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where(~F.col("kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar word shingles (five words, 0.8 or more) the one with the smallest id stays."""
    row = "row"
    while row in map(str.lower, docs.columns):
        row += "_"
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    named = rows.select(F.col(row).alias("row"), "doc_id", "text")
    grouped = settle(similar_groups(named.select("row", "text")).join(named.drop("text"), "row").where("doc_id is not null"))
    kept = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    rejected = settle(grouped.join(kept.hint("merge"), "row", "left_anti").select(F.col("row").alias(row)))
    return rows.join(rejected.hint("merge"), row, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like an item of ``benchmark`` go."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics."""
    return _without(docs, mix(docs).where(~F.col("sampled")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; one row per document read back from them."""
    return token_files(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup by word shingles", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Fitted models, graph components and a tokenizer can't be stated in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
