"""Exact duplicates by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted, so equal texts lie
next to each other; a window over the sorted runs compares neighbours in full and keeps the
smallest identifier of each run.  DataFrame functions only.

The splitters are sampled on a short key (first bytes, then a hash), so the sample does not
carry whole texts.  A text with more than 1/4096 of all rows would make one run too long for
one task: such texts (at most 4096, found by counting hashes first) get a slab number in the
key, in proportion to their count; the slabs' smallest identifiers are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.registry import query, table
from refrain.operators.settle import settle

#: A text is split once it has more than this share of all rows, and at least _HOT_LEAST rows.
_HOT_PARTS = 4096
_HOT_LEAST = 64
_KEY_CHARS = 24


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts.  Of equal texts the row with the smallest id is kept (null
    ids last); rows that repeat id and text count in ``group_size`` and one of them is kept.
    An empty table gives an empty result.  Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    parts = _hot_parts(rows)
    slab = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")), F.lit(0)).cast("int")
    keyed = (
        rows.join(F.broadcast(parts), "hash", "left")  # at most _HOT_PARTS rows
        .withColumn("head", F.substring("norm", 1, _KEY_CHARS))
        .withColumn("slab", slab)
        .repartitionByRange("head", "hash", "slab")
    )
    run = Window.partitionBy("head", "hash", "slab", "norm")  # satisfied by the range partitioning
    ordered = run.orderBy(F.col("id").asc_nulls_last())
    runs = keyed.select(
        "id", "hash", "slab", "parts",
        F.first("id").over(ordered).alias("run_keep"),
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    return _merge_slabs(settle(runs)).select(
        F.col("id").alias(id_col), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("text_sha256")
    )


def _hot_parts(rows: DataFrame) -> DataFrame:
    """(hash, parts) of the texts that hold more than their share of rows."""
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(_HOT_LEAST), F.ceil(F.col("total") / _HOT_PARTS))
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.where(F.col("n") > _HOT_LEAST)
        .join(F.broadcast(total))  # one row
        .where(F.col("n") > least)
        .select("hash", F.ceil(F.col("n") / least).alias("parts"))
    )


def _merge_slabs(runs: DataFrame) -> DataFrame:
    """Runs of unsplit texts are whole groups; those of split texts (at most 2 * _HOT_PARTS) are merged by content."""
    firsts = runs.where(F.col("parts").isNotNull() & (F.col("place") == 1))
    group = Window.partitionBy("hash", "text_sha256")  # one row per slab
    merged = firsts.select(
        F.col("hash").alias("m_hash"),
        F.col("text_sha256").alias("m_sha"),
        F.col("slab").alias("m_slab"),
        F.first("run_keep").over(group.orderBy(F.col("run_keep").asc_nulls_last(), "slab")).alias("m_keep"),
        F.row_number().over(group.orderBy(F.col("run_keep").asc_nulls_last(), "slab")).alias("m_place"),
        F.sum("run_size").over(group).alias("m_size"),
    )
    split = F.col("m_hash").isNotNull()
    same = (F.col("hash") == F.col("m_hash")) & (F.col("text_sha256") == F.col("m_sha")) & (F.col("slab") == F.col("m_slab"))
    return runs.join(F.broadcast(merged), same, "left").select(
        "id",
        "text_sha256",
        F.when(split, F.col("m_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(split, F.col("m_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & F.coalesce(F.col("m_place") == 1, F.lit(True))).alias("kept"),
    )


@query(
    "op9_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
    ), g AS (
        SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
