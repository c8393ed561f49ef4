"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic).  Raking scales the cells' weights to
one marginal after the other until all hold; no cell may ask for more tokens than it has.
Each document is then sampled with its cell's probability, wanted over present tokens, by a
hash of its id, so a repeated run draws the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.settle import settle

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
#: Targets by default: each marginal is the present one to this power (0: even, 1: as it is).
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Tokens wanted, of all present.
BUDGET = 0.5
TOLERANCE = 1e-6
MOST_CYCLES = 30


def token_count_and_topic(text: str | None) -> tuple[int, int]:
    """(words, topic): the topic that most words of six or more bytes hash to; without such words topic 0."""
    words = (text or "").encode().lower().split()
    long = [crc32(w) % TOPICS for w in words if len(w) > 5]
    return len(words), int(np.bincount(long).argmax()) if long else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [token_count_and_topic(t.as_py()) for t in b.column("text")]
        columns = [b.column("id"), b.column("source"), b.column("lang"), pa.array([str(t) for _, t in both], pa.string()), pa.array([n for n, _ in both], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "source", "lang", "topic", "n_tokens"])


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): shares of the present marginal's tokens to ``power``; values without tokens get none."""
    present = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    raised = present.select("value", F.pow(F.col("tokens").cast("double"), power).alias("raised"))
    return raised.join(F.broadcast(raised.agg(F.sum("raised").alias("whole")))).select("value", (F.col("raised") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], budget: float = BUDGET, tolerance: float = TOLERANCE, cycles: int = MOST_CYCLES) -> DataFrame:
    """``cells`` with ``weight`` (wanted tokens) and ``probability``; stops when a cycle changes no cell's weight by more than ``tolerance`` of it.

    ``cells`` has the dimensions and ``tokens``.  ``targets`` has (value, share) for each
    dimension; values without a share, and cells without tokens, want nothing.  Weights never
    exceed a cell's tokens; where targets ask for more than that, the nearest cycle is returned.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    wanted = total * budget
    columns = cells.columns
    now = cells.withColumn("weight", F.col("tokens") * budget)
    for dimension, target in targets.items():
        share = target.select(F.col("value").alias(dimension), F.col("share").cast("double").alias(f"share_{dimension}"))
        now = now.join(share, dimension, "left")
    now = settle(now.fillna(0.0, [f"share_{d}" for d in targets]))
    kept = now.columns
    for _ in range(cycles if total else 0):
        step = now.withColumn("before", F.col("weight"))
        for dimension in targets:
            had = step.groupBy(dimension).agg(F.sum("weight").alias("had"))
            scale = F.when(F.col("had") > 0, F.col(f"share_{dimension}") * wanted / F.col("had")).otherwise(0.0)
            step = step.join(had, dimension).withColumn("weight", F.col("weight") * scale).drop("had")
        step = step.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))
        moved = F.when(F.col("before") > 0, F.abs(F.col("weight") / F.col("before") - 1)).otherwise(0.0)
        now = settle(step.select(*kept, moved.alias("moved")))
        most = now.agg(F.max("moved")).first()[0]
        now = now.select(*kept)
        if most <= tolerance:
            break
    probability = F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0))).otherwise(0.0)
    return now.select(*columns, "weight", probability.alias("probability"))


def unit_hash(column: Column, seed: int) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    budget: float = BUDGET, seed: int = 11,
) -> DataFrame:
    """One row per document row: id, source, lang, topic, n_tokens, probability, sampled.

    Null sources and languages are values of their own, named ``<null>``.  Documents without
    words are in cells like others and follow their cell's probability (zero where the whole
    cell has no words).  Rows that repeat an id are sampled together.  An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("<null>"))
    rows = docs.select(F.col(id_col).alias("id"), name(source_col).alias("source"), name(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = settle(rows.mapInArrow(_counted, f"id {rows.schema['id'].dataType.simpleString()}, source string, lang string, topic string, n_tokens long"))
    cells = settle(counted.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    if targets is None:
        targets = {d: tempered_targets(cells, d, TEMPERS[d]) for d in DIMENSIONS}
    fitted = settle(rake(cells, targets, budget)).select(*DIMENSIONS, "probability")
    return counted.join(fitted, list(DIMENSIONS)).select(
        F.col("id").alias(id_col), *DIMENSIONS, "n_tokens", "probability", (unit_hash(F.col("id"), seed) < F.col("probability")).alias("sampled")
    )


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
