"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators.settle import settle


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); ``label`` is the component's smallest node.

    Each round hangs every node's larger neighbours under its smallest one (large star), then
    its smaller neighbours (small star), until nothing changes; rounds grow with the
    logarithm of the longest path.  Every round is written, so a lost executor costs one round.
    """
    links = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _fingerprint(links)
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low")))
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        links = settle(small.union(low.select("u", F.col("low").alias("v"))).distinct())
        before, state = state, _fingerprint(links)
        if before == state:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _fingerprint(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)
