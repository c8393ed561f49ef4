"""How well scores separate good from bad votes.

Rank statistics are computed from counts per distinct score, cumulated bin by bin
(:func:`refrain.operators.ordered.scan`): no group is ever sorted in one task and no
good/bad pair is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.operators.ordered import order_statistic, scan

#: Width of a score bin; scores live in 0..1, so a group has about a million bins at most.
SCORE_BIN = 1e-6


def melt_scores(rated: DataFrame, keys: list[str], score_cols: list[str]) -> DataFrame:
    """One row per (vote, score column)."""
    return rated.unpivot([*keys, "rating"], score_cols, "metric", "score").filter(F.col("score").isNotNull())


def _counts(melted: DataFrame, keys: list[str]) -> DataFrame:
    return melted.groupBy(*keys, "score").agg(
        F.count_if(F.col("rating") == "good").alias("good"), F.count_if(F.col("rating") == "bad").alias("bad")
    )


def auc(melted: DataFrame, keys: list[str], bin_width: float = SCORE_BIN) -> DataFrame:
    """P(good scores higher than bad), ties half, per ``keys`` (one group overall when empty)."""
    counts = _counts(melted, keys)
    below = scan(
        counts, keys, F.floor(F.col("score") / bin_width).cast("bigint"), ["score"], before={"bad_below": F.col("bad")}
    )
    wins = F.sum(F.col("good") * (F.col("bad_below") + F.col("bad") * 0.5))
    agg = below.groupBy(*keys).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), wins.alias("wins"))
    pairs = F.col("n_good") * F.col("n_bad")
    value = F.when(pairs == 0, F.lit(0.5)).otherwise(F.col("wins") / pairs)
    return agg.select(*keys, "n_good", "n_bad", value.alias("auc"), (pairs > 0).alias("has_pairs"))


def grouped(rated: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Tag each vote with every report group it belongs to; a null label means not a member.

    ``groups`` maps a group kind ("all", "song", "length", ...) to its label column.
    """
    labels = F.array(
        *[F.struct(F.lit(k).alias("group_kind"), c.cast("string").alias("group_label")) for k, c in groups.items()]
    )
    members = F.filter(labels, lambda s: s["group_label"].isNotNull())
    return rated.withColumn("__g", F.explode(members)).select(
        *rated.columns, F.col("__g.group_kind").alias("group_kind"), F.col("__g.group_label").alias("group_label")
    )


def evaluate(rated: DataFrame, score_cols: list[str], groups: dict[str, Column]) -> DataFrame:
    """AUC of every score over every report group in one pass."""
    members = grouped(rated, groups)
    keys = ["group_kind", "group_label"]
    return auc(melt_scores(members, keys, score_cols), [*keys, "metric"])


def score_stats(rated: DataFrame, score_cols: list[str], bin_width: float = SCORE_BIN) -> DataFrame:
    """Count, mean and lower median of each score per class."""
    melted = melt_scores(rated, [], score_cols)
    keys = ["metric", "rating"]
    means = melted.groupBy(*keys).agg(F.avg("score").alias("mean"))
    medians = order_statistic(melted, keys, "score", {"median": F.floor((F.col("n") - 1) / 2)}, bin_width)
    return medians.join(means, keys).select(*keys, "n", "mean", "median")


def best_f1(rated: DataFrame, score: str, keys: list[str] | None = None, bin_width: float = SCORE_BIN) -> DataFrame:
    """Threshold with the best F1 when "good if score >= t"; the lowest t wins ties."""
    keys = keys or []
    votes = rated.filter(F.col(score).isNotNull()).withColumn("score", F.col(score))
    counts = _counts(votes, keys).withColumn("__down", -F.col("score"))
    block = F.floor(F.col("__down") / bin_width).cast("bigint")
    at_least = scan(counts, keys, block, ["__down"], through={"tp": F.col("good"), "fp": F.col("bad")})
    totals = counts.groupBy(*keys).agg(F.sum("good").alias("all_good"))
    joined = at_least.join(totals, keys) if keys else at_least.crossJoin(F.broadcast(totals))  # one row
    precision = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("all_good"))
    f1 = 2.0 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)
    scored = joined.select(
        *keys, "score", "tp", "fp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )
    best = F.max_by(F.struct("score", "f1", "precision", "recall", "tp", "fp"), F.struct("f1", (-F.col("score")).alias("s")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(
        *keys,
        F.when(F.col("b.f1") > 0, F.col("b.score")).otherwise(F.lit(0.0)).alias("threshold"),
        F.col("b.f1").alias("f1"),
        F.when(F.col("b.f1") > 0, F.col("b.precision")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("b.f1") > 0, F.col("b.recall")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(F.col("b.f1") > 0, F.col("b.tp")).otherwise(F.lit(0)).alias("kept_good"),
        F.when(F.col("b.f1") > 0, F.col("b.fp")).otherwise(F.lit(0)).alias("kept_bad"),
    )


def top_composition(rated: DataFrame, score: str, tie: str, n: int = 20) -> DataFrame:
    """Good and bad votes among the ``n`` best by one score (a top-k report)."""
    top = rated.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)
    return top.agg(
        F.lit(score).alias("metric"),
        F.count_if(F.col("rating") == "good").alias("good"),
        F.count_if(F.col("rating") == "bad").alias("bad"),
    )


def score_drift(rated: DataFrame, new: str, stored: str, version: str) -> DataFrame:
    """Largest difference between recomputed and stored scores of the current version."""
    return rated.filter(F.col("analysis_version") == version).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(new) - F.col(stored))).alias("max_delta")
    )


def match_rated(candidates: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-identity match of detected candidates with votes; a nearby vote is never borrowed."""
    return candidates.join(ratings.select(*keys, "rating"), keys, "left")


def detection_summary(matched: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Per song: candidates per length, best quality, lengths present, and vote counts."""
    per_length = [F.count_if(F.col("bars") == b).alias(f"bars_{b}") for b in lengths]
    return matched.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"),
        *per_length,
        F.max("quality_score").alias("top_quality"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_set("bars")), lambda b: b.cast("string"))).alias("lengths"),
        F.count_if(F.col("rating") == "good").alias("rated_good"),
        F.count_if(F.col("rating") == "bad").alias("rated_bad"),
        F.count_if(F.col("rating").isNull()).alias("unrated"),
    )


def safe_exits(jumps: DataFrame, min_p: float = 0.7) -> DataFrame:
    """Share of exit beats with at least one jump that is likely good."""
    per_exit = jumps.groupBy("song_id", "exit_beat").agg(
        F.max("p_good_cut").alias("cut"), F.max("p_good_blended").alias("blended")
    )
    return per_exit.groupBy("song_id").agg(
        F.count_if(F.col("cut") >= min_p).alias("safe_cut"),
        F.count_if(F.col("blended") >= min_p).alias("safe_blended"),
        F.count(F.lit(1)).alias("exits"),
    )


def distinct_sources(df: DataFrame, col: str = "source_name") -> DataFrame:
    return df.select(col).distinct()
