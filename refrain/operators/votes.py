"""Replay of append-only listening logs.

Every "latest" is decided by ``seq`` (position in the log), never by the clock.  All
replays are ``max_by`` aggregations, so a cut, source or listener that holds a third of
the log is combined map-side and no key's history is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.exact import fixed_text, fixed_units
from refrain.operators.ordered import BLOCK_SEQ, block_of, scan
from refrain.operators.settle import settle

CUT = ["source_name", "bars", "start_units", "end_units"]
WRAP = ["source_name", "exit_units", "entry_units"]
MUSICAL_BLEND_SEC = 0.12

_RECORD_FIELDS = [
    "at", "start_sec", "end_sec", "seam_score", "context_score", "homogeneity_score", "quality_score",
    "closure_score", "bpm", "vibe_window_sec", "rating", "note", "tags", "analysis_version",
    "wrap_crossfade_sec", "normalize",
]


def with_cut_key(df: DataFrame) -> DataFrame:
    """Identity of a cut: source, bars and both edges to the hundredth of a second."""
    return df.withColumns(
        {"start_units": fixed_units(F.col("start_sec"), 2), "end_units": fixed_units(F.col("end_sec"), 2)}
    )


def cut_key_text(source: Column, bars: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("|", source, bars.cast("string"), fixed_text(start, 2), fixed_text(end, 2))


def with_wrap_key(df: DataFrame) -> DataFrame:
    """Identity of a wrap: both points to the millisecond."""
    return df.withColumns(
        {"exit_units": fixed_units(F.col("exit_sec"), 3), "entry_units": fixed_units(F.col("entry_sec"), 3)}
    )


def _last(name: str, order: str = "seq") -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)


def rating_state(votes: DataFrame) -> DataFrame:
    """Last rating per cut, clears included; note-only lines do not count."""
    rated = with_cut_key(votes).filter(F.col("rating").isNotNull())
    return rated.groupBy(*CUT).agg(F.max_by("rating", "seq").alias("rating"))


def latest_ratings(votes: DataFrame) -> DataFrame:
    """Current good/bad per cut; a clear removes it."""
    return rating_state(votes).filter(F.col("rating") != "clear")


def latest_notes(votes: DataFrame) -> DataFrame:
    noted = with_cut_key(votes).filter(F.col("note").isNotNull())
    return noted.groupBy(*CUT).agg(F.max_by("note", "seq").alias("note"))


def latest_tags(votes: DataFrame) -> DataFrame:
    """The last tag list per cut replaces the earlier ones."""
    tagged = with_cut_key(votes).filter(F.col("tags").isNotNull())
    return tagged.groupBy(*CUT).agg(F.max_by("tags", "seq").alias("tags"))


def latest_records(votes: DataFrame) -> DataFrame:
    """One merged record per cut: each field keeps its last provided value.

    ``first_seq`` gives the order in which cuts first appeared.
    """
    return (
        with_cut_key(votes)
        .groupBy(*CUT)
        .agg(F.min("seq").alias("first_seq"), *[_last(c) for c in _RECORD_FIELDS if c in votes.columns])
    )


def latest_rendered(votes: DataFrame) -> DataFrame:
    """Merged record per cut *and* render (crossfade, normalise); a clear drops every render seen before it."""
    keyed = with_cut_key(votes)
    cleared = keyed.filter(F.col("rating") == "clear").groupBy(*CUT).agg(F.max("seq").alias("clear_seq"))
    kept = (
        keyed.filter(F.col("rating").isNull() | (F.col("rating") != "clear"))
        .join(cleared, CUT, "left")
        .filter(F.col("clear_seq").isNull() | (F.col("seq") > F.col("clear_seq")))
        .withColumns(
            {
                "fade_key": F.coalesce("wrap_crossfade_sec", F.lit(0.0)),
                "normalize_key": F.coalesce("normalize", F.lit(False)),
            }
        )
    )
    return kept.groupBy(*CUT, "fade_key", "normalize_key").agg(
        F.min("seq").alias("first_seq"), *[_last(c) for c in _RECORD_FIELDS if c in votes.columns]
    )


def original_cut_votes(votes: DataFrame) -> DataFrame:
    """Votes that judge the detector's own cut: clears, and renders without a musical blend."""
    blend = F.coalesce("wrap_crossfade_sec", F.lit(0.0))
    return votes.filter(F.coalesce(F.col("rating") == "clear", F.lit(False)) | (blend <= MUSICAL_BLEND_SEC))


def musical_blends(votes: DataFrame) -> DataFrame:
    """Rendered variants with a long blend, reported apart from the cut ranking."""
    return latest_rendered(votes).filter(F.coalesce("wrap_crossfade_sec", F.lit(0.0)) > MUSICAL_BLEND_SEC)


def wrap_state(wrap_votes: DataFrame) -> DataFrame:
    """Last decision per wrap, clears included."""
    return (
        with_wrap_key(wrap_votes)
        .groupBy(*WRAP)
        .agg(F.max_by(F.struct("exit_sec", "entry_sec", "rating", "seq"), "seq").alias("v"))
        .select(*WRAP, "v.exit_sec", "v.entry_sec", "v.rating", "v.seq")
    )


def latest_wraps(wrap_votes: DataFrame) -> DataFrame:
    """Current decision per wrap; a clear removes it."""
    return wrap_state(wrap_votes).filter(F.col("rating") != "clear")


def latest_pack_votes(pack_votes: DataFrame) -> DataFrame:
    """Current decision per join of the older log, which has no clear and ignores natural switches."""
    usable = pack_votes.filter(
        F.col("rating").isin("good", "bad")
        & F.col("join").isNotNull()
        & (F.coalesce(F.col("join.kind"), F.lit("")) != "natural-switch")
        & F.col("join.exitSec").isNotNull()
        & F.col("join.entrySec").isNotNull()
    ).select("source_name", "rating", "seq", F.col("join.exitSec").alias("exit_sec"), F.col("join.entrySec").alias("entry_sec"))
    return latest_wraps(usable)


def merge_rated_joins(current: DataFrame, *older: DataFrame) -> DataFrame:
    """Current votes replace older ones of the same wrap; among older sources bad wins, else the last.

    ``older`` sources come in precedence order (earlier arguments first, then by ``seq``).
    """
    cols = ["source_name", "exit_sec", "entry_sec", "rating", "seq"]
    parts = [d.select(*cols).withColumn("tier", F.lit(i)) for i, d in enumerate(older)]
    parts.append(current.select(*cols).withColumn("tier", F.lit(len(older))))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    when = F.struct("tier", "seq")
    row = F.struct("exit_sec", "entry_sec", "rating")
    is_current = F.col("tier") == len(older)
    is_bad = ~is_current & (F.col("rating") == "bad")
    picked = (
        with_wrap_key(merged)
        .groupBy(*WRAP)
        .agg(
            F.max_by(row, F.when(is_current, when)).alias("now"),
            F.min_by(row, F.when(is_bad, when)).alias("vetoed"),
            F.max_by(row, when).alias("latest"),
        )
        .withColumn("j", F.coalesce("now", "vetoed", "latest"))
    )
    return picked.select(*WRAP, "j.exit_sec", "j.entry_sec", "j.rating")


def toggle_votes(clicks: DataFrame, keys: list[str], value: str = "rating", block_rows: int = BLOCK_SEQ) -> DataFrame:
    """What each click writes to the log: clicking the current rating clears it, any other click sets it.

    Inside a run of equal clicks the odd ones set and the even ones clear, so only the
    position inside the run matters; runs are found with block-wise scans over ``seq``.
    """
    block = block_of(F.col("seq"), block_rows)
    ordered = scan(clicks, keys, block, ["seq"], before={"__idx": F.lit(1)}, previous={"__prev": F.col(value)})
    starts = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col(value)), F.col("__idx"))
    runs = scan(settle(ordered), keys, block, ["seq"], latest={"__run": starts})
    odd = (F.col("__idx") - F.col("__run")) % 2 == 0
    return runs.withColumn("emitted", F.when(odd, F.col(value)).otherwise(F.lit("clear"))).drop(
        "__idx", "__prev", "__run"
    )


def toggle_tags(clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Tags switched on an odd number of times, in the order they were last added."""
    per_tag = (
        clicks.groupBy(*keys, "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("added"))
        .filter(F.col("n") % 2 == 1)
    )
    ordered = F.array_sort(F.collect_list(F.struct("added", "tag")))  # one entry per tag of a closed vocabulary
    return per_tag.groupBy(*keys).agg(F.transform(ordered, lambda s: s["tag"]).alias("tags"))


def restore_saved(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Saved candidates of open sessions: rated, noted or tagged cuts inside the session's trim."""
    useful = (
        F.col("rating").isin("good", "bad")
        | (F.coalesce(F.length(F.trim("note")), F.lit(0)) > 0)
        | (F.coalesce(F.size("tags"), F.lit(0)) > 0)
    )
    valid = records.filter(F.coalesce(useful, F.lit(False)) & (F.col("bpm") > 0) & ~F.isnan("bpm"))
    joined = valid.join(sessions, "source_name").filter(
        (F.col("start_sec") >= F.col("trim_start")) & (F.col("end_sec") <= F.col("trim_end"))
    )
    key = cut_key_text(F.col("source_name"), F.col("bars"), F.col("start_sec"), F.col("end_sec"))
    return joined.select(
        "session_id",
        "source_name",
        F.concat(F.lit("saved:"), key).alias("id"),
        F.lit("saved").alias("origin"),
        "start_sec", "end_sec", "bars", "bpm", "seam_score", "context_score", "homogeneity_score",
        "quality_score", "closure_score",
        F.coalesce("analysis_version", F.lit("legacy")).alias("score_version"),
        F.coalesce("wrap_crossfade_sec", F.lit(0.0)).alias("saved_fade_sec"),
        F.coalesce("normalize", F.lit(False)).alias("saved_normalize"),
    )


def merge_saved(candidates: DataFrame, restored: DataFrame) -> DataFrame:
    """Found candidates plus the restored ones; stale saved rows are dropped."""
    found = candidates.filter(F.coalesce(F.col("origin"), F.lit("found")) != "saved")
    return found.unionByName(restored, allowMissingColumns=True)
