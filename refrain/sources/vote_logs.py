"""Readers, parsers and the append sink of the JSON-lines vote logs and older vote documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.schemas import (
    FEELS,
    LOOP_VOTE_JSON,
    PACK_DOCUMENT_JSON,
    PACK_VOTE_JSON,
    RATINGS,
    VOTE_BAR_LENGTHS,
    WRAP_VOTE_JSON,
)

_BAD = "_bad_json"


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many (rotated) logs as (seq, value).

    ``seq`` orders by file name, byte block and line, so a log of any size is read in
    parallel splits and still replays in file order.
    """
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
        "value",
    )


def _parse(lines: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json(F.trim("value"), f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    # A generator over one element: the optimizer copies an expression into each of its uses, but not a generator's output.
    return lines.filter(F.length(F.trim("value")) > 0).withColumn("r", F.explode(F.array(parsed)))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def parse_loop_votes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid votes, quarantined lines) of a loop-vote log with columns (seq, value)."""
    p = _parse(lines, LOOP_VOTE_JSON)
    r = F.col("r")
    rating_ok = r["rating"].isNull() | r["rating"].isin(*RATINGS)
    payload = r["rating"].isNotNull() | r["note"].isNotNull() | r["tags"].isNotNull()
    cut_ok = (
        r["sourceName"].isNotNull()
        & _finite(r["startSec"])
        & _finite(r["endSec"])
        & (r["startSec"] >= 0)
        & (r["endSec"] > r["startSec"])
        & r["bars"].isin(*[float(b) for b in VOTE_BAR_LENGTHS])
    )
    tags_ok = r["tags"].isNull() | F.forall(r["tags"], lambda t: F.coalesce(t.isin(*FEELS), F.lit(False)))
    p = p.withColumn("ok", _flag(r[_BAD].isNull() & rating_ok & payload & cut_ok & tags_ok))
    votes = p.filter("ok").select(
        "seq",
        r["at"].alias("at"),
        r["sourceName"].alias("source_name"),
        r["startSec"].alias("start_sec"),
        r["endSec"].alias("end_sec"),
        r["bars"].cast("int").alias("bars"),
        r["seamScore"].alias("seam_score"),
        r["contextScore"].alias("context_score"),
        r["homogeneityScore"].alias("homogeneity_score"),
        r["qualityScore"].alias("quality_score"),
        r["closureScore"].alias("closure_score"),
        r["bpm"].alias("bpm"),
        r["vibeWindowSec"].alias("vibe_window_sec"),
        r["rating"].alias("rating"),
        r["note"].alias("note"),
        r["tags"].alias("tags"),
        r["analysisVersion"].alias("analysis_version"),
        r["wrapCrossfadeSec"].alias("wrap_crossfade_sec"),
        r["normalize"].alias("normalize"),
    )
    return votes, p.filter(~F.col("ok")).select("seq", "value")


def parse_wrap_votes(lines: DataFrame) -> DataFrame:
    r = F.col("r")
    ok = (
        r[_BAD].isNull()
        & (r["version"] == 1)
        & r["sourceName"].isNotNull()
        & F.try_to_timestamp(r["at"]).isNotNull()
        & _finite(r["exitSec"])
        & _finite(r["entrySec"])
        & _finite(r["fadeSec"])
        & r["rating"].isin(*RATINGS)
    )
    return (
        _parse(lines, WRAP_VOTE_JSON)
        .filter(_flag(ok))
        .select(
            "seq",
            r["version"].cast("int").alias("version"),
            F.try_to_timestamp(r["at"]).alias("at"),
            r["sourceName"].alias("source_name"),
            r["exitSec"].alias("exit_sec"),
            r["entrySec"].alias("entry_sec"),
            r["fadeSec"].alias("fade_sec"),
            r["rating"].alias("rating"),
        )
    )


def parse_pack_votes(lines: DataFrame) -> DataFrame:
    """Votes of the older log: good/bad only, natural switches dropped."""
    r = F.col("r")
    j = r["join"]
    ok = (
        r[_BAD].isNull()
        & r["sourceName"].isNotNull()
        & r["rating"].isin("good", "bad")
        & j["exitSec"].isNotNull()
        & j["entrySec"].isNotNull()
        & (F.coalesce(j["kind"], F.lit("")) != "natural-switch")
    )
    return (
        _parse(lines, PACK_VOTE_JSON)
        .filter(_flag(ok))
        .select("seq", r["sourceName"].alias("source_name"), r["rating"].alias("rating"), j.alias("join"))
    )


def parse_pack_documents(documents: DataFrame) -> DataFrame:
    """Joins a listener approved, from (source_name, seq, value) documents; a broken document gives no rows."""
    r = F.col("r")
    return (
        _parse(documents, PACK_DOCUMENT_JSON)
        .filter(r[_BAD].isNull())
        .select("source_name", "seq", F.posexplode(r["jumps"]).alias("jump_idx", "j"))
        .filter((F.col("j.source") == "listener") & F.col("j.exitSec").isNotNull() & F.col("j.entrySec").isNotNull())
        .select(
            "source_name",
            "seq",
            "jump_idx",
            F.col("j.exitSec").alias("exit_sec"),
            F.col("j.entrySec").alias("entry_sec"),
            F.lit("good").alias("rating"),
        )
    )


def read_loop_votes(spark: SparkSession, path: str) -> DataFrame:
    return parse_loop_votes(read_log_lines(spark, path))[0]


def read_wrap_votes(spark: SparkSession, path: str) -> DataFrame:
    return parse_wrap_votes(read_log_lines(spark, path))


def read_pack_votes(spark: SparkSession, path: str) -> DataFrame:
    return parse_pack_votes(read_log_lines(spark, path))


def read_pack_documents(spark: SparkSession, path: str) -> DataFrame:
    """``<song>.pack.json`` documents, one per file; the song name is the file's base name."""
    docs = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.pack\.json$", 1).alias("source_name"),
        F.lit(0).cast("bigint").alias("seq"),
        "value",
    )
    return parse_pack_documents(docs)


def loop_vote_lines(votes: DataFrame) -> DataFrame:
    """Votes as the JSON text of the log; absent fields are left out."""
    return votes.select(
        "seq",
        F.to_json(
            F.struct(
                "at",
                F.col("source_name").alias("sourceName"),
                F.col("start_sec").alias("startSec"),
                F.col("end_sec").alias("endSec"),
                "bars",
                F.col("seam_score").alias("seamScore"),
                F.col("context_score").alias("contextScore"),
                F.col("homogeneity_score").alias("homogeneityScore"),
                F.col("quality_score").alias("qualityScore"),
                F.col("closure_score").alias("closureScore"),
                "bpm",
                F.col("vibe_window_sec").alias("vibeWindowSec"),
                "rating",
                "note",
                "tags",
                F.col("analysis_version").alias("analysisVersion"),
                F.col("wrap_crossfade_sec").alias("wrapCrossfadeSec"),
                "normalize",
            )
        ).alias("value"),
    )


def append_votes(votes: DataFrame, path: str) -> None:
    """Append one JSON line per vote."""
    loop_vote_lines(votes).select("value").write.mode("append").text(path)
