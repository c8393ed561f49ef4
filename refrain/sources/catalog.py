"""Audio catalogue listing and freshness of derived assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.schemas import AUDIO_EXTENSIONS


def list_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below ``path`` with size and time; the content column is never read."""
    pattern = r"(?i)\.(" + "|".join(AUDIO_EXTENSIONS) + r")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return select_audio(files.select("path", "length", F.col("modificationTime").alias("modified")), pattern)


def select_audio(files: DataFrame, pattern: str | None = None) -> DataFrame:
    pattern = pattern or r"(?i)\.(" + "|".join(AUDIO_EXTENSIONS) + r")$"
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.col("path").rlike(pattern)).select(
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("base_name"),
        "length",
        "modified",
    )


def asset_status(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Per song: are both layers there and no older than the source, and their content version.

    ``sources`` (base_name, modified), ``assets`` (base_name, kind in base/top, length, modified).
    Songs whose source file is gone keep their layers.
    """
    layers = (
        assets.filter(F.col("kind").isin("base", "top"))
        .groupBy("base_name")
        .agg(
            F.count_if(F.col("kind") == "base").alias("n_base"),
            F.count_if(F.col("kind") == "top").alias("n_top"),
            F.min("modified").alias("oldest"),
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.array_compact(
                            F.array(
                                *[
                                    F.max(
                                        F.when(
                                            F.col("kind") == k,
                                            F.struct(F.lit(i).alias("i"), F.concat_ws("-", "length", F.unix_millis(F.col("modified").cast("timestamp"))).alias("v")),
                                        )
                                    )
                                    for i, k in enumerate(("base", "top"))
                                ]
                            )
                        )
                    ),
                    lambda s: s["v"],
                ),
                "_",
            ).alias("version"),
        )
    )
    joined = sources.select("base_name", F.col("modified").alias("source_modified")).join(layers, "base_name", "full_outer")
    complete = (F.coalesce("n_base", F.lit(0)) > 0) & (F.coalesce("n_top", F.lit(0)) > 0)
    fresh = F.col("source_modified").isNull() | (F.col("oldest") >= F.col("source_modified"))
    ready = F.coalesce(complete & fresh, F.lit(False))
    return joined.select("base_name", ready.alias("ready"), F.when(ready, F.col("version")).alias("version"))


def stale_assets(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """The work list: sources whose layers are missing or outdated."""
    ready = asset_status(sources, assets).filter("ready")
    return sources.join(ready, "base_name", "left_anti")
