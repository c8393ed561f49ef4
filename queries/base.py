"""Domain tables derived from the given parquet tables, in Spark and as SQL text.

Each derivation is written twice on purpose: once with the DataFrame API and once as a
common table expression, so that a query and its SQL check share no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.vectors import l2_normalize
from refrain.operators.ordered import BLOCK_SEQ, block_of, dense_index, scan
from refrain.operators.settle import settle
from refrain.schemas import FEELS

BEATS_PER_SONG = 128
BAR_SEC = 2.5


class Registry:
    """Queries of one module with the SQL they must equal (none where SQL cannot say it)."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql:
                self.oracle[name] = sql
            return fn

        return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def r9(c: Column) -> Column:
    return F.round(c, 9) + F.lit(0.0)


def q9(expr: str) -> str:
    return f"(round({expr}, 9) + 0.0::DOUBLE)"


def q6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"


def fixed_units_sql(x: str, digits: int) -> str:
    """The exact-tie rounding of ``fixed_units`` for non-negative ``x``."""
    k = f"{10**digits}.0::DOUBLE"
    split = "134217729.0::DOUBLE"
    hi = f"({x} * {split} - ({x} * {split} - {x}))"
    err = f"(({hi} * {k} - {x} * {k}) + ({x} - {hi}) * {k})"
    floor = f"floor({x} * {k})"
    up = f"CASE WHEN ({x} * {k} - {floor} - 0.5::DOUBLE) + {err} >= 0 THEN 1 ELSE 0 END"
    return f"CAST({floor} + {up} AS BIGINT)"


def k_of_props() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


# ---------------------------------------------------------------- votes from events
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_of(read(spark, sf_dir, "events"))


def votes_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", k_of_props())
    kind = F.col("event_type")
    feels = F.array(*[F.lit(f) for f in FEELS])
    start = F.floor(F.col("value") / 50.0) * 2.5
    bars = F.element_at(F.array(*[F.lit(b) for b in (1, 2, 4, 6, 8, 12, 16)]), (F.col("event_id") % 7 + 1).cast("int"))
    pick = F.element_at(feels, F.col("k") % 5 + 1)
    both = F.array(pick, F.element_at(feels, (F.col("k") + 2) % 5 + 1))
    return e.select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        start.alias("start_sec"),
        (start + bars * 2.0).alias("end_sec"),
        bars.alias("bars"),
        ((F.col("event_id") % 89) / 89.0).alias("seam_score"),
        ((F.col("event_id") % 97) / 97.0).alias("context_score"),
        ((F.col("event_id") % 83) / 83.0).alias("homogeneity_score"),
        (F.col("k") / 100.0).alias("quality_score"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 71) / 71.0).alias("closure_score"),
        (F.lit(90.0) + F.col("k") % 60).alias("bpm"),
        F.lit(1.5).alias("vibe_window_sec"),
        F.when(kind == "purchase", "good").when(kind == "error", "bad").when(kind == "signup", "clear").alias("rating"),
        F.when(
            kind == "view", F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("note "), F.col("k").cast("string")))
        ).alias("note"),
        F.when(kind == "click", F.when(F.col("k") % 3 == 0, both).otherwise(F.array(pick))).alias("tags"),
        F.when(F.col("event_id") % 5 == 0, "phase-closure-v1").alias("analysis_version"),
        F.when(F.col("event_id") % 3 == 0, 0.035).when(F.col("event_id") % 3 == 1, 0.5).alias("wrap_crossfade_sec"),
        F.when(F.col("event_id") % 4 == 0, True).when(F.col("event_id") % 4 == 1, False).alias("normalize"),
    )


VOTES_SQL = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
votes0 AS (
  SELECT *, floor(value / 50.0) * 2.5::DOUBLE AS start_sec,
    [1,2,4,6,8,12,16][CAST(event_id % 7 + 1 AS INT)] AS bars,
    ['exploration','tension','combat','intensity','stinger'] AS feels
  FROM ev),
votes AS (
  SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS voted_at, 'u' || user_id AS source_name,
    start_sec, start_sec + bars * 2.0::DOUBLE AS end_sec, bars,
    (event_id % 89) / 89.0::DOUBLE AS seam_score, (event_id % 97) / 97.0::DOUBLE AS context_score,
    (event_id % 83) / 83.0::DOUBLE AS homogeneity_score, k / 100.0::DOUBLE AS quality_score,
    CASE WHEN event_id % 2 = 0 THEN (event_id % 71) / 71.0::DOUBLE END AS closure_score,
    90.0::DOUBLE + k % 60 AS bpm, 1.5::DOUBLE AS vibe_window_sec,
    CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'clear' END AS rating,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'note ' || k END END AS note,
    CASE WHEN event_type = 'click' THEN
      CASE WHEN k % 3 = 0 THEN [feels[k % 5 + 1], feels[(k + 2) % 5 + 1]] ELSE [feels[k % 5 + 1]] END END AS tags,
    CASE WHEN event_id % 5 = 0 THEN 'phase-closure-v1' END AS analysis_version,
    CASE event_id % 3 WHEN 0 THEN 0.035::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS wrap_crossfade_sec,
    CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS normalize
  FROM votes0),
keyed AS (
  SELECT *, START_UNITS AS start_units, END_UNITS AS end_units FROM votes)
""".replace("START_UNITS", fixed_units_sql("start_sec", 2)).replace("END_UNITS", fixed_units_sql("end_sec", 2))


def wrap_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrap_votes_of(read(spark, sf_dir, "events"))


def wrap_votes_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", k_of_props())
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        (F.floor(F.col("value") / 2.5) * 2.5 + (F.col("k") % 5) * 0.02).alias("exit_sec"),
        (F.floor(F.col("k") / 4) * 2.5 + (F.col("event_id") % 5) * 0.02).alias("entry_sec"),
        F.when(kind.isin("purchase", "view"), "good").when(kind == "signup", "clear").otherwise("bad").alias("rating"),
    )


WRAP_VOTES_SQL = """
wev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
wrap_votes AS (
  SELECT event_id AS seq, 'u' || user_id AS source_name,
    floor(value / 2.5::DOUBLE) * 2.5::DOUBLE + (k % 5) * 0.02::DOUBLE AS exit_sec,
    (k // 4) * 2.5::DOUBLE + (event_id % 5) * 0.02::DOUBLE AS entry_sec,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'good' WHEN event_type = 'signup' THEN 'clear' ELSE 'bad' END AS rating
  FROM wev),
wrap_keyed AS (SELECT *, EXIT_UNITS AS exit_units, ENTRY_UNITS AS entry_units FROM wrap_votes),
latest_wraps AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_name, exit_units, entry_units ORDER BY seq DESC) AS rn FROM wrap_keyed)
  WHERE rn = 1 AND rating <> 'clear')
""".replace("EXIT_UNITS", fixed_units_sql("exit_sec", 3)).replace("ENTRY_UNITS", fixed_units_sql("entry_sec", 3))


# ---------------------------------------------------------------- layered bars from events
def layer_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event of a user, in event order; levels come from the event values."""
    e = read(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("song_id"),
        F.col("event_id").alias("seq"),
        "value",
        k_of_props().alias("k"),
    )
    block = block_of(F.col("seq"), BLOCK_SEQ)
    e = scan(e, ["song_id"], block, ["seq"], previous={"prev_value": F.col("value")}, before={"bar_idx": F.lit(1)})
    db = lambda c: F.round(20.0 * F.log10(c + 1e-9), 6)
    return settle(e.select(
        "song_id",
        F.col("bar_idx").cast("int").alias("bar_idx"),
        (F.col("bar_idx") * BAR_SEC).alias("start_sec"),
        ((F.col("bar_idx") + 1) * BAR_SEC).alias("end_sec"),
        db(F.col("value")).alias("base_db"),
        db(F.coalesce("prev_value", "value")).alias("top_db"),
        (F.col("k") / 199.0).alias("gain"),
    ))


LAYER_BARS_SQL = """
lb0 AS (
  SELECT 'u' || user_id AS song_id, event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
    lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_value
  FROM events),
layer_bars AS (
  SELECT song_id, CAST(i AS INT) AS bar_idx, i * 2.5::DOUBLE AS start_sec, (i + 1) * 2.5::DOUBLE AS end_sec,
    round(20.0::DOUBLE * log10(value + 1e-9::DOUBLE), 6) AS base_db,
    round(20.0::DOUBLE * log10(coalesce(prev_value, value) + 1e-9::DOUBLE), 6) AS top_db,
    k / 199.0::DOUBLE AS gain
  FROM lb0)
"""


# ---------------------------------------------------------------- frames and beats from embeddings
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hop frame per embedding; a song is a run of 128 consecutive vectors."""
    e = read(spark, sf_dir, "embeddings")
    mag = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: F.abs(x.cast("double")))
    raw = e.select(
        F.concat(F.lit("e"), F.floor(F.col("vec_id") / BEATS_PER_SONG).cast("string")).alias("song_id"),
        (F.col("vec_id") % BEATS_PER_SONG).alias("hop_idx"),
        mag(1, 12).alias("chroma"),
        mag(13, 8).alias("timbre"),
        mag(21, 24).alias("spec"),
        F.element_at("embedding", 45).cast("double").alias("rms"),
        F.element_at("embedding", 46).cast("double").alias("centroid"),
        F.element_at("embedding", 47).cast("double").alias("flux"),
    )
    return raw.select(
        "song_id",
        "hop_idx",
        (F.col("hop_idx") * 0.5).alias("t_sec"),
        l2_normalize(F.col("chroma")).alias("chroma"),
        l2_normalize(F.col("timbre")).alias("timbre"),
        "spec",
        F.abs("rms").alias("rms"),
        F.abs("centroid").alias("centroid"),
        F.abs("flux").alias("flux"),
    )


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def norm_sql(a: str) -> str:
    n = f"coalesce(nullif(sqrt({dot_sql(a, a)}), 0), 1)"
    return f"list_transform({a}, lambda x: x / {n})"


FRAMES_SQL = f"""
fr0 AS (
  SELECT 'e' || (vec_id // 128) AS song_id, vec_id % 128 AS hop_idx,
    list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)) AS chroma,
    list_transform(embedding[13:20], lambda x: abs(x::DOUBLE)) AS timbre,
    list_transform(embedding[21:44], lambda x: abs(x::DOUBLE)) AS spec,
    abs(embedding[45]::DOUBLE) AS rms, abs(embedding[46]::DOUBLE) AS centroid, abs(embedding[47]::DOUBLE) AS flux
  FROM embeddings),
fr1 AS (
  SELECT *, coalesce(nullif(sqrt(list_dot_product(chroma, chroma)), 0), 1) AS cn,
    coalesce(nullif(sqrt(list_dot_product(timbre, timbre)), 0), 1) AS tn FROM fr0),
frames AS (
  SELECT song_id, hop_idx, hop_idx * 0.5::DOUBLE AS t_sec,
    list_transform(chroma, lambda x: x / cn) AS chroma, list_transform(timbre, lambda x: x / tn) AS timbre,
    spec, rms, centroid, flux FROM fr1)
"""


def clamp01_sql(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def cosine_sql(a: str, b: str) -> str:
    den = f"sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    return f"(CASE WHEN {den} < 1e-12 THEN 1.0::DOUBLE ELSE {clamp01_sql(f'list_dot_product({a}, {b}) / {den}')} END)"


def ratio_sql(a: str, b: str) -> str:
    return f"(least(abs({a}), abs({b})) / greatest(abs({a}), abs({b}), 1e-8::DOUBLE))"


def vibe_sql(f: str, g: str) -> str:
    """frame_vibe_sim over two table aliases."""
    h = clamp01_sql(f"list_dot_product({f}.chroma, {g}.chroma)")
    t = clamp01_sql(f"list_dot_product({f}.timbre, {g}.timbre)")
    s = cosine_sql(f"{f}.spec", f"{g}.spec")
    e = ratio_sql(f"{f}.rms", f"{g}.rms")
    b = f"(1.0::DOUBLE - least(1.0::DOUBLE, abs({f}.centroid - {g}.centroid) / 0.2::DOUBLE))"
    return clamp01_sql(
        f"least({h}, {t}, {s}, {e}) * 0.55::DOUBLE + ({h} + {t} + {s} + {e} + {b}) / 5.0::DOUBLE * 0.45::DOUBLE"
    )


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
