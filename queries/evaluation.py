"""Ranking evaluation of votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import VOTES_SQL, Registry, q6, r6, read, votes, with_ctes
from queries.votes import KEY
from refrain.functions.exact import fixed_units
from refrain.operators import evaluate as E
from refrain.operators import votes as V
from refrain.schemas import ANALYSIS_VERSION, BAR_LENGTHS

query = Registry()


SCORES = ["s_length", "s_mod", "s_id"]


def rated(spark, d):
    """A vote per labelled document; scores are derived from its size and id."""
    lab = read(spark, d, "labels")
    doc = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("rating"),
        F.col("source").alias("source_name"),
        "lang",
        (F.col("n_chars") / 50000.0).alias("s_length"),
        ((F.col("n_chars") % 97) / 97.0).alias("s_mod"),
        ((F.col("doc_id") % 89) / 89.0).alias("s_id"),
        F.when(F.col("toxic") == 0, ANALYSIS_VERSION).alias("analysis_version"),
    )


RATED_SQL = """
rated AS (
  SELECT l.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating, source AS source_name, lang,
    n_chars / 50000.0::DOUBLE AS s_length, (n_chars % 97) / 97.0::DOUBLE AS s_mod, (l.doc_id % 89) / 89.0::DOUBLE AS s_id,
    CASE WHEN toxic = 0 THEN 'phase-closure-v1' END AS analysis_version
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
melted AS (
  SELECT doc_id, rating, source_name, lang, analysis_version, 's_length' AS metric, s_length AS score FROM rated
  UNION ALL SELECT doc_id, rating, source_name, lang, analysis_version, 's_mod', s_mod FROM rated
  UNION ALL SELECT doc_id, rating, source_name, lang, analysis_version, 's_id', s_id FROM rated)
"""


@query(
    "eval_auc_groups",
    with_ctes(
        RATED_SQL,
        """
        members AS (
          SELECT 'all' AS group_kind, 'all' AS group_label, * FROM melted
          UNION ALL SELECT 'source', source_name, * FROM melted
          UNION ALL SELECT 'lang', lang, * FROM melted
          UNION ALL SELECT 'version', analysis_version, * FROM melted WHERE analysis_version IS NOT NULL),
        pairs AS (
          SELECT g.group_kind, g.group_label, g.metric,
            sum(CASE WHEN g.score > b.score THEN 1.0::DOUBLE WHEN g.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc
          FROM members g JOIN members b ON g.group_kind = b.group_kind AND g.group_label = b.group_label
            AND g.metric = b.metric AND g.rating = 'good' AND b.rating = 'bad' GROUP BY 1, 2, 3),
        sizes AS (SELECT group_kind, group_label, metric, count(*) FILTER (rating = 'good') AS n_good,
            count(*) FILTER (rating = 'bad') AS n_bad FROM members GROUP BY 1, 2, 3)
        """,
        select=f"""
        SELECT group_kind, group_label, metric, n_good, n_bad, {q6('coalesce(auc, 0.5)')} AS auc, auc IS NOT NULL AS has_pairs
        FROM sizes LEFT JOIN pairs USING (group_kind, group_label, metric)""",
    ),
)
def eval_auc_groups(spark, d):
    groups = {
        "all": F.lit("all"),
        "source": F.col("source_name"),
        "lang": F.col("lang"),
        "version": F.col("analysis_version"),
    }
    out = E.evaluate(rated(spark, d), SCORES, groups)
    return out.withColumn("auc", r6(F.col("auc")))


@query(
    "eval_score_stats",
    with_ctes(
        RATED_SQL,
        select=f"""
        SELECT metric, rating, count(*) AS n, {q6('avg(score)')} AS mean, {q6('quantile_disc(score, 0.5)')} AS median
        FROM melted GROUP BY 1, 2""",
    ),
)
def eval_score_stats(spark, d):
    s = E.score_stats(rated(spark, d), SCORES)
    return s.withColumns({"mean": r6(F.col("mean")), "median": r6(F.col("median"))})


@query(
    "eval_best_f1",
    with_ctes(
        RATED_SQL,
        """
        m AS (SELECT 'src' AS g, source_name AS lab, * FROM melted UNION ALL SELECT 'all', 'all', * FROM melted),
        t AS (SELECT DISTINCT g, lab, metric, score FROM m),
        c AS (SELECT t.g, t.lab, t.metric, t.score,
            count(*) FILTER (m.score >= t.score AND rating = 'good') AS tp,
            count(*) FILTER (m.score >= t.score AND rating = 'bad') AS fp,
            count(*) FILTER (rating = 'good') AS goods
          FROM t JOIN m ON m.g = t.g AND m.lab = t.lab AND m.metric = t.metric GROUP BY 1, 2, 3, 4),
        f AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS p, tp / greatest(1, goods)::DOUBLE AS r FROM c),
        s AS (SELECT *, 2.0::DOUBLE * p * r / greatest(1e-9::DOUBLE, p + r) AS f1 FROM f),
        b AS (SELECT *, row_number() OVER (PARTITION BY g, lab, metric ORDER BY f1 DESC, score) AS rn FROM s)
        """,
        select=f"""
        SELECT g, lab, metric, {q6('CASE WHEN f1 > 0 THEN score ELSE 0 END')} AS threshold, {q6('f1')} AS f1,
          {q6('CASE WHEN f1 > 0 THEN p ELSE 0 END')} AS precision, {q6('CASE WHEN f1 > 0 THEN r ELSE 0 END')} AS recall,
          CASE WHEN f1 > 0 THEN tp ELSE 0 END AS kept_good, CASE WHEN f1 > 0 THEN fp ELSE 0 END AS kept_bad
        FROM b WHERE rn = 1""",
    ),
)
def eval_best_f1(spark, d):
    r = E.grouped(rated(spark, d), {"src": F.col("source_name"), "all": F.lit("all")})
    melted = E.melt_scores(r, ["group_kind", "group_label"], SCORES)
    out = E.best_f1(melted, "score", ["group_kind", "group_label", "metric"])
    return out.select(
        F.col("group_kind").alias("g"), F.col("group_label").alias("lab"), "metric",
        *[r6(F.col(c)).alias(c) for c in ("threshold", "f1", "precision", "recall")], "kept_good", "kept_bad",
    )


@query(
    "eval_top20",
    with_ctes(
        RATED_SQL,
        select=" UNION ALL ".join(
            f"""SELECT '{s}' AS metric, count(*) FILTER (rating = 'good') AS good, count(*) FILTER (rating = 'bad') AS bad
            FROM (SELECT rating FROM rated ORDER BY {s} DESC, doc_id LIMIT 20)"""
            for s in SCORES
        ),
    ),
)
def eval_top20(spark, d):
    r = rated(spark, d)
    out = [E.top_composition(r, s, "doc_id") for s in SCORES]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "eval_score_drift",
    with_ctes(
        RATED_SQL,
        select=f"SELECT count(*) AS n, {q6('max(abs(s_mod - s_id))')} AS max_delta FROM rated WHERE analysis_version = 'phase-closure-v1'",
    ),
)
def eval_score_drift(spark, d):
    return E.score_drift(rated(spark, d), "s_mod", "s_id", ANALYSIS_VERSION).withColumn("max_delta", r6(F.col("max_delta")))


def detected(spark, d):
    """Detected candidates laid on the same coarse cuts as the votes."""
    e = read(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    start = F.floor(F.col("k") / 10) * 2.5
    bars = F.element_at(F.array(*[F.lit(b) for b in BAR_LENGTHS]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("song_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        "event_id",
        bars.alias("bars"),
        start.alias("start_sec"),
        (start + bars * 2.0).alias("end_sec"),
        (F.col("value") / 500.0).alias("quality_score"),
    ).withColumns({"start_units": fixed_units(F.col("start_sec"), 2), "end_units": fixed_units(F.col("end_sec"), 2)})


@query(
    "eval_detection_summary",
    with_ctes(
        VOTES_SQL,
        f"""
        cur AS (SELECT {KEY}, rating FROM (
          SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE rating IS NOT NULL)
          WHERE rn = 1 AND rating <> 'clear'),
        det AS (SELECT 'u' || user_id AS source_name, [1,2,4,8,16][CAST(event_id % 5 + 1 AS INT)] AS bars,
            (k // 10) * 2.5::DOUBLE AS start_sec, value / 500.0::DOUBLE AS quality FROM ev),
        m AS (SELECT d.*, c.rating FROM det d LEFT JOIN cur c ON c.source_name = d.source_name AND c.bars = d.bars
          AND c.start_units = CAST(round(d.start_sec * 100) AS BIGINT)
          AND c.end_units = CAST(round((d.start_sec + d.bars * 2.0::DOUBLE) * 100) AS BIGINT))
        """,
        select=f"""
        SELECT source_name AS song_id, count(*) AS n,
          {', '.join(f'count(*) FILTER (bars = {b}) AS bars_{b}' for b in BAR_LENGTHS)},
          {q6('max(quality)')} AS top_quality, array_to_string(list_sort(list(DISTINCT bars)), ',') AS lengths,
          count(*) FILTER (rating = 'good') AS rated_good, count(*) FILTER (rating = 'bad') AS rated_bad,
          count(*) FILTER (rating IS NULL) AS unrated
        FROM m GROUP BY 1""",
    ),
)
def eval_detection_summary(spark, d):
    matched = E.match_rated(detected(spark, d), V.latest_ratings(votes(spark, d)), V.CUT)
    return E.detection_summary(matched, BAR_LENGTHS).withColumn("top_quality", r6(F.col("top_quality")))


@query(
    "eval_distinct_sources",
    "SELECT DISTINCT 'u' || user_id AS source_name FROM events",
)
def eval_distinct_sources(spark, d):
    return E.distinct_sources(votes(spark, d))


@query(
    "eval_safe_exits",
    """
    SELECT 'u' || user_id AS song_id,
      count(DISTINCT CASE WHEN value / 120.0 >= 0.7 THEN event_id // 40 END) AS safe_cut,
      count(DISTINCT CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 100.0 >= 0.7 THEN event_id // 40 END) AS safe_blended,
      count(DISTINCT event_id // 40) AS exits
    FROM events GROUP BY 1
    """,
)
def eval_safe_exits(spark, d):
    e = read(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    jumps = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("song_id"),
        F.floor(F.col("event_id") / 40).alias("exit_beat"),
        (F.col("value") / 120.0).alias("p_good_cut"),
        (F.col("k") / 100.0).alias("p_good_blended"),
    )
    return E.safe_exits(jumps)
