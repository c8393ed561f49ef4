"""Vote logs: parsing, replay, merging, toggles."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    VOTES_SQL,
    WRAP_VOTES_SQL,
    Registry,
    fixed_units_sql,
    k_of_props,
    q6,
    r6,
    read,
    votes,
    with_ctes,
    wrap_votes,
)
from refrain.operators import votes as V
from refrain.sources import vote_logs as L

query = Registry()


KEY = "source_name, bars, start_units, end_units"


@query(
    "vote_cut_keys",
    f"""
    WITH p AS (SELECT event_id, value * 1.005::DOUBLE AS a, (value + event_id) / 7.0::DOUBLE AS b FROM events)
    SELECT event_id, {fixed_units_sql('a', 2)} AS cents, {fixed_units_sql('b', 3)} AS millis,
      CAST({fixed_units_sql('a', 2)} // 100 AS VARCHAR) || '.' || lpad(CAST({fixed_units_sql('a', 2)} % 100 AS VARCHAR), 2, '0') AS text
    FROM p
    """,
)
def vote_cut_keys(spark, d):
    from refrain.functions.exact import fixed_text, fixed_units

    e = read(spark, d, "events").select(
        "event_id", (F.col("value") * 1.005).alias("a"), ((F.col("value") + F.col("event_id")) / 7.0).alias("b")
    )
    return e.select(
        "event_id",
        fixed_units(F.col("a"), 2).alias("cents"),
        fixed_units(F.col("b"), 3).alias("millis"),
        fixed_text(F.col("a"), 2).alias("text"),
    )


@query(
    "vote_latest_ratings",
    with_ctes(
        VOTES_SQL,
        select=f"""
        SELECT {KEY}, rating FROM (
          SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE rating IS NOT NULL)
        WHERE rn = 1 AND rating <> 'clear'""",
    ),
)
def vote_latest_ratings(spark, d):
    return V.latest_ratings(votes(spark, d))


@query(
    "vote_latest_notes",
    with_ctes(
        VOTES_SQL,
        select=f"""
        SELECT {KEY}, note FROM (
          SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE note IS NOT NULL)
        WHERE rn = 1""",
    ),
)
def vote_latest_notes(spark, d):
    return V.latest_notes(votes(spark, d))


@query(
    "vote_latest_tags",
    with_ctes(
        VOTES_SQL,
        select=f"""
        SELECT {KEY}, array_to_string(tags, ',') AS tags FROM (
          SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE tags IS NOT NULL)
        WHERE rn = 1""",
    ),
)
def vote_latest_tags(spark, d):
    return V.latest_tags(votes(spark, d)).withColumn("tags", F.concat_ws(",", "tags"))


_FIELDS = [
    "start_sec", "end_sec", "seam_score", "context_score", "homogeneity_score", "quality_score",
    "closure_score", "bpm", "rating", "note", "analysis_version", "wrap_crossfade_sec", "normalize",
]
_FLOATS = {"start_sec", "end_sec", "seam_score", "context_score", "homogeneity_score", "quality_score", "closure_score", "bpm", "wrap_crossfade_sec"}


def _merged_sql(keys: str, source: str) -> str:
    """Latest non-null value of each field by an independent route: last_value over a full frame."""
    frame = f"OVER (PARTITION BY {keys} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    cols = ", ".join(
        (q6(f"last_value({c} IGNORE NULLS) {frame}") if c in _FLOATS else f"last_value({c} IGNORE NULLS) {frame}") + f" AS {c}"
        for c in _FIELDS
    )
    return f"""
      SELECT {keys}, first_seq, voted_at, {', '.join(_FIELDS)}, tags FROM (
        SELECT {keys}, first_value(seq) {frame} AS first_seq, last_value(voted_at IGNORE NULLS) {frame} AS voted_at, {cols},
          array_to_string(last_value(tags IGNORE NULLS) {frame}, ',') AS tags,
          row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS rn FROM {source}) WHERE rn = 1"""


def show_records(df, keys):
    cols = [r6(F.col(c)).alias(c) if c in _FLOATS else F.col(c) for c in _FIELDS]
    tags = F.when(F.col("tags").isNotNull(), F.concat_ws(",", "tags")).alias("tags")
    return df.select(*keys, "first_seq", F.col("at").alias("voted_at"), *cols, tags)


@query("vote_latest_records", with_ctes(VOTES_SQL, select=_merged_sql(KEY, "keyed")))
def vote_latest_records(spark, d):
    return show_records(V.latest_records(votes(spark, d)), V.CUT)


_RENDER_CTE = f"""
rendered AS (
  SELECT *, coalesce(wrap_crossfade_sec, 0.0::DOUBLE) AS fade_key, coalesce(normalize, FALSE) AS normalize_key FROM (
    SELECT *, max(CASE WHEN rating = 'clear' THEN seq END) OVER (PARTITION BY {KEY}) AS clear_seq FROM keyed)
  WHERE (clear_seq IS NULL OR seq > clear_seq) AND (rating IS NULL OR rating <> 'clear'))
"""


@query(
    "vote_latest_rendered",
    with_ctes(VOTES_SQL, _RENDER_CTE, select=_merged_sql(KEY + ", fade_key, normalize_key", "rendered")),
)
def vote_latest_rendered(spark, d):
    return show_records(V.latest_rendered(votes(spark, d)), [*V.CUT, "fade_key", "normalize_key"])


@query(
    "vote_partition_by_render",
    with_ctes(
        VOTES_SQL,
        _RENDER_CTE,
        select=f"""
        SELECT 'musical_blend' AS part, coalesce(rating, 'none') AS rating, count(*) AS n FROM (
          SELECT DISTINCT {KEY}, fade_key, normalize_key,
            last_value(rating IGNORE NULLS) OVER (PARTITION BY {KEY}, fade_key, normalize_key ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rating
          FROM rendered WHERE fade_key > 0.12)
        GROUP BY 2
        UNION ALL
        SELECT 'original_cut', coalesce(rating, 'none'), count(*) FROM (
          SELECT DISTINCT {KEY}, last_value(rating IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rating
          FROM keyed WHERE coalesce(rating = 'clear', FALSE) OR coalesce(wrap_crossfade_sec, 0) <= 0.12)
        GROUP BY 2""",
    ),
)
def vote_partition_by_render(spark, d):
    v = votes(spark, d)
    blends = V.musical_blends(v).select(F.lit("musical_blend").alias("part"), "rating")
    cuts = V.latest_records(V.original_cut_votes(v)).select(F.lit("original_cut").alias("part"), "rating")
    both = blends.unionByName(cuts).withColumn("rating", F.coalesce("rating", F.lit("none")))
    return both.groupBy("part", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vote_latest_wraps",
    with_ctes(
        WRAP_VOTES_SQL,
        select=f"SELECT source_name, exit_units, entry_units, {q6('exit_sec')} AS exit_sec, {q6('entry_sec')} AS entry_sec, rating, seq FROM latest_wraps",
    ),
)
def vote_latest_wraps(spark, d):
    w = V.latest_wraps(wrap_votes(spark, d))
    return w.withColumns({"exit_sec": r6(F.col("exit_sec")), "entry_sec": r6(F.col("entry_sec"))})


def _join_sources(spark, d):
    """Current votes, approved joins and older votes, told apart by event type."""
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type")
    w = wrap_votes(spark, d).join(e, "seq")
    current = V.latest_wraps(w.filter(F.col("event_type").isin("purchase", "signup")))
    approved = w.filter(F.col("event_type") == "error").withColumn("rating", F.lit("good"))
    older = w.filter(F.col("event_type").isin("view", "click"))
    return current, approved, V.latest_wraps(older)


@query(
    "vote_merge_sources",
    with_ctes(
        WRAP_VOTES_SQL,
        f"""
        typed AS (SELECT w.*, e.event_type FROM wrap_keyed w JOIN events e ON e.event_id = w.seq),
        cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name, exit_units, entry_units ORDER BY seq DESC) AS rn
                FROM typed WHERE event_type IN ('purchase', 'signup')) WHERE rn = 1 AND rating <> 'clear'),
        old AS (SELECT *, 1 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY source_name, exit_units, entry_units ORDER BY seq DESC) AS rn
                FROM typed WHERE event_type IN ('view', 'click')) WHERE rn = 1),
        older AS (
          SELECT source_name, exit_units, entry_units, exit_sec, entry_sec, rating, seq, tier FROM old
          UNION ALL SELECT source_name, exit_units, entry_units, exit_sec, entry_sec, 'good', seq, 0 FROM typed WHERE event_type = 'error'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source_name, exit_units, entry_units
            ORDER BY CASE WHEN rating = 'bad' THEN 0 ELSE 1 END,
              CASE WHEN rating = 'bad' THEN tier ELSE -tier END, CASE WHEN rating = 'bad' THEN seq ELSE -seq END) AS rk FROM older)
        """,
        select=f"""
        SELECT source_name, exit_units, entry_units, {q6('exit_sec')} AS exit_sec, {q6('entry_sec')} AS entry_sec, rating FROM cur
        UNION ALL
        SELECT source_name, exit_units, entry_units, {q6('exit_sec')}, {q6('entry_sec')}, rating FROM ranked r WHERE rk = 1
          AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.source_name = r.source_name AND c.exit_units = r.exit_units AND c.entry_units = r.entry_units)""",
    ),
)
def vote_merge_sources(spark, d):
    current, approved, older = _join_sources(spark, d)
    m = V.merge_rated_joins(current, approved, older)
    return m.withColumns({"exit_sec": r6(F.col("exit_sec")), "entry_sec": r6(F.col("entry_sec"))})


def clicks(spark, d):
    e = read(spark, d, "events").withColumn("k", k_of_props())
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        F.floor(F.col("value") / 50.0).cast("bigint").alias("cell"),
        F.when(F.col("event_type").isin("error", "click"), "bad").otherwise("good").alias("rating"),
        F.element_at(F.array(*[F.lit(t) for t in ("exploration", "tension", "combat", "intensity", "stinger")]), F.col("k") % 5 + 1).alias("tag"),
    )


_CLICKS_SQL = """
ck AS (SELECT event_id AS seq, 'u' || user_id AS source_name, CAST(floor(value / 50.0) AS BIGINT) AS cell,
    CASE WHEN event_type IN ('error', 'click') THEN 'bad' ELSE 'good' END AS rating,
    ['exploration','tension','combat','intensity','stinger'][CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 + 1] AS tag
  FROM events)
"""


ORACLE_TOGGLE = (
    "WITH RECURSIVE "
    + _CLICKS_SQL.strip()
    + """,
    n AS (SELECT *, row_number() OVER (PARTITION BY source_name, cell ORDER BY seq) AS rn FROM ck),
    st AS (
      SELECT source_name, cell, seq, rn, rating, rating AS emitted, rating AS state FROM n WHERE rn = 1
      UNION ALL
      SELECT n.source_name, n.cell, n.seq, n.rn, n.rating,
        CASE WHEN n.rating = st.state THEN 'clear' ELSE n.rating END,
        CASE WHEN n.rating = st.state THEN 'none' ELSE n.rating END
      FROM st JOIN n ON n.source_name = st.source_name AND n.cell = st.cell AND n.rn = st.rn + 1)
    SELECT source_name, cell, seq, rating, emitted FROM st"""
)


@query("vote_toggle_clicks", ORACLE_TOGGLE)
def vote_toggle_clicks(spark, d):
    return V.toggle_votes(clicks(spark, d).drop("tag"), ["source_name", "cell"])


@query(
    "vote_toggle_tags",
    with_ctes(
        _CLICKS_SQL,
        "odd AS (SELECT source_name, cell, tag, max(seq) AS added FROM ck GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)",
        select="SELECT source_name, cell, string_agg(tag, ',' ORDER BY added) AS tags FROM odd GROUP BY 1, 2",
    ),
)
def vote_toggle_tags(spark, d):
    t = V.toggle_tags(clicks(spark, d), ["source_name", "cell"])
    return t.withColumn("tags", F.concat_ws(",", "tags"))


_SESSIONS_SQL = "sess AS (SELECT 's' || user_id AS session_id, 'u' || user_id AS source_name, (user_id % 3) * 2.5::DOUBLE AS trim_start, 10.0::DOUBLE + (user_id % 40) AS trim_end FROM (SELECT DISTINCT user_id FROM events))"


def sessions(spark, d):
    u = read(spark, d, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        ((F.col("user_id") % 3) * 2.5).alias("trim_start"),
        (F.lit(10.0) + F.col("user_id") % 40).alias("trim_end"),
    )


_RESTORED_SQL = "rec AS (" + _merged_sql(KEY, "keyed") + "), " + _SESSIONS_SQL + f"""
, restored AS (
  SELECT session_id, source_name,
    'saved:' || source_name || '|' || bars || '|' || printf('%d.%02d', start_units // 100, start_units % 100) || '|'
      || printf('%d.%02d', end_units // 100, end_units % 100) AS id,
    start_sec, end_sec, bars, bpm, quality_score, coalesce(analysis_version, 'legacy') AS score_version,
    {q6('coalesce(wrap_crossfade_sec, 0)')} AS saved_fade_sec, coalesce(normalize, FALSE) AS saved_normalize
  FROM rec JOIN sess USING (source_name)
  WHERE start_sec >= trim_start AND end_sec <= trim_end AND bpm > 0
    AND (coalesce(rating IN ('good', 'bad'), FALSE) OR coalesce(length(trim(note)), 0) > 0 OR coalesce(length(tags), 0) > 0))
"""


@query("vote_restore_saved", with_ctes(VOTES_SQL, _RESTORED_SQL, select="SELECT * FROM restored"))
def vote_restore_saved(spark, d):
    r = V.restore_saved(V.latest_records(votes(spark, d)), sessions(spark, d))
    return r.select(
        "session_id", "source_name", "id", "start_sec", "end_sec", "bars", "bpm",
        r6(F.col("quality_score")).alias("quality_score"), "score_version",
        r6(F.col("saved_fade_sec")).alias("saved_fade_sec"), "saved_normalize",
    )


@query(
    "vote_merge_saved",
    with_ctes(
        VOTES_SQL,
        _RESTORED_SQL,
        select=f"""
        SELECT session_id, id, coalesce(origin, 'found') AS origin, bars FROM (
          SELECT 's' || user_id AS session_id, 'loop-' || event_id AS id,
            CASE WHEN event_type = 'view' THEN 'saved' WHEN event_type = 'click' THEN NULL ELSE 'found' END AS origin,
            [1,2,4,6,8,12,16][CAST(event_id % 7 + 1 AS INT)] AS bars FROM events)
        WHERE coalesce(origin, 'found') <> 'saved'
        UNION ALL SELECT session_id, id, 'saved', bars FROM restored""",
    ),
)
def vote_merge_saved(spark, d):
    e = read(spark, d, "events")
    found = e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("loop-"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "view", "saved").when(F.col("event_type") != "click", "found").alias("origin"),
        F.element_at(F.array(*[F.lit(b) for b in (1, 2, 4, 6, 8, 12, 16)]), (F.col("event_id") % 7 + 1).cast("int")).alias("bars"),
    )
    restored = V.restore_saved(V.latest_records(votes(spark, d)), sessions(spark, d))
    merged = V.merge_saved(found, restored.select("session_id", "id", "origin", "bars"))
    return merged.withColumn("origin", F.coalesce("origin", F.lit("found")))


# ---------------------------------------------------------------- log parsing
def _log_lines(spark, d):
    """The votes written as a log, with torn and invalid lines in between."""
    lines = L.loop_vote_lines(votes(spark, d))
    v = F.col("value")
    return lines.withColumn(
        "value",
        F.when(F.col("seq") % 11 == 3, F.substring(v, F.lit(1), (F.length(v) / 2).cast("int")))
        .when(F.col("seq") % 13 == 5, F.regexp_replace(v, '"bars":[0-9]+', '"bars":3'))
        .when(F.col("seq") % 17 == 2, F.regexp_replace(v, '"startSec":', '"startSec":-'))
        .when(F.col("seq") % 19 == 4, F.regexp_replace(v, '"tags":\\["', '"tags":["unknown","'))
        .otherwise(v),
    )


_LOG_OK = """
  NOT (seq % 11 = 3) AND NOT (seq % 13 = 5)
  AND NOT (seq % 17 = 2 AND seq % 11 <> 3 AND seq % 13 <> 5 AND start_sec > 0)
  AND NOT (seq % 19 = 4 AND seq % 17 <> 2 AND tags IS NOT NULL)
"""


@query(
    "vote_log_parse",
    with_ctes(
        VOTES_SQL,
        select=f"""
        SELECT seq, source_name, start_sec, end_sec, bars, {q6('quality_score')} AS quality_score, rating, note,
          array_to_string(tags, ',') AS tags, {q6('wrap_crossfade_sec')} AS wrap_crossfade_sec, normalize
        FROM votes WHERE {_LOG_OK}""",
    ),
)
def vote_log_parse(spark, d):
    good, _ = L.parse_loop_votes(_log_lines(spark, d))
    return good.select(
        "seq", "source_name", "start_sec", "end_sec", "bars", r6(F.col("quality_score")).alias("quality_score"),
        "rating", "note", F.when(F.col("tags").isNotNull(), F.concat_ws(",", "tags")).alias("tags"),
        r6(F.col("wrap_crossfade_sec")).alias("wrap_crossfade_sec"), "normalize",
    )


@query("vote_log_quarantine", with_ctes(VOTES_SQL, select=f"SELECT seq FROM votes WHERE NOT ({_LOG_OK})"))
def vote_log_quarantine(spark, d):
    return L.parse_loop_votes(_log_lines(spark, d))[1].select("seq")


@query(
    "vote_wrap_log_parse",
    with_ctes(
        WRAP_VOTES_SQL,
        select=f"""
        SELECT seq, source_name, {q6('exit_sec')} AS exit_sec, {q6('entry_sec')} AS entry_sec, rating FROM wrap_votes
        WHERE seq % 10 <> 1 AND seq % 7 <> 3 AND seq % 9 <> 5""",
    ),
)
def vote_wrap_log_parse(spark, d):
    w = wrap_votes(spark, d)
    lines = w.select(
        "seq",
        F.to_json(
            F.struct(
                F.when(F.col("seq") % 10 == 1, 2).otherwise(1).alias("version"),
                F.when(F.col("seq") % 7 == 3, "yesterday").otherwise("2026-01-02T03:04:05.000Z").alias("at"),
                F.col("source_name").alias("sourceName"),
                F.col("exit_sec").alias("exitSec"),
                F.col("entry_sec").alias("entrySec"),
                F.when(F.col("seq") % 9 != 5, 0.035).alias("fadeSec"),
                "rating",
            )
        ).alias("value"),
    )
    p = L.parse_wrap_votes(lines)
    return p.select("seq", "source_name", r6(F.col("exit_sec")).alias("exit_sec"), r6(F.col("entry_sec")).alias("entry_sec"), "rating")


@query(
    "vote_pack_log_parse",
    with_ctes(
        WRAP_VOTES_SQL,
        f"""
        pk AS (SELECT *, row_number() OVER (PARTITION BY source_name, exit_units, entry_units ORDER BY seq DESC) AS rn
          FROM wrap_keyed WHERE rating <> 'clear' AND seq % 4 <> 0)""",
        select=f"SELECT source_name, exit_units, entry_units, rating, seq FROM pk WHERE rn = 1",
    ),
)
def vote_pack_log_parse(spark, d):
    w = wrap_votes(spark, d)
    lines = w.select(
        "seq",
        F.to_json(
            F.struct(
                F.col("source_name").alias("sourceName"),
                "rating",
                F.struct(
                    F.when(F.col("seq") % 4 == 0, "natural-switch").when(F.col("seq") % 4 == 1, "wrap").alias("kind"),
                    F.col("exit_sec").alias("exitSec"),
                    F.col("entry_sec").alias("entrySec"),
                ).alias("join"),
            )
        ).alias("value"),
    )
    return V.latest_pack_votes(L.parse_pack_votes(lines)).select("source_name", "exit_units", "entry_units", "rating", "seq")


@query(
    "vote_pack_documents",
    """
    SELECT 'o' || l_orderkey AS source_name, l_quantity * 1.5::DOUBLE AS exit_sec,
      CAST(l_linenumber AS DOUBLE) AS entry_sec, 'good' AS rating, count(*) AS n
    FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 19 <> 0 GROUP BY ALL
    """,
)
def vote_pack_documents(spark, d):
    """One document per order; an order has a handful of lines, so the array is small."""
    li = read(spark, d, "lineitem")
    jump = F.struct(
        (F.col("l_quantity") * 1.5).alias("exitSec"),
        F.col("l_linenumber").cast("double").alias("entrySec"),
        F.when(F.col("l_returnflag") == "A", "listener").otherwise("model").alias("source"),
    )
    docs = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(jump).alias("jumps"))).alias("value"))
    docs = docs.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_name"),
        F.lit(0).alias("seq"),
        F.when(F.col("l_orderkey") % 19 == 0, F.concat(F.lit("{"), F.col("value"))).otherwise(F.col("value")).alias("value"),
    )
    parsed = L.parse_pack_documents(docs)
    return parsed.groupBy("source_name", "exit_sec", "entry_sec", "rating").agg(F.count(F.lit(1)).alias("n"))
