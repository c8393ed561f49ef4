"""Bar levels, warnings and wrap suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    LAYER_BARS_SQL,
    WRAP_VOTES_SQL,
    Registry,
    layer_bars,
    q6,
    q9,
    r6,
    r9,
    with_ctes,
    wrap_votes,
)
from refrain.operators import bars as B
from refrain.operators import suggest as S
from refrain.operators import votes as V
from refrain.operators.settle import settle

query = Registry()


def classified_sql(drop: float = 9.0) -> str:
    return f"""
{LAYER_BARS_SQL.strip()},
usual AS (
  SELECT song_id, base_db AS usual_db FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY base_db) - 1 AS r, count(*) OVER (PARTITION BY song_id) AS n FROM layer_bars)
  WHERE r = floor(0.75::DOUBLE * (n - 1) + 0.5)),
bars AS (SELECT b.*, base_db < usual_db - {drop}::DOUBLE AS quiet FROM layer_bars b JOIN usual u ON u.song_id = b.song_id),
intro AS (
  SELECT s.song_id, coalesce(min(i.bar_idx), 0) AS intro_bar, s.n_bars FROM (SELECT song_id, count(*) AS n_bars FROM bars GROUP BY 1) s
  LEFT JOIN (SELECT b.song_id, b.bar_idx FROM bars b JOIN bars c ON c.song_id = b.song_id AND c.bar_idx BETWEEN b.bar_idx AND b.bar_idx + 3
    GROUP BY 1, 2 HAVING count(*) = 4 AND count(*) FILTER (c.quiet) = 0) i ON i.song_id = s.song_id
  GROUP BY s.song_id, s.n_bars)
"""


def classified(spark, d, drop: float = 9.0):
    return B.classify_bars(layer_bars(spark, d), drop)


@query("bars_layered", with_ctes(LAYER_BARS_SQL, select=f"SELECT song_id, bar_idx, start_sec, end_sec, {q6('base_db')} AS base_db, {q6('top_db')} AS top_db FROM layer_bars"))
def bars_layered(spark, d):
    return layer_bars(spark, d).select(
        "song_id", "bar_idx", "start_sec", "end_sec", r6(F.col("base_db")).alias("base_db"), r6(F.col("top_db")).alias("top_db")
    )


@query("bars_quiet", with_ctes(classified_sql(), select="SELECT song_id, bar_idx, quiet FROM bars"))
def bars_quiet(spark, d):
    return classified(spark, d).select("song_id", "bar_idx", "quiet")


@query("bars_intro_end", with_ctes(classified_sql(), select="SELECT song_id, intro_bar, n_bars FROM intro"))
def bars_intro_end(spark, d):
    return B.intro_end(classified(spark, d))


@query(
    "bars_top_change",
    with_ctes(
        classified_sql(),
        """
        ch AS (SELECT song_id, bar_idx,
          avg(top_db) OVER (PARTITION BY song_id ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a,
          avg(top_db) OVER (PARTITION BY song_id ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b FROM bars)
        """,
        select=f"""
        SELECT song_id, bar_idx,
          {q9('CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE greatest(0, least(1, (a - b) / 12.0::DOUBLE)) END')} AS drop_change,
          {q9('CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE greatest(0, least(1, (b - a) / 12.0::DOUBLE)) END')} AS return_change
        FROM ch""",
    ),
)
def bars_top_change(spark, d):
    p = B.bar_profile(classified(spark, d))
    return p.select("song_id", "bar_idx", r9(F.col("drop")).alias("drop_change"), r9(F.col("rise")).alias("return_change"))


@query(
    "bars_lateness",
    with_ctes(
        classified_sql(),
        """
        edges AS (SELECT b.song_id, b.bar_idx, i.n_bars,
            coalesce((SELECT max(q.bar_idx) FROM bars q WHERE q.song_id = b.song_id AND q.quiet AND q.bar_idx < b.bar_idx) + 1, 0) AS s,
            coalesce((SELECT min(q.bar_idx) FROM bars q WHERE q.song_id = b.song_id AND q.quiet AND q.bar_idx > b.bar_idx), i.n_bars) - 1 AS e
          FROM bars b JOIN intro i ON i.song_id = b.song_id)
        """,
        select=f"SELECT song_id, bar_idx, {q6('CASE WHEN e = s THEN 1.0 ELSE (bar_idx - s) / (e - s)::DOUBLE END')} AS lateness FROM edges",
    ),
)
def bars_lateness(spark, d):
    out = B.lateness(classified(spark, d))
    return out.select("song_id", "bar_idx", r6(F.col("lateness")).alias("lateness"))


_LOOPS_SQL = """
loops AS (SELECT source_name AS song_id, seq AS loop_id, entry_sec AS start_sec, entry_sec + exit_sec / 2.0::DOUBLE + 10.0::DOUBLE AS end_sec FROM wrap_votes),
placed AS (SELECT l.*, coalesce(s.bar_idx, -1) AS start_bar, coalesce(e.bar_idx, -1) AS end_bar FROM loops l
  LEFT JOIN bars s ON s.song_id = l.song_id AND l.start_sec + 0.06::DOUBLE >= s.start_sec AND l.start_sec < s.end_sec - 0.06::DOUBLE
  LEFT JOIN bars e ON e.song_id = l.song_id AND l.end_sec + 0.06::DOUBLE >= e.start_sec AND l.end_sec < e.end_sec - 0.06::DOUBLE)
"""


def loops(spark, d):
    w = wrap_votes(spark, d)
    return w.select(
        F.col("source_name").alias("song_id"),
        F.col("seq").alias("loop_id"),
        F.col("entry_sec").alias("start_sec"),
        (F.col("entry_sec") + F.col("exit_sec") / 2.0 + 10.0).alias("end_sec"),
    )


@query(
    "bars_locate_points",
    with_ctes(WRAP_VOTES_SQL, classified_sql(), _LOOPS_SQL, select="SELECT song_id, loop_id, start_bar, end_bar FROM placed"),
)
def bars_locate_points(spark, d):
    b = layer_bars(spark, d)
    p = B.bars_at(loops(spark, d), b, {"start_bar": "start_sec", "end_bar": "end_sec"})
    return p.select("song_id", "loop_id", "start_bar", "end_bar")


@query(
    "bars_longest_quiet_run",
    with_ctes(
        WRAP_VOTES_SQL,
        classified_sql(),
        _LOOPS_SQL,
        """
        q AS (SELECT song_id, bar_idx, bar_idx - row_number() OVER (PARTITION BY song_id ORDER BY bar_idx) AS g FROM bars WHERE quiet),
        runs AS (SELECT song_id, min(bar_idx) AS a, max(bar_idx) + 1 AS b FROM q GROUP BY song_id, g)
        """,
        select="""
        SELECT p.song_id, loop_id, CAST(coalesce(max(greatest(0, least(end_bar, b) - greatest(start_bar, a))), 0) AS INT) AS longest
        FROM placed p LEFT JOIN runs r ON r.song_id = p.song_id WHERE start_bar >= 0 AND end_bar >= 0 GROUP BY 1, 2""",
    ),
)
def bars_longest_quiet_run(spark, d):
    b = settle(classified(spark, d))
    p = B.bars_at(loops(spark, d), b, {"from_bar": "start_sec", "to_bar": "end_sec"})
    ranges = p.filter("from_bar >= 0 AND to_bar >= 0").withColumnRenamed("loop_id", "range_id")
    out = B.longest_quiet_run(b, settle(ranges))
    return out.select("song_id", F.col("range_id").alias("loop_id"), F.col("longest").cast("int").alias("longest"))


@query(
    "bars_loop_warnings",
    with_ctes(
        WRAP_VOTES_SQL,
        classified_sql(),
        _LOOPS_SQL,
        """
        w AS (SELECT p.song_id, p.loop_id, p.start_sec, p.end_sec, i.intro_bar,
          (SELECT start_sec FROM bars b WHERE b.song_id = p.song_id AND b.bar_idx = i.intro_bar) AS intro_sec,
          coalesce((SELECT bool_or(quiet) FROM bars b WHERE b.song_id = p.song_id AND p.start_bar >= 0 AND b.bar_idx IN (p.start_bar, p.start_bar + 1)), FALSE) AS soft,
          coalesce((SELECT sum(end_sec - start_sec) FROM bars b WHERE b.song_id = p.song_id AND b.quiet
            AND b.bar_idx >= greatest(0, p.start_bar) AND b.bar_idx < CASE WHEN p.end_bar < 0 THEN i.n_bars ELSE p.end_bar END), 0) AS quiet_sec
          FROM placed p JOIN intro i ON i.song_id = p.song_id)
        """,
        select="""
        SELECT song_id, loop_id, array_to_string(list_filter([
          CASE WHEN end_sec - start_sec < 60 THEN 'short:' || CAST(floor(end_sec - start_sec + 0.5) AS BIGINT) END,
          CASE WHEN start_sec < intro_sec - 0.06::DOUBLE THEN 'intro-start' END,
          CASE WHEN NOT (start_sec < intro_sec - 0.06::DOUBLE) AND soft THEN 'quiet-start' END,
          CASE WHEN quiet_sec >= 8 THEN 'quiet-inside:' || CAST(floor(quiet_sec + 0.5) AS BIGINT) END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM w""",
    ),
)
def bars_loop_warnings(spark, d):
    out = B.loop_warnings(loops(spark, d), classified(spark, d))
    label = lambda s: F.concat_ws(":", s["id"], s["seconds"].cast("string"))
    return out.select("song_id", "loop_id", F.concat_ws(",", F.transform("warnings", label)).alias("warnings"))


# ---------------------------------------------------------------- suggestions
def current_votes(spark, d):
    w = V.latest_wraps(wrap_votes(spark, d))
    return w.select(
        F.col("source_name").alias("song_id"), "exit_sec", "entry_sec", "rating", F.col("seq").alias("vote_seq")
    )


@query(
    "wrap_prior_match",
    with_ctes(
        WRAP_VOTES_SQL,
        select=f"""
        SELECT j.source_name AS song_id, j.seq, CASE WHEN bool_or(v.rating = 'bad') THEN 'bad' WHEN count(v.rating) > 0 THEN 'good' END AS prior
        FROM wrap_votes j LEFT JOIN latest_wraps v ON v.source_name = j.source_name
          AND abs(v.exit_sec - (j.exit_sec + 0.03::DOUBLE)) <= 0.06::DOUBLE AND abs(v.entry_sec - j.entry_sec) <= 0.06::DOUBLE
        GROUP BY 1, 2""",
    ),
)
def wrap_prior_match(spark, d):
    joins = wrap_votes(spark, d).select(
        F.col("source_name").alias("song_id"), "seq", (F.col("exit_sec") + 0.03).alias("exit_sec"), "entry_sec"
    )
    return S.prior_match(joins, current_votes(spark, d)).select("song_id", "seq", "prior")


def acceptable_sql(drop: float) -> str:
    return f"""
{classified_sql(drop).strip()},
pf AS (
  SELECT b.*, i.intro_bar, i.n_bars,
    coalesce(lead(quiet, 1) OVER w, FALSE) AS q_next,
    coalesce(lag(quiet, 1) OVER w, FALSE) AS q1, coalesce(lag(quiet, 2) OVER w, FALSE) AS q2,
    coalesce(sum(quiet::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb,
    avg(top_db) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ta,
    avg(top_db) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS tb,
    max(CASE WHEN quiet THEN b.bar_idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pq,
    min(CASE WHEN quiet THEN b.bar_idx END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nq
  FROM bars b JOIN intro i ON i.song_id = b.song_id
  WINDOW w AS (PARTITION BY b.song_id ORDER BY b.bar_idx)),
prof AS (
  SELECT *, CASE WHEN ta IS NULL OR tb IS NULL THEN 0.0::DOUBLE ELSE greatest(0, least(1, (ta - tb) / 12.0::DOUBLE)) END AS drp,
    CASE WHEN ta IS NULL OR tb IS NULL THEN 0.0::DOUBLE ELSE greatest(0, least(1, (tb - ta) / 12.0::DOUBLE)) END AS ris,
    coalesce(pq + 1, 0) AS ls, coalesce(nq, n_bars) - 1 AS le FROM pf),
runs3 AS (SELECT song_id, bar_idx FROM pf WHERE quiet AND q1 AND q2),
acc AS (
  SELECT x.song_id, x.bar_idx AS x, e.bar_idx AS e, x.intro_bar, x.drp, e.ris, x.gain + e.gain AS p_good,
    CASE WHEN x.le = x.ls THEN 1.0::DOUBLE ELSE (x.bar_idx - 1 - x.ls) / (x.le - x.ls)::DOUBLE END AS late, x.qb - e.qb AS quiets,
    x.start_sec AS x_sec, e.start_sec AS e_sec
  FROM prof x JOIN prof e ON e.song_id = x.song_id AND e.bar_idx < x.bar_idx
  WHERE x.bar_idx >= 2 AND NOT x.q1 AND NOT x.q2 AND e.bar_idx >= e.intro_bar AND NOT e.quiet AND NOT e.q_next
    AND NOT EXISTS (SELECT 1 FROM runs3 r WHERE r.song_id = x.song_id AND r.bar_idx BETWEEN e.bar_idx + 2 AND x.bar_idx - 1))
"""


def suggestions_sql(drop: float) -> str:
    score = "p_good + 0.3::DOUBLE * least(1.0::DOUBLE, (exit_sec - entry_sec) / 90.0::DOUBLE) + 0.1::DOUBLE * late - 0.1::DOUBLE * quiets + 0.25::DOUBLE * drp + 0.25::DOUBLE * ris + CASE WHEN prior = 'good' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""
WITH RECURSIVE {WRAP_VOTES_SQL.strip()}, {acceptable_sql(drop).strip()},
v AS (SELECT source_name AS song_id, exit_sec, entry_sec, rating, seq FROM latest_wraps),
grid0 AS (
  SELECT a.song_id, x, e, x_sec AS exit_sec, e_sec AS entry_sec, p_good, late, quiets, drp, ris,
    CASE WHEN bool_or(v.rating = 'bad') THEN 'bad' WHEN count(v.rating) > 0 THEN 'good' END AS prior
  FROM acc a LEFT JOIN v ON v.song_id = a.song_id AND abs(v.exit_sec - a.x_sec) <= 0.06::DOUBLE AND abs(v.entry_sec - a.e_sec) <= 0.06::DOUBLE
  WHERE x_sec - e_sec >= 60 AND x >= intro_bar + 2 GROUP BY ALL),
grid AS (SELECT * FROM grid0 WHERE prior IS NULL OR prior = 'good'),
off0 AS (
  SELECT g.song_id, g.exit_sec, g.entry_sec, g.seq, a.x, a.e, a.p_good, a.late, a.quiets, a.drp, a.ris FROM v g
  JOIN bars bx ON bx.song_id = g.song_id AND g.exit_sec + 0.06::DOUBLE >= bx.start_sec AND g.exit_sec < bx.end_sec - 0.06::DOUBLE
  JOIN bars be ON be.song_id = g.song_id AND g.entry_sec + 0.06::DOUBLE >= be.start_sec AND g.entry_sec < be.end_sec - 0.06::DOUBLE
  JOIN acc a ON a.song_id = g.song_id AND a.x = bx.bar_idx AND a.e = be.bar_idx
  WHERE g.rating = 'good' AND g.exit_sec - g.entry_sec >= 60
    AND NOT EXISTS (SELECT 1 FROM v b WHERE b.song_id = g.song_id AND b.rating = 'bad' AND abs(b.exit_sec - g.exit_sec) <= 0.06::DOUBLE AND abs(b.entry_sec - g.entry_sec) <= 0.06::DOUBLE)
    AND NOT EXISTS (SELECT 1 FROM grid s WHERE s.song_id = g.song_id AND abs(s.exit_sec - g.exit_sec) <= 0.06::DOUBLE AND abs(s.entry_sec - g.entry_sec) <= 0.06::DOUBLE)),
off1 AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY seq) AS rn FROM off0),
offr AS (
  SELECT song_id, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, e DOUBLE)[] AS kept, NULL::BIGINT AS seq, FALSE AS added FROM (SELECT DISTINCT song_id FROM off1)
  UNION ALL
  SELECT o.song_id, o.rn,
    CASE WHEN len(list_filter(r.kept, lambda k: abs(k.x - o.exit_sec) <= 0.06::DOUBLE AND abs(k.e - o.entry_sec) <= 0.06::DOUBLE)) > 0 THEN r.kept
      ELSE list_append(r.kept, {{'x': o.exit_sec, 'e': o.entry_sec}}) END,
    o.seq, len(list_filter(r.kept, lambda k: abs(k.x - o.exit_sec) <= 0.06::DOUBLE AND abs(k.e - o.entry_sec) <= 0.06::DOUBLE)) = 0
  FROM offr r JOIN off1 o ON o.song_id = r.song_id AND o.rn = r.rn + 1),
every AS (
  SELECT song_id, x, e, exit_sec, entry_sec, p_good, prior, -1::BIGINT AS seq, {score} AS score FROM grid
  UNION ALL
  SELECT song_id, x, e, exit_sec, entry_sec, p_good, prior, seq, {score} FROM (
    SELECT o.*, 'good' AS prior FROM off1 o JOIN offr r ON r.song_id = o.song_id AND r.seq = o.seq AND r.added)),
ord AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(score, 9) DESC, seq, x, e) AS rn FROM every),
pick AS (
  SELECT song_id, 0::BIGINT AS rn, []::STRUCT(e BIGINT, x BIGINT)[] AS acc, FALSE AS taken, 0::BIGINT AS rank FROM (SELECT DISTINCT song_id FROM ord)
  UNION ALL
  SELECT o.song_id, o.rn,
    CASE WHEN len(p.acc) < 8 AND len(list_filter(p.acc, lambda k: abs(k.e - o.e) < 2 AND abs(k.x - o.x) < 2)) = 0
      THEN list_append(p.acc, {{'e': o.e::BIGINT, 'x': o.x::BIGINT}}) ELSE p.acc END,
    len(p.acc) < 8 AND len(list_filter(p.acc, lambda k: abs(k.e - o.e) < 2 AND abs(k.x - o.x) < 2)) = 0,
    CAST(len(p.acc) + 1 AS BIGINT)
  FROM pick p JOIN ord o ON o.song_id = p.song_id AND o.rn = p.rn + 1 WHERE len(p.acc) < 8)
SELECT o.song_id, CAST(p.rank AS INT) AS rank, {q6('o.entry_sec')} AS start_sec, {q6('o.exit_sec')} AS end_sec, {q9('o.p_good')} AS p_good,
  {q9('o.score')} AS score, o.prior
FROM pick p JOIN ord o ON o.song_id = p.song_id AND o.rn = p.rn WHERE p.taken
"""


def _suggestions(spark, d, drop):
    return show_suggestions(S.rank_suggestions(classified(spark, d, drop), current_votes(spark, d)))


def show_suggestions(out):
    return out.withColumns({c: r9(F.col(c)) for c in ("start_sec", "end_sec", "p_good", "score")})


@query("wrap_suggestions", suggestions_sql(9.0))
def wrap_suggestions(spark, d):
    return _suggestions(spark, d, 9.0)


@query("wrap_suggestions_15db", suggestions_sql(15.0))
def wrap_suggestions_15db(spark, d):
    return _suggestions(spark, d, 15.0)


@query(
    "wrap_acceptable_pairs",
    with_ctes(
        acceptable_sql(15.0),
        select="""
        SELECT song_id, count(*) AS pairs, count(DISTINCT x) AS exits FROM acc
        WHERE x_sec - e_sec >= 60 AND x >= intro_bar + 2 GROUP BY 1""",
    ),
)
def wrap_acceptable_pairs(spark, d):
    return S.acceptable_pair_counts(classified(spark, d, 15.0))
