"""Render rules, names, manifests, song records and asset freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import VOTES_SQL, Registry, q6, r6, read, votes, with_ctes
from queries.votes import KEY
from refrain.functions import render as X
from refrain.operators import timeline as T
from refrain.operators import votes as V
from refrain.sources import catalog as C
from refrain.sources import exports as E

query = Registry()


@query(
    "render_rules",
    f"""
    WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 100.0::DOUBLE AS x, (event_id % 7) * 0.1::DOUBLE AS fade, 80.0::DOUBLE + event_id % 90 AS bpm,
        value / 5.0::DOUBLE AS s, value / 5.0::DOUBLE + 1.0::DOUBLE + event_id % 50 AS e, ['click','half-beat','beat','bar','second'][CAST(event_id % 5 + 1 AS INT)] AS choice, 1500000 AS n FROM events),
    c AS (SELECT *, greatest(0, CAST(floor(s * 8000.0::DOUBLE + 0.5) AS BIGINT)) AS a, least(n, CAST(floor(e * 8000.0::DOUBLE + 0.5) AS BIGINT)) AS b FROM e)
    SELECT event_id, {q6('CASE WHEN fade >= 0.3 THEN sin(x * pi() / 2) ELSE x END')} AS gain_in, {q6('CASE WHEN fade >= 0.3 THEN sin((1 - x) * pi() / 2) ELSE 1 - x END')} AS gain_out,
      {q6("CASE choice WHEN 'click' THEN 0.035 WHEN 'half-beat' THEN 60.0::DOUBLE / bpm / 2 WHEN 'beat' THEN 60.0::DOUBLE / bpm WHEN 'bar' THEN 60.0::DOUBLE / bpm * 4 ELSE 1.0 END")} AS blend,
      {q6('greatest(0, least(fade * 5, e - s, 2 * s, 2 * (200.0::DOUBLE - e)))')} AS clamped,
      {q6('CASE WHEN 150 < e THEN 150 ELSE s + (150.0::DOUBLE - e) % (e - s) END')} AS heard,
      {q6('greatest(0, least(CAST(floor(fade * 8000.0::DOUBLE + 0.5) AS BIGINT), CASE WHEN n - b >= 40 THEN n - b ELSE 40 END, (b - a) // 4)) / 8000.0::DOUBLE')} AS crossfade
    FROM c
    """,
)
def render_rules(spark, d):
    e = read(spark, d, "events")
    x = F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0
    fade = (F.col("event_id") % 7) * 0.1
    bpm = F.lit(80.0) + F.col("event_id") % 90
    s = F.col("value") / 5.0
    end = F.col("value") / 5.0 + 1.0 + F.col("event_id") % 50
    choice = F.element_at(F.array(*[F.lit(c) for c in ("click", "half-beat", "beat", "bar", "second")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        "event_id",
        r6(X.fade_gain(x, fade, True)).alias("gain_in"),
        r6(X.fade_gain(x, fade, False)).alias("gain_out"),
        r6(X.blend_sec(choice, bpm)).alias("blend"),
        r6(X.clamp_fade(fade * 5, s, end, F.lit(200.0))).alias("clamped"),
        r6(X.source_time_at(s, end, F.lit(150.0))).alias("heard"),
        r6(X.loop_crossfade_sec(fade, s, end, F.lit(1500000), F.lit(8000.0))).alias("crossfade"),
    )


@query(
    "render_split_parts",
    f"""
    WITH e AS (SELECT event_id, 60.0::DOUBLE AS dur, least(greatest(0, value - 10.0::DOUBLE), 60.0::DOUBLE) AS s, value + 20.0::DOUBLE AS e0 FROM events),
    c AS (SELECT *, least(greatest(s, e0), dur) AS e FROM e)
    SELECT event_id, 'lead-in' AS part, 0.0::DOUBLE AS part_from, {q6('s')} AS part_to FROM c WHERE s >= 1e-3
    UNION ALL SELECT event_id, 'loop', {q6('s')}, {q6('e')} FROM c WHERE e - s >= 1e-3
    UNION ALL SELECT event_id, 'lead-out', {q6('e')}, {q6('dur')} FROM c WHERE dur - e >= 1e-3
    """,
)
def render_split_parts(spark, d):
    e = read(spark, d, "events")
    dur = F.lit(60.0)
    s = F.least(F.greatest(F.lit(0.0), F.col("value") - 10.0), dur)
    end = F.least(F.greatest(s, F.col("value") + 20.0), dur)
    rows = e.select("event_id", F.explode(T.song_parts(F.lit(0.0), dur, s, end, F.lit("loop"))).alias("p"))
    return rows.select("event_id", "p.part", r6(F.col("p.part_from")).alias("part_from"), r6(F.col("p.part_to")).alias("part_to"))


@query(
    "render_names",
    """
    WITH n AS (SELECT p_partkey AS id, p_name || '__' || p_type || ' (' || p_size || ')-' || p_brand || '.final.mp3' AS name FROM part
      UNION ALL SELECT -1 - page_id, url FROM pages),
    b AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS base FROM n),
    t AS (SELECT *, trim(regexp_replace(regexp_replace(base, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS txt,
      regexp_replace(regexp_replace(lower(base), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      regexp_replace(regexp_replace(base, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_|_$', '', 'g') AS stem FROM b)
    SELECT id, CASE WHEN slug = '' THEN 'song' ELSE slug END AS song_id, CASE WHEN stem = '' THEN 'loop' ELSE stem END AS stem,
      array_to_string(list_transform(range(1, length(txt) + 1), lambda i: CASE WHEN regexp_matches(txt[i], '[A-Za-z0-9_]') AND (i = 1 OR NOT regexp_matches(txt[i - 1], '[A-Za-z0-9_]')) THEN upper(txt[i]) ELSE txt[i] END), '') AS title,
      regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') AS is_id
    FROM t
    """,
)
def render_names(spark, d):
    p = read(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("__"), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")-"), "p_brand", F.lit(".final.mp3")).alias("name"))
    n = a.unionByName(read(spark, d, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("name")))
    name = F.col("name")
    return n.select(
        "id", X.song_id_from_name(name).alias("song_id"), X.safe_stem(name).alias("stem"), X.title_from_name(name).alias("title"), X.is_song_id(name).alias("is_id")
    )


_REQ = """
req AS (SELECT o_orderkey AS k, 'o' || o_orderkey || '.mp3' AS source_name, CASE WHEN o_orderkey % 13 = 0 THEN 'Bad Id' ELSE 'song-' || o_orderkey END AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS title, 70.0::DOUBLE + o_custkey / 7.0::DOUBLE AS bpm, (o_custkey % 90) / 7.0::DOUBLE - 0.3::DOUBLE AS s,
  20.0::DOUBLE + o_totalprice / 6000.0::DOUBLE AS e, 0.035::DOUBLE AS fade, -30.0::DOUBLE + o_custkey % 20 + o_orderkey / 7919.0::DOUBLE AS lufs, -12.0::DOUBLE + o_orderkey % 12 AS peak,
  (o_orderkey % 4) * 0.0003::DOUBLE AS off, (o_orderkey % 9) * 0.0002::DOUBLE AS spread FROM orders),
rg AS (SELECT *, least(-14.0::DOUBLE - lufs, -1.0::DOUBLE - peak) AS gain, CASE WHEN off >= 0.0005 THEN off ELSE 0.0::DOUBLE END AS shift FROM req)
"""


def requests(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("o"), k.cast("string"), F.lit(".mp3")).alias("source_name"),
        F.when(k % 13 == 0, "Bad Id").otherwise(F.concat(F.lit("song-"), k.cast("string"))).alias("id"),
        F.when(k % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("title"),
        (70.0 + F.col("o_custkey") / 7.0).alias("bpm"),
        ((F.col("o_custkey") % 90) / 7.0 - 0.3).alias("start_sec"),
        (20.0 + F.col("o_totalprice") / 6000.0).alias("end_sec"),
        F.lit(0.035).alias("fade_sec"),
        (-30.0 + F.col("o_custkey") % 20 + k / 7919.0).alias("lufs"),
        (-12.0 + k % 12).alias("true_peak_db"),
        ((k % 4) * 0.0003).alias("offset_sec"),
        ((k % 9) * 0.0002).alias("spread_sec"),
        F.lit(90.25).alias("duration_sec"),
        F.lit(4332000).alias("base_frames"),
        F.lit(4332000).alias("top_frames"),
        F.lit(4332000).alias("encoded_base"),
        F.when(k % 17 == 0, 4331999).otherwise(4332000).alias("encoded_top"),
        F.lit(48000).alias("rate"),
    )


@query(
    "export_problems",
    with_ctes(
        _REQ,
        select="""
        SELECT source_name, 'bad-id' AS rule FROM req WHERE k % 13 = 0
        UNION ALL SELECT source_name, 'loop-outside' FROM req WHERE s < 0 OR e <= s OR (e + fade / 2) * 48000 > 4332000
        UNION ALL SELECT source_name, 'length-mismatch' FROM req WHERE k % 17 = 0
        UNION ALL SELECT source_name, 'drifting' FROM req WHERE spread > 0.001""",
    ),
)
def export_problems(spark, d):
    return E.export_problems(requests(spark, d))


@query(
    "export_song_records",
    with_ctes(
        _REQ,
        select="""
        SELECT source_name, id, CASE WHEN trim(title) = '' THEN id ELSE trim(title) END AS title, floor(bpm * 1000 + 0.5) / 1000 AS bpm, floor((s + shift) * 1000 + 0.5) / 1000 AS start_sec,
          floor((e + shift) * 1000 + 0.5) / 1000 AS end_sec, floor((lufs + gain) * 10 + 0.5) / 10 AS lufs, floor(gain * 100 + 0.5) / 100 AS gain_db,
          lufs + gain < -14.5 AS limited, shift <> 0 AS moved FROM rg""",
    ),
)
def export_song_records(spark, d):
    r = E.song_records(requests(spark, d))
    at = lambda path: F.get_json_object("json", path)
    num = lambda path: at(path).cast("double")
    return r.select(
        "source_name", "id", at("$.title").alias("title"), num("$.bpm").alias("bpm"), num("$.loop.startSec").alias("start_sec"), num("$.loop.endSec").alias("end_sec"),
        num("$.loudness.integratedLufs").alias("lufs"), num("$.loudness.gainDb").alias("gain_db"),
        F.array_contains("notes", "limited-loudness").alias("limited"), F.array_contains("notes", "moved-loop-points").alias("moved"),
    )


_MANIFEST = f"""
tg AS (SELECT * FROM (SELECT {KEY}, tags, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE tags IS NOT NULL) WHERE rn = 1),
nt AS (SELECT * FROM (SELECT {KEY}, note, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE note IS NOT NULL) WHERE rn = 1),
cand AS (SELECT k.source_name, k.seq, k.bars, k.start_sec, k.end_sec, 120.0::DOUBLE + CASE WHEN k.bars = 16 THEN 0.5 ELSE 0 END AS bpm, k.quality_score AS q, t.tags, n.note,
    CASE WHEN k.seq % 10 = 0 THEN 0.5::DOUBLE ELSE 0.035::DOUBLE END AS fade, k.rating = 'good' AS normalize
  FROM keyed k LEFT JOIN tg t USING (source_name, bars, start_units, end_units) LEFT JOIN nt n USING (source_name, bars, start_units, end_units) WHERE k.rating IN ('good', 'bad')),
mf AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY seq) AS nn, least(8000, greatest(1, 800000)) AS z FROM cand)
"""


def manifest(spark, d):
    v = V.with_cut_key(votes(spark, d))
    cands = (
        v.filter(F.col("rating").isin("good", "bad"))
        .select(
            *V.CUT, F.col("seq").alias("loop_order"), "start_sec", "end_sec", "seam_score", "context_score", "homogeneity_score", "quality_score", "closure_score",
            F.col("analysis_version").alias("score_version"), (F.lit(120.0) + F.when(F.col("bars") == 16, 0.5).otherwise(0.0)).alias("bpm"),
            F.when(F.col("seq") % 10 == 0, 0.5).otherwise(0.035).alias("fade_sec"), (F.col("rating") == "good").alias("normalize"),
        )
        .join(V.latest_tags(v), V.CUT, "left")
        .join(V.latest_notes(v), V.CUT, "left")
    )
    sources = v.select("source_name").distinct().select("source_name", F.lit(120.0).alias("session_bpm"), F.lit(800000).alias("n_samples"), F.lit(8000).alias("sample_rate"))
    return E.loop_manifest(cands, sources)


@query(
    "export_manifest_rows",
    with_ctes(
        VOTES_SQL,
        _MANIFEST,
        select=f"""
        SELECT source_name, seq AS loop_order, source_name || '_loop_' || CASE WHEN nn < 10 THEN '0' || nn ELSE '' || nn END || '_' || bars || 'bar_' || CAST(floor(bpm + 0.5) AS BIGINT) || 'bpm'
          || CASE WHEN len(tags) > 0 THEN '_' || array_to_string(tags, '-') ELSE '' END || '.wav' AS file, note, CAST((end_sec - start_sec) * 8000 AS BIGINT) AS sample_count,
          floor(q * 1000 + 0.5) / 1000 AS quality_score, {q6('fade')} AS wrap_crossfade_sec, normalize FROM mf""",
    ),
)
def export_manifest_rows(spark, d):
    rows, _ = manifest(spark, d)
    return rows.select(
        "source_name", "loop_order", "file", "note", "sample_count", "quality_score", r6(F.col("wrap_crossfade_sec")).alias("wrap_crossfade_sec"), "normalize"
    )


@query(
    "export_manifest_headers",
    with_ctes(
        VOTES_SQL,
        _MANIFEST,
        select="""
        SELECT source_name, count(*) AS loops, CASE WHEN max(abs(bpm - 120)) < 1e-6 THEN 120.0::DOUBLE END AS bpm, CASE WHEN min(fade) = max(fade) THEN min(fade) END AS wrap_crossfade_sec,
          CASE WHEN bool_and(normalize) OR NOT bool_or(normalize) THEN bool_or(normalize) END AS normalize FROM mf GROUP BY 1""",
    ),
)
def export_manifest_headers(spark, d):
    _, headers = manifest(spark, d)
    return headers.select("source_name", "loops", "bpm", "wrap_crossfade_sec", "normalize")


@query(
    "render_options",
    with_ctes(
        VOTES_SQL,
        f"ov AS (SELECT {KEY}, arg_max(wrap_crossfade_sec, seq) AS fade, coalesce(arg_max(normalize, seq) FILTER (normalize IS NOT NULL), FALSE) AS norm FROM keyed WHERE wrap_crossfade_sec IS NOT NULL GROUP BY ALL)",
        select=f"""
        SELECT k.seq, {q6("coalesce(o.fade, CASE WHEN k.seq % 2 = 0 THEN 0.25::DOUBLE END, 0.035::DOUBLE)")} AS fade_sec,
          CASE WHEN o.fade IS NOT NULL THEN o.norm WHEN k.seq % 2 = 0 THEN TRUE ELSE FALSE END AS normalize
        FROM keyed k LEFT JOIN ov o USING (source_name, bars, start_units, end_units)""",
    ),
)
def render_options(spark, d):
    v = V.with_cut_key(votes(spark, d))
    over = v.filter("wrap_crossfade_sec IS NOT NULL").groupBy(*V.CUT).agg(
        F.max_by("wrap_crossfade_sec", "seq").alias("fade_sec"),
        F.coalesce(F.max_by("normalize", F.when(F.col("normalize").isNotNull(), F.col("seq"))), F.lit(False)).alias("normalize"),
    )
    even = F.col("seq") % 2 == 0
    c = v.select("seq", *V.CUT, F.when(even, 0.25).alias("saved_fade_sec"), F.when(even, True).alias("saved_normalize"))
    out = E.resolve_render(c, over, V.CUT)
    return out.select("seq", r6(F.col("fade_sec")).alias("fade_sec"), "normalize")


@query(
    "render_bake_crossfade",
    f"""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:40], lambda x: x::DOUBLE) AS h, list_transform(embedding[41:48], lambda x: x::DOUBLE) AS c, embedding[40]::DOUBLE AS l, vec_id % 12 AS f FROM embeddings),
    u AS (SELECT *, least(f, 10) AS n FROM e)
    SELECT vec_id, {q6('''list_sum(list_transform(h, lambda s, i: i * CASE WHEN n >= 2 AND i <= n THEN (CASE WHEN n <= 8 THEN c[i] ELSE l END) * (1 - (0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * (i - 1) / (n - 1))))
      + s * (0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * (i - 1) / (n - 1))) ELSE s END))''')} AS weighted FROM u
    """,
)
def render_bake_crossfade(spark, d):
    e = read(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    baked = X.bake_crossfade(F.slice(v, 1, 40), F.slice(v, 41, 8), F.element_at(v, 40), (F.col("vec_id") % 12).cast("int"))
    total = F.aggregate(F.transform(baked, lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, s: a + s)
    return e.select("vec_id", r6(total).alias("weighted"))


_ASSETS = """
src AS (SELECT 'o' || o_orderkey AS base_name, o_orderdate AS modified FROM orders WHERE o_orderstatus <> 'P'),
ast AS (SELECT 'o' || l_orderkey AS base_name, CASE l_linenumber WHEN 1 THEN 'base' WHEN 2 THEN 'top' ELSE 'drums' END AS kind, l_shipdate AS modified FROM lineitem),
lay AS (SELECT base_name, count(*) FILTER (kind = 'base') AS b, count(*) FILTER (kind = 'top') AS t, min(modified) AS oldest FROM ast WHERE kind IN ('base', 'top') GROUP BY 1),
st AS (SELECT coalesce(s.base_name, l.base_name) AS base_name, coalesce(b > 0 AND t > 0 AND (s.modified IS NULL OR oldest >= s.modified), FALSE) AS ready
  FROM src s FULL OUTER JOIN lay l ON l.base_name = s.base_name)
"""


def _assets(spark, d):
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("base_name")
    src = read(spark, d, "orders").filter(F.col("o_orderstatus") != "P").select(name("o_orderkey"), F.col("o_orderdate").alias("modified"))
    kind = F.when(F.col("l_linenumber") == 1, "base").when(F.col("l_linenumber") == 2, "top").otherwise("drums")
    ast = read(spark, d, "lineitem").select(name("l_orderkey"), kind.alias("kind"), F.col("l_quantity").cast("bigint").alias("length"), F.col("l_shipdate").alias("modified"))
    return src, ast


@query("catalog_asset_status", with_ctes(_ASSETS, select="SELECT base_name, ready FROM st"))
def catalog_asset_status(spark, d):
    return C.asset_status(*_assets(spark, d)).select("base_name", "ready")


@query("catalog_stale_assets", with_ctes(_ASSETS, select="SELECT base_name, modified FROM src WHERE base_name NOT IN (SELECT base_name FROM st WHERE ready)"))
def catalog_stale_assets(spark, d):
    return C.stale_assets(*_assets(spark, d)).select("base_name", "modified")


@query(
    "catalog_audio_files",
    """
    WITH f AS (SELECT url || CASE page_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.WAV' WHEN 2 THEN '.txt' ELSE '.flac' END AS path, page_id AS length FROM pages)
    SELECT path, string_split(path, '/')[-1] AS name, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS base_name, length FROM f WHERE lower(path) SIMILAR TO '.*\\.(mp3|wav|flac|ogg|m4a|aac)'
    """,
)
def catalog_audio_files(spark, d):
    p = read(spark, d, "pages")
    k = F.col("page_id") % 4
    ext = F.when(k == 0, ".mp3").when(k == 1, ".WAV").when(k == 2, ".txt").otherwise(".flac")
    files = p.select(F.concat("url", ext).alias("path"), F.col("page_id").alias("length"), F.current_timestamp().alias("modified"))
    return C.select_audio(files).drop("modified")
