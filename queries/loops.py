"""Frames, beats, loop windows and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import (
    FRAMES_SQL,
    VOTES_SQL,
    Registry,
    cosine_sql,
    frames as raw_frames,
    q6,
    r6,
    read,
    vibe_sql,
    votes,
    with_ctes,
)
from queries.evaluation import detected
from queries.votes import KEY
from refrain.functions import scoring as Q
from refrain.functions import vectors as X
from refrain.operators import candidates as K
from refrain.operators import jumps as J
from refrain.operators import rhythm as R
from refrain.operators import spans as P
from refrain.operators import votes as V
from refrain.operators.ordered import asof, top_per_key  # noqa: F401
from refrain.operators.settle import settle

query = Registry()
HOP = 0.5


def frames(spark, d):
    return settle(raw_frames(spark, d))


def songs(f):
    return P.frame_counts(f).withColumns({"hop_sec": F.lit(HOP), "duration_sec": F.col("n_frames") * HOP, "downbeat": F.lit(1)})


BEATS = "beats AS (SELECT song_id, CAST(hop_idx AS INT) AS beat_idx, t_sec FROM frames), nf AS (SELECT song_id, max(hop_idx) + 1 AS n_frames FROM frames GROUP BY 1)"


def beats(f):
    return f.select("song_id", F.col("hop_idx").cast("int").alias("beat_idx"), "t_sec")


def mean_sql(name: str, spans: str) -> str:
    """Mean frames of ``spans`` (song_id, sid, i0, i1) by joining every frame inside."""
    mean = lambda v, n: "[" + ", ".join(f"avg({v}[{i + 1}])" for i in range(n)) + "]"
    norm = lambda v: f"list_transform({v}, lambda x: x / coalesce(nullif(sqrt(list_dot_product({v}, {v})), 0), 1))"
    return f"""
{name}_m AS (SELECT s.song_id, s.sid, {mean('f.chroma', 12)} AS c0, {mean('f.timbre', 8)} AS t0, {mean('f.spec', 24)} AS spec,
    avg(f.rms) AS rms, avg(f.centroid) AS centroid, avg(f.flux) AS flux
  FROM {spans} s JOIN frames f ON f.song_id = s.song_id AND f.hop_idx >= s.i0 AND f.hop_idx < s.i1 GROUP BY 1, 2),
{name} AS (SELECT song_id, sid, {norm('c0')} AS chroma, {norm('t0')} AS timbre, spec, rms, centroid, flux FROM {name}_m)
"""


@query(
    "frame_similarity",
    with_ctes(
        FRAMES_SQL,
        select=f"""
        SELECT a.song_id, a.hop_idx, {q6(vibe_sql('a', 'b'))} AS vibe,
          {q6('(1.0::DOUBLE - ' + cosine_sql('a.spec', 'b.spec') + ') + 0.75::DOUBLE * least(1.0::DOUBLE, abs(ln(a.rms + 1e-6) - ln(b.rms + 1e-6)) / ln(8.0::DOUBLE))')} AS distance
        FROM frames a JOIN frames b ON b.song_id = a.song_id AND b.hop_idx = a.hop_idx + 1""",
    ),
)
def frame_similarity(spark, d):
    f = frames(spark, d)
    pairs = f.select("song_id", "hop_idx", F.array(F.struct(F.col("hop_idx").alias("a"), (F.col("hop_idx") + 1).alias("b"))).alias("o"))
    value = lambda a, b: F.struct(X.frame_vibe_sim(a, b).alias("v"), X.spec_distance(a["spec"], b["spec"], a["rms"], b["rms"]).alias("d"))
    out = P.compare_aligned(f, pairs, ["song_id", "hop_idx"], F.col("o"), value)
    return out.select("song_id", "hop_idx", r6(F.col("value.v")).alias("vibe"), r6(F.col("value.d")).alias("distance"))


_SPANS = "sp AS (SELECT b.song_id, beat_idx AS sid, b.beat_idx AS i0, least(n_frames, b.beat_idx + 2 + beat_idx % 9) AS i1 FROM beats b JOIN nf ON nf.song_id = b.song_id)"


@query(
    "frame_span_means",
    with_ctes(
        FRAMES_SQL, BEATS, _SPANS, mean_sql("m", "sp"),
        select=f"SELECT song_id, sid, {q6('rms')} AS rms, {q6('centroid')} AS centroid, {q6('chroma[3]')} AS chroma_3, {q6('timbre[8]')} AS timbre_8, {q6('spec[24]')} AS spec_24 FROM m",
    ),
)
def frame_span_means(spark, d):
    f = frames(spark, d)
    s = beats(f).join(P.frame_counts(f), "song_id").select(
        "song_id", F.col("beat_idx").alias("sid"), F.col("beat_idx").cast("bigint").alias("i0"),
        F.least("n_frames", F.col("beat_idx") + 2 + F.col("beat_idx") % 9).alias("i1"),
    )
    m = P.span_means(P.frame_prefix(f), s)
    at = lambda v, i: r6(F.element_at(f"mean.{v}", i)).alias(f"{v}_{i}")
    return m.select("song_id", "sid", r6(F.col("mean.rms")).alias("rms"), r6(F.col("mean.centroid")).alias("centroid"), at("chroma", 3), at("timbre", 8), at("spec", 24))


_DOWN = """
bn AS (SELECT b.song_id, b.beat_idx AS sid, b.beat_idx AS i0, b.beat_idx + 1 AS i1, n_frames FROM beats b JOIN nf ON nf.song_id = b.song_id),
ch AS (SELECT f.song_id, f.hop_idx AS k, 1.0::DOUBLE - list_dot_product(f.chroma, p.chroma) AS change,
    CASE WHEN n.song_id IS NULL THEN 0 ELSE f.flux END AS onset FROM frames f
  LEFT JOIN frames p ON p.song_id = f.song_id AND p.hop_idx = f.hop_idx - 1 LEFT JOIN frames n ON n.song_id = f.song_id AND n.hop_idx = f.hop_idx + 1),
oa AS (SELECT song_id, coalesce(nullif(avg(change), 0), 1) AS ca, coalesce(nullif(avg(onset), 0), 1) AS fa FROM ch GROUP BY 1),
ph AS (SELECT c.song_id, c.k % 4 AS phase, avg(change) / max(ca) + 0.5::DOUBLE * avg(onset) / max(fa) AS score FROM ch c JOIN oa ON oa.song_id = c.song_id WHERE k >= 1 GROUP BY 1, 2),
al AS (SELECT s.song_id, p.phase, coalesce(h.score, 0) AS score FROM (SELECT DISTINCT song_id FROM frames) s CROSS JOIN (VALUES (0), (1), (2), (3)) p(phase)
  LEFT JOIN ph h ON h.song_id = s.song_id AND h.phase = p.phase),
rk AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, phase) AS rn, lead(score) OVER (PARTITION BY song_id ORDER BY score DESC, phase) AS nxt FROM al)
"""


@query(
    "rhythm_downbeat",
    with_ctes(
        FRAMES_SQL, BEATS, _DOWN,
        select=f"SELECT song_id, CAST(phase AS INT) AS downbeat, {q6('CASE WHEN score > 0 THEN greatest(0, least(1, (score - nxt) / score * 4.0::DOUBLE)) ELSE 0 END')} AS confidence FROM rk WHERE rn = 1",
    ),
)
def rhythm_downbeat(spark, d):
    f = frames(spark, d)
    out = R.downbeat(f, settle(P.frame_prefix(f)), beats(f), songs(f))
    return out.withColumn("confidence", r6(F.col("confidence")))


@query(
    "rhythm_bars",
    with_ctes(
        FRAMES_SQL, BEATS,
        "sp AS (SELECT b.song_id, b.beat_idx AS sid, b.beat_idx AS i0, b.beat_idx + 4 AS i1 FROM beats b JOIN nf ON nf.song_id = b.song_id WHERE beat_idx % 4 = 1 AND beat_idx + 4 < n_frames)",
        mean_sql("m", "sp"),
        select=f"""SELECT song_id, CAST((sid - 1) // 4 AS INT) AS bar_idx, CAST(sid AS INT) AS start_beat, {q6('20.0::DOUBLE * log10(rms + 1e-9::DOUBLE)')} AS loudness_db,
          {q6('centroid')} AS brightness, {q6('flux')} AS density, {q6('chroma[1]')} AS chroma_1 FROM m""",
    ),
)
def rhythm_bars(spark, d):
    f = frames(spark, d)
    s = songs(f)
    bars = R.song_bars(beats(f), s)
    out = R.bar_features(P.frame_prefix(f), bars, s)
    return out.select(
        "song_id", "bar_idx", "start_beat", *[r6(F.col(c)).alias(c) for c in ("loudness_db", "brightness", "density")],
        r6(F.element_at("chroma", 1)).alias("chroma_1"),
    )


@query(
    "rhythm_lag_stripe",
    with_ctes(
        FRAMES_SQL, BEATS,
        f"""
        st AS (SELECT b.song_id, beat_idx AS start, [4, 8, 16][beat_idx % 3 + 1] AS lag, n_frames AS n FROM beats b JOIN nf ON nf.song_id = b.song_id),
        pr AS (SELECT s.song_id, s.start, s.lag, {vibe_sql('a', 'b')} AS v FROM st s JOIN frames a ON a.song_id = s.song_id JOIN frames b ON b.song_id = s.song_id
          WHERE (s.start + s.lag * 2 <= s.n AND a.hop_idx >= s.start AND a.hop_idx < s.start + s.lag AND b.hop_idx = a.hop_idx + s.lag)
             OR (s.start + s.lag * 2 > s.n AND s.start + s.lag <= s.n AND a.hop_idx = s.start + s.lag - 1 AND b.hop_idx = s.start))
        """,
        select=f"SELECT st.song_id, st.start, st.lag, {q6('coalesce(avg(v), 0)')} AS stripe FROM st LEFT JOIN pr USING (song_id, start, lag) GROUP BY 1, 2, 3",
    ),
)
def rhythm_lag_stripe(spark, d):
    f = frames(spark, d)
    lag = F.element_at(F.array(F.lit(4), F.lit(8), F.lit(16)), F.col("beat_idx") % 3 + 1)
    starts = beats(f).select("song_id", F.col("beat_idx").alias("start"), lag.alias("lag"))
    return R.lag_stripe(f, starts).withColumn("stripe", r6(F.col("stripe")))


_GRID = "gr AS (SELECT l_orderkey AS song_id, l_linenumber * 2.5::DOUBLE AS t_sec, min(l_linenumber) AS g FROM lineitem GROUP BY 1, 2), gi AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t_sec) - 1 AS grid_idx FROM gr)"


@query(
    "rhythm_snap_and_step",
    with_ctes(
        _GRID,
        """
        pt AS (SELECT o_orderkey AS song_id, (o_custkey % 200) / 10.0::DOUBLE AS sec FROM orders),
        nr AS (SELECT p.song_id, p.sec, g.t_sec, g.grid_idx, row_number() OVER (PARTITION BY p.song_id ORDER BY abs(g.t_sec - p.sec), g.grid_idx) AS rn,
            max(g.grid_idx) OVER (PARTITION BY p.song_id) AS last FROM pt p LEFT JOIN gi g ON g.song_id = p.song_id)
        """,
        select=f"""SELECT n.song_id, {q6('n.sec')} AS sec, {q6('coalesce(n.t_sec, n.sec)')} AS snapped, {q6('coalesce(t.t_sec, n.sec)')} AS stepped
        FROM nr n LEFT JOIN gi t ON t.song_id = n.song_id AND t.grid_idx = greatest(0, least(n.last, n.grid_idx + 2)) WHERE n.rn = 1""",
    ),
)
def rhythm_snap_and_step(spark, d):
    from refrain.operators.ordered import block_of, dense_index

    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("song_id"), "l_linenumber").distinct()
    grid = dense_index(li, ["song_id"], block_of(F.col("l_linenumber")), ["l_linenumber"], "grid_idx").select(
        "song_id", "grid_idx", (F.col("l_linenumber") * 2.5).alias("t_sec")
    )
    grid = settle(grid)
    pts = read(spark, d, "orders").select(F.col("o_orderkey").alias("song_id"), ((F.col("o_custkey") % 200) / 10.0).alias("sec"))
    out = R.step_on_grid(pts, grid, "sec", F.lit(2))
    return out.select("song_id", *[r6(F.col(c)).alias(c) for c in ("sec", "snapped", "stepped")])


@query(
    "rhythm_loop_edits",
    f"""
    WITH RECURSIVE b AS (SELECT event_id, value + 5.0::DOUBLE AS s, value + 7.0::DOUBLE + event_id % 30 AS e, 60.0::DOUBLE / (70.0::DOUBLE + event_id % 110) AS beat, value / 4.0::DOUBLE + 0.5::DOUBLE AS bpm FROM events),
    nb AS (SELECT event_id, arg_min(bars, (abs(bars * 4.0::DOUBLE * beat - (e - s)), bars)) AS bars FROM b CROSS JOIN (VALUES (1), (2), (4), (8), (16)) v(bars) GROUP BY 1),
    fb AS (SELECT event_id, bpm AS f FROM b UNION ALL SELECT event_id, CASE WHEN f < 70 THEN f * 2 ELSE f / 2 END FROM fb WHERE f < 70 OR f > 180),
    r AS (SELECT b.*, nb.bars, [1,2,4,6,8,12,16] AS lens, (SELECT greatest(70, least(180, f)) FROM fb WHERE fb.event_id = b.event_id AND f >= 70 AND f <= 180) AS folded FROM b JOIN nb ON nb.event_id = b.event_id),
    q AS (SELECT *, 2.0::DOUBLE + floor((s - 2.0::DOUBLE) / beat + 0.5) * beat AS snap, lens[list_position(lens, bars) + 1] AS longer FROM r),
    w AS (SELECT *, greatest(1.0::DOUBLE, least(e - 0.25::DOUBLE, snap)) AS fs FROM q)
    SELECT event_id, bars AS nearest_bars, {q6('folded')} AS folded,
      CASE WHEN fs + bars * 4.0::DOUBLE * beat <= 400 AND fs + bars * 4.0::DOUBLE * beat - fs >= 0.25 THEN {q6('fs')} END AS fit_start,
      CASE WHEN s + 4 * beat >= 1 AND e + 4 * beat <= 400 THEN {q6('e + 4 * beat')} END AS shift_end,
      CASE WHEN longer IS NOT NULL AND s + longer * 4.0::DOUBLE * beat <= 400 AND s >= 1 THEN {q6('s + longer * 4.0::DOUBLE * beat')} END AS longer_end
    FROM w
    """,
)
def rhythm_loop_edits(spark, d):
    e = read(spark, d, "events").select(
        "event_id",
        (F.col("value") + 5.0).alias("s"),
        (F.col("value") + 7.0 + F.col("event_id") % 30).alias("e"),
        (60.0 / (70.0 + F.col("event_id") % 110)).alias("beat"),
        (F.col("value") / 4.0 + 0.5).alias("bpm"),
    )
    s, end, beat, lo, hi = F.col("s"), F.col("e"), F.col("beat"), F.lit(1.0), F.lit(400.0)
    return e.select(
        "event_id",
        R.nearest_bar_length(end - s, beat).alias("nearest_bars"),
        r6(R.fold_bpm(F.col("bpm"))).alias("folded"),
        r6(R.fit_to_bars(s, end, F.lit(2.0), beat, lo, hi)["start_sec"]).alias("fit_start"),
        r6(R.shift_beats(s, end, F.lit(4), beat, lo, hi)["end_sec"]).alias("shift_end"),
        r6(R.resize_loop(s, end, "end", 1, beat, lo, hi)["end_sec"]).alias("longer_end"),
    )


# ---------------------------------------------------------------- windows and scores
_WINDOWS = """
win AS (
  SELECT b.song_id, v.bars, b.beat_idx AS start_beat, b.beat_idx + v.bars * 4 AS end_beat, b.t_sec AS start_sec, e.t_sec AS end_sec, n_frames,
    b.song_id || ':' || v.bars || ':' || b.beat_idx AS sid
  FROM beats b CROSS JOIN (VALUES (1), (2), (4), (8), (16)) v(bars) JOIN beats e ON e.song_id = b.song_id AND e.beat_idx = b.beat_idx + v.bars * 4
  JOIN nf ON nf.song_id = b.song_id
  WHERE e.t_sec - b.t_sec >= 1 AND v.bars * 4 < n_frames - 1 AND (v.bars < 4 OR (b.beat_idx >= 1 AND (b.beat_idx - 1) % 4 = 0)))
"""
_KEYS = ["song_id", "bars", "start_beat"]


def windows(f, s):
    w = K.generate_windows(beats(f), s)
    return w.join(s.select("song_id", "n_frames", "hop_sec"), "song_id").withColumns(
        {
            "window_sec": Q.effective_window(F.col("end_sec") - F.col("start_sec"), F.lit(3.0)),
            "bar_sec": (F.col("end_sec") - F.col("start_sec")) / F.col("bars"),
            "window_beats": F.lit(6),
        }
    )


@query("loop_windows", with_ctes(FRAMES_SQL, BEATS, _WINDOWS, select="SELECT song_id, bars, start_beat, end_beat, start_sec, end_sec FROM win"))
def loop_windows(spark, d):
    f = frames(spark, d)
    return K.generate_windows(beats(f), songs(f))


_WRAP = f"""
wb AS (SELECT *, greatest(1, least(6, (end_beat - start_beat) // 2)) AS w FROM win),
bw0 AS (SELECT x.song_id, x.bars, x.start_beat, {vibe_sql('a', 'b')} AS v FROM wb x
  JOIN frames a ON a.song_id = x.song_id AND a.hop_idx >= x.start_beat AND a.hop_idx < x.start_beat + x.w
  JOIN frames b ON b.song_id = x.song_id AND b.hop_idx = x.end_beat - x.w + a.hop_idx - x.start_beat),
bw AS (SELECT song_id, bars, start_beat, 0.65::DOUBLE * avg(v) + 0.35::DOUBLE * least(1.0::DOUBLE, min(v)) AS beat_wrap FROM bw0 GROUP BY 1, 2, 3)
"""


@query("loop_beat_wrap", with_ctes(FRAMES_SQL, BEATS, _WINDOWS, _WRAP, select=f"SELECT song_id, bars, start_beat, {q6('beat_wrap')} AS beat_wrap FROM bw"))
def loop_beat_wrap(spark, d):
    f = frames(spark, d)
    return P.beat_wrap_vibe(f, windows(f, songs(f)), _KEYS).withColumn("beat_wrap", r6(F.col("beat_wrap")))


_HOM = (
    """
hp AS (
  SELECT song_id, bars, start_beat, i AS part, start_sec + i * 2.0::DOUBLE AS t0, least(end_sec, start_sec + (i + 1) * 2.0::DOUBLE) AS t1, n_frames FROM win, range(0, 16) r(i) WHERE i < bars AND bars >= 2
  UNION ALL SELECT song_id, bars, start_beat, bars, start_sec, start_sec + bars // 2 * 2.0::DOUBLE, n_frames FROM win WHERE bars >= 2
  UNION ALL SELECT song_id, bars, start_beat, bars + 1, start_sec + bars // 2 * 2.0::DOUBLE, end_sec, n_frames FROM win WHERE bars >= 2),
hs AS (SELECT song_id, bars || ':' || start_beat || ':' || part AS sid, bars, start_beat, part,
    least(n_frames - 1, CAST(floor(t0 / 0.5) AS BIGINT)) AS i0, least(n_frames, least(n_frames - 1, CAST(floor(t1 / 0.5) AS BIGINT)) + 1) AS i1 FROM hp),
"""
    + mean_sql("hm", "hs").strip()
    + f""",
hk AS (SELECT hs.bars, hs.start_beat, hs.part, hm.* FROM hs JOIN hm ON hm.song_id = hs.song_id AND hm.sid = hs.sid),
hv AS (SELECT a.song_id, a.bars, a.start_beat, a.part, {vibe_sql('a', 'b')} AS v FROM hk a JOIN hk b
  ON b.song_id = a.song_id AND b.bars = a.bars AND b.start_beat = a.start_beat AND b.part = a.part + 1 AND a.part <> a.bars - 1),
hom AS (SELECT song_id, bars, start_beat, greatest(0, least(1, 0.35::DOUBLE * avg(v) FILTER (part < bars) + 0.35::DOUBLE * least(1.0::DOUBLE, min(v) FILTER (part < bars))
    + 0.3::DOUBLE * max(v) FILTER (part = bars))) AS homogeneity FROM hv GROUP BY 1, 2, 3)
"""
)


@query(
    "loop_homogeneity",
    with_ctes(
        FRAMES_SQL, BEATS, _WINDOWS, _HOM,
        select=f"SELECT w.song_id, w.bars, w.start_beat, {q6('coalesce(h.homogeneity, 1)')} AS homogeneity FROM win w LEFT JOIN hom h USING (song_id, bars, start_beat)",
    ),
)
def loop_homogeneity(spark, d):
    f = frames(spark, d)
    out = P.homogeneity(settle(P.frame_prefix(f)), windows(f, songs(f)), _KEYS)
    return out.withColumn("homogeneity", r6(F.col("homogeneity")))


_CLOSE = """
cw AS (SELECT *, greatest(2, CAST(floor(least(3.0::DOUBLE, greatest(0.2::DOUBLE, (end_sec - start_sec) * 0.45::DOUBLE)) / 0.5::DOUBLE + 0.5) AS BIGINT)) AS w,
    CAST(floor(start_sec / 0.5 + 0.5) AS BIGINT) AS s, CAST(floor(end_sec / 0.5 + 0.5) AS BIGINT) AS e FROM win),
cp AS (SELECT song_id, bars, start_beat, s - w AS a, e - w AS b, w, n_frames FROM cw UNION ALL SELECT song_id, bars, start_beat, s, e, w, n_frames FROM cw),
ck AS (SELECT song_id, bars, start_beat, a + k * w // least(16, w) AS a, b + k * w // least(16, w) AS b FROM cp, range(0, 16) r(k)
  WHERE k < least(16, w) AND a >= 0 AND b >= 0 AND a + w <= n_frames AND b + w <= n_frames),
cd AS (SELECT k.song_id, k.bars, k.start_beat,
    list_sum(list_transform(list_zip(x.spec, y.spec), lambda z: least(1.0::DOUBLE, greatest(z[1], z[2]) / 0.5::DOUBLE) * abs(z[1] - z[2])))
      / greatest(1.0::DOUBLE, list_sum(list_transform(list_zip(x.spec, y.spec), lambda z: least(1.0::DOUBLE, greatest(z[1], z[2]) / 0.5::DOUBLE)))) AS dd
  FROM ck k JOIN frames x ON x.song_id = k.song_id AND x.hop_idx = k.a JOIN frames y ON y.song_id = k.song_id AND y.hop_idx = k.b),
clo AS (SELECT song_id, bars, start_beat, exp(-(0.65::DOUBLE * avg(dd) + 0.35::DOUBLE * list_sort(list(dd))[CAST(floor((count(*) - 1) * 0.8) AS INT) + 1])) AS closure FROM cd GROUP BY 1, 2, 3)
"""


# All meter-preserving pairs far enough apart for the whole window; bars holds the exit and start_beat the entry.
_FAR_PAIRS = f"""
win AS (SELECT x.song_id, x.beat_idx AS bars, e.beat_idx AS start_beat, e.t_sec AS start_sec, x.t_sec AS end_sec, n_frames
  FROM beats x JOIN beats e ON e.song_id = x.song_id JOIN nf ON nf.song_id = x.song_id
  WHERE x.beat_idx >= 1 AND x.beat_idx % 4 = e.beat_idx % 4 AND x.beat_idx <> e.beat_idx AND abs(x.t_sec - e.t_sec) >= {Q.DEFAULT_VIBE_WINDOW_SEC}::DOUBLE / 0.45::DOUBLE)
"""


@query(
    "jump_far_closures",
    with_ctes(
        FRAMES_SQL, BEATS, _FAR_PAIRS, _CLOSE.replace("(end_sec - start_sec) * 0.45::DOUBLE", f"{Q.DEFAULT_VIBE_WINDOW_SEC}::DOUBLE"),
        "jr AS (SELECT song_id, bars, start_beat, closure, row_number() OVER (PARTITION BY song_id, bars ORDER BY closure DESC, start_beat) AS rank FROM clo)",
        select=f"SELECT song_id, bars AS exit_beat, CAST(rank AS INT) AS rank, start_beat AS entry_beat, {q6('closure')} AS closure FROM jr WHERE rank <= 4",
    ),
)
def jump_far_closures(spark, d):
    """The four entries of highest closure per exit, by bounded top-k; the SQL compares all pairs."""
    f = frames(spark, d)
    strips = settle(J.placed_strips(f, beats(f), songs(f)))
    far, _ = J.compared_tiles(strips, 4, 0.0, J.NEAR_SEC)
    best = top_per_key(far.where("closure is not null and not isnan(closure)"), ["song_id", "exit_beat"], [F.col("closure").desc(), F.col("entry_beat")], 4)
    return best.select("song_id", "exit_beat", "rank", "entry_beat", r6(F.col("closure")).alias("closure"))


@query("loop_phrase_closure", with_ctes(FRAMES_SQL, BEATS, _WINDOWS, _CLOSE, select=f"SELECT song_id, bars, start_beat, {q6('closure')} AS closure FROM clo"))
def loop_phrase_closure(spark, d):
    f = frames(spark, d)
    return P.phrase_closure(f, windows(f, songs(f)), _KEYS).withColumn("closure", r6(F.col("closure")))


@query(
    "loop_wrap_vibe",
    with_ctes(
        FRAMES_SQL, BEATS, _WINDOWS,
        """
        vw AS (SELECT *, least(3.0::DOUBLE, greatest(0.2::DOUBLE, (end_sec - start_sec) * 0.45::DOUBLE)) AS ws FROM win),
        va AS (SELECT *, least(n_frames - 1, CAST(floor(start_sec / 0.5) AS BIGINT)) AS a0, least(n_frames - 1, CAST(floor((start_sec + ws) / 0.5) AS BIGINT)) + 1 AS a1,
          greatest(0, CAST(floor((end_sec - ws) / 0.5) AS BIGINT)) AS b0, least(n_frames - 1, CAST(floor(end_sec / 0.5) AS BIGINT)) + 1 AS b1 FROM vw),
        vh AS (SELECT song_id, sid, a0 AS i0, a1 AS i1 FROM va), vt AS (SELECT song_id, sid, b0 AS i0, b1 AS i1 FROM va)
        """,
        mean_sql("mh", "vh"), mean_sql("mt", "vt"),
        f"""
        ms AS (SELECT a.sid, {vibe_sql('a', 'b')} AS m FROM mh a JOIN mt b ON b.sid = a.sid),
        al AS (SELECT v.sid, {vibe_sql('a', 'b')} AS v FROM va v JOIN frames a ON a.song_id = v.song_id AND a.hop_idx >= v.a0 AND a.hop_idx < v.a0 + least(v.a1 - v.a0, v.b1 - v.b0)
          JOIN frames b ON b.song_id = v.song_id AND b.hop_idx = v.b0 + a.hop_idx - v.a0 WHERE least(v.a1 - v.a0, v.b1 - v.b0) >= 2),
        ag AS (SELECT sid, avg(v) AS s, least(1.0::DOUBLE, min(v)) AS w FROM al GROUP BY 1)
        """,
        select=f"SELECT song_id, bars, start_beat, {q6('coalesce(greatest(0, least(1, 0.4::DOUBLE * m + 0.35::DOUBLE * s + 0.25::DOUBLE * w)), m)')} AS wrap FROM va JOIN ms USING (sid) LEFT JOIN ag USING (sid)",
    ),
)
def loop_wrap_vibe(spark, d):
    f = frames(spark, d)
    out = P.wrap_vibe(f, settle(P.frame_prefix(f)), windows(f, songs(f)), _KEYS)
    return out.withColumn("wrap", r6(F.col("wrap")))


def _dist(a: str, b: str) -> str:
    return f"((1.0::DOUBLE - {cosine_sql(a + '.spec', b + '.spec')}) + 0.75::DOUBLE * least(1.0::DOUBLE, abs(ln({a}.rms + 1e-6::DOUBLE) - ln({b}.rms + 1e-6::DOUBLE)) / ln(8.0::DOUBLE)))"


_MODEL = (
    """
ta AS (SELECT n.song_id, w AS width, t AS a0, t + w AS b0, n.song_id || ':' || w || ':' || t AS sid FROM nf n, (VALUES (4), (6)) x(w), range(0, 128, 2) r(t) WHERE t + 2 * w < n_frames),
t1 AS (SELECT song_id, sid, a0 AS i0, a0 + width AS i1 FROM ta), t2 AS (SELECT song_id, sid, b0 AS i0, b0 + width AS i1 FROM ta),
"""
    + mean_sql("tm1", "t1").strip()
    + ",\n"
    + mean_sql("tm2", "t2").strip()
    + f""",
tq AS (SELECT t.sid, avg({_dist('a', 'b')}) AS q FROM ta t JOIN frames a ON a.song_id = t.song_id AND a.hop_idx >= t.a0 AND a.hop_idx < t.a0 + t.width
  JOIN frames b ON b.song_id = t.song_id AND b.hop_idx = a.hop_idx + t.width GROUP BY 1),
td AS (SELECT ta.song_id, ta.width, 0.4::DOUBLE * {_dist('a', 'b')} + 0.6::DOUBLE * tq.q AS dist FROM ta JOIN tm1 a ON a.sid = ta.sid JOIN tm2 b ON b.sid = ta.sid JOIN tq ON tq.sid = ta.sid),
tr AS (SELECT *, row_number() OVER (PARTITION BY song_id, width ORDER BY dist) - 1 AS r, count(*) OVER (PARTITION BY song_id, width) AS n FROM td),
model AS (SELECT song_id, width, max(n) AS n, max(dist) FILTER (r = floor((n - 1) * 0.5)) AS median, max(dist) FILTER (r = ceil((n - 1) * 0.9)) AS high FROM tr GROUP BY 1, 2)
"""
)


def _model(f, prefix, s):
    return P.transition_model(f, prefix, s.withColumns({"beat_sec": F.lit(1.0), "widths": F.array(F.lit(0.2), F.lit(3.0))}))


@query(
    "loop_transition_model",
    with_ctes(FRAMES_SQL, BEATS, _MODEL, select=f"SELECT song_id, width, n, {q6('median')} AS median, {q6('high')} AS high FROM model"),
)
def loop_transition_model(spark, d):
    f = frames(spark, d)
    out = _model(f, settle(P.frame_prefix(f)), songs(f))
    return out.select("song_id", "width", "n", r6(F.col("median")).alias("median"), r6(F.col("high")).alias("high"))


@query(
    "loop_join_continuity",
    with_ctes(
        FRAMES_SQL, BEATS, _WINDOWS, _MODEL,
        """
        ju AS (SELECT w.song_id, w.bars, w.start_beat, m.width, m.median, m.high, w.end_beat AS e, least(n_frames - 1, w.start_beat) AS b0, w.sid || ':' || m.width AS sid
          FROM win w JOIN model m ON m.song_id = w.song_id WHERE abs(w.end_beat - w.start_beat) >= 2 * m.width AND n_frames >= 8 AND w.end_beat - m.width >= 0 AND w.start_beat + m.width <= n_frames),
        j1 AS (SELECT song_id, sid, e - width AS i0, e AS i1 FROM ju), j2 AS (SELECT song_id, sid, b0 AS i0, b0 + width AS i1 FROM ju)
        """,
        mean_sql("jm1", "j1"), mean_sql("jm2", "j2"),
        f"""
        jq AS (SELECT t.sid, avg({_dist('a', 'b')}) AS q FROM ju t JOIN frames a ON a.song_id = t.song_id AND a.hop_idx >= t.e - t.width AND a.hop_idx < t.e
          JOIN frames b ON b.song_id = t.song_id AND b.hop_idx = t.b0 + a.hop_idx - (t.e - t.width) GROUP BY 1),
        jd AS (SELECT ju.*, 0.4::DOUBLE * {_dist('a', 'b')} + 0.6::DOUBLE * jq.q AS dist FROM ju JOIN jm1 a ON a.sid = ju.sid JOIN jm2 b ON b.sid = ju.sid JOIN jq ON jq.sid = ju.sid),
        jc AS (SELECT song_id, bars, start_beat, least(1.0::DOUBLE, min(CASE WHEN dist <= median + 1e-3 THEN 0.95::DOUBLE
          ELSE greatest(0, least(0.95::DOUBLE, 0.95::DOUBLE - (dist - median) / greatest(high - median, 0.02::DOUBLE) * 0.75::DOUBLE)) END)) AS j FROM jd GROUP BY 1, 2, 3)
        """,
        select=f'SELECT w.song_id, w.bars, w.start_beat, {q6("coalesce(j, 0)")} AS "join" FROM win w LEFT JOIN jc USING (song_id, bars, start_beat)',
    ),
)
def loop_join_continuity(spark, d):
    f = frames(spark, d)
    prefix, s = settle(P.frame_prefix(f)), songs(f)
    out = P.join_continuity(f, prefix, settle(_model(f, prefix, s)), settle(windows(f, s)), _KEYS)
    return out.withColumn("join", r6(F.col("join")))


@query(
    "loop_shortlist",
    with_ctes(
        FRAMES_SQL, BEATS, _WINDOWS, _WRAP, _HOM, _CLOSE,
        """
        sl AS (SELECT w.song_id, w.bars, w.start_beat, beat_wrap, 0.75::DOUBLE * coalesce(closure, beat_wrap) + 0.25::DOUBLE * beat_wrap AS ranked FROM win w JOIN bw USING (song_id, bars, start_beat)
          LEFT JOIN hom USING (song_id, bars, start_beat) LEFT JOIN clo USING (song_id, bars, start_beat)
          WHERE beat_wrap >= 0.58::DOUBLE - 0.08::DOUBLE AND coalesce(homogeneity, 1) >= CASE WHEN w.bars >= 16 THEN 0.92 WHEN w.bars >= 8 THEN 0.9 WHEN w.bars >= 4 THEN 0.86 ELSE 0 END),
        sr AS (SELECT *, row_number() OVER (PARTITION BY song_id, bars, start_beat // 4 ORDER BY ranked DESC, start_beat) AS rn FROM sl)
        """,
        select=f"SELECT song_id, bars, start_beat, {q6('ranked')} AS ranked FROM sr WHERE bars >= 4 OR rn <= 2",
    ),
)
def loop_shortlist(spark, d):
    f = frames(spark, d)
    w = settle(windows(f, songs(f)))
    gated = (
        w.join(P.beat_wrap_vibe(f, w, _KEYS), _KEYS)
        .join(P.homogeneity(settle(P.frame_prefix(f)), w, _KEYS), _KEYS)
        .join(P.phrase_closure(f, w, _KEYS), _KEYS, "left")
    )
    return K.shortlist(gated).select(*_KEYS, r6(F.col("ranked")).alias("ranked"))


# ---------------------------------------------------------------- selection over candidates from lineitem
_CANDS = """
cand AS (
  SELECT l_orderkey AS song_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS cand_id, [1,2,4,8,16][l_linenumber % 5 + 1] AS bars, l_quantity AS start_sec,
    l_quantity + [1,2,4,8,16][l_linenumber % 5 + 1] * 2.0::DOUBLE AS end_sec, l_discount * 10.0::DOUBLE AS seam_score,
    l_extendedprice / 110000.0::DOUBLE AS quality_score, l_tax * 12.0::DOUBLE AS context_score FROM lineitem),
rs AS (SELECT *, quality_score + CASE WHEN bars >= 8 THEN 0.04::DOUBLE WHEN bars >= 4 THEN 0.025::DOUBLE WHEN bars >= 2 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS rank_score FROM cand),
ro AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY rank_score DESC, cand_id) AS rn FROM rs)
"""
_RIVAL = """list_position(list_transform(f.acc, lambda o: (o.bars = c.bars AND c.bars >= 8 AND abs(c.start_sec - o.s) < c.end_sec - c.start_sec)
    OR (o.bars = c.bars AND greatest(0, least(c.end_sec, o.e) - greatest(c.start_sec, o.s)) / least(c.end_sec - c.start_sec, o.e - o.s) > 0.45)
    OR (o.bars <> c.bars AND greatest(0, least(c.end_sec, o.e) - greatest(c.start_sec, o.s)) / least(c.end_sec - c.start_sec, o.e - o.s) > 0.85
        AND greatest(c.end_sec - c.start_sec, o.e - o.s) / greatest(1e-6, least(c.end_sec - c.start_sec, o.e - o.s)) < 1.5)), TRUE)"""
_FOLD = f"""
fold AS (
  SELECT song_id, 0::BIGINT AS rn, []::STRUCT(id BIGINT, slot BIGINT, bars INT, s DOUBLE, e DOUBLE, seam DOUBLE, q DOUBLE)[] AS acc FROM (SELECT DISTINCT song_id FROM ro)
  UNION ALL
  SELECT c.song_id, c.rn, CASE
    WHEN coalesce({_RIVAL}, 0) = 0 THEN list_append(f.acc, {{'id': c.cand_id, 'slot': c.rn, 'bars': c.bars, 's': c.start_sec, 'e': c.end_sec, 'seam': c.seam_score, 'q': c.quality_score}})
    WHEN f.acc[{_RIVAL}].bars = c.bars AND abs(c.quality_score - f.acc[{_RIVAL}].q) < 0.05 AND c.seam_score > f.acc[{_RIVAL}].seam + 0.01
      THEN list_transform(f.acc, lambda o, i: CASE WHEN i = {_RIVAL} THEN {{'id': c.cand_id, 'slot': o.slot, 'bars': c.bars, 's': c.start_sec, 'e': c.end_sec, 'seam': c.seam_score, 'q': c.quality_score}} ELSE o END)
    ELSE f.acc END
  FROM fold f JOIN ro c ON c.song_id = f.song_id AND c.rn = f.rn + 1),
done AS (SELECT f.song_id, unnest(f.acc) AS k FROM fold f JOIN (SELECT song_id, max(rn) AS n FROM ro GROUP BY 1) m ON m.song_id = f.song_id AND m.n = f.rn),
kept AS (SELECT song_id, k.id AS cand_id, k.slot AS slot, k.bars AS bars, k.s AS start_sec, k.e AS end_sec, k.q AS quality_score FROM done)
"""


def line_candidates(spark, d, li=None, song=None, cand=None, start=None, longer=None):
    li = read(spark, d, "lineitem") if li is None else li
    bars = F.element_at(F.array(*[F.lit(b) for b in (1, 2, 4, 8, 16)]), F.col("l_linenumber") % 5 + 1)
    start = F.col("l_quantity") if start is None else start
    length = bars * 2.0 if longer is None else bars * 2.0 + longer
    return li.select(
        (F.col("l_orderkey") if song is None else song).alias("song_id"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber") if cand is None else cand).alias("cand_id"),
        bars.alias("bars"),
        start.alias("start_sec"),
        (start + length).alias("end_sec"),
        (F.col("l_discount") * 10.0).alias("seam_score"),
        (F.col("l_extendedprice") / 110000.0).alias("quality_score"),
        (F.col("l_tax") * 12.0).alias("context_score"),
    )


def _recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


@query("loop_suppress_duplicates", _recursive(_CANDS, _FOLD, select="SELECT song_id, cand_id, bars FROM kept"))
def loop_suppress_duplicates(spark, d):
    return K.suppress_near_duplicates(line_candidates(spark, d)).select("song_id", "cand_id", "bars")


# Loops of one length that differ a little in duration, many per song, often starting where another ends.
_VARYING = _CANDS.replace("l_orderkey AS song_id", "l_orderkey // 160 AS song_id").replace(
    "l_quantity AS start_sec", "floor(l_quantity / 2) * 8.0::DOUBLE AS start_sec"
).replace(
    "l_quantity + [1,2,4,8,16][l_linenumber % 5 + 1] * 2.0::DOUBLE AS end_sec",
    "floor(l_quantity / 2) * 8.0::DOUBLE + ([1,2,4,8,16][l_linenumber % 5 + 1] * 2.0::DOUBLE + (l_partkey % 7) * 0.05::DOUBLE) AS end_sec",
).replace("l_partkey * 1000000 + l_suppkey * 100 + l_linenumber", "l_orderkey * 100 + l_linenumber")


def varying_candidates(spark, d):
    li = read(spark, d, "lineitem")
    start = F.floor(F.col("l_quantity") / 2) * 8.0
    return line_candidates(spark, d, li, F.floor(F.col("l_orderkey") / 160).cast("bigint"), F.col("l_orderkey") * 100 + F.col("l_linenumber"), start, (F.col("l_partkey") % 7) * 0.05)


@query("loop_suppress_varying", _recursive(_VARYING, _FOLD, select="SELECT song_id, cand_id, bars FROM kept"))
def loop_suppress_varying(spark, d):
    return K.suppress_near_duplicates(varying_candidates(spark, d)).select("song_id", "cand_id", "bars")


@query(
    "loop_suppress_keep",
    _recursive(_VARYING, _FOLD.replace("c.rn = f.rn + 1)", "c.rn = f.rn + 1 WHERE len(f.acc) < 6)").replace(
        "(SELECT song_id, max(rn) AS n FROM ro GROUP BY 1)", "(SELECT song_id, max(rn) AS n FROM fold GROUP BY 1)"
    ), select="SELECT song_id, cand_id, bars FROM kept"),
)
def loop_suppress_keep(spark, d):
    """The first six loops of each song."""
    return K.suppress_near_duplicates(varying_candidates(spark, d), keep=6).select("song_id", "cand_id", "bars")


_SELECT = """
lst AS (SELECT *, row_number() OVER (PARTITION BY song_id, bars ORDER BY slot) AS pos, min(slot) OVER (PARTITION BY song_id, bars) AS list_slot,
    max(end_sec) OVER (PARTITION BY song_id, bars) AS last_end, row_number() OVER (PARTITION BY song_id, bars ORDER BY start_sec, slot) AS early FROM kept),
resc AS (SELECT song_id, bars FROM lst WHERE early = 1 AND pos > KEEP AND start_sec <= last_end * 0.25),
pick AS (SELECT l.*, pos AS at FROM lst l WHERE pos < KEEP OR (pos = KEEP AND NOT EXISTS (SELECT 1 FROM resc r WHERE r.song_id = l.song_id AND r.bars = l.bars))
  UNION ALL SELECT l.*, KEEP FROM lst l JOIN resc r ON r.song_id = l.song_id AND r.bars = l.bars WHERE l.early = 1)
"""


@query(
    "loop_select_across_lengths",
    _recursive(
        _CANDS, _FOLD, _SELECT.replace("KEEP", "2").replace(" AS at ", " AS ppos "),
        select=f"""SELECT song_id, cand_id, bars, {q6('quality_score')} AS quality_score, CAST(row_number() OVER (PARTITION BY song_id ORDER BY
          quality_score + CASE WHEN bars >= 8 THEN 0.04::DOUBLE WHEN bars >= 4 THEN 0.025::DOUBLE WHEN bars >= 2 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END DESC, list_slot, ppos) AS INT) AS rank FROM pick""",
    ),
)
def loop_select_across_lengths(spark, d):
    out = K.select_across_lengths(line_candidates(spark, d), 2)
    return out.select("song_id", "cand_id", "bars", r6(F.col("quality_score")).alias("quality_score"), "rank")


@query(
    "loop_score_formulas",
    with_ctes(
        _CANDS,
        select=f"""
        SELECT song_id, cand_id, {q6('least(CASE WHEN quality_score > 0.9 THEN 1.5::DOUBLE ELSE least(4, greatest(0.25::DOUBLE, quality_score * 5)) END, greatest(0.2::DOUBLE, (end_sec - start_sec) * 0.45::DOUBLE))')} AS window_sec,
          {q6('greatest(0, least(1, pow(greatest(0.01, context_score), 0.55) * pow(greatest(0.01, quality_score), 0.25) * pow(greatest(0.01, seam_score), 0.2)))')} AS combined,
          {q6('1.0::DOUBLE / (1.0::DOUBLE + exp(-(-0.021161504923734::DOUBLE + 1.2432855554848206::DOUBLE * (seam_score - 0.3973921770386248::DOUBLE) / 0.11298518156880039::DOUBLE + 1.0999457070279293::DOUBLE * (CASE WHEN context_score >= 0.3 THEN 1 ELSE 0 END - 0.4523809523809524::DOUBLE) / 0.49772726096111664::DOUBLE)))')} AS p_good
        FROM cand""",
    ),
)
def loop_score_formulas(spark, d):
    c = line_candidates(spark, d)
    asked = F.when(F.col("quality_score") <= 0.9, F.col("quality_score") * 5)
    features = Q.with_fade({"closure": F.col("seam_score")}, F.col("context_score"))
    return c.select(
        "song_id",
        "cand_id",
        r6(Q.effective_window(F.col("end_sec") - F.col("start_sec"), asked)).alias("window_sec"),
        r6(Q.combine_quality(F.col("seam_score"), F.col("context_score"), F.col("quality_score"))).alias("combined"),
        r6(Q.logistic(features)).alias("p_good"),
    )


@query(
    "loop_filter_candidates",
    with_ctes(
        VOTES_SQL,
        f"""
        cur AS (SELECT * FROM (SELECT {KEY}, rating, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE rating IS NOT NULL) WHERE rn = 1 AND rating <> 'clear'),
        tg AS (SELECT * FROM (SELECT {KEY}, tags, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM keyed WHERE tags IS NOT NULL) WHERE rn = 1),
        det AS (SELECT event_id, 'u' || user_id AS source_name, [1,2,4,8,16][CAST(event_id % 5 + 1 AS INT)] AS bars, (k // 10) * 2.5::DOUBLE AS start_sec, value / 500.0::DOUBLE AS quality,
            CASE WHEN event_type = 'view' THEN 'saved' END AS origin, (event_id % 100) / 100.0::DOUBLE AS context FROM ev),
        m AS (SELECT d.*, c.rating, t.tags FROM det d
          LEFT JOIN cur c ON c.source_name = d.source_name AND c.bars = d.bars AND c.start_units = CAST(round(d.start_sec * 100) AS BIGINT) AND c.end_units = CAST(round((d.start_sec + d.bars * 2.0::DOUBLE) * 100) AS BIGINT)
          LEFT JOIN tg t ON t.source_name = d.source_name AND t.bars = d.bars AND t.start_units = CAST(round(d.start_sec * 100) AS BIGINT) AND t.end_units = CAST(round((d.start_sec + d.bars * 2.0::DOUBLE) * 100) AS BIGINT))
        """,
        select="""
        SELECT 'found-not-bad' AS view, event_id FROM m WHERE coalesce(origin, 'found') = 'found' AND coalesce(rating <> 'bad', TRUE) AND quality + 1e-6 >= 0.05 AND context + 1e-6 >= 0.2 AND bars >= 4 AND bars * 2 > 16
        UNION ALL SELECT 'saved-tagged', event_id FROM m WHERE origin = 'saved' AND coalesce(list_contains(tags, 'combat'), FALSE)
        UNION ALL SELECT 'unrated-short', event_id FROM m WHERE coalesce(origin, 'found') = 'found' AND rating IS NULL AND bars * 2 < 8 AND bars = 2""",
    ),
)
def loop_filter_candidates(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type")
    c = detected(spark, d).join(e, "event_id").withColumns(
        {"origin": F.when(F.col("event_type") == "view", "saved"), "context_score": (F.col("event_id") % 100) / 100.0}
    )
    v = votes(spark, d)
    ratings, tags = V.latest_ratings(v), V.latest_tags(v)
    show = lambda name, **opts: K.filter_candidates(c, ratings, tags, V.CUT, **opts).select(F.lit(name).alias("view"), "event_id")
    return (
        show("found-not-bad", review="not-bad", min_quality=0.05, min_vibe=0.2, bars="beds", length="long")
        .unionByName(show("saved-tagged", view="saved", feel="combat", min_quality=2.0))
        .unionByName(show("unrated-short", review="unrated", length="short", bars=2))
    )
