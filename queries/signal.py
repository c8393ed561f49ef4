"""PCM derived from document texts: fifty documents make a signal, a character is a sample."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.base import Registry, q6, r6, read, with_ctes
from refrain.operators import signal as S
from refrain.operators.ordered import block_of, scan
from refrain.operators.settle import settle, shared_dir
from refrain.plans import detect as D
from refrain.plans import song_map as M
from refrain.sources import exports as X
from refrain.sources import pcm as P
from refrain.sources.file_sink import write_loops
from refrain.sources.wav import read_wav

query = Registry()
RATE, CHUNK, DOCS = 8000, 16384, 50


def text_pcm(spark, d):
    doc = read(spark, d, "documents").select(
        F.concat(F.lit("t"), F.floor(F.col("doc_id") / DOCS).cast("string")).alias("song_id"), "doc_id", "text", F.length("text").alias("n")
    )
    doc = scan(doc.filter("n > 0"), ["song_id"], block_of(F.col("doc_id")), ["doc_id"], before={"at": F.col("n")})
    cells = doc.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("at") / CHUNK), F.floor((F.col("at") + F.col("n") - 1) / CHUNK))))
    lo = F.greatest(F.lit(0), F.col("chunk_idx") * CHUNK - F.col("at"))
    hi = F.least(F.col("n"), (F.col("chunk_idx") + 1) * CHUNK - F.col("at"))
    piece = F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int"))
    # One chunk's worth of characters per group.
    text = cells.groupBy("song_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("ps"))
    chars = F.flatten(F.transform("ps", lambda s: F.regexp_extract_all(s["p"], F.lit("(?s)(.)"), F.lit(1))))
    sample = lambda c: ((F.ascii(c) % 64 - 32) / 40.0).cast("float")
    return settle(
        text.select(
            "song_id", F.lit(0).alias("channel"), "chunk_idx", (F.col("chunk_idx") * CHUNK).alias("start_sample"), F.lit(RATE).alias("sample_rate"),
            F.transform(chars, sample).alias("samples"),
        ),
        wide=True,
    )


PCM_SQL = """
tx AS (SELECT 't' || (doc_id // 50) AS song_id, doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0),
pcm AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY doc_id, i) - 1 AS pos, ((unicode(c) % 64 - 32) / 40.0::DOUBLE)::FLOAT::DOUBLE AS x FROM tx),
len AS (SELECT song_id, count(*) AS n FROM pcm GROUP BY 1)
"""


@query("pcm_lengths", with_ctes(PCM_SQL, select=f"SELECT song_id, count(*) AS n_samples, {q6('sum(x)')} AS total FROM pcm GROUP BY 1"))
def pcm_lengths(spark, d):
    p = text_pcm(spark, d)
    s = p.groupBy("song_id").agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))
    return P.song_lengths(p).select("song_id", "n_samples").join(s.withColumn("total", r6(F.col("total"))), "song_id")


def stereo(p, rate: int = RATE):
    other = p.withColumns({"channel": F.lit(1), "samples": F.transform("samples", lambda x: (x * F.lit(0.5).cast("float")).cast("float"))})
    return p.unionByName(other).withColumn("sample_rate", F.lit(rate))


@query(
    "pcm_prepare_mono",
    with_ctes(
        PCM_SQL,
        """
        m AS (SELECT p.song_id, p.pos - 4800 AS k, ((x + (x * 0.5::DOUBLE)::FLOAT::DOUBLE) * 0.5::DOUBLE)::FLOAT::DOUBLE AS y, n - 4800 AS size FROM pcm p JOIN len USING (song_id) WHERE p.pos >= 4800),
        k AS (SELECT * FROM m WHERE k % 2 = 0 AND k // 2 < size // 2)
        """,
        select=f"SELECT song_id, count(*) AS n, {q6('sum(y)')} AS total, {q6('sum(y * (k // 2 + 1)) / 1000.0::DOUBLE')} AS weighted FROM k GROUP BY 1",
    ),
)
def pcm_prepare_mono(spark, d):
    p = stereo(text_pcm(spark, d), 48000)
    # To the end of each song, and beyond it, where the trim is cut.
    trims = P.song_lengths(p).select("song_id", F.lit(0.1).alias("trim_start"), (F.col("n_samples") / 48000.0 + 1.0).alias("trim_end"))
    m = P.prepare_mono(p, trims)
    part = m.select(
        "song_id",
        F.size("samples").alias("n"),
        F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("s"),
        F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (F.col("start_sample") + i + 1)), F.lit(0.0), lambda a, x: a + x).alias("w"),
    )
    return part.groupBy("song_id").agg(
        F.sum("n").alias("n"), r6(F.sum("s")).alias("total"), r6(F.sum("w") / 1000.0).alias("weighted")
    )


@query(
    "pcm_rms_envelope",
    with_ctes(PCM_SQL, select=f"SELECT song_id, pos // 500 AS bucket, {q6('sqrt(sum(x * x) / 500.0::DOUBLE)')} AS rms FROM pcm GROUP BY 1, 2 HAVING count(*) = 500"),
)
def pcm_rms_envelope(spark, d):
    return S.rms_envelope(text_pcm(spark, d), 500).withColumn("rms", r6(F.col("rms")))


_PEAKS = """
pk0 AS (SELECT p.song_id, pos, x, n, least(400, ceil(n / 256.0))::BIGINT AS buckets FROM pcm p JOIN len USING (song_id)),
pk1 AS (SELECT *, CAST(floor((pos + 1) * buckets / n::DOUBLE) AS BIGINT) AS g, n / buckets::DOUBLE AS per FROM pk0),
pk2 AS (SELECT *, CASE WHEN g < buckets AND floor(g * per) <= pos THEN g WHEN floor((g - 1) * per) <= pos THEN g - 1 ELSE g - 2 END AS bucket FROM pk1),
pk AS (SELECT song_id, bucket, least(0, min(x)) AS low, greatest(0, max(x)) AS high, max(buckets) AS buckets FROM pk2 GROUP BY 1, 2)
"""


@query("pcm_peaks", with_ctes(PCM_SQL, _PEAKS, select=f"SELECT song_id, bucket, {q6('low')} AS low, {q6('high')} AS high FROM pk"))
def pcm_peaks(spark, d):
    p = S.peaks(text_pcm(spark, d), 400)
    return p.select("song_id", "bucket", r6(F.col("low").cast("double")).alias("low"), r6(F.col("high").cast("double")).alias("high"))


@query(
    "pcm_waveform_columns",
    with_ctes(
        PCM_SQL,
        _PEAKS,
        """
        cl AS (SELECT song_id, n / 8000.0::DOUBLE AS dur, max(buckets) AS buckets, 0.25::DOUBLE AS t0, n / 8000.0::DOUBLE AS t1, 1.25::DOUBLE / 40.0::DOUBLE AS pp FROM len JOIN pk USING (song_id) GROUP BY 1, 2),
        cc AS (SELECT *, unnest(range(CAST(floor(t0 / pp + 3) AS BIGINT), CAST(ceil(t0 / pp + least(greatest(0, t1 - t0) / 1.25::DOUBLE * 40.0::DOUBLE, 500.0)) AS BIGINT))) AS col FROM cl),
        cb AS (SELECT *, greatest(0, least(buckets - 1, CAST(floor(col * pp * (buckets / dur)) AS BIGINT))) AS lo FROM cc),
        ch AS (SELECT *, greatest(lo + 1, least(buckets, CAST(ceil((col + 1) * pp * (buckets / dur)) AS BIGINT))) AS hi FROM cb)
        """,
        select=f"""SELECT c.song_id AS clip_id, {q6('c.col - c.t0 / c.pp')} AS x, {q6('least(0, min(low))')} AS low, {q6('greatest(0, max(high))')} AS high
        FROM ch c JOIN pk ON pk.song_id = c.song_id AND pk.bucket >= c.lo AND pk.bucket < c.hi GROUP BY c.song_id, c.col, c.t0, c.pp""",
    ),
)
def pcm_waveform_columns(spark, d):
    p = text_pcm(spark, d)
    sec = F.col("n_samples") / float(RATE)
    clips = P.song_lengths(p).select(
        "song_id", F.col("song_id").alias("clip_id"), F.lit(0.25).alias("trim_start"), sec.alias("trim_end"), F.lit(1.25).alias("speed"),
        sec.alias("buffer_sec"), F.lit(0.0).alias("start_time"), F.lit(3.0).alias("from_px"), F.lit(500.0).alias("to_px"),
    )
    w = S.waveform_columns(settle(S.peaks(p, 400)), clips, 40.0)
    return w.select("clip_id", *[r6(F.col(c).cast("double")).alias(c) for c in ("x", "low", "high")])


@query(
    "pcm_interval_db",
    with_ctes(
        PCM_SQL,
        "iv AS (SELECT song_id, unnest(range(0, n // 5600 + 2)) AS k, n FROM len), ib AS (SELECT *, CAST(floor(k * 0.7::DOUBLE * 8000.0::DOUBLE) AS BIGINT) AS a, least(n, CAST(floor((k * 0.7::DOUBLE + 0.5::DOUBLE) * 8000.0::DOUBLE) AS BIGINT)) AS b FROM iv)",
        select=f"""SELECT i.song_id, i.k, {q6('10.0::DOUBLE * log10(coalesce(sum(x * x), 0) / greatest(1, max(b - a)) + 1e-12::DOUBLE)')} AS db
        FROM ib i LEFT JOIN pcm p ON p.song_id = i.song_id AND p.pos >= a AND p.pos < b GROUP BY 1, 2""",
    ),
)
def pcm_interval_db(spark, d):
    p = text_pcm(spark, d)
    # One every 0.7 s over the whole song, the last beyond its end.
    iv = P.song_lengths(p).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_samples") / 5600) + 1))).select("song_id", "k").withColumns(
        {"start_sec": F.col("k") * 0.7, "end_sec": F.col("k") * 0.7 + 0.5}
    )
    return S.interval_rms_db(p, iv, ["song_id", "k"]).withColumn("db", r6(F.col("db")))


@query(
    "pcm_layer_checks",
    with_ctes(
        PCM_SQL,
        """
        ly AS (SELECT song_id, pos, x, (x * 0.75::FLOAT::DOUBLE)::FLOAT::DOUBLE AS b, (x * 0.2::FLOAT::DOUBLE)::FLOAT::DOUBLE AS t FROM pcm),
        rs AS (SELECT song_id, 10.0::DOUBLE * log10(sum((b + t - x) * (b + t - x)) / CASE WHEN sum(x * x) = 0 THEN 1 ELSE sum(x * x) END + 1e-12::DOUBLE) AS residual, max(abs(x)) AS top,
          max(CASE WHEN abs(x) > 0.7 THEN pos END) AS last, count(*) AS n FROM ly GROUP BY 1)
        """,
        select=f"""SELECT song_id, {q6('residual')} AS residual_db, least(n, greatest(coalesce(last, -1) + 1 + 800, CAST(ceil(1.5 * 8000) AS BIGINT))) AS frames,
          {q6('0.89::DOUBLE / top')} AS gain FROM rs""",
    ),
)
def pcm_layer_checks(spark, d):
    p = text_pcm(spark, d)
    scaled = lambda g: p.withColumn("samples", F.transform("samples", lambda x: (x.cast("double") * F.lit(g).cast("float").cast("double")).cast("float")))
    res = S.layer_residual_db(p, scaled(0.75), scaled(0.2)).withColumn("residual_db", r6(F.col("residual_db")))
    keep = p.select("song_id").distinct().withColumn("keep_sec", F.lit(1.5))
    end = S.natural_end(p, keep, 0.7, 0.1).select("song_id", "frames")
    top = lambda q, n: q.groupBy("song_id").agg(F.max(F.array_max(F.transform("samples", lambda x: F.abs(x)))).cast("double").alias(n))
    gain = top(S.peak_normalize(p), "after").join(top(p, "before"), "song_id").select(
        "song_id", r6(F.when(F.abs(F.col("after") - 0.89) < 1e-6, 0.89 / F.col("before"))).alias("gain")
    )
    return res.join(end, "song_id").join(gain, "song_id")


@query(
    "pcm_mix_layers",
    with_ctes(
        PCM_SQL,
        "mx AS (SELECT p.song_id, p.pos, p.x, CASE WHEN p.pos < len.n // 2 THEN p.x * 0.5::DOUBLE END AS y FROM pcm p JOIN len USING (song_id))",
        select=f"SELECT song_id, count(y) AS cut_n, {q6('sum((x + y)::FLOAT::DOUBLE)')} AS cut_sum, count(*) AS pad_n, {q6('sum((x + coalesce(y, 0))::FLOAT::DOUBLE)')} AS pad_sum FROM mx GROUP BY 1",
    ),
)
def pcm_mix_layers(spark, d):
    p = text_pcm(spark, d)
    half = P.fit_length(
        p.withColumn("samples", F.transform("samples", lambda x: (x * F.lit(0.5).cast("float")).cast("float"))),
        P.song_lengths(p).select("song_id", F.floor(F.col("n_samples") / 2).alias("n_samples")),
    )
    half = settle(half, wide=True)
    tally = lambda m, n: m.groupBy("song_id").agg(
        F.sum(F.size("samples")).cast("bigint").alias(f"{n}_n"),
        r6(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")))).alias(f"{n}_sum"),
    )
    return tally(P.mix_layers(p, half), "cut").join(tally(P.mix_layers(p, half, pad=True), "pad"), "song_id")


@query(
    "frame_rms",
    with_ctes(
        PCM_SQL,
        "hp AS (SELECT song_id, unnest(range(0, CASE WHEN n >= 1024 THEN (n - 1024) // 256 + 1 ELSE 0 END)) AS hop_idx FROM len)",
        select=f"SELECT h.song_id, h.hop_idx, {q6('sqrt(sum(x * x) / 1024.0::DOUBLE)')} AS rms FROM hp h JOIN pcm p ON p.song_id = h.song_id AND p.pos >= h.hop_idx * 256 AND p.pos < h.hop_idx * 256 + 1024 GROUP BY 1, 2",
    ),
)
def frame_rms(spark, d):
    f = S.extract_frames(text_pcm(spark, d))
    return f.select("song_id", "hop_idx", r6(F.col("rms")).alias("rms"))


_ROUNDTRIP_SQL = (
    with_ctes(
        PCM_SQL,
        "w AS (SELECT song_id, pos, CAST(greatest(-32768, least(32767, floor(greatest(-1, least(1, x)) * 32767.0::DOUBLE + 0.5))) AS BIGINT) AS v FROM pcm JOIN len USING (song_id) WHERE pos >= floor(n / 8000.0::DOUBLE * 0.05::DOUBLE * 8000.0::DOUBLE + 0.5) AND pos < floor(n / 8000.0::DOUBLE * 0.95::DOUBLE * 8000.0::DOUBLE + 0.5))",
        select=f"SELECT song_id, 8000 AS sample_rate, count(*) AS n, {q6('sum(v) / 32768.0::DOUBLE')} AS total FROM w GROUP BY 1",
    )
)


def _middles(p):
    """The middle nine tenths of every song as a rendered loop named like its song."""
    loops = P.song_lengths(p).select(
        "song_id", F.col("song_id").alias("cand_id"), (F.col("n_samples") / 8000.0 * 0.05).alias("start_sec"), (F.col("n_samples") / 8000.0 * 0.95).alias("end_sec"),
        F.lit(0.0).alias("fade_sec"), F.lit(False).alias("normalize"),
    )
    return X.render_loops(loops, p, P.song_lengths(p))


def _sample_sums(pcm):
    return pcm.groupBy("song_id", "sample_rate").agg(
        F.sum(F.size("samples")).cast("bigint").alias("n"),
        r6(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")))).alias("total"),
    )


@query("pcm_wav_roundtrip", _ROUNDTRIP_SQL)
def pcm_wav_roundtrip(spark, d):
    wav = settle(_middles(text_pcm(spark, d)), wide=True)
    return _sample_sums(P.decode_wav(wav.select("song_id", "content")))


@query("pcm_wav_files", _ROUNDTRIP_SQL)
def pcm_wav_files(spark, d):
    """A file per loop, read back by byte ranges."""
    folder = f"{shared_dir(spark)}/wav/{uuid.uuid4().hex}"
    write_loops(_middles(text_pcm(spark, d)), folder)
    return _sample_sums(read_wav(spark, folder, chunk=4096, range_bytes=1 << 16))


@query(
    "render_loops",
    with_ctes(
        PCM_SQL,
        "rl AS (SELECT song_id, n, unnest(range(0, 4)) AS k FROM len)",
        "rs AS (SELECT *, CAST(floor(n / 8000.0::DOUBLE * k / 4 * 8000.0::DOUBLE + 0.5) AS BIGINT) AS a, CAST(floor(n / 8000.0::DOUBLE * (k + 1) / 4 * 8000.0::DOUBLE + 0.5) AS BIGINT) AS b FROM rl)",
        select="SELECT song_id, k::VARCHAR AS cand_id, least(n, greatest(a + 1, b)) - a AS sample_count, CAST(44 + 2 * (least(n, greatest(a + 1, b)) - a) AS INT) AS bytes FROM rs",
    ),
)
def render_loops(spark, d):
    p = text_pcm(spark, d)
    n = P.song_lengths(p)
    loops = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "song_id", F.col("k").cast("string").alias("cand_id"), (F.col("n_samples") / 8000.0 * F.col("k") / 4).alias("start_sec"),
        (F.col("n_samples") / 8000.0 * (F.col("k") + 1) / 4).alias("end_sec"),
        F.lit(0.035).alias("fade_sec"), (F.col("k") % 2 == 0).alias("normalize"),
    )
    return X.render_loops(loops, p, n).select("song_id", "cand_id", "sample_count", F.length("content").alias("bytes"))


# The encoded signal is the original, eight samples late.
@query("align_offsets", with_ctes(PCM_SQL, select="SELECT song_id, 8 / 8000.0::DOUBLE AS offset_sec, 0.0::DOUBLE AS spread_sec FROM len"))
def align_offsets(spark, d):
    p = text_pcm(spark, d)
    # The whole signal delayed by eight samples: each chunk starts with the last eight of the one before.
    tail = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - 7), F.lit(8))
    tails = p.select("song_id", "channel", (F.col("chunk_idx") + 1).alias("chunk_idx"), tail.alias("before"))
    moved = p.join(tails, ["song_id", "channel", "chunk_idx"], "left")
    before = F.coalesce("before", F.array_repeat(F.lit(0.0).cast("float"), 8))
    shifted = moved.withColumn("samples", F.slice(F.concat(before, "samples"), F.lit(1), F.size("samples"))).select(*p.columns)
    return S.align_offsets(p, shifted)


def _analysis(spark, d):
    return D.analyse(text_pcm(spark, d))


@query("signal_tempo_and_beats")
def signal_tempo_and_beats(spark, d):
    a = _analysis(spark, d)
    n = a["beats"].groupBy("song_id").agg(F.count(F.lit(1)).alias("beats"))
    return a["songs"].join(n, "song_id", "left").select("song_id", r6(F.col("bpm")).alias("bpm"), "downbeat", "n_frames", "beats")


@query("signal_detect_loops")
def signal_detect_loops(spark, d):
    return D.detect_loops(_analysis(spark, d)).select("song_id", "rank", "id", "bars", r6(F.col("quality_score")).alias("quality_score"))


@query("signal_jump_table")
def signal_jump_table(spark, d):
    j = M.jump_table(_analysis(spark, d), 8)
    return j.select("song_id", "exit_beat", "rank", "entry_beat", r6(F.col("p_good_cut")).alias("p_good_cut"), r6(F.col("seam")).alias("seam"))
