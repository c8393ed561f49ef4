"""Signals: chunking must not matter, features equal a plain transform, loops make sense."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.operators import signal as S
from refrain.operators.settle import settle
from refrain.plans import detect as D
from refrain.plans import song_map as M
from refrain.schemas import PCM_CHUNK
from refrain.sources import exports as X
from refrain.sources import pcm as P
from tests.signals import aba_song, click, pcm_table

RATE = 8000


def frames_of(df):
    return {r.hop_idx: r for r in S.extract_frames(df).collect()}


def test_chunking_does_not_matter(spark):
    x = np.random.default_rng(2).uniform(-0.5, 0.5, 20000)
    small, large = (frames_of(pcm_table(spark, {"a": x}, RATE, c)) for c in (1500, 32768))
    assert sorted(small) == sorted(large) == list(range((len(x) - 1024) // 256 + 1))
    for h in small:
        for c in ("flux", "rms", "centroid"):
            assert small[h][c] == pytest.approx(large[h][c], abs=1e-9)
        for c in ("chroma", "timbre", "spec"):
            np.testing.assert_allclose(small[h][c], large[h][c], atol=1e-9)
    # Against a direct transform of one window.
    win = np.float32(x[5 * 256 : 5 * 256 + 1024]).astype(float)
    k = np.arange(512)[:, None] * np.arange(1024)[None]
    mag = np.abs((np.exp(-2j * np.pi * k / 1024) * (win * np.hamming(1024))).sum(axis=1))
    freq = np.arange(512) / 1024 * RATE
    assert small[5].centroid == pytest.approx((freq[1:] * mag[1:]).sum() / mag[1:].sum() / (RATE / 2), abs=1e-9)
    assert small[5].rms == pytest.approx(np.sqrt((win**2).mean()), abs=1e-9)


def test_short_signal_gives_one_silent_frame(spark):
    f = frames_of(pcm_table(spark, {"a": np.ones(500)}, RATE))
    assert list(f) == [0] and f[0].rms == 0


def test_prepare_equals_plain_slicing(spark):
    x = np.linspace(-1, 1, 50001).astype(np.float32)
    for rate in (22050, 44100, 48000):
        pcm = pcm_table(spark, {"a": x}, rate, 7000, channels=2)
        trims = spark.createDataFrame([("a", 0.1003, 0.7)], "song_id string, trim_start double, trim_end double")
        rows = P.prepare_mono(pcm, trims).orderBy("start_sample").collect()
        got = np.concatenate([r.samples for r in rows])
        a, b, f = int(0.1003 * rate), int(0.7 * rate), 2 if rate >= 40000 else 1
        np.testing.assert_allclose(got, x[a:b][::f][: (b - a) // f], atol=1e-6)
        assert [r.start_sample for r in rows] == list(np.cumsum([0] + [len(r.samples) for r in rows])[:-1])


@pytest.fixture(scope="module")
def analysis(spark):
    pcm = settle(pcm_table(spark, {"aba": aba_song(RATE), "click": click(RATE, 100, 30), "quiet": np.zeros(40000)}, RATE))
    return D.analyse(pcm)


def test_tempo_and_beats(analysis):
    bpm = {r.song_id: r.bpm for r in analysis["songs"].collect()}
    assert bpm["aba"] == pytest.approx(120, abs=0.5) and bpm["click"] == pytest.approx(100, abs=0.5) and bpm["quiet"] == 120
    t = [r.t_sec for r in analysis["beats"].filter("song_id = 'aba'").orderBy("beat_idx").collect()]
    assert len(t) > 85 and np.abs(np.diff(t) - 0.5).max() < 0.05


def test_loops_stay_inside_one_section(analysis):
    loops = D.detect_loops(analysis).filter("song_id = 'aba'").collect()
    assert any(r.bars >= 4 for r in loops)
    for r in loops:
        assert r.quality_score >= 0.4 and r.seam_score >= 0.58 and r.context_score >= 0.58
        if r.bars >= 4:
            assert r.homogeneity_score >= 0.86
            assert not any(r.start_sec < edge - 1 and r.end_sec > edge + 1 for edge in (16, 32))


def test_jumps_prefer_matching_material_and_keep_the_meter(analysis):
    j = settle(M.jump_table(analysis)).filter("song_id = 'aba'")
    rows = j.collect()
    assert rows and all((r.exit_beat - r.entry_beat) % 4 == 0 and r.exit_beat != r.entry_beat for r in rows)
    assert j.groupBy("exit_beat").count().agg(F.max("count")).collect()[0][0] <= 8
    best = {r.exit_beat: r for r in rows if r["rank"] == 1}
    inside_b = best[48]
    assert 15 < inside_b.entry_sec < 33 and inside_b.p_good_blended > inside_b.p_good_cut > 0.5


def test_rendered_wav_round_trip(spark):
    x = np.sin(np.arange(16000) / 9.0) * 0.5
    pcm = pcm_table(spark, {"a": x}, RATE, 5000)
    loops = spark.createDataFrame([("a", "1", 0.25, 1.25, 0.035, True)], "song_id string, cand_id string, start_sec double, end_sec double, fade_sec double, normalize boolean")
    wav = X.render_loops(loops, pcm, P.song_lengths(pcm))
    back = P.decode_wav(wav.select("song_id", "content")).collect()[0]
    assert len(back.samples) == 8000 and back.sample_rate == RATE
    assert max(abs(v) for v in back.samples) == pytest.approx(0.89, abs=1e-3)


def test_alignment(spark):
    x = np.random.default_rng(4).uniform(-1, 1, 24000)
    late = np.concatenate([np.zeros(24), x])[: len(x)]
    r = S.align_offsets(pcm_table(spark, {"a": x}, RATE, 6000), pcm_table(spark, {"a": late}, RATE, 6000)).collect()[0]
    assert (r.offset_sec, r.spread_sec) == (24 / RATE, 0.0)


def test_mixdown_adds_overlapping_clips(spark):
    pcm = pcm_table(spark, {"b": np.full(16000, 0.25)}, RATE, 5000)
    cols = "project_id bigint, clip_id string, buffer_id string, start_time double, row int, trim_start double, trim_end double, gain double, fade_in_sec double, fade_out_sec double, speed double"
    clips = spark.createDataFrame([(1, "x", "b", 0.0, 0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0), (1, "y", "b", 1.0, 1, 0.5, 1.5, 2.0, 0.0, 0.0, 1.0)], cols)
    ends = spark.createDataFrame([(1, 8.0)], "project_id bigint, end_sec double")
    out = X.mixdown(clips, pcm, ends, RATE, chunk=4000).orderBy("channel", "out_chunk").collect()
    y = np.concatenate([r.samples for r in out if r.channel == 0])
    assert y[4000] == pytest.approx(0.25) and y[12000] == pytest.approx(0.75) and out[0].n_samples == len(y) == 66000
    assert y[40000:].max() == 0.0 and (np.concatenate([r.samples for r in out if r.channel == 1]) == y).all()


def test_mixdown_refuses_projects_that_need_a_stretch(spark):
    pcm = pcm_table(spark, {"b": np.full(16000, 0.25)}, RATE, 5000)
    cols = "project_id bigint, clip_id string, buffer_id string, start_time double, row int, trim_start double, trim_end double, gain double, fade_in_sec double, fade_out_sec double, speed double"
    clips = spark.createDataFrame([(p, c, "b", 0.0, 0, 0.0, 2.0, 1.0, 0.0, 0.0, s) for p, c, s in [(1, "x", 1.0), (2, "y", 1.0), (2, "z", 1.5)]], cols)
    ends = spark.createDataFrame([(1, 2.0), (2, 2.0)], "project_id bigint, end_sec double")
    assert [(r.project_id, r.clip_id) for r in X.mixdown_problems(clips).collect()] == [(2, "z")]
    assert {r.project_id for r in X.mixdown(clips, pcm, ends, RATE).collect()} == {1}


def _wav(kind: int, bits: int, body: bytes, channels: int = 1, before: bytes = b"", extensible: bool = False) -> bytes:
    frame = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, RATE, RATE * frame, frame, bits)
    if extensible:
        fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", kind) + bytes(14)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    rest = b"WAVE" + before + chunk(b"fmt ", fmt) + chunk(b"LIST", b"data of another chunk") + chunk(b"data", body)
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


def test_wav_kinds_and_rejects(spark):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    files = {
        "u8": _wav(1, 8, (x * 128 + 128).astype(np.uint8).tobytes()),
        "i16": _wav(1, 16, (x * 2**15).astype("<i2").tobytes(), extensible=True),
        "i24": _wav(1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)),
        "i32": _wav(1, 32, (x * 2**31).astype("<i4").tobytes(), before=b"JUNK\x02\x00\x00\x00\x00\x00"),
        "f32": _wav(3, 32, x.astype("<f4").tobytes()),
        "f64": _wav(3, 64, x.astype("<f8").tobytes(), extensible=True),
        "torn": _wav(1, 16, bytes(8))[:-3],
        "text": b"no wav at all",
        "alaw": _wav(6, 8, bytes(4)),
        "none": None,
    }
    table = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "song_id string, content binary")
    got = {r.song_id: np.array(r.samples) for r in P.decode_wav(table).collect()}
    assert got.keys() == {"u8", "i16", "i24", "i32", "f32", "f64"} and all(np.allclose(v, x) for v in got.values())
    assert {r.song_id for r in P.wav_rejects(table).collect()} == {"torn", "text", "alaw", "none"}


def test_many_channels(spark):
    rows = [("a", c, 0, 0, RATE, [1.0, float(c)]) for c in range(70)]
    mono = P.prepare_mono(spark.createDataFrame(rows, PCM_CHUNK)).first()
    assert mono.samples == [1.0, 34.5]
    back = P._wav_samples(P.wav_bytes([np.full(3, c / 10) for c in range(5)], RATE))[1]
    assert back.shape == (3, 5) and np.allclose(back[0], np.arange(5) / 10, atol=1e-4)


def test_sample_rate_of_each_song(spark):
    """The same 120 bpm clicks at three rates in one table."""
    tables = [pcm_table(spark, {f"r{rate}": click(rate, 120.0, 24.0)}, rate, rate) for rate in (8000, 22050, 24000)]
    a = D.analyse(tables[0].union(tables[1]).union(tables[2]))
    songs = {r.song_id: r for r in a["songs"].collect()}
    assert len(songs) == 3 and all(r.bpm == pytest.approx(120.0, abs=0.5) and r.duration_sec == pytest.approx(24.0) for r in songs.values())
    maps = {r.song_id: r for r in M.song_maps(a).collect()}
    assert {r.sampleRate for r in maps.values()} == {8000, 22050, 24000}
    assert all(abs(np.diff(r.beatsSec).mean() - 0.5) < 0.01 for r in maps.values())


def test_fixed_offset_ends_before_the_last_frame():
    """The grid of phase 7.75 ends on the last frame by rounding, which has none after it."""
    from refrain.operators.tempo import fixed_offset

    assert fixed_offset(np.ones(100), 256 / RATE, 164.38356164383563) == 0.0
    flux = np.zeros(100)
    flux[[4, 15, 27]] = 1.0
    assert 3 <= fixed_offset(flux, 256 / RATE, 164.38356164383563) / (256 / RATE) <= 5
