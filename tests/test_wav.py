"""WAV files read by byte ranges equal the whole-file decoder."""

import struct

import numpy as np
import pytest

from refrain.sources import pcm as P
from refrain.sources import wav as W
from tests.test_signal import _wav

COLUMNS = ["song_id", "channel", "chunk_idx", "start_sample", "sample_rate", "samples"]


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**15), 2**15, (20_011, 8)).astype("<i2")
    files = {
        "eight.wav": _wav(1, 16, x.tobytes(), channels=8, before=b"JUNK\x02\x00\x00\x00\x00\x00"),
        "sub/mono24.wav": _wav(1, 24, rng.bytes(3 * 5003)),
        "short.wav": _wav(3, 32, np.array([0.5], "<f4").tobytes()),
        "empty.wav": _wav(1, 16, b""),
        "odd.wav": _wav(1, 16, bytes(7), channels=2),  # a cut last frame
        "torn.wav": _wav(1, 16, bytes(8))[:-3],
        "text.wav": b"no wav at all",
        "nothing.wav": b"",
        "alaw.wav": _wav(6, 8, bytes(4)),
        "notes.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_ranges_equal_whole_files(spark, folder):
    whole = spark.createDataFrame([(p.stem, bytearray(p.read_bytes())) for p in folder.rglob("*.wav")], "song_id string, content binary")
    expected = rows(P.decode_wav(whole, 512))
    size = (folder / "eight.wav").stat().st_size
    cut = W.read_wav(spark, str(folder), chunk=512, range_bytes=-(-size // 16))
    assert rows(cut) == expected and len(expected) > 8 * 39
    reader = W.WavReader({"path": str(folder), "chunk": "512", "rangeBytes": str(-(-size // 16))})
    parts = [p for p in reader.partitions() if p.file.endswith("eight.wav")]
    assert len(parts) == 16
    held = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(held) == 8 * 40 and max(held) <= 8 * 3  # chunks are dealt evenly, and yielded one at a time
    assert all(b.num_rows == 8 for b in reader.read(parts[3]))
    assert rows(W.read_wav(spark, str(folder), chunk=512)) == expected
    assert rows(W.read_wav(spark, f"file://{folder}", chunk=512, range_bytes=999)) == expected


def test_rejects_name_their_reason(spark, folder):
    got = {r.song_id: r.reason for r in W.read_wav_rejects(spark, str(folder)).collect()}
    assert got == {"torn": "data chunk is cut short", "text": "no RIFF/WAVE header", "nothing": "no RIFF/WAVE header", "alaw": "kind 6 with 8 bits"}


def test_long_file_header(spark, tmp_path):
    body = np.arange(-50, 50, dtype="<i2").tobytes()
    plain = _wav(1, 16, body)
    at = plain.index(b"data" + struct.pack("<I", len(body)))
    wide = b"ds64" + struct.pack("<IQQQI", 28, 0, len(body), 100, 0)
    long = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + wide + plain[12:at] + b"data" + struct.pack("<I", 0xFFFFFFFF) + body
    (tmp_path / "long.wav").write_bytes(long)
    (tmp_path / "plain.wav").write_bytes(plain)
    got = {r[0]: r[1:] for r in rows(W.read_wav(spark, str(tmp_path)))}
    assert got["long"] == got["plain"] and len(got["long"][-1]) == 100


def test_empty_folder(spark, tmp_path):
    assert rows(W.read_wav(spark, str(tmp_path))) == [] and W.read_wav_rejects(spark, str(tmp_path)).count() == 0
    assert P.read_pcm(spark, str(tmp_path)).columns == COLUMNS
