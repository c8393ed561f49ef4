"""WAV files as byte ranges.

A file is planned as partitions of about ``rangeBytes`` bytes; each task reads the file's
header, seeks to its own chunks and decodes one chunk at a time, so neither the driver nor a
task ever holds a file.  Chunks are those of the whole file, wherever it is cut.  RIFF files
and RF64 files (over 4 GB) are read.

Options of the source: ``path`` (a file or folder, by path or uri), ``chunk`` (samples per
row), ``rangeBytes``, ``what`` (``pcm``, or ``rejects`` for the files that can't be read).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from refrain.schemas import PCM_CHUNK
from refrain.sources.files import at, listed

FORMAT = "refrain_wav"
RANGE_BYTES = 64 << 20
CHUNK_SAMPLES = 65536
_WHOLE = 0xFFFFFFFF
_ARROW = pa.schema(
    [("song_id", pa.string()), ("channel", pa.int32()), ("chunk_idx", pa.int64()), ("start_sample", pa.int64()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32()))]
)


class BadWav(ValueError):
    """A file that is no WAV this reader knows; the message names why."""


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are and what they are."""

    kind: int
    bits: int
    channels: int
    rate: int
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def layout(f, size: int) -> Layout:
    """Layout of an open file of ``size`` bytes: first ``fmt `` and ``data`` chunk, wherever they are."""
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise BadWav("no RIFF/WAVE header")
    fmt, data, wide, place = None, None, None, 12
    while place + 8 <= size:
        f.seek(place)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"ds64" and head[:4] == b"RF64" and length >= 16:
            wide = struct.unpack("<QQ", f.read(16))[1]
        if name == b"data" and length == _WHOLE and wide is not None:
            length = wide
        if name in (b"fmt ", b"data") and place + 8 + length > size:
            raise BadWav(f"{name.decode()} chunk is cut short")
        if name == b"fmt " and fmt is None:
            fmt = f.read(min(length, 64))
        elif name == b"data" and data is None:
            data = (place + 8, length)
        place += 8 + length + length % 2
    if fmt is None or data is None:
        raise BadWav("no fmt chunk" if fmt is None else "no data chunk")
    if len(fmt) < 16:
        raise BadWav("format chunk is cut short")
    kind, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", fmt)
    if kind == 0xFFFE and len(fmt) >= 26:  # extensible: the kind is the start of the sub-format
        kind = struct.unpack_from("<H", fmt, 24)[0]
    if not channels or not rate or frame != channels * (bits // 8):
        raise BadWav("format chunk contradicts itself")
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise BadWav(f"kind {kind} with {bits} bits")
    return Layout(kind, bits, channels, rate, data[0], data[1] // frame)


def decoded(raw: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples as 32-bit floats: 8 to 32-bit integers, 32 or 64-bit floats."""
    if kind == 3:
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    if bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4")[:, 0] / float(1 << 31)).astype(np.float32)
    return (np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)


def song_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Part(InputPartition):
    """The ``index``-th of ``count`` runs of chunks of a file."""

    file: str
    size: int
    index: int
    count: int


class WavRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "song_id string, reason string" if self.options.get("what") == "rejects" else PCM_CHUNK

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_RejectReader if self.options.get("what") == "rejects" else WavReader)(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK_SAMPLES))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        found = [(f, size, max(1, -(-size // self.range_bytes))) for f, size in listed(self.path, "*.wav")]
        return [Part(f, size, i, n) for f, size, n in found for i in range(n)] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:  # no files
            return
        store, _ = at(self.path)
        with store.open_input_file(part.file) as f:
            try:
                wav = layout(f, part.size)
            except BadWav:
                return
            chunks = -(-wav.frames // self.chunk)
            for c in range(chunks * part.index // part.count, chunks * (part.index + 1) // part.count):
                yield self._chunk(f, part, wav, c)

    def _chunk(self, f, part: Part, wav: Layout, c: int) -> pa.RecordBatch:
        """One row per channel."""
        first = c * self.chunk
        f.seek(wav.start + first * wav.frame_bytes)
        n = min(self.chunk, wav.frames - first)
        planes = decoded(f.read(n * wav.frame_bytes), wav.kind, wav.bits).reshape(n, wav.channels).T
        k = wav.channels
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * n)
        columns = [
            pa.array([song_name(part.file)] * k), pa.array(range(k), pa.int32()), pa.array([c] * k, pa.int64()), pa.array([first] * k, pa.int64()),
            pa.array([wav.rate] * k, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(planes.ravel())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _RejectReader(WavReader):
    def partitions(self) -> list[Part]:
        return [Part(f, size, 0, 1) for f, size in listed(self.path, "*.wav")] or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.count:
            return
        store, _ = at(self.path)
        with store.open_input_file(part.file) as f:
            try:
                layout(f, part.size)
            except BadWav as e:
                yield song_name(part.file), str(e)


def read_wav(spark: SparkSession, path: str, chunk: int = CHUNK_SAMPLES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pcm_chunk`` rows of all WAV files below a path; files that can't be read give none (``read_wav_rejects``)."""
    spark.dataSource.register(WavRanges)
    return spark.read.format(FORMAT).options(path=path, chunk=chunk, rangeBytes=range_bytes).load()


def read_wav_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, reason) of the WAV files that ``read_wav`` leaves out; only headers are read."""
    spark.dataSource.register(WavRanges)
    return spark.read.format(FORMAT).options(path=path, what="rejects").load()
