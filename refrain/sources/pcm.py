"""PCM tables: WAV files in and out, preparation for analysis, layer mixing.

A signal is rows of ``pcm_chunk`` (song_id, channel, chunk_idx, start_sample, sample_rate,
samples); one row holds a few seconds, never a whole song and never one sample.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators.batches import bounded_batches
from refrain.schemas import PCM_CHUNK
from refrain.sources.wav import CHUNK_SAMPLES, BadWav, decoded, layout, read_wav


def _wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples[frames, channels]) of the bytes of a whole WAV file."""
    wav = layout(io.BytesIO(data), len(data))
    raw = data[wav.start : wav.start + wav.frames * wav.frame_bytes]
    return wav.rate, decoded(raw, wav.kind, wav.bits).reshape(-1, wav.channels)


def decode_wav(files: DataFrame, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Chunks of WAV contents (song_id, content), a few files per batch; files that can't be read give none (``wav_rejects``)."""
    bounded_batches(files.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for song, data in zip(batch["song_id"], batch["content"]):
                try:
                    rate, pcm = _wav_samples(bytes(data))
                except BadWav:
                    continue
                for c in range(pcm.shape[1] if len(pcm) else 0):
                    starts = range(0, len(pcm), chunk)
                    yield pd.DataFrame(
                        {
                            "song_id": song,
                            "channel": np.int32(c),
                            "chunk_idx": [s // chunk for s in starts],
                            "start_sample": list(starts),
                            "sample_rate": np.int32(rate),
                            "samples": [pcm[s : s + chunk, c] for s in starts],
                        }
                    )

    return files.dropna(subset=["content"]).select("song_id", "content").mapInPandas(decode, PCM_CHUNK)


def wav_rejects(files: DataFrame) -> DataFrame:
    """(song_id, reason) of the WAV contents that ``decode_wav`` leaves out."""
    bounded_batches(files.sparkSession)

    @F.pandas_udf("string")
    def reason(contents: pd.Series) -> pd.Series:
        def why(data: bytes | None) -> str | None:
            if data is None:
                return "no content"
            try:
                _wav_samples(bytes(data))
            except BadWav as e:
                return str(e)
            return None

        return contents.map(why).astype(object)

    return files.select("song_id", reason("content").alias("reason")).filter("reason IS NOT NULL")


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    """PCM of all WAV files below a path, each file cut into byte ranges; see :mod:`refrain.sources.wav`."""
    return read_wav(spark, path)


def sum_channels(pcm: DataFrame, scale: Column) -> DataFrame:
    """Channels of each chunk added sample by sample, times ``scale`` (may use ``channels``)."""
    grouped = pcm.groupBy("song_id", "chunk_idx", "start_sample", "sample_rate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda c: c["samples"]).alias("parts"),
        F.count(F.lit(1)).alias("channels"),
    )
    added = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")),
        F.transform(F.element_at("parts", 1), lambda x: x.cast("double")),
        lambda acc, p: F.zip_with(acc, p, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b.cast("double"), F.lit(0.0))),
    )
    return grouped.select(
        "song_id", F.lit(0).alias("channel"), "chunk_idx", "start_sample", "sample_rate",
        F.transform(added, lambda x: (x * scale).cast("float")).alias("samples"),
    )


def song_lengths(pcm: DataFrame) -> DataFrame:
    return pcm.groupBy("song_id").agg(
        F.max(F.col("start_sample") + F.size("samples")).alias("n_samples"), F.max("sample_rate").alias("sample_rate")
    )


def prepare_mono(pcm: DataFrame, trims: DataFrame | None = None) -> DataFrame:
    """Trimmed, averaged to mono, and halved in rate from 40 kHz on; samples are re-indexed from 0.

    ``trims``: song_id, trim_start, trim_end in seconds (default: the whole song).
    """
    lengths = song_lengths(pcm)
    mono = sum_channels(pcm, 1.0 / F.col("channels"))
    if trims is None:
        bounds = lengths.select("song_id", F.lit(0).cast("bigint").alias("a"), F.col("n_samples").alias("b"))
    else:
        a = F.greatest(F.lit(0), F.floor(F.col("trim_start") * F.col("sample_rate")))
        b = F.least(F.col("n_samples"), F.greatest(a + 1, F.floor(F.col("trim_end") * F.col("sample_rate"))))
        bounds = lengths.join(trims, "song_id").select("song_id", a.alias("a"), b.alias("b"))
    factor = F.when(F.col("sample_rate") >= 40000, 2).otherwise(1)
    x = mono.join(bounds, "song_id").withColumn("f", factor)
    at = lambda i: F.col("start_sample") + i - F.col("a")
    n_out = F.floor((F.col("b") - F.col("a")) / F.col("f"))
    kept = F.filter("samples", lambda s, i: (at(i) >= 0) & (at(i) % F.col("f") == 0) & (at(i) / F.col("f") < n_out))
    first = F.greatest(F.lit(0), F.ceil((F.col("start_sample") - F.col("a")) / F.col("f")))
    # In its own step: a lambda would resolve start_sample to the alias of the same select.
    x = x.withColumn("kept", kept)
    out = x.select(
        "song_id", F.lit(0).alias("channel"), "chunk_idx", first.alias("start_sample"),
        (F.col("sample_rate") / F.col("f")).cast("int").alias("sample_rate"), F.col("kept").alias("samples"),
    ).filter(F.size("samples") > 0)
    lead = out.groupBy("song_id").agg(F.min("chunk_idx").alias("__first"))
    return out.join(lead, "song_id").withColumn("chunk_idx", F.col("chunk_idx") - F.col("__first")).drop("__first")


def mix_layers(a: DataFrame, b: DataFrame, *, pad: bool = False) -> DataFrame:
    """Sum of two equally chunked signals: cut to the shorter one, or zero-padded to the longer."""
    keys = ["song_id", "channel", "chunk_idx", "start_sample", "sample_rate"]
    right = b.select(*keys, F.col("samples").alias("other"))
    if pad:
        joined = a.join(right, keys, "full_outer")
        empty = F.array().cast("array<float>")
        x, y = F.coalesce("samples", empty), F.coalesce("other", empty)
        zero = F.lit(0.0).cast("float")
        mixed = F.zip_with(x, y, lambda p, q: F.coalesce(p, zero) + F.coalesce(q, zero))
    else:
        joined = a.join(right, keys)
        n = F.least(F.size("samples"), F.size("other"))
        mixed = F.zip_with(F.slice("samples", F.lit(1), n), F.slice("other", F.lit(1), n), lambda p, q: p + q)
    return joined.select(*keys, mixed.alias("samples"))


def fit_length(pcm: DataFrame, lengths: DataFrame) -> DataFrame:
    """Pad or trim every signal to its source's length (song_id, n_samples)."""
    n = F.col("n_samples")
    ends = pcm.groupBy("song_id", "channel").agg(F.max("chunk_idx").alias("__last"))
    x = pcm.join(lengths.select("song_id", "n_samples"), "song_id").join(ends, ["song_id", "channel"])
    room = F.greatest(F.lit(0), n - F.col("start_sample")).cast("int")
    cut = F.slice("samples", F.lit(1), F.least(room, F.size("samples")))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), room - F.size("samples")))
    fitted = F.when(F.col("chunk_idx") == F.col("__last"), F.concat(cut, zeros)).otherwise(cut)
    return x.withColumn("samples", fitted).filter(F.size("samples") > 0).select(*pcm.columns)


def wav_bytes(channels: list[np.ndarray], rate: int) -> bytes:
    """16-bit PCM WAV of the float channels; rounding ties go up."""
    planes = np.stack(channels, axis=1).astype(np.float64)
    ints = np.floor(np.clip(planes, -1.0, 1.0) * 32767.0 + 0.5).clip(-32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(planes.shape[1])
        w.setsampwidth(2)
        w.setframerate(int(rate))
        w.writeframes(ints.tobytes())
    return out.getvalue()
