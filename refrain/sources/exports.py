"""Exported artefacts: loop manifests, rendered loops, song records, mixdowns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import render as X
from refrain.functions.clips import clip_end, playback_speed
from refrain.functions.exact import half_up, half_up_digits
from refrain.operators.batches import bounded_batches
from refrain.operators.ordered import block_of, dense_index
from refrain.operators.timeline import gain_points
from refrain.schemas import ANALYSIS_VERSION
from refrain.sources.pcm import wav_bytes

SOURCE = ["source_name"]


def resolve_render(candidates: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Render options of each cut: its override, else how it was saved, else a short crossfade without normalising."""
    o = overrides.select(*keys, F.col("fade_sec").alias("__fade"), F.col("normalize").alias("__norm"))
    joined = candidates.join(o, keys, "left")
    pick = lambda over, saved, default: F.when(F.col(over).isNotNull(), F.col(over)).when(F.col("saved_fade_sec").isNotNull(), F.col(saved)).otherwise(F.lit(default))
    return joined.withColumns(
        {"fade_sec": pick("__fade", "saved_fade_sec", 0.035), "normalize": pick("__norm", "saved_normalize", False)}
    ).drop("__fade", "__norm")


def loop_manifest(candidates: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of the manifest of each source.

    ``candidates``: source_name, loop_order, bars, start_sec, end_sec, bpm, four scores,
    score_version, tags, note, fade_sec (requested), normalize.  ``sources``: source_name,
    session_bpm, n_samples, sample_rate.
    """
    numbered = dense_index(candidates, SOURCE, block_of(F.col("loop_order")), ["loop_order"], "idx").join(sources, SOURCE)
    nn = F.col("idx") + 1
    number = F.when(nn < 10, F.lpad(nn.cast("string"), 2, "0")).otherwise(nn.cast("string"))
    feel = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.concat(F.lit("_"), F.concat_ws("-", "tags"))).otherwise(F.lit(""))
    file = F.concat(
        X.safe_stem(F.col("source_name")), F.lit("_loop_"), number, F.lit("_"), F.col("bars").cast("string"), F.lit("bar_"),
        half_up(F.col("bpm")).cast("string"), F.lit("bpm"), feel, F.lit(".wav"),
    )
    fade = X.loop_crossfade_sec(F.col("fade_sec"), F.col("start_sec"), F.col("end_sec"), F.col("n_samples"), F.col("sample_rate"))
    a = F.greatest(F.lit(0), half_up(F.col("start_sec") * F.col("sample_rate")))
    b = F.least("n_samples", F.greatest(a + 1, half_up(F.col("end_sec") * F.col("sample_rate"))))
    scores = ("seam_score", "context_score", "homogeneity_score", "quality_score")
    rows = numbered.select(
        "source_name", "loop_order", file.alias("file"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "note",
        "closure_score", "sample_rate", (b - a).alias("sample_count"), "start_sec", "end_sec", "bars", "bpm",
        F.coalesce("score_version", F.lit(ANALYSIS_VERSION)).alias("score_version"), *[half_up_digits(F.col(c), 3).alias(c) for c in scores],
        fade.alias("wrap_crossfade_sec"), F.col("fade_sec").alias("requested_crossfade_sec"), "normalize", "session_bpm",
    )
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    headers = rows.groupBy(*SOURCE).agg(
        F.lit(ANALYSIS_VERSION).alias("analysis_version"),
        F.when(F.max(F.abs(F.col("bpm") - F.col("session_bpm"))) < 1e-6, F.max("session_bpm")).alias("bpm"),
        F.lit(4).alias("beats_per_bar"), same("wrap_crossfade_sec").alias("wrap_crossfade_sec"), same("normalize").alias("normalize"),
        F.count(F.lit(1)).alias("loops"),
    )
    return rows.drop("session_bpm"), headers


def render_loops(loops: DataFrame, pcm: DataFrame, lengths: DataFrame) -> DataFrame:
    """WAV bytes per loop: slice, crossfade into the continuation, optional peak normalisation.

    ``loops``: song_id, cand_id, start_sec, end_sec, fade_sec, normalize.  A loop is at most
    sixteen bars, so one loop's samples fit a task; loops of a song spread over tasks.
    """
    bounded_batches(pcm.sparkSession)
    at = loops.join(lengths, "song_id")
    size = pcm.groupBy("song_id").agg(F.max(F.size("samples")).alias("chunk"))
    fade = X.loop_crossfade_sec(F.col("fade_sec"), F.col("start_sec"), F.col("end_sec"), F.col("n_samples"), F.col("sample_rate"))
    a = F.greatest(F.lit(0), half_up(F.col("start_sec") * F.col("sample_rate")))
    b = F.least("n_samples", F.greatest(a + 1, half_up(F.col("end_sec") * F.col("sample_rate"))))
    spans = at.join(size, "song_id").withColumns({"a": a, "b": b, "fade": half_up(fade * F.col("sample_rate"))})
    repair = F.greatest(F.lit(2), half_up(0.005 * F.col("sample_rate")))
    spans = spans.withColumn("more", F.when(F.col("n_samples") - F.col("b") >= repair, F.col("fade")).otherwise(F.lit(0)))
    last = F.greatest(F.col("a"), F.least(F.col("n_samples"), F.col("b") + F.col("more")) - 1)
    cells = spans.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("a") / F.col("chunk")), F.floor(last / F.col("chunk")))))
    rows = cells.select("song_id", "cand_id", "chunk_idx", "a", "b", "fade", "more", "normalize", F.col("sample_rate").alias("rate")).join(
        pcm.select("song_id", "channel", "chunk_idx", "start_sample", "samples"), ["song_id", "chunk_idx"]
    )

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        a, b, fade, more = int(r.a), int(r.b), int(r.fade), int(r.more)
        planes = []
        for _, part in pdf.sort_values("start_sample").groupby("channel"):
            x = np.concatenate([np.asarray(s, dtype=np.float64) for s in part["samples"]])
            base = int(part["start_sample"].iloc[0])
            y, cont = x[a - base : b - base].copy(), x[b - base : b - base + more]
            if fade >= 2:
                mix = 0.5 - 0.5 * np.cos(np.pi * np.arange(fade) / (fade - 1))
                source = cont if len(cont) >= fade else y[-1]
                y[:fade] = source * (1 - mix) + y[:fade] * mix
            planes.append(y)
        top = max(float(np.abs(p).max()) for p in planes)
        if bool(r.normalize) and top >= 1e-8:
            planes = [p * (0.89 / top) for p in planes]
        return pd.DataFrame(
            {"song_id": [r.song_id], "cand_id": [r.cand_id], "sample_count": [b - a], "content": [wav_bytes(planes, int(r.rate))]}
        )

    return rows.groupBy("song_id", "cand_id").applyInPandas(render, "song_id string, cand_id string, sample_count bigint, content binary")


def export_problems(requests: DataFrame) -> DataFrame:
    """Requests that cannot be exported, as (source_name, rule).

    ``requests``: source_name, id, start_sec, end_sec, fade_sec, base_frames, top_frames,
    encoded_base, encoded_top, rate, spread_sec.
    """
    total = F.least("base_frames", "top_frames")
    reach = (F.col("end_sec") + F.col("fade_sec") / 2) * F.col("rate")
    rules = {
        "bad-id": ~X.is_song_id(F.col("id")),
        "loop-outside": (F.col("start_sec") < 0) | (F.col("end_sec") <= F.col("start_sec")) | (reach > total),
        "length-mismatch": (F.col("encoded_base") != F.col("encoded_top")) | (F.col("encoded_base") != total),
        "drifting": F.col("spread_sec") > X.MAX_OFFSET_SPREAD_SEC,
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return requests.select("source_name", F.explode(hits).alias("rule"))


def song_records(requests: DataFrame) -> DataFrame:
    """Song JSON per valid request: loudness gain and loop points moved by a constant encoder delay."""
    shift = X.encoder_shift(F.col("offset_sec"))
    gain = X.normalize_gain_db(F.col("lufs"), F.col("true_peak_db"))
    title = F.when(F.trim("title") == "", F.col("id")).otherwise(F.trim("title"))
    fields = {
        "id": F.col("id"), "title": title, "source_name": F.col("source_name"), "bpm": F.col("bpm"), "duration_sec": F.col("duration_sec"),
        "start_sec": F.col("start_sec") + shift, "end_sec": F.col("end_sec") + shift, "fade_sec": F.col("fade_sec"),
        "lufs": F.col("lufs") + gain, "gain_db": gain,
    }
    notes = F.array_compact(
        F.array(
            F.when(X.limited_loudness(F.col("lufs"), F.col("true_peak_db")), F.lit("limited-loudness")),
            F.when(shift != 0, F.lit("moved-loop-points")),
        )
    )
    return requests.select("source_name", "id", X.song_json(fields).alias("json"), notes.alias("notes"))


def mixdown_problems(clips: DataFrame) -> DataFrame:
    """Clips that ``mixdown`` can't place, as (project_id, clip_id, rule): those that need a time stretch."""
    stretched = ~F.coalesce(F.abs(playback_speed() - 1.0) < 1e-6, F.lit(False))
    return clips.filter(stretched).select("project_id", "clip_id", F.lit("needs-stretch").alias("rule"))


def mixdown(clips: DataFrame, pcm: DataFrame, ends: DataFrame, rate: int, master: Column | float = 1.0, chunk: int = 65536, salts: int = 16) -> DataFrame:
    """Sum of all clips per project: gain automation times samples, in output chunks of (project_id, channel, out_chunk, samples, n_samples).

    ``pcm``: song_id = buffer_id, at ``rate``; ``ends``: project_id, end_sec.  Every clip meets
    only the chunks inside its trim; overlapping pieces are added per salt first, then per chunk.
    Two channels at least, a mono buffer on both; silent chunks are there, and the last one
    ends with the mix.  A project with a clip of ``mixdown_problems`` has no mix.
    """
    failed = mixdown_problems(clips).select("project_id").distinct()
    clips, ends = clips.join(failed, "project_id", "left_anti"), ends.join(failed, "project_id", "left_anti")
    planes = pcm.groupBy("song_id").agg((F.max("channel") == 0).alias("__mono"))
    onto = F.when(F.col("__mono"), F.array(F.lit(0), F.lit(1))).otherwise(F.array("channel"))
    pcm = pcm.join(planes, "song_id").withColumn("channel", F.explode(onto)).drop("__mono")
    points = gain_points(clips).groupBy("project_id", "clip_id").agg(
        F.array_sort(F.collect_list(F.struct("point", "time_sec", "value"))).alias("points")  # a few hundred per clip
    )
    size = pcm.groupBy("song_id").agg(F.max(F.size("samples")).alias("size"))
    plain = clips.withColumn("song_id", F.col("buffer_id")).withColumn("fin", clip_end())
    cells = plain.join(points, ["project_id", "clip_id"]).join(size, "song_id").withColumn(
        "chunk_idx",
        F.explode(F.sequence(F.floor(F.col("trim_start") * rate / F.col("size")), F.floor(F.col("trim_end") * rate / F.col("size")))),
    )
    gain = master if isinstance(master, Column) else F.lit(float(master))
    rows = cells.join(pcm.select("song_id", "channel", "chunk_idx", "start_sample", "samples"), ["song_id", "chunk_idx"]).select(
        "project_id", "clip_id", "channel", "start_time", "trim_start", "trim_end", "start_sample", "samples",
        F.transform("points", lambda p: p["time_sec"]).alias("pt"), F.transform("points", lambda p: p["value"]).alias("pv"),
        F.least(F.lit(4.0), F.greatest(F.lit(0.0), gain)).alias("master"),
    )
    schema = "project_id bigint, channel int, out_chunk bigint, start int, samples array<double>, salt int"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lo = max(int(r.start_sample), math.floor(r.trim_start * rate + 0.5))
                hi = min(int(r.start_sample) + len(r.samples), math.floor(r.trim_end * rate + 0.5))
                if hi <= lo:
                    continue
                x = np.asarray(r.samples, dtype=np.float64)[lo - r.start_sample : hi - r.start_sample]
                first = math.floor(r.start_time * rate + 0.5) + lo - math.floor(r.trim_start * rate + 0.5)
                t = (first + np.arange(len(x))) / rate
                y = x * np.interp(t, r.pt, r.pv) * r.master
                for c in range(first // chunk, (first + len(y) - 1) // chunk + 1):
                    a, b = max(first, c * chunk), min(first + len(y), (c + 1) * chunk)
                    out.append((r.project_id, r.channel, c, a - c * chunk, y[a - first : b - first], crc32(str(r.clip_id).encode()) % salts))
            yield pd.DataFrame(out, columns=["project_id", "channel", "out_chunk", "start", "samples", "salt"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(max(int(s) + len(x) for s, x in zip(pdf["start"], pdf["samples"])))
        for s, x in zip(pdf["start"], pdf["samples"]):
            total[s : s + len(x)] += x
        head = pdf.iloc[0]
        return pd.DataFrame({**{c: [head[c]] for c in ("project_id", "channel", "out_chunk")}, "start": [0], "samples": [total], "salt": [0]})

    keys = ["project_id", "channel", "out_chunk"]
    pieces = rows.mapInPandas(place, schema)
    partial = pieces.groupBy(*keys, "salt").applyInPandas(add, schema)
    summed = partial.groupBy(*keys).applyInPandas(add, schema).drop("salt", "start")
    whole = ends.withColumn("n_samples", F.ceil((F.col("end_sec") + 0.25) * rate)).drop("end_sec")
    channels = summed.groupBy("project_id").agg(F.max("channel").alias("__top"))
    cells = (
        whole.join(channels, "project_id", "left")
        .withColumn("channel", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce("__top", F.lit(1))))))
        .withColumn("out_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n_samples") / chunk) - 1)))
    )
    room = F.least(F.lit(chunk), F.col("n_samples") - F.col("out_chunk") * chunk).cast("int")
    heard = F.slice(F.coalesce("samples", F.array().cast("array<double>")), F.lit(1), room)
    filled = F.concat(heard, F.array_repeat(F.lit(0.0), room - F.size(heard)))
    return cells.join(summed, keys, "left").select(*keys, filled.alias("samples"), "n_samples")
