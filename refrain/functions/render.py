"""Fades, blends, names and export rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions.exact import clamp01, half_up, half_up_digits

TARGET_LUFS, MAX_TRUE_PEAK_DB = -14.0, -1.0
EQUAL_POWER_MIN_SEC = 0.3
MAX_OFFSET_SPREAD_SEC, MIN_SHIFT_SEC = 0.001, 0.0005


def fade_gain(x: Column, fade_sec: Column, rising: bool) -> Column:
    """Equal-power gain for real blends, linear for click repairs; ``x`` runs 0..1."""
    t = clamp01(x)
    u = t if rising else 1.0 - t
    return F.when(fade_sec >= EQUAL_POWER_MIN_SEC, F.sin(u * math.pi / 2)).otherwise(u)


def fade_curve(fade_sec: Column, rising: bool, points: int = 128) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: fade_gain(i / float(points - 1), fade_sec, rising))


def blend_sec(choice: Column, bpm: Column) -> Column:
    beat = 60.0 / bpm
    return (
        F.when(choice == "click", F.lit(0.035))
        .when(choice == "half-beat", beat / 2)
        .when(choice == "beat", beat)
        .when(choice == "bar", beat * 4)
        .when(choice == "second", F.lit(1.0))
    )


def clamp_fade(fade: Column, start: Column, end: Column, duration: Column) -> Column:
    room = F.least(end - start, 2 * start, 2 * (duration - end))
    return F.greatest(F.lit(0.0), F.least(fade, room))


def source_time_at(start: Column, end: Column, t: Column) -> Column:
    period = end - start
    return F.when((t < end) | (period <= 0), t).otherwise(start + F.pmod(t - end, period))


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def song_id_from_name(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(_without_extension(name)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("song")).otherwise(slug)


def title_from_name(name: Column) -> Column:
    """Words separated by spaces, every word character after a word break in upper case."""
    text = F.regexp_replace(F.regexp_replace(_without_extension(name), "[_-]+", " "), r"\s+", " ")
    pieces = F.split(F.trim(text), r"(?<=\W)(?=\w)")
    raised = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[A-Za-z0-9_]"), raised(w)).otherwise(w)), "")


def is_song_id(song_id: Column) -> Column:
    return song_id.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def safe_stem(name: Column) -> Column:
    safe = F.regexp_replace(_without_extension(name), "[^a-zA-Z0-9._-]+", "_")
    safe = F.regexp_replace(safe, "^_|_$", "")
    return F.when(safe == "", F.lit("loop")).otherwise(safe)


def normalize_gain_db(lufs: Column, true_peak_db: Column) -> Column:
    return F.least(TARGET_LUFS - lufs, MAX_TRUE_PEAK_DB - true_peak_db)


def limited_loudness(lufs: Column, true_peak_db: Column) -> Column:
    """True when the peak limit keeps the song more than half a unit below the target."""
    return lufs + normalize_gain_db(lufs, true_peak_db) < TARGET_LUFS - 0.5


def loop_crossfade_sec(requested: Column, start: Column, end: Column, length: Column, rate: Column) -> Column:
    """Crossfade that fits: real continuation, else a short repair, at most a quarter of the loop.

    ``length`` and ``rate`` are the source's samples and sample rate.
    """
    a = F.greatest(F.lit(0), half_up(start * rate))
    b = F.least(length, half_up(end * rate))
    repair = F.greatest(F.lit(2), half_up(0.005 * rate))
    left = length - b
    available = F.when(left >= repair, left).otherwise(repair)
    sane = requested.isNotNull() & ~F.isnan(requested) & (F.abs(requested) < float("inf"))
    wanted = F.when(sane, F.greatest(F.lit(0), half_up(requested * rate))).otherwise(F.lit(0))
    count = F.greatest(F.lit(0), F.least(wanted, available, F.floor((b - a) / 4)))
    return F.when(count >= 2, count).otherwise(F.lit(0)) / rate


def bake_crossfade(head: Column, continuation: Column, last: Column, fade: Column) -> Column:
    """Raised-cosine blend of the source's continuation into the first ``fade`` samples of a loop.

    ``continuation`` may be null at the end of the source; the last sample is held then.
    """
    n = F.size(head)
    usable = F.greatest(F.lit(0), F.least(fade, F.floor(n / 4).cast("int")))
    mix = lambda i: 0.5 - 0.5 * F.cos(F.lit(math.pi) * i / (usable - 1))
    enough = continuation.isNotNull() & (F.size(continuation) >= usable)
    source = lambda i: F.when(enough, F.get(continuation, i)).otherwise(last)
    blended = F.transform(head, lambda s, i: F.when(i < usable, source(i) * (1 - mix(i)) + s * mix(i)).otherwise(s))
    return F.when(usable < 2, head).otherwise(blended)


def encoder_shift(offset: Column) -> Column:
    """Constant encoder delay worth moving the loop points for."""
    return F.when(F.abs(offset) >= MIN_SHIFT_SEC, offset).otherwise(F.lit(0.0))


def song_json(prefix: dict[str, Column]) -> Column:
    """The exported song record as JSON text."""
    ms = lambda c: half_up_digits(c, 3)
    return F.to_json(
        F.struct(
            F.lit("game-song-v1").alias("version"),
            prefix["id"].alias("id"),
            prefix["title"].alias("title"),
            prefix["source_name"].alias("sourceName"),
            half_up_digits(prefix["bpm"], 3).alias("bpm"),
            ms(prefix["duration_sec"]).alias("durationSec"),
            F.struct(
                ms(prefix["start_sec"]).alias("startSec"), ms(prefix["end_sec"]).alias("endSec"), ms(prefix["fade_sec"]).alias("fadeSec")
            ).alias("loop"),
            F.struct(
                half_up_digits(prefix["lufs"], 1).alias("integratedLufs"), half_up_digits(prefix["gain_db"], 2).alias("gainDb")
            ).alias("loudness"),
        )
    )
