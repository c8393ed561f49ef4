"""Clip arithmetic on the timeline: speed, ends, source positions, fades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions.exact import clamp, clamp01

SPEED_RANGE = (0.2, 3.0)
GAIN_RANGE = (0.0, 4.0)
FADE_RANGE = (0.0, 60.0)
PROJECT_MIN_SEC = 8.0


def playback_speed(speed: Column | str = "speed") -> Column:
    return clamp(F.col(speed) if isinstance(speed, str) else speed, *SPEED_RANGE)


def clip_duration() -> Column:
    return F.greatest(F.lit(0.0), F.col("trim_end") - F.col("trim_start")) / playback_speed()


def clip_end() -> Column:
    return F.col("start_time") + clip_duration()


def source_time(t: Column) -> Column:
    return F.col("trim_start") + (t - F.col("start_time")) * playback_speed()


def fade_multiplier(t: Column, end: Column) -> Column:
    """Product of the linear fade-in and fade-out at timeline time ``t``."""
    start, fade_in, fade_out = F.col("start_time"), F.col("fade_in_sec"), F.col("fade_out_sec")
    rising = F.when((fade_in > 0) & (t < start + fade_in), clamp01((t - start) / fade_in)).otherwise(F.lit(1.0))
    falling = F.when((fade_out > 0) & (t > end - fade_out), clamp01((end - t) / fade_out)).otherwise(F.lit(1.0))
    return rising * falling
