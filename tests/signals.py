"""Deterministic test signals as PCM chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd

from refrain.schemas import PCM_CHUNK


def aba_song(rate: int = 8000) -> np.ndarray:
    """48 s at 120 BPM: A (16 s), a different B, then A again, with clicks on every beat."""
    n = 48 * rate
    t = np.arange(n) / rate
    b = (t >= 16) & (t < 32)
    x = np.where(b, 0.3 * np.sin(2 * np.pi * 330 * t) + 0.2 * np.sin(2 * np.pi * 1320 * t), 0.3 * np.sin(2 * np.pi * 220 * t))
    noise = np.random.default_rng(1).uniform(-1, 1, int(0.02 * rate))
    for beat in range(96):
        at = int(beat * 0.5 * rate)
        x[at : at + len(noise)] += 0.6 * noise * np.linspace(1, 0, len(noise))
    return x


def click(rate: int, bpm: float, sec: float) -> np.ndarray:
    x, period, size = np.zeros(int(sec * rate)), round(60 / bpm * rate), int(0.004 * rate)
    for at in range(0, len(x), period):
        tail = 0.4 * (1 - np.arange(size) / size)
        tail[0] = 1.0
        m = min(size, len(x) - at)
        x[at : at + m] = tail[:m]
    return x


def pcm_table(spark, songs: dict[str, np.ndarray], rate: int, chunk: int = 32768, channels: int = 1):
    rows = []
    for name, x in songs.items():
        for c in range(channels):
            for i, s in enumerate(range(0, len(x), chunk)):
                rows.append((name, c, i, s, rate, [float(v) for v in x[s : s + chunk]]))
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in PCM_CHUNK.split(", ")]), PCM_CHUNK)
