"""Distances between feature vectors and frames as higher-order column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions.exact import clamp, clamp01


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(a: Column) -> Column:
    norm = F.coalesce(F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)), F.lit(1.0))
    return bound(norm, lambda n: F.transform(a, lambda x: x / n))


def cosine_unit(a: Column, b: Column) -> Column:
    """Similarity of two unit vectors, 0..1."""
    return clamp01(dot(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two raw vectors; two silent ones count as equal."""
    den = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(den < 1e-12, F.lit(1.0)).otherwise(clamp01(dot(a, b) / den))


def ratio_sim(a: Column, b: Column) -> Column:
    return F.least(F.abs(a), F.abs(b)) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-8))


def frame_vibe_sim(f: Column, g: Column) -> Column:
    """Harmony, timbre, spectrum and loudness must all agree, so the worst of them weighs most.

    ``f`` and ``g`` are frame structs (chroma, timbre, spec, rms, centroid).
    """
    harmony = cosine_unit(f["chroma"], g["chroma"])
    timbre = cosine_unit(f["timbre"], g["timbre"])
    spectrum = cosine(f["spec"], g["spec"])
    energy = ratio_sim(f["rms"], g["rms"])
    bright = 1.0 - F.least(F.lit(1.0), F.abs(f["centroid"] - g["centroid"]) / 0.2)
    parts = {"h": harmony, "t": timbre, "s": spectrum, "e": energy, "b": bright}

    def mixed(p: Column) -> Column:
        worst = F.least(p["h"], p["t"], p["s"], p["e"])
        mean = (p["h"] + p["t"] + p["s"] + p["e"] + p["b"]) / 5.0
        return clamp01(worst * 0.55 + mean * 0.45)

    return bound(F.struct(*[c.alias(n) for n, c in parts.items()]), mixed)


def spec_distance(a: Column, b: Column, rms_a: Column, rms_b: Column) -> Column:
    """Spectral shape distance plus a bounded loudness difference."""
    level = F.abs(F.log(rms_a + 1e-6) - F.log(rms_b + 1e-6)) / math.log(8.0)
    return (1.0 - cosine(a, b)) + 0.75 * F.least(F.lit(1.0), level)


def band_delta(a: Column, b: Column) -> Column:
    """Mean absolute band difference in which inaudible bands count less."""
    weights = F.zip_with(a, b, lambda x, y: F.least(F.lit(1.0), F.greatest(x, y) / 0.5))
    deltas = F.zip_with(a, b, lambda x, y: F.least(F.lit(1.0), F.greatest(x, y) / 0.5) * F.abs(x - y))
    return total(deltas) / F.greatest(F.lit(1.0), total(weights))


__all__ = [
    "band_delta", "bound", "clamp", "cosine", "cosine_unit", "dot", "frame_vibe_sim", "l2_normalize",
    "ratio_sim", "spec_distance", "total",
]
