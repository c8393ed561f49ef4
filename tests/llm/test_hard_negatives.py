import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import hard_negatives as hn
from refrain.llm.hard_negatives import _Grid, _Tile, _Window, hard_negatives, walk_tile

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row string, q string, rank double, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], c, 1, "r", "q", 0.5, "s") for i, v, c in rows], SCHEMA)


def brute(rows, every=100, k=5):
    """Expected rows: all pairs, sorted."""
    taken = []
    for i, v, c in rows:
        if i is None or v is None or c is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**18 for x in v):
            continue
        taken.append((i, [math.floor(256 * float(np.float32(x))) for x in v], c))
    out = []
    for i, v, c in taken:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, w, d in taken if j != i]
        for less, j, _ in sorted(x for x in scored if x[2] == c)[:k]:
            fits = sorted(x for x in scored if x[2] != c and -80 * less <= -100 * x[0] <= -100 * less)[:k]
            out += [(i, j, r, x[1], -less, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def vectors(seed, n, dims, labels=3, coarse=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) / math.sqrt(dims)
    if coarse:  # few values: many ties
        v = np.round(v * 4) / 4
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_equals_all_pairs(spark, monkeypatch, coarse):
    monkeypatch.setattr(hn, "TILE_ROWS", 150)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn, "STRIPE_TILES", 2)
    rows = vectors(5, 900, 6, coarse=coarse)
    rows += [(900, rows[100][1], rows[100][2]), (901, rows[100][1], 1 - min(rows[100][2], 1))]  # an anchor's copy with its label, and with another
    got = mined(table(spark, rows))
    assert got == brute(rows) and len(got) > 50


def test_nulls_lengths_repeats_and_large_components(spark):
    rows = vectors(6, 300, 4)
    rows += [(None, [0.1] * 4, 1), (400, None, 1), (500, [0.1] * 4, None), (600, [0.1, None, 0.1, 0.1], 1), (700, [float("nan")] * 4, 1), (701, [float("inf"), 0, 0, 0], 1)]
    rows += [(702, [2.0**18, 0, 0, 0], 0), (703, [5e4, -5e4, 0, 0], 0), (800, [9e4, 8e4, 0, 0], 0), (804, [7e4, 8e4, 0, 0], 1)]
    rows += [(900, [], 0), (905, [0.5], 1), (1000, [0.0] * 4, 2), (200, rows[200][1], rows[200][2]), (7, rows[7][1], rows[7][2])]
    assert mined(table(spark, rows)) == brute(rows)


def test_empty_and_without_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [0.1], 1), (2, [0.2], 2)])) == []


def test_threshold_stops_early_and_keeps_ties():
    """Lists that fall steeply end after the first rounds; a row that ties with the k-th score is still met."""
    rng = np.random.default_rng(1)
    q = rng.integers(-3, 4, (2000, 8)).astype(np.int32)
    q[:12] = 100
    ids = np.arange(2000)[::-1].astype("<i8")
    packed = {"ids": ids.tobytes(), "labels": np.zeros(2000, "<i8").tobytes(), "q": q.astype("<i4").tobytes()}
    tile = _Tile(packed, _Grid(2000, 1, 8, 100))
    window = _Window(True, -(1 << 62), 1 << 62, 5)
    met = walk_tile(tile, np.ones(8, np.float32), -1, 0, [window])
    assert met < 1000
    assert window.best == [(-800, 1988 + i) for i in range(5)]
