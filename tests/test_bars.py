"""Suggestion rules on a small song and against brute force on random songs."""

import random

import pytest

from refrain.operators import bars as B
from refrain.operators import suggest as S

BAR = "song_id string, bar_idx int, start_sec double, end_sec double, base_db double, top_db double, gain double"
VOTES = "song_id string, exit_sec double, entry_sec double, rating string, vote_seq bigint"


def song(levels, name="s", gain=0.25):
    return [(name, i, i * 2.5, (i + 1) * 2.5, float(db), -20.0, gain) for i, db in enumerate(levels)]


@pytest.fixture(scope="module")
def levels():
    return [-40] * 8 + [-12] * 80 + [-35] * 4 + [-12] * 8


def test_intro_and_breakdown(spark, levels):
    bars = B.classify_bars(spark.createDataFrame(song(levels), BAR))
    quiet = {r.bar_idx: r.quiet for r in bars.collect()}
    assert quiet[0] and not quiet[8] and quiet[89]
    assert B.intro_end(bars).collect()[0].intro_bar == 8
    got = S.rank_suggestions(bars, spark.createDataFrame([], VOTES)).collect()
    assert got
    for r in got:
        first, last = r.start_sec / 2.5, r.end_sec / 2.5
        assert first >= 8 and not (first < 88 and last > 91)


def test_off_grid_vote_ranks_first(spark, levels):
    bars = B.classify_bars(spark.createDataFrame(song(levels), BAR))
    votes = spark.createDataFrame([("s", 70 * 2.5 + 0.6, 20 * 2.5 + 0.6, "good", 1)], VOTES)
    best = S.rank_suggestions(bars, votes).filter("rank = 1").collect()[0]
    assert (round(best.end_sec, 6), best.prior) == (175.6, "good")


def brute(levels, gains, votes, count=8):
    n = len(levels)
    order = sorted(levels)
    quiet = [x < order[min(n - 1, int(0.75 * (n - 1) + 0.5))] - 9 for x in levels]
    intro = next((i for i in range(n - 3) if not any(quiet[i : i + 4])), 0)
    found = []
    for x in range(intro + 2, n):
        for e in range(intro, x):
            length = (x - e) * 2.5
            if x < 2 or length < 60 or quiet[e] or (e + 1 < n and quiet[e + 1]) or quiet[x - 1] or quiet[x - 2]:
                continue
            if any(all(quiet[i : i + 3]) for i in range(e, x - 2)):
                continue
            rated = [r for vx, ve, r in votes if abs(vx - x * 2.5) <= 0.06 and abs(ve - e * 2.5) <= 0.06]
            if "bad" in rated:
                continue
            lo = hi = x - 1
            while lo > 0 and not quiet[lo - 1]:
                lo -= 1
            while hi + 1 < n and not quiet[hi + 1]:
                hi += 1
            late = 1 if hi == lo else (x - 1 - lo) / (hi - lo)
            score = gains[x] + gains[e] + 0.3 * min(1, length / 90) + 0.1 * late - 0.1 * sum(quiet[e:x]) + (0.5 if rated else 0)
            found.append((-round(score, 9), x, e))
    picked = []
    for s, x, e in sorted(found):
        if len(picked) < count and all(abs(e - pe) >= 2 or abs(x - px) >= 2 for _, px, pe in picked):
            picked.append((s, x, e))
    return [(e * 2.5, x * 2.5) for _, x, e in picked]


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    rows, votes, want = [], [], {}
    for k in range(6):
        n = rnd.choice([30, 80, 150])
        levels = [rnd.choice([-12, -13, -12, -11, -30]) for _ in range(n)]
        gains = [rnd.randrange(1000) / 997 for _ in range(n)]
        rows += [(f"s{k}", i, i * 2.5, (i + 1) * 2.5, float(levels[i]), -20.0, gains[i]) for i in range(n)]
        own = {(rnd.randrange(n) * 2.5, rnd.randrange(n) * 2.5): rnd.choice(["good", "bad"]) for _ in range(60)}
        own = {(x, e): r for (x, e), r in own.items() if x - e >= 60}
        votes += [(f"s{k}", x, e, r, i) for i, ((x, e), r) in enumerate(own.items())]
        want[f"s{k}"] = brute(levels, gains, [(x, e, r) for (x, e), r in own.items()])
    bars = B.classify_bars(spark.createDataFrame(rows, BAR))
    got = {}
    for r in S.rank_suggestions(bars, spark.createDataFrame(votes, VOTES)).orderBy("song_id", "rank").collect():
        got.setdefault(r.song_id, []).append((r.start_sec, r.end_sec))
    assert got == {k: v for k, v in want.items() if v}
