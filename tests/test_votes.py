"""Exact small cases of the vote replay, parsing and evaluation."""

import json

from pyspark.sql import functions as F

from refrain.functions.exact import fixed_text, fixed_units
from refrain.operators import evaluate as E
from refrain.operators import votes as V
from refrain.sources import vote_logs as L

VOTE = "seq bigint, source_name string, start_sec double, end_sec double, bars int, rating string, note string, tags array<string>, wrap_crossfade_sec double, normalize boolean"


def votes(spark, rows):
    full = [(i, "song", float(s), float(e), 4, r.get("rating"), r.get("note"), r.get("tags"), r.get("fade"), r.get("norm")) for i, (s, e, r) in enumerate(rows)]
    return spark.createDataFrame(full, VOTE)


def test_key_rounding_uses_the_exact_binary_value(spark):
    xs = [1.005, 0.125, 2.675, 0.0, 599.995]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(fixed_units(F.col("x"), 2).alias("u"), fixed_text(F.col("x"), 2).alias("t"))
    got = [(r.u, r.t) for r in df.collect()]
    assert [u for u, _ in got] == [100, 13, 267, 0, 60000]
    assert got[1][1] == "0.13"


def test_latest_rating_per_cut(spark):
    v = votes(spark, [(1, 9, {"rating": "good"}), (1.001, 9, {"rating": "bad"}), (2, 10, {"rating": "clear"}), (2, 10, {"rating": "good"}), (3, 5, {"note": "x"})])
    assert {(r.start_units, r.rating) for r in V.latest_ratings(v).collect()} == {(100, "bad"), (200, "good")}


def test_renders_are_separate_and_clear_removes_them(spark):
    rows = [(1, 9, {"rating": "bad", "fade": 0.035}), (1, 9, {"note": "softer", "fade": 0.5})]
    out = V.latest_rendered(votes(spark, rows)).collect()
    assert sorted((r.fade_key, r.rating) for r in out) == [(0.035, "bad"), (0.5, None)]
    assert V.latest_rendered(votes(spark, [*rows, (1, 9, {"rating": "clear", "fade": 0.035})])).count() == 0


def test_toggle_blocks(spark):
    clicks = ["good", "good", "good", "bad", "bad", "good", "bad", "bad", "bad", "good", "good", "good", "good"]
    want, state = [], None
    for c in clicks:
        state = None if state == c else c
        want.append(state or "clear")
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate(clicks)], "k string, seq bigint, rating string")
    for rows in (2, 3, 100):
        got = [r.emitted for r in V.toggle_votes(df, ["k"], block_rows=rows).orderBy("seq").collect()]
        assert got == want


def test_merge_sources(spark):
    s = "source_name string, exit_sec double, entry_sec double, rating string, seq bigint"
    current = spark.createDataFrame([("a", 1.0, 2.0, "good", 5)], s)
    older = spark.createDataFrame([("a", 1.0, 2.0, "bad", 1), ("a", 3.0, 4.0, "bad", 2), ("a", 3.0, 4.0, "good", 3), ("a", 5.0, 6.0, "good", 4)], s)
    got = {(r.exit_units, r.rating) for r in V.merge_rated_joins(current, older).collect()}
    assert got == {(1000, "good"), (3000, "bad"), (5000, "good")}


def test_log_round_trip_with_torn_lines(spark, tmp_path):
    ok = {"at": "x", "sourceName": "s", "startSec": 0, "endSec": 8, "bars": 4, "rating": "good", "bpm": 120}
    lines = [json.dumps(ok), "", '{"sourceName": "s", "st', json.dumps({**ok, "bars": 3}), json.dumps({**ok, "tags": ["nope"]}), json.dumps({**ok, "rating": None}), json.dumps({**ok, "rating": None, "note": ""})]
    (tmp_path / "log-001.jsonl").write_text("\n".join(lines))
    read = L.read_loop_votes(spark, str(tmp_path))
    assert sorted("-" if r.note is None else r.note for r in read.collect()) == ["", "-"]
    L.append_votes(read, str(tmp_path / "out"))
    L.append_votes(read, str(tmp_path / "out"))
    assert L.read_loop_votes(spark, str(tmp_path / "out")).count() == 4


def test_wrap_votes_validation(spark):
    ok = {"version": 1, "at": "2026-01-02T03:04:05Z", "sourceName": "s", "exitSec": 1, "entrySec": 2, "fadeSec": 0.5, "rating": "good"}
    bad = [{**ok, "version": 2}, {**ok, "at": "soon"}, {**ok, "rating": "great"}, {**ok, "exitSec": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([ok, *bad])], "seq bigint, value string")
    assert [r.seq for r in L.parse_wrap_votes(df).collect()] == [0]


def test_auc_ties_and_f1(spark):
    rows = [("good", 1.0), ("good", 2.0), ("good", 2.0), ("bad", 2.0), ("bad", 0.0)]
    df = spark.createDataFrame(rows, "rating string, score double")
    r = E.auc(df, []).collect()[0]
    assert (r.n_good, r.n_bad, r.auc) == (3, 2, 4 / 6)
    f = E.best_f1(df, "score").collect()[0]
    assert (f.threshold, f.kept_good, f.kept_bad) == (1.0, 3, 1)
    only = E.auc(df.filter("rating = 'good'"), []).collect()[0]
    assert (only.auc, only.has_pairs) == (0.5, False)
