"""Block scans equal plain windows, whatever the block size, also for one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from refrain.operators.ordered import asof, block_of, core_rows, dense_index, order_statistic, scan, with_neighbours


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}", i, float(rnd.randrange(40)), None if rnd.random() < 0.4 else i) for i in range(900)]
    return spark.createDataFrame(rows, "k string, seq bigint, v double, mark bigint").cache()


@pytest.mark.parametrize("rows", [7, 64, 100000])
def test_scan_equals_windows(series, rows):
    w = Window.partitionBy("k").orderBy("seq")
    past, upto, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    got = scan(
        series, ["k"], block_of(F.col("seq"), rows), ["seq"],
        before={"b": F.col("v")}, through={"t": F.col("v")}, previous={"p": F.col("mark")}, latest={"l": F.col("mark")},
        following={"f": F.col("mark")}, highest={"h": F.col("v")},
    )
    want = series.select(
        "*", F.coalesce(F.sum("v").over(past), F.lit(0.0)).alias("b"), F.sum("v").over(upto).alias("t"),
        F.last("mark", True).over(past).alias("p"), F.last("mark", True).over(upto).alias("l"),
        F.first("mark", True).over(later).alias("f"), F.max("v").over(past).alias("h"),
    )
    cols = ["k", "seq", "b", "t", "p", "l", "f", "h"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect(), key=lambda r: (r.k, r.seq))


def test_index_and_neighbours(series):
    idx = dense_index(series, ["k"], block_of(F.col("seq"), 32), ["seq"])
    w = Window.partitionBy("k").orderBy("seq")
    assert idx.join(series.withColumn("rn", F.row_number().over(w) - 1), ["k", "seq"]).filter("idx <> rn").count() == 0
    near, tile = with_neighbours(idx, ["k"], "idx", 2, 3, rows=8)
    got = core_rows(near.withColumn("s", F.sum("v").over(tile.rowsBetween(-2, 3))))
    want = series.withColumn("s", F.sum("v").over(w.rowsBetween(-2, 3)))
    assert sorted(map(tuple, got.select("k", "seq", "s").collect())) == sorted(map(tuple, want.select("k", "seq", "s").collect()))


def test_order_statistic_is_exact(series):
    out = order_statistic(series, ["k"], "v", {"p75": F.floor(0.75 * (F.col("n") - 1) + 0.5)}, bin_width=3.0).collect()
    values = {}
    for r in series.collect():
        values.setdefault(r.k, []).append(r.v)
    for r in out:
        v = sorted(values[r.k])
        assert r.n == len(v) and r.p75 == v[int(0.75 * (len(v) - 1) + 0.5)]


def test_asof(spark):
    grid = spark.createDataFrame([("a", float(i * 3), i) for i in range(50)], "k string, t double, g int")
    pts = spark.createDataFrame([("a", x / 7.0, x) for x in range(-5, 1200)], "k string, x double, id int")
    for r in asof(pts, grid, ["k"], F.col("x"), F.col("t"), ["g"], before="b", after="a", block_sec=10.0).collect():
        lower = [g for g in range(50) if g * 3 <= r.x]
        upper = [g for g in range(50) if g * 3 > r.x]
        assert (r.b.g if r.b else None) == (lower[-1] if lower else None)
        assert (r.a.g if r.a else None) == (upper[0] if upper else None)
