"""Look-ups in packed frames equal plain joins and never shuffle stored frames."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from refrain.operators.settle import scratch
from refrain.operators.tiles import TILE_HOPS, at_hop, stored, tiled


@pytest.fixture
def frames(spark):
    rng = random.Random(1)
    rows = [(s, h, [rng.random() for _ in range(3)]) for s in ("a", "b") for h in range(500) if s == "a" or h % 7]
    return spark.createDataFrame(rows, "song_id string, hop_idx bigint, v array<double>")


@pytest.fixture
def requests(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.choice(["a", "b", "c", None]), i, rng.randrange(-3, 520) if i % 9 else None) for i in range(400)], "song_id string, id int, hop bigint")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kept", [False, True])
def test_equals_a_plain_join(spark, frames, requests, how, kept):
    tiles = tiled(frames, F.col("v"))
    got = at_hop(requests, stored(tiles) if kept else tiles, F.col("hop"), "x", how)
    want = requests.join(frames.select("song_id", F.col("hop_idx").alias("hop"), F.col("v").alias("x")), ["song_id", "hop"], how)
    order = ["id", "song_id", "hop", "x"]
    assert got.select(order).orderBy("id").collect() == want.select(order).orderBy("id").collect()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), plan


def test_stored_frames_are_not_shuffled(spark, frames, requests):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tiles = stored(tiled(frames, F.col("v")))
        once = at_hop(requests, tiles, F.col("hop"), "x")
        twice = at_hop(once, tiles, F.col("hop") + TILE_HOPS, "y")
        assert exchanges(once)[0] == 1 and exchanges(twice)[0] == 2, exchanges(twice)[1]
        assert "Bucketed: true" in exchanges(once)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch_drops_bucketed_tables(spark, frames):
    before = {t.name for t in spark.catalog.listTables()}
    with scratch(spark):
        tiles = stored(tiled(frames, F.col("v")))
        path = tiles.packed.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path.removeprefix("//")) and {t.name for t in spark.catalog.listTables()} - before
    assert {t.name for t in spark.catalog.listTables()} == before and not os.path.exists(path.removeprefix("//"))
