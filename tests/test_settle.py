"""Settled tables, the shipped package, and streams over a folder of parts."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path
from types import SimpleNamespace

import pyspark
from pyspark.sql import functions as F

import __spark_entry__ as entry
from refrain.operators.candidates import suppress_near_duplicates
from refrain.operators.settle import WIDE_ROWS, scratch, settle, shared_dir


def test_scratch_removes_its_tables(spark):
    with scratch(spark):
        table = settle(spark.range(5))
        path = table.inputFiles()[0].removeprefix("file:")
        assert table.count() == 5 and os.path.exists(path.removeprefix("//"))
    assert not os.path.exists(path.removeprefix("//"))


def test_chunks_of_samples_are_read_a_few_at_a_time(spark, tmp_path):
    """Spark's reader decodes a batch of rows inside one row group, so a row group of chunks must be small."""
    import pyarrow.parquet as pq

    from queries.signal import text_pcm

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab c"), 6000).alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    chunks = text_pcm(spark, str(tmp_path))
    groups = [g for f in chunks.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:").removeprefix("//")).metadata] for g in (m.row_group(i).num_rows for i in range(m.num_row_groups))]
    assert sum(groups) == chunks.count() == 4 * -(-50 * 24000 // 16384) > 4 * WIDE_ROWS
    assert max(groups) <= WIDE_ROWS


def test_chunks_reach_python_in_bounded_batches(spark):
    """Stages that see chunks or files lower the session's batch limits, whatever these were."""
    from refrain.operators.batches import MOST_BYTES, MOST_ROWS
    from refrain.operators.signal import extract_frames
    from refrain.schemas import PCM_CHUNK
    from refrain.sources.pcm import decode_wav, wav_rejects

    keys, most = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"), (MOST_ROWS, MOST_BYTES)
    files, were = spark.createDataFrame([], "song_id string, content binary"), [spark.conf.get(k) for k in keys]
    try:
        for stage, rows in ((extract_frames, spark.createDataFrame([], PCM_CHUNK)), (decode_wav, files), (wav_rejects, files)):
            for k in keys:
                spark.conf.set(k, str(1 << 30))
            stage(rows)
            assert [int(spark.conf.get(k)) for k in keys] == [*most]
    finally:
        for k, v in zip(keys, were, strict=True):
            spark.conf.set(k, v)


def test_touching_long_loops_are_rivals(spark):
    """The later, slightly longer loop reaches back to the start of the earlier one."""
    cols = "song_id string, cand_id string, bars int, start_sec double, end_sec double, seam_score double, quality_score double"
    rows = [("s", "a", 8, 0.0, 16.0, 0.5, 0.9), ("s", "b", 8, 16.0, 32.05, 0.5, 0.8), ("s", "c", 1, 16.01, 18.0, 0.5, 0.2)]
    kept = suppress_near_duplicates(spark.createDataFrame(rows, cols)).collect()
    assert {r.cand_id for r in kept} == {"a", "c"}


def test_streams_read_a_folder_of_parts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    queries = entry.queries()
    for name in ("latest_ratings", "latest_records"):
        live = queries[f"stream_{name}"](spark, str(tmp_path))
        want = queries[f"vote_{name}"](spark, str(tmp_path))
        assert live.count() > 100 and live.exceptAll(want.select(*live.columns)).count() == 0 and want.select(*live.columns).exceptAll(live).count() == 0


def test_bursts_over_several_batches(spark, tmp_path):
    """Three batches in time order give the bursts of the batch form, the open ones included."""
    from pyspark.sql import types as T

    from refrain.streaming import votes as W

    rows = [(k, t) for k in range(3) for t in (0, 300, 900, 2500, 2600, 9000 + k, 9100, 20_000)]
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("at_ms", T.LongType())])
    table = spark.createDataFrame(rows, schema)
    for i, (lo, hi) in enumerate(((0, 950), (950, 9050), (9050, 30_000))):
        part = table.filter(F.col("at_ms").between(lo, hi - 1)).select("user_id", F.timestamp_millis("at_ms").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(p for p in sorted((tmp_path / "in").glob("part-*"), key=os.path.getmtime)[-1:]), (1000 + i, 1000 + i))
    edits = spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")
    q = W.coalesce_stream(edits, "user_id", "bigint").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    updates = spark.read.parquet(out)
    assert updates.select("batch").distinct().count() == 3
    live = {tuple(r) for r in W.newest(updates, ["user_id", "first_ms"]).select("user_id", "first_ms", "last_ms", "edits", "saved_ms").collect()}
    want = {tuple(r) for r in W.coalesce_bursts(table, "user_id", "bigint").select("user_id", "first_ms", "last_ms", "edits", "saved_ms").collect()}
    assert live == want


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A query with a Python stage runs in a session that was started elsewhere."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
        import sys
        sys.path.insert(0, {str(root)!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as entry
        print("ROWS", entry.queries()["pcm_wav_roundtrip"](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def _session(master, checkpoints=None, **conf):
    """What ``shared_dir`` asks of a session."""
    context = SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: checkpoints)
    named = {"spark.sql.warehouse.dir": "file:/shared/warehouse", "spark.master": master} | {f"spark.{k.replace('_', '.')}": v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named.get(key, default)), sparkContext=context)


def test_clusters_settle_in_any_shared_folder():
    """A checkpoint folder without a scheme, one set on the context, or none at all: never an error, never the driver's temp folder."""
    for master in ("spark://host:7077", "yarn", "local-cluster[3,4,10240]"):
        assert shared_dir(_session(master, checkpoint_dir="/shared/checkpoints")) == "/shared/checkpoints"
        assert shared_dir(_session(master, "file:/shared/set")) == "file:/shared/set"
        assert shared_dir(_session(master)) == "file:/shared/warehouse"


def test_a_folder_set_on_the_context_overrides_the_configured_one():
    """Spark's defaults may name a folder that each machine has for itself; the cluster's own is then set on the context."""
    for master in ("spark://host:7077", "local-cluster[3,4,10240]", "local[4]"):
        assert shared_dir(_session(master, "hdfs://store/checkpoints/a", checkpoint_dir="/tmp/checkpoints")) == "hdfs://store/checkpoints/a"


def test_executors_apart_from_the_driver_settle_in_the_set_folder(tmp_path):
    """Three executors, for each of which the configured folder is another one."""
    root = Path(__file__).resolve().parent.parent
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
        import sys
        sys.path.insert(0, {str(root)!r})
        from pyspark.sql import SparkSession
        conf = {{"spark.checkpoint.dir": "/proc/self/cwd/own", "spark.ui.enabled": "false", "spark.executor.memory": "1g", "spark.sql.shuffle.partitions": "3",
            "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": {str(tmp_path / "warehouse")!r}}}
        spark = SparkSession.builder.master("local-cluster[3,1,1024]").config(map=conf).getOrCreate()
        spark.sparkContext.setCheckpointDir({str(tmp_path / "shared")!r})
        import __spark_entry__ as entry
        print("ROWS", entry.queries()["bars_layered"](spark, "/root/testdata/sf0.001").count())
        spark.stop()
    """
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1000" in done.stdout, done.stderr[-2000:]
