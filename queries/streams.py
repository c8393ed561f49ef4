"""Streaming twins: each runs the event table as a stream to its end and returns the state it reached."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from queries.base import Registry, r6, read, votes, votes_of, wrap_votes_of
from queries.bars import classified, current_votes, show_suggestions
from queries.bars import query as bar_queries
from queries.votes import ORACLE_TOGGLE, show_records
from queries.votes import query as vote_queries
from refrain.operators import suggest as S
from refrain.operators import votes as V
from refrain.operators.settle import shared_dir
from refrain.sources.vote_logs import loop_vote_lines
from refrain.streaming import votes as W

query = Registry()
BATCH = vote_queries.oracle


def _events_stream(spark, d):
    """The table as a stream, whether it is one file or a folder of parts."""
    schema = read(spark, d, "events").schema
    # As a pattern, since a stream takes a single file only from one.
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def _drain(spark, df, mode: str):
    """Run a stream over everything available into a table, and read that table with its column ``batch``."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{root}/out/batch=-1")  # a stream without data runs no batch
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    with_batch = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(with_batch).parquet(f"{root}/out")


def _state(spark, df, keys):
    """What a stream of aggregates has reached: only changed keys are written per batch."""
    return W.newest(_drain(spark, df, "update"), keys)


@query("stream_latest_ratings", BATCH["vote_latest_ratings"])
def stream_latest_ratings(spark, d):
    return _state(spark, V.rating_state(votes_of(_events_stream(spark, d))), V.CUT).filter("rating <> 'clear'")


@query("stream_latest_notes", BATCH["vote_latest_notes"])
def stream_latest_notes(spark, d):
    return _state(spark, V.latest_notes(votes_of(_events_stream(spark, d))), V.CUT)


@query("stream_latest_tags", BATCH["vote_latest_tags"])
def stream_latest_tags(spark, d):
    return _state(spark, V.latest_tags(votes_of(_events_stream(spark, d))), V.CUT).withColumn("tags", F.concat_ws(",", "tags"))


@query("stream_latest_records", BATCH["vote_latest_records"])
def stream_latest_records(spark, d):
    return show_records(_state(spark, V.latest_records(votes_of(_events_stream(spark, d))), V.CUT), V.CUT)


@query("stream_latest_wraps", BATCH["vote_latest_wraps"])
def stream_latest_wraps(spark, d):
    w = _state(spark, V.wrap_state(wrap_votes_of(_events_stream(spark, d))), V.WRAP).filter("rating <> 'clear'")
    return w.withColumns({"exit_sec": r6(F.col("exit_sec")), "entry_sec": r6(F.col("entry_sec"))})


@query("stream_appended_votes", BATCH["vote_latest_ratings"])
def stream_appended_votes(spark, d):
    """The table written as logs, read back by the line source, whose (file, byte) orders the votes."""
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}/log"
    in_order = loop_vote_lines(votes(spark, d)).repartitionByRange("seq").sortWithinPartitions("seq")
    in_order.select("value").write.text(folder)
    return _state(spark, V.rating_state(W.stream_loop_votes(spark, folder)), V.CUT).filter("rating <> 'clear'")


@query("stream_toggle_clicks", ORACLE_TOGGLE)
def stream_toggle_clicks(spark, d):
    e = _events_stream(spark, d)
    clicks = e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        F.floor(F.col("value") / 50.0).cast("bigint").alias("cell"),
        F.when(F.col("event_type").isin("error", "click"), "bad").otherwise("good").alias("rating"),
    )
    return _drain(spark, W.toggle_stream(clicks, ["source_name", "cell"], "source_name string, cell bigint"), "append").drop("batch")


_BURSTS = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (
  SELECT user_id, rn, t AS f, t AS l, 1::BIGINT AS n, FALSE AS fresh FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN e.t > least(b.l + 14400000, b.f + 43200000) THEN e.t ELSE b.f END, e.t,
    CASE WHEN e.t > least(b.l + 14400000, b.f + 43200000) THEN 1 ELSE b.n + 1 END, e.t > least(b.l + 14400000, b.f + 43200000)
  FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1),
s AS (SELECT *, lead(fresh) OVER (PARTITION BY user_id ORDER BY rn) AS closes FROM b)
SELECT user_id, f AS first_ms, l AS last_ms, n AS edits, least(l + 14400000, f + 43200000) AS saved_ms FROM s WHERE coalesce(closes, TRUE)
"""


@query("stream_coalesce_batch", _BURSTS)
def stream_coalesce_batch(spark, d):
    """Burst coalescing with a four-hour idle time and a twelve-hour deadline, as a batch."""
    e = read(spark, d, "events").select("user_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at_ms"))
    return W.coalesce_bursts(e, "user_id", "bigint", 14_400_000, 43_200_000)


@query("stream_coalesce_live", _BURSTS)
def stream_coalesce_live(spark, d):
    """The streaming form, with the bursts that are open at the end."""
    e = _events_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return W.newest(_drain(spark, W.coalesce_stream(e, "user_id", "bigint", 14_400_000, 43_200_000), "update"), ["user_id", "first_ms"])


# Every song of the table gets a vote, so all are ranked again.
@query("stream_rerank_touched", bar_queries.oracle["wrap_suggestions"])
def stream_rerank_touched(spark, d):
    """New votes arrive as a stream; only songs that got one are ranked again."""
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    incoming = votes_of(_events_stream(spark, d)).filter("rating IS NOT NULL").select("source_name", "seq")
    step = W.rerank_touched(classified(spark, d), lambda: current_votes(spark, d), S.rank_suggestions, f"{root}/out")
    q = incoming.writeStream.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()
    return show_suggestions(W.newest(spark.read.parquet(f"{root}/out"), ["song_id"]))
