"""The vote log as a stream, and the state it keeps.

"Latest" is ``max_by(value, seq)``, which Spark maintains incrementally, so the batch replay
functions of :mod:`refrain.operators.votes` run unchanged on a stream.  Only rules that
depend on the previous event of a key (toggles, burst coalescing) keep custom state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from refrain.operators.ordered import scan
from refrain.operators.settle import settle
from refrain.sources.log_tail import stream_log_lines
from refrain.sources.vote_logs import parse_loop_votes


def stream_loop_votes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Valid votes of live logs, each once its line is complete; invalid lines are dropped."""
    return parse_loop_votes(stream_log_lines(spark, path, pattern))[0]


def toggle_stream(clicks: DataFrame, keys: list[str], key_schema: str) -> DataFrame:
    """Streaming twin of ``toggle_votes``: (keys, seq, rating, emitted).  State: the current rating of a key."""
    out_schema = f"{key_schema}, seq bigint, rating string, emitted string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        events = pd.concat(list(batches)).sort_values("seq")
        emitted = []
        for rating in events["rating"]:
            current = None if rating == current else rating
            emitted.append(current or "clear")
        state.update((current,))
        frame = events[["seq", "rating"]].assign(emitted=emitted)
        for i, k in enumerate(keys):
            frame.insert(i, k, key[i])
        yield frame

    return clicks.groupBy(*keys).applyInPandasWithState(
        step, out_schema, "rating string", "append", GroupStateTimeout.NoTimeout
    )


def _bursts(times: list[int], idle_ms: int, deadline_ms: int, pending: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Closed bursts (first, last, n, saved_at) and the open one (first, last, n)."""
    closed = []
    for t in times:
        if pending:
            due = min(pending[1] + idle_ms, pending[0] + deadline_ms)
            if t > due:
                closed.append((*pending, due))
                pending = None
        pending = (pending[0], t, pending[2] + 1) if pending else (t, t, 1)
    return closed, pending


_BURST = "first_ms bigint, last_ms bigint, edits bigint, saved_ms bigint"


def coalesce_bursts(edits: DataFrame, key: str, key_type: str, idle_ms: int = 500, deadline_ms: int = 2000) -> DataFrame:
    """Saves of a debounced writer with a deadline, from a batch of edits (key, at_ms).

    Edits further apart than the idle time never share a save, so each key is first cut at
    those gaps; the deadline rule then runs inside one gap-free stretch.
    """
    block = F.floor(F.col("at_ms") / F.lit(86_400_000)).cast("bigint")
    gap = scan(edits.select(key, "at_ms"), [key], block, ["at_ms"], previous={"__prev": F.col("at_ms")})
    opens = (F.col("__prev").isNull() | (F.col("at_ms") - F.col("__prev") > idle_ms)).cast("int")
    runs = settle(scan(gap.withColumn("__o", opens), [key], block, ["at_ms"], through={"run": F.col("__o")}))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        closed, rest = _bursts(sorted(pdf["at_ms"]), idle_ms, deadline_ms, None)
        closed.append((*rest, min(rest[1] + idle_ms, rest[0] + deadline_ms)))
        out = pd.DataFrame(closed, columns=["first_ms", "last_ms", "edits", "saved_ms"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    spans = runs.groupBy(key, "run").agg(
        F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count(F.lit(1)).alias("edits")
    )
    long = F.col("last_ms") - F.col("first_ms") > deadline_ms
    # A stretch within the deadline is one save; only longer ones need the step-by-step rule.
    whole = spans.filter(~long).select(
        key, "first_ms", "last_ms", "edits",
        F.least(F.col("last_ms") + idle_ms, F.col("first_ms") + deadline_ms).alias("saved_ms"),
    )
    rest = runs.join(spans.filter(long).select(key, "run"), [key, "run"], "left_semi").select(key, "run", "at_ms")
    return whole.unionByName(rest.groupBy(key, "run").applyInPandas(split, f"{key} {key_type}, {_BURST}"))


def coalesce_stream(edits: DataFrame, key: str, key_type: str, idle_ms: int = 500, deadline_ms: int = 2000) -> DataFrame:
    """Streaming twin of ``coalesce_bursts`` over (key, ts), in update mode: every burst as it stands after a batch.

    A burst is known by (key, first_ms); its newest row (:func:`newest`) is the save that will
    be, or was, made at ``saved_ms``.  Nothing is dropped: an edit that arrives late counts for
    the burst that is open then.  The state is one row per key.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get if state.exists else None
        times = sorted(int(t) for b in batches for t in b["at_ms"])
        if pending:
            times = [max(t, pending[1]) for t in times]
        bursts, pending = _bursts(times, idle_ms, deadline_ms, pending)
        if pending:
            state.update(pending)
            bursts.append((*pending, min(pending[1] + idle_ms, pending[0] + deadline_ms)))
        out = pd.DataFrame(bursts, columns=["first_ms", "last_ms", "edits", "saved_ms"])
        out.insert(0, key, k[0])
        yield out

    timed = edits.withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, {_BURST}", "first_ms bigint, last_ms bigint, edits bigint", "update", GroupStateTimeout.NoTimeout
    )


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of update-mode output with a column ``batch``, the rows of each key's newest batch, without ``batch``."""
    last = updates.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return updates.join(last, [*keys, "batch"], "left_semi").drop("batch")


def rerank_touched(
    bars: DataFrame, votes_table: Callable[[], DataFrame], rank: Callable[[DataFrame, DataFrame], DataFrame], out_path: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: songs with new votes are ranked again from stored bars; others stay as they are.

    ``votes_table()`` returns the current decisions including this batch (song_id, ...);
    each batch is one partition of ``out_path``, so a retried batch replaces its own output.
    A song ranked by several batches has rows in each; readers take :func:`newest` by song.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(F.col("source_name").alias("song_id")).distinct()
        ranked = rank(bars.join(touched, "song_id", "left_semi"), votes_table().join(touched, "song_id", "left_semi"))
        ranked.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return step
