"""Bar levels of layered songs: quiet bars, intro, section changes, and where a point falls.

A song's bars are scanned in blocks (:mod:`refrain.operators.ordered`); range counts
between two bars become differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.exact import clamp01, half_up
from refrain.operators.settle import settle
from refrain.operators.ordered import asof, block_of, core_rows, order_statistic, scan, with_neighbours

SONG = ["song_id"]
QUIET_DROP_DB = 9.0
REFERENCE_PERCENTILE = 0.75
INTRO_RUN_BARS = 4
MAX_QUIET_RUN_BARS = 3
TOP_CHANGE_FULL_DB = 12.0
POINT_SLACK_SEC = 0.06
MIN_LOOP_SEC = 60.0
QUIET_INSIDE_SEC = 8.0


def classify_bars(bars: DataFrame, quiet_drop_db: float = QUIET_DROP_DB) -> DataFrame:
    """Add ``quiet``: the base layer is far below the song's usual (nearest-rank) level."""
    rank = F.floor(F.lit(REFERENCE_PERCENTILE) * (F.col("n") - 1) + 0.5)
    usual = order_statistic(bars, SONG, "base_db", {"usual_db": rank}, bin_width=0.01).drop("n")
    return (
        bars.join(usual, SONG).withColumn("quiet", F.col("base_db") < F.col("usual_db") - quiet_drop_db).drop("usual_db")
    )


def intro_end(bars: DataFrame) -> DataFrame:
    """Per song: first bar of the first run of loud bars, 0 when there is none."""
    near, w = with_neighbours(bars, SONG, "bar_idx", 0, INTRO_RUN_BARS - 1)
    run = w.rowsBetween(0, INTRO_RUN_BARS - 1)
    flagged = core_rows(
        near.withColumn(
            "__loud",
            (F.sum(F.col("quiet").cast("int")).over(run) == 0) & (F.count(F.lit(1)).over(run) == INTRO_RUN_BARS),
        )
    )
    first = F.min(F.when(F.col("__loud"), F.col("bar_idx")))
    return flagged.groupBy(*SONG).agg(F.coalesce(first, F.lit(0)).alias("intro_bar"), F.count(F.lit(1)).alias("n_bars"))


def bar_profile(bars: DataFrame) -> DataFrame:
    """Everything wrap ranking needs to know about each bar as an exit or an entry.

    ``quiet_before``/``runs_before``: quiet bars / ends of three-bar quiet runs so far, so
    counts over a bar range are differences.  ``exit_late``: how far through its loud run
    the bar before this one is.  ``drop``/``rise``: top layer change at this bar, 0..1.
    """
    near, w = with_neighbours(bars, SONG, "bar_idx", 3, INTRO_RUN_BARS)
    quiet = F.col("quiet").cast("int")
    before_db = F.avg("top_db").over(w.rowsBetween(-2, -1))
    after_db = F.avg("top_db").over(w.rowsBetween(0, 1))
    change = before_db - after_db
    full = F.lit(TOP_CHANGE_FULL_DB)
    flat = before_db.isNull() | after_db.isNull()
    local = core_rows(
        near.withColumns(
            {
                "drop": F.when(flat, F.lit(0.0)).otherwise(clamp01(change / full)),
                "rise": F.when(flat, F.lit(0.0)).otherwise(clamp01(-change / full)),
                "__run3": (F.sum(quiet).over(w.rowsBetween(-2, 0)) == MAX_QUIET_RUN_BARS).cast("int"),
                "__loud4": (F.sum(quiet).over(w.rowsBetween(0, 3)) == 0)
                & (F.count(F.lit(1)).over(w.rowsBetween(0, 3)) == INTRO_RUN_BARS),
                "__next": F.coalesce(F.lead("quiet", 1).over(w), F.lit(False)),
                "__prev_loud": (F.sum(quiet).over(w.rowsBetween(-2, -1)) == 0)
                & (F.count(F.lit(1)).over(w.rowsBetween(-2, -1)) == 2),
            }
        )
    )
    quiet_idx = F.when(F.col("quiet"), F.col("bar_idx"))
    run = scan(
        local,
        SONG,
        block_of(F.col("bar_idx")),
        ["bar_idx"],
        before={"quiet_before": quiet, "runs_before": F.col("__run3")},
        previous={"__quiet_prev": quiet_idx},
        following={"__quiet_next": quiet_idx},
    )
    songs = local.groupBy(*SONG).agg(
        F.coalesce(F.min(F.when(F.col("__loud4"), F.col("bar_idx"))), F.lit(0)).alias("intro_bar"),
        F.count(F.lit(1)).alias("n_bars"),
    )
    out = run.join(songs, SONG)
    first = F.coalesce(F.col("__quiet_prev") + 1, F.lit(0))
    last = F.coalesce(F.when(F.col("quiet"), F.col("bar_idx")), F.col("__quiet_next"), F.col("n_bars")) - 1
    late = F.when(last == first, F.lit(1.0)).otherwise((F.col("bar_idx") - 1 - first) / (last - first))
    return out.withColumns(
        {
            "exit_ok": F.col("__prev_loud") & (F.col("bar_idx") >= 2) & (F.col("bar_idx") >= F.col("intro_bar") + 2),
            "entry_ok": ~F.col("quiet") & ~F.col("__next") & (F.col("bar_idx") >= F.col("intro_bar")),
            "exit_late": F.when(F.col("__prev_loud"), late),
        }
    ).drop("__run3", "__loud4", "__next", "__prev_loud", "__quiet_prev", "__quiet_next")


def lateness(bars: DataFrame) -> DataFrame:
    """Position of each bar inside its run of loud bars, 0..1 (1 when it is alone)."""
    quiet_idx = F.when(F.col("quiet"), F.col("bar_idx"))
    marked = scan(
        bars, SONG, block_of(F.col("bar_idx")), ["bar_idx"],
        previous={"__p": quiet_idx}, following={"__n": quiet_idx},
    )
    n = bars.groupBy(*SONG).agg(F.count(F.lit(1)).alias("__count"))
    first = F.coalesce(F.col("__p") + 1, F.lit(0))
    last = F.coalesce(F.col("__n"), F.col("__count")) - 1
    value = F.when(last == first, F.lit(1.0)).otherwise((F.col("bar_idx") - first) / (last - first))
    return marked.join(n, SONG).withColumn("lateness", value).drop("__p", "__n", "__count")


def longest_quiet_run(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """Longest run of quiet bars in ``[from_bar, to_bar)`` of each range (song_id, range_id, from_bar, to_bar).

    Quiet runs are found once per song; a range then meets only the runs it overlaps.
    """
    quiet_idx = F.when(~F.col("quiet"), F.col("bar_idx"))
    marked = scan(
        bars, SONG, block_of(F.col("bar_idx")), ["bar_idx"], previous={"__loud": quiet_idx}
    ).filter("quiet")
    runs = marked.groupBy(*SONG, F.coalesce(F.col("__loud") + 1, F.lit(0)).alias("run_start")).agg(
        (F.max("bar_idx") + 1).alias("run_end")
    )
    cell = 64
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell)))
    r = ranges.filter("to_bar > from_bar").withColumn("__cell", spread(F.col("from_bar"), F.col("to_bar")))
    q = runs.withColumn("__cell", spread(F.col("run_start"), F.col("run_end")))
    part = F.least("to_bar", "run_end") - F.greatest("from_bar", "run_start")
    hits = r.join(q, [*SONG, "__cell"]).filter(part > 0).groupBy(*SONG, "range_id").agg(F.max(part).alias("longest"))
    return ranges.join(hits, [*SONG, "range_id"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def bar_at(points: DataFrame, bars: DataFrame, time: str, name: str = "bar_idx") -> DataFrame:
    """The bar a point falls in (a little slack before each bar line), -1 outside the grid."""
    found = asof(
        points, bars, SONG, F.col(time) + POINT_SLACK_SEC, F.col("start_sec"), ["bar_idx", "end_sec"], before="__bar"
    )
    inside = F.col("__bar").isNotNull() & (F.col(time) < F.col("__bar.end_sec") - POINT_SLACK_SEC)
    return found.withColumn(name, F.when(inside, F.col("__bar.bar_idx")).otherwise(F.lit(-1))).drop("__bar")


def bars_at(points: DataFrame, bars: DataFrame, times: dict[str, str]) -> DataFrame:
    """``bar_at`` for several times of a point (name: time column); ``bars`` should be a stored table.

    A scan reads its input twice, so the points are written between two of them: the plan
    grows with the number of times and not with its power.
    """
    for i, (name, time) in enumerate(times.items()):
        points = bar_at(points if i == 0 else settle(points), bars, time, name)
    return points


def loop_warnings(loops: DataFrame, bars: DataFrame) -> DataFrame:
    """Why a loop may disappoint, as (id, seconds): short, back into the intro or a quiet part, or quiet inside.

    ``loops`` (song_id, loop_id, start_sec, end_sec); ``bars`` are classified.
    """
    bars = settle(bars)
    duration = F.when(F.col("quiet"), F.col("end_sec") - F.col("start_sec")).otherwise(F.lit(0.0))
    cum = scan(bars, SONG, block_of(F.col("bar_idx")), ["bar_idx"], before={"__quiet_sec": duration})
    near, w = with_neighbours(cum, SONG, "bar_idx", 0, 1)
    at_start = core_rows(
        near.withColumn("__soft", F.col("quiet") | F.coalesce(F.lead("quiet", 1).over(w), F.lit(False)))
    ).select("song_id", F.col("bar_idx").alias("start_bar"), F.col("__quiet_sec").alias("__from"), "__soft")
    at_end = cum.select("song_id", F.col("bar_idx").alias("end_bar"), F.col("__quiet_sec").alias("__to"))
    intro = intro_end(bars)
    intro_sec = (
        bars.join(intro, SONG)
        .filter(F.col("bar_idx") == F.col("intro_bar"))
        .select("song_id", F.col("start_sec").alias("__intro_sec"))
    )
    totals = bars.groupBy(*SONG).agg(F.sum(duration).alias("__all"))
    placed = bars_at(loops, bars, {"start_bar": "start_sec", "end_bar": "end_sec"})
    joined = (
        placed.join(at_start, ["song_id", "start_bar"], "left")
        .join(at_end, ["song_id", "end_bar"], "left")
        .join(intro_sec, SONG)
        .join(totals, SONG)
    )
    upto = F.when(F.col("end_bar") < 0, F.col("__all")).otherwise(F.col("__to"))
    inside = F.greatest(F.lit(0.0), upto - F.coalesce(F.col("__from"), F.lit(0.0)))
    length = F.col("end_sec") - F.col("start_sec")
    in_intro = F.col("start_sec") < F.col("__intro_sec") - POINT_SLACK_SEC

    def warn(cond: Column, key: str, seconds: Column | None = None) -> Column:
        told = F.lit(None).cast("bigint") if seconds is None else half_up(seconds).cast("bigint")
        return F.when(cond, F.struct(F.lit(key).alias("id"), told.alias("seconds")))

    warnings = F.array_compact(
        F.array(
            warn(length < MIN_LOOP_SEC, "short", length),
            warn(in_intro, "intro-start"),
            warn(~in_intro & F.coalesce(F.col("__soft"), F.lit(False)), "quiet-start"),
            warn(inside >= QUIET_INSIDE_SEC, "quiet-inside", inside),
        )
    )
    return joined.select(*loops.columns, "start_bar", "end_bar", warnings.alias("warnings"))
