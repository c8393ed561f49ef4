"""Wrap suggestions: the best distinct (entry, exit) bar pairs of each song.

A song with n bars has about n*n/2 pairs.  They are never formed.  For pairs at least
``FULL_LENGTH_SEC`` long the score is an exit part plus an entry part, so the best pairs
follow from the best exits and best entries of dyadic index ranges; shorter pairs lie in a
window of bounded duration.  A chosen wrap hides at most nine neighbouring pairs, so the
top ``9 * count`` pairs always contain the final list: the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.operators.bars import MIN_LOOP_SEC, POINT_SLACK_SEC, bars_at, bar_profile
from refrain.operators.ordered import BLOCK_ROWS, asof, block_of, scan, top_per_key, top_per_key_tiled
from refrain.operators.settle import settle

SONG = ["song_id"]
FULL_LENGTH_SEC = 90.0
SUGGESTION_COUNT = 8
DISTINCT_BARS = 2
PRIOR_GOOD = 0.5
_UNIT = 1e12  # scores are compared as integers of this resolution, so sums are exact


def prior_match(joins: DataFrame, votes: DataFrame) -> DataFrame:
    """Earlier decision on each join (song_id, exit_sec, entry_sec): bad beats good, null when unrated.

    Votes are reduced to one row per millisecond point first; both ends are binned, so a
    bin holds a bounded number of points and no song is compared with all its votes.
    """
    width = POINT_SLACK_SEC
    cell = lambda c: F.floor(c / width).cast("bigint")
    around = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    distinct = votes.groupBy("song_id", "exit_sec", "entry_sec").agg(
        F.bool_or(F.col("rating") == "bad").alias("bad")
    )
    v = (
        distinct.withColumnsRenamed({"exit_sec": "v_exit", "entry_sec": "v_entry"})
        .withColumn("xb", F.explode(around(F.col("v_exit"))))
        .withColumn("eb", F.explode(around(F.col("v_entry"))))
    )
    points = joins.select("song_id", "exit_sec", "entry_sec").distinct()
    hits = (
        points.withColumns({"xb": cell(F.col("exit_sec")), "eb": cell(F.col("entry_sec"))})
        .join(v, ["song_id", "xb", "eb"])
        .filter(
            (F.abs(F.col("v_exit") - F.col("exit_sec")) <= width)
            & (F.abs(F.col("v_entry") - F.col("entry_sec")) <= width)
        )
        .groupBy("song_id", "exit_sec", "entry_sec")
        .agg(F.when(F.bool_or("bad"), "bad").otherwise("good").alias("prior"))
    )
    return joins.join(hits, ["song_id", "exit_sec", "entry_sec"], "left")


def _units(c: Column) -> Column:
    return F.floor(c * _UNIT + 0.5).cast("bigint")


def _exit_terms() -> Column:
    return F.struct("gain", F.col("exit_late").alias("late"), "drop", "quiet_before")


def _entry_terms() -> Column:
    return F.struct("gain", "rise", "quiet_before")


def _sides(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    tenth = F.lit(int(_UNIT / 10)).cast("bigint")
    quiet = F.col("quiet_before").cast("bigint") * tenth
    exits = profile.filter("exit_ok").select(
        "song_id",
        F.col("bar_idx").alias("x"),
        F.col("start_sec").alias("exit_sec"),
        F.col("runs_before").alias("seg"),
        _exit_terms().alias("x_terms"),
        (_units(F.col("gain") + 0.1 * F.col("exit_late") + 0.25 * F.col("drop")) - quiet).alias("x_part"),
    )
    entries = profile.filter("entry_ok").select(
        "song_id",
        F.col("bar_idx").alias("e"),
        F.col("start_sec").alias("entry_sec"),
        F.col("runs_before").alias("seg"),
        _entry_terms().alias("e_terms"),
        "n_bars",
        (_units(F.col("gain") + 0.25 * F.col("rise")) + quiet).alias("e_part"),
    )
    return exits, entries


def _positions(exits: DataFrame, bars: DataFrame, min_loop: float) -> DataFrame:
    """For each exit: how many bars start early enough for the minimum and for the full length."""
    near = asof(
        exits, bars, SONG, F.col("exit_sec") - min_loop + 1e-9, F.col("start_sec"), ["bar_idx"], before="__near"
    )
    far = asof(
        settle(near), bars, SONG, F.col("exit_sec") - max(FULL_LENGTH_SEC, min_loop), F.col("start_sec"), ["bar_idx"], before="__far"
    )
    return far.withColumns(
        {
            "near_end": F.coalesce(F.col("__near.bar_idx") + 1, F.lit(0)),
            "far_end": F.coalesce(F.col("__far.bar_idx") + 1, F.lit(0)),
        }
    ).drop("__near", "__far")


def _long_pairs(exits: DataFrame, entries: DataFrame, limits: DataFrame) -> DataFrame:
    """Candidate pairs (e < far_end of x) that contain the song's ``k`` best ones.

    The range [0, far_end) splits into one dyadic node per set bit; inside a node every
    entry pairs with every exit, so a pair ranked (i, j) is beaten by i*j - 1 others.
    """
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("n_bars"), F.lit(1)))).cast("int"))
    left = (
        entries.withColumn("level", F.explode(levels))
        .withColumn("node", F.expr("shiftright(e, level)"))
        .filter("node % 2 = 0")
        .join(limits, SONG)
    )
    bits = F.sequence(F.lit(0), F.floor(F.log2(F.col("far_end"))).cast("int"))
    right = (
        exits.filter("far_end > 0")
        .withColumn("level", F.explode(bits))
        .withColumn("node", F.expr("shiftright(far_end, level) - 1"))
        .filter("node % 2 = 0")
        .join(limits, SONG)
    )
    node = ["song_id", "seg", "level", "node"]
    best_e = top_per_key_tiled(
        left, node, F.floor(F.col("e") / BLOCK_ROWS), [F.col("e_part").desc(), F.col("e")], F.col("k"), "e_rank"
    )
    best_x = top_per_key_tiled(
        right, node, F.floor(F.col("x") / BLOCK_ROWS), [F.col("x_part").desc(), F.col("x")], F.col("k"), "x_rank"
    )
    return (
        best_x.select(*node, "x", "exit_sec", "x_terms", "x_part", "x_rank", "k")
        .join(best_e.select(*node, "e", "entry_sec", "e_terms", "e_part", "e_rank"), node)
        .filter(F.col("e_rank") * F.col("x_rank") <= F.col("k"))
        .drop("level", "node", "e_rank", "x_rank", "k")
    )


def _short_pairs(exits: DataFrame, entries: DataFrame, min_loop: float) -> DataFrame:
    """Pairs between the minimum and the full length: a bounded stretch of bars per exit."""
    return (
        exits.filter("near_end > far_end")
        .withColumn("e", F.explode(F.sequence(F.col("far_end"), F.col("near_end") - 1)))
        .join(entries.drop("n_bars"), ["song_id", "seg", "e"])
        .filter(F.col("exit_sec") - F.col("entry_sec") >= min_loop)
        .select("song_id", "seg", "x", "exit_sec", "x_terms", "x_part", "e", "entry_sec", "e_terms", "e_part")
    )


def _scored(pairs: DataFrame) -> DataFrame:
    length = F.least(F.lit(1.0), (F.col("exit_sec") - F.col("entry_sec")) / FULL_LENGTH_SEC)
    bonus = F.when(F.col("prior") == "good", F.lit(int(PRIOR_GOOD * _UNIT))).otherwise(F.lit(0)).cast("bigint")
    x, e = F.col("x_terms"), F.col("e_terms")
    p_good = x["gain"] + e["gain"]
    score = p_good + 0.3 * length + 0.1 * x["late"] - 0.1 * (x["quiet_before"] - e["quiet_before"])
    score = score + 0.25 * x["drop"] + 0.25 * e["rise"]
    return pairs.withColumns(
        {
            "p_good": p_good,
            "score": score + F.when(F.col("prior") == "good", F.lit(PRIOR_GOOD)).otherwise(F.lit(0.0)),
            "units": F.col("x_part") + F.col("e_part") + _units(0.3 * length) + bonus,
        }
    )


def _grid_matches(votes: DataFrame, bars: DataFrame) -> DataFrame:
    """Bar pairs a vote speaks about, bad winning: (song_id, x, e, prior)."""
    width = POINT_SLACK_SEC
    lines = bars.select("song_id", "bar_idx", "start_sec", F.floor(F.col("start_sec") / width).alias("b"))

    def line_of(df: DataFrame, time: str, out: str) -> DataFrame:
        c = F.floor(F.col(time) / width)
        return (
            df.withColumn("b", F.explode(F.sequence(c - 1, c + 1)))
            .join(lines, ["song_id", "b"])
            .filter(F.abs(F.col("start_sec") - F.col(time)) <= width)
            .withColumn(out, F.col("bar_idx"))
            .drop("b", "bar_idx", "start_sec")
        )

    points = votes.groupBy("song_id", "exit_sec", "entry_sec").agg(F.bool_or(F.col("rating") == "bad").alias("bad"))
    both = line_of(line_of(points, "exit_sec", "x"), "entry_sec", "e")
    return both.groupBy("song_id", "x", "e").agg(F.when(F.bool_or("bad"), "bad").otherwise("good").alias("prior"))


def _off_grid(votes: DataFrame, profile: DataFrame, min_loop: float) -> DataFrame:
    """Good votes between bar lines that would be acceptable wraps and that no bad vote disputes."""
    good = prior_match(votes.filter(F.col("rating") == "good"), votes).filter(F.col("prior") == "good")
    lines = profile.select("song_id", "bar_idx", "start_sec", "end_sec")
    placed = bars_at(good, lines, {"x": "exit_sec", "e": "entry_sec"})
    # Acceptance asks for bar 2 or later as exit; only listed bar pairs start two bars after the intro.
    x_ok = F.col("exit_late").isNotNull() & (F.col("bar_idx") >= 2)
    quiet = F.col("quiet_before").cast("bigint") * F.lit(int(_UNIT / 10)).cast("bigint")
    exits = profile.filter(x_ok).select(
        "song_id", F.col("bar_idx").alias("x"), F.col("runs_before").alias("seg"), _exit_terms().alias("x_terms"),
        (_units(F.col("gain") + 0.1 * F.col("exit_late") + 0.25 * F.col("drop")) - quiet).alias("x_part"),
    )
    entries = _sides(profile)[1].drop("entry_sec", "n_bars")
    return (
        placed.join(exits, ["song_id", "x"])
        .join(entries, ["song_id", "seg", "e"])
        .filter(F.col("exit_sec") - F.col("entry_sec") >= min_loop)
    )


def _first_of_near(off: DataFrame) -> DataFrame:
    """Of votes within the match distance at both ends, only the earliest kept one counts.

    Decided per chain of neighbouring exits; a chain spans votes a few hundredths of a
    second apart, and points are distinct milliseconds, so its array stays small.
    """
    chained = scan(
        off, SONG, F.floor(F.col("exit_sec") / 64.0).cast("bigint"), ["exit_sec", "entry_sec", "vote_seq"],
        previous={"__before": F.col("exit_sec")}, before={"__n": F.lit(1)},
    )
    start = F.col("__before").isNull() | (F.col("exit_sec") - F.col("__before") > POINT_SLACK_SEC)
    chained = scan(
        chained, SONG, F.floor(F.col("exit_sec") / 64.0).cast("bigint"), ["exit_sec", "entry_sec", "vote_seq"],
        latest={"__chain": F.when(start, F.col("__n"))},
    )
    fields = [c for c in off.columns if c not in ("song_id", "vote_seq")]
    item = F.struct("vote_seq", *fields)
    near = lambda a, b: (
        (F.abs(a["exit_sec"] - b["exit_sec"]) <= POINT_SLACK_SEC)
        & (F.abs(a["entry_sec"] - b["entry_sec"]) <= POINT_SLACK_SEC)
    )
    groups = chained.groupBy(*SONG, "__chain").agg(F.array_sort(F.collect_list(item)).alias("v"))
    kept = F.aggregate(
        "v",
        F.slice("v", 1, 0),
        lambda acc, s: F.when(F.exists(acc, lambda o: near(o, s)), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return groups.select("song_id", F.explode(kept).alias("s")).select("song_id", "s.*")


def pick_distinct(ranked: DataFrame, count: int) -> DataFrame:
    """Greedy choice along the rank: skip a wrap close to a chosen one at both ends.

    ``ranked`` holds at most ``9 * count`` rows per song, ordered by ``rank``.
    """
    item = F.struct("rank", "e", "x", "start_sec", "end_sec", "p_good", "score", "prior")
    songs = ranked.groupBy(*SONG).agg(F.array_sort(F.collect_list(item)).alias("v"))
    close = lambda a, b: (
        (F.abs(a["e"] - b["e"]) < DISTINCT_BARS) & (F.abs(a["x"] - b["x"]) < DISTINCT_BARS)
    )
    chosen = F.aggregate(
        "v",
        F.slice("v", 1, 0),
        lambda acc, s: F.when((F.size(acc) >= count) | F.exists(acc, lambda o: close(o, s)), acc).otherwise(
            F.concat(acc, F.array(s))
        ),
    )
    return songs.select("song_id", F.posexplode(chosen).alias("rank", "s")).select(
        "song_id",
        (F.col("rank") + 1).alias("rank"),
        "s.start_sec",
        "s.end_sec",
        "s.p_good",
        "s.score",
        "s.prior",
    )


def rank_suggestions(
    bars: DataFrame, votes: DataFrame, min_loop: float = MIN_LOOP_SEC, count: int = SUGGESTION_COUNT
) -> DataFrame:
    """The ``count`` best distinct wraps per song.

    ``bars`` are classified bars with ``gain``: a bar's contribution to P(good), as exit
    plus as entry.  ``votes`` (song_id, exit_sec, entry_sec, rating, vote_seq) are the
    current decisions.  Pairwise models rank through :func:`rank_scored_wraps`.
    """
    profile = settle(bar_profile(settle(bars)))
    bars, votes = profile.select("song_id", "bar_idx", "start_sec", "end_sec"), settle(votes)
    exits, entries = _sides(profile)
    exits = settle(_positions(exits, bars, min_loop))
    matches = settle(_grid_matches(votes, bars))
    spread = (2 * DISTINCT_BARS - 1) ** 2 * count
    touched = matches.groupBy(*SONG).agg(F.count(F.lit(1)).alias("m"))
    songs = bars.select("song_id").distinct().join(touched, SONG, "left")
    limits = songs.select("song_id", (F.lit(spread) + F.coalesce("m", F.lit(0))).alias("k"))

    grid = _long_pairs(exits, entries, limits).unionByName(_short_pairs(exits, entries, min_loop))
    open_pairs = grid.join(matches, ["song_id", "x", "e"], "left_anti").withColumn("prior", F.lit(None).cast("string"))
    approved = (
        matches.filter(F.col("prior") == "good")
        .join(exits.drop("near_end", "far_end"), ["song_id", "x"])
        .join(entries.drop("n_bars"), ["song_id", "seg", "e"])
        .filter(F.col("exit_sec") - F.col("entry_sec") >= min_loop)
    )
    listed = approved.select("song_id", F.col("exit_sec").alias("g_exit"), F.col("entry_sec").alias("g_entry"))
    off = settle(_off_grid(votes, profile, min_loop))
    cell = lambda c: F.floor(c / POINT_SLACK_SEC)
    covered = (
        off.withColumn("xb", F.explode(F.sequence(cell(F.col("exit_sec")) - 1, cell(F.col("exit_sec")) + 1)))
        .join(listed.withColumn("xb", cell(F.col("g_exit"))), ["song_id", "xb"])
        .filter(
            (F.abs(F.col("g_exit") - F.col("exit_sec")) <= POINT_SLACK_SEC)
            & (F.abs(F.col("g_entry") - F.col("entry_sec")) <= POINT_SLACK_SEC)
        )
        .select("song_id", "vote_seq")
        .distinct()
    )
    off = _first_of_near(off.join(covered, ["song_id", "vote_seq"], "left_anti"))
    cols = ["song_id", "x", "e", "exit_sec", "entry_sec", "x_terms", "x_part", "e_terms", "e_part", "prior", "off_seq"]
    on = open_pairs.unionByName(approved, allowMissingColumns=True).withColumn("off_seq", F.lit(-1).cast("bigint"))
    every = on.select(*cols).unionByName(off.withColumn("off_seq", F.col("vote_seq").cast("bigint")).select(*cols))
    return rank_scored_wraps(_scored(every), count)


def rank_scored_wraps(pairs: DataFrame, count: int = SUGGESTION_COUNT) -> DataFrame:
    """Distinct top wraps from scored pairs (song_id, x, e, exit_sec, entry_sec, p_good, score, units, prior, off_seq)."""
    keep = F.struct("exit_sec", "entry_sec", "p_good", "score", "units", "prior", "off_seq")
    first = F.struct(F.col("units"), (-F.col("off_seq")).alias("o"))
    cells = pairs.groupBy("song_id", "x", "e").agg(F.max_by(keep, first).alias("b")).select("song_id", "x", "e", "b.*")
    order = [F.col("units").desc(), F.col("off_seq"), F.col("x"), F.col("e")]
    ranked = top_per_key(cells, SONG, order, (2 * DISTINCT_BARS - 1) ** 2 * count)
    return pick_distinct(
        ranked.withColumnsRenamed({"entry_sec": "start_sec", "exit_sec": "end_sec"}), count
    )


def acceptable_pair_counts(bars: DataFrame, min_loop: float = MIN_LOOP_SEC) -> DataFrame:
    """Number of acceptable bar pairs per song and per exit, from running counts instead of pairs."""
    profile = settle(bar_profile(settle(bars)))
    bars = profile.select("song_id", "bar_idx", "start_sec", "end_sec")
    counted = scan(
        profile, ["song_id"], block_of(F.col("bar_idx")), ["bar_idx"], through={"ok_upto": F.col("entry_ok").cast("int")}
    )
    seg_start = profile.groupBy("song_id", F.col("runs_before").alias("seg")).agg(F.min("bar_idx").alias("seg_bar"))
    exits = _positions(_sides(profile)[0], bars, min_loop).join(seg_start, ["song_id", "seg"])
    cum = counted.select("song_id", F.col("bar_idx").alias("last_bar"), "ok_upto")
    start = counted.select(
        "song_id", F.col("bar_idx").alias("seg_bar"), (F.col("ok_upto") - F.col("entry_ok").cast("int")).alias("ok_before")
    )
    joined = (
        exits.withColumn("last_bar", F.least(F.col("near_end"), F.col("x")) - 1)
        .filter(F.col("last_bar") >= F.col("seg_bar"))
        .join(cum, ["song_id", "last_bar"])
        .join(start, ["song_id", "seg_bar"])
    )
    pairs = (F.col("ok_upto") - F.col("ok_before")).cast("bigint")
    return joined.groupBy("song_id").agg(F.sum(pairs).alias("pairs"), F.count_if(pairs > 0).alias("exits")).filter("pairs > 0")
