"""Means and aligned comparisons over stretches of hop frames.

``frames`` is (song_id, hop_idx, chroma, timbre, spec, rms, centroid, flux), dense per song.
Means over any stretch come from running sums looked up at its two ends, so overlapping
stretches (every loop window of a song) never re-read the frames between them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.exact import clamp01, half_up
from refrain.functions.vectors import band_delta, frame_vibe_sim, l2_normalize, spec_distance
from refrain.operators.ordered import block_of, order_statistic, scan
from refrain.operators.tiles import Tiles, at_hop, tiled

SONG = ["song_id"]
_VECTORS = (("chroma", 12), ("timbre", 8), ("spec", 24))
_SCALARS = ("rms", "centroid", "flux")
_FRAME = ("chroma", "timbre", "spec", "rms", "centroid", "flux")


def frame_prefix(frames: DataFrame) -> DataFrame:
    """Running sums of every feature up to and including each hop: (song_id, hop_idx, sums)."""
    parts = {f"{v}_{i}": F.element_at(v, i + 1) for v, n in _VECTORS for i in range(n)}
    parts |= {s: F.col(s) for s in _SCALARS}
    flat = frames.select("song_id", "hop_idx", *[c.alias(f"p_{n}") for n, c in parts.items()])
    summed = scan(flat, SONG, block_of(F.col("hop_idx")), ["hop_idx"], through={f"s_{n}": F.col(f"p_{n}") for n in parts})
    return summed.select("song_id", "hop_idx", F.array(*[F.col(f"s_{n}") for n in parts]).alias("sums"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*SONG).agg((F.max("hop_idx") + 1).alias("n_frames"))


def frame_at(t: Column, hop_sec: Column | float, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(t / hop_sec)))


def frame_tiles(frames: DataFrame | Tiles) -> Tiles:
    """Frames ready for look-ups; a table of frames is packed first."""
    return frames if isinstance(frames, Tiles) else tiled(frames, F.struct(*_FRAME))


def prefix_tiles(prefix: DataFrame | Tiles) -> Tiles:
    """Running sums ready for look-ups; a table of them is packed first."""
    return prefix if isinstance(prefix, Tiles) else tiled(prefix, F.col("sums"))


def span_means(prefix: DataFrame | Tiles, spans: DataFrame, lo: str = "i0", hi: str = "i1") -> DataFrame:
    """Mean frame of each span ``[lo, hi)`` (already inside the song) as a struct column ``mean``."""
    sums = prefix_tiles(prefix)
    joined = at_hop(at_hop(spans, sums, F.col(hi) - 1, "__hi"), sums, F.col(lo) - 1, "__lo", "left")
    n = F.col(hi) - F.col(lo)
    mean = F.when(F.col("__lo").isNull(), F.transform("__hi", lambda v: v / n)).otherwise(
        F.zip_with("__hi", "__lo", lambda a, b: (a - b) / n)
    )
    out = joined.withColumn("__m", mean)
    at, cols = 1, {}
    for v, size in _VECTORS:
        cols[v] = F.slice("__m", at, size)
        at += size
    frame = F.struct(
        l2_normalize(cols["chroma"]).alias("chroma"),
        l2_normalize(cols["timbre"]).alias("timbre"),
        cols["spec"].alias("spec"),
        *[F.element_at("__m", at + i).alias(s) for i, s in enumerate(_SCALARS)],
    )
    return out.withColumn("mean", frame).drop("__m", "__hi", "__lo")


def clamp_span(i0: Column, i1: Column, n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.lit(0), F.least(n - 1, i0))
    return a, F.greatest(a + 1, F.least(n, i1))


def compare_aligned(
    frames: DataFrame | Tiles,
    pairs: DataFrame,
    keys: Sequence[str],
    offsets: Column,
    value: Callable[[Column, Column], Column],
) -> DataFrame:
    """Evaluate ``value(frame a, frame b)`` for each {a, b} hop pair in ``offsets``: (keys, pos, value)."""
    tiles = frame_tiles(frames)
    rows = pairs.select(*keys, F.posexplode(offsets).alias("pos", "o")).select(*keys, "pos", "o.a", "o.b")
    joined = at_hop(at_hop(rows, tiles, F.col("a"), "__a"), tiles, F.col("b"), "__b")
    return joined.select(*keys, "pos", value(F.col("__a"), F.col("__b")).alias("value"))


def _strided(n: Column, step: Column, a: Column, b: Column) -> Column:
    ks = F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint"), step.cast("bigint"))
    return F.transform(ks, lambda k: F.struct((a + k).alias("a"), (b + k).alias("b")))


def homogeneity(prefix: DataFrame | Tiles, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Penalty for a section change inside a loop: bar to bar and half to half similarity.

    ``spans``: keys + start_sec, end_sec, bar_sec, hop_sec, n_frames.  At most a few dozen bars each.
    """
    keys = list(keys)
    n_bars = F.greatest(F.lit(1), half_up((F.col("end_sec") - F.col("start_sec")) / F.col("bar_sec"))).cast("int")
    s = spans.withColumn("__n", n_bars)
    mid = F.col("start_sec") + F.floor(F.col("__n") / 2) * F.col("bar_sec")
    bar = lambda i: F.struct(
        i.alias("part"),
        (F.col("start_sec") + i * F.col("bar_sec")).alias("t0"),
        F.least(F.col("end_sec"), F.col("start_sec") + (i + 1) * F.col("bar_sec")).alias("t1"),
    )
    half = lambda i, a, b: F.struct((F.col("__n") + i).alias("part"), a.alias("t0"), b.alias("t1"))
    parts = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("__n") - 1), bar),
        F.array(half(0, F.col("start_sec"), mid), half(1, mid, F.col("end_sec"))),
    )
    multi = s.filter("__n >= 2").select(*keys, "__n", "hop_sec", "n_frames", F.explode(parts).alias("p"))
    lo, hi = (frame_at(F.col(f"p.{c}"), F.col("hop_sec"), F.col("n_frames")) for c in ("t0", "t1"))
    a, b = clamp_span(lo, hi + 1, F.col("n_frames"))
    means = span_means(prefix, multi.withColumns({"i0": a, "i1": b}))
    seq = means.groupBy(*keys, "__n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("p.part").alias("part"), "mean"))), lambda x: x["mean"]).alias("f")
    )
    bars_of = lambda at: F.slice("f", F.lit(at), F.col("__n") - 1)
    sims = F.zip_with(bars_of(1), bars_of(2), frame_vibe_sim)
    scored = seq.withColumn("__adj", sims).withColumn(
        "__half", frame_vibe_sim(F.element_at("f", F.col("__n") + 1), F.element_at("f", F.col("__n") + 2))
    )
    mean_adj = F.aggregate("__adj", F.lit(0.0), lambda acc, v: acc + v) / F.size("__adj")
    value = clamp01(0.35 * mean_adj + 0.35 * F.least(F.lit(1.0), F.array_min("__adj")) + 0.3 * F.col("__half"))
    return s.select(*keys).join(scored.select(*keys, value.alias("homogeneity")), keys, "left").withColumn(
        "homogeneity", F.coalesce("homogeneity", F.lit(1.0))
    )


def wrap_vibe(frames: DataFrame | Tiles, prefix: DataFrame | Tiles, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is heard across the wrap: after the start against before the end.

    ``spans``: keys + start_sec, end_sec, window_sec, hop_sec, n_frames.
    """
    keys = list(keys)
    n = F.col("n_frames")
    at = lambda t: frame_at(t, F.col("hop_sec"), n)
    s = spans.withColumns(
        {"a0": at(F.col("start_sec")), "b0": at(F.col("end_sec") - F.col("window_sec")), "b1": at(F.col("end_sec")) + 1}
    ).withColumn("a1", F.greatest(F.col("a0") + 1, at(F.col("start_sec") + F.col("window_sec")) + 1))
    head = span_means(prefix, s.withColumns(dict(zip(("i0", "i1"), clamp_span(F.col("a0"), F.col("a1"), n)))))
    tail = span_means(prefix, s.withColumns(dict(zip(("i0", "i1"), clamp_span(F.col("b0"), F.col("b1"), n)))))
    means = head.select(*keys, F.col("mean").alias("h")).join(tail.select(*keys, F.col("mean").alias("t")), keys)
    overall = means.select(*keys, frame_vibe_sim(F.col("h"), F.col("t")).alias("mean_sim"))
    length = F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    step = F.greatest(F.lit(1), F.floor(length / 20))
    offsets = _strided(length, step, F.col("a0"), F.col("b0"))
    seq = compare_aligned(frames, s.filter(length >= 2), keys, offsets, frame_vibe_sim)
    agg = seq.groupBy(*keys).agg(F.avg("value").alias("seq_sim"), F.least(F.lit(1.0), F.min("value")).alias("worst"))
    value = clamp01(0.4 * F.col("mean_sim") + 0.35 * F.col("seq_sim") + 0.25 * F.col("worst"))
    return overall.join(agg, keys, "left").select(*keys, F.coalesce(value, F.col("mean_sim")).alias("wrap"))


def beat_wrap_vibe(beats: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cheap wrap proxy on beat frames.  ``windows``: keys + start_beat, end_beat, window_beats; ``beats`` carry hop_idx = beat."""
    w = F.greatest(
        F.lit(1), F.least(F.col("window_beats"), F.floor((F.col("end_beat") - F.col("start_beat")) / 2))
    )
    sized = windows.withColumn("__w", w).filter(F.col("end_beat") - F.col("start_beat") >= F.col("__w") * 2)
    offsets = _strided(F.col("__w"), F.lit(1), F.col("start_beat"), F.col("end_beat") - F.col("__w"))
    seq = compare_aligned(beats, sized, keys, offsets, frame_vibe_sim)
    return seq.groupBy(*keys).agg(
        (0.65 * F.avg("value") + 0.35 * F.least(F.lit(1.0), F.min("value"))).alias("beat_wrap")
    )


def phrase_closure(frames: DataFrame | Tiles, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Does the arrival resemble the continuation it replaces, before and after the cut.

    ``spans``: keys + start_sec, end_sec, window_sec, hop_sec, n_frames.  Spans without a
    comparable side are absent from the result (callers fall back to the wrap score).
    """
    width = F.greatest(F.lit(2), half_up(F.col("window_sec") / F.col("hop_sec")))
    s = spans.withColumns(
        {
            "__w": width,
            "__s": half_up(F.col("start_sec") / F.col("hop_sec")),
            "__e": half_up(F.col("end_sec") / F.col("hop_sec")),
        }
    )

    def side(a: Column, b: Column) -> Column:
        inside = (a >= 0) & (b >= 0) & (F.greatest(a, b) + F.col("__w") <= F.col("n_frames"))
        steps = F.least(F.lit(16), F.col("__w"))
        at = F.transform(
            F.sequence(F.lit(0).cast("bigint"), steps - 1),
            lambda k: F.struct(
                (a + F.floor(k * F.col("__w") / steps)).alias("a"), (b + F.floor(k * F.col("__w") / steps)).alias("b")
            ),
        )
        return F.when(inside, at).otherwise(F.slice(at, 1, 0))

    offsets = F.concat(
        side(F.col("__s") - F.col("__w"), F.col("__e") - F.col("__w")), side(F.col("__s"), F.col("__e"))
    )
    seq = compare_aligned(frames, s, keys, offsets, lambda f, g: band_delta(f["spec"], g["spec"]))
    agg = seq.groupBy(*keys).agg(F.avg("value").alias("m"), F.array_sort(F.collect_list("value")).alias("v"))  # <= 32 values
    p80 = F.element_at("v", (F.floor((F.size("v") - 1) * 0.8) + 1).cast("int"))
    return agg.select(*keys, F.exp(-(0.65 * F.col("m") + 0.35 * p80)).alias("closure"))


def span_distance(frames: DataFrame | Tiles, prefix: DataFrame | Tiles, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of two equally long stretches: of their means and along them.

    ``pairs``: keys + a0, b0, width (both stretches inside the song).
    """
    keys = list(keys)
    mean_of = lambda c, out: span_means(
        prefix, pairs.withColumns({"i0": F.col(c), "i1": F.col(c) + F.col("width")})
    ).select(*keys, F.col("mean").alias(out))
    means = mean_of("a0", "ma").join(mean_of("b0", "mb"), keys)
    dist = lambda f, g: spec_distance(f["spec"], g["spec"], f["rms"], g["rms"])
    overall = means.select(*keys, dist(F.col("ma"), F.col("mb")).alias("mean_d"))
    step = F.greatest(F.lit(1), F.floor(F.col("width") / 24))
    seq = compare_aligned(frames, pairs, keys, _strided(F.col("width"), step, F.col("a0"), F.col("b0")), dist)
    along = seq.groupBy(*keys).agg(F.avg("value").alias("seq_d"))
    return overall.join(along, keys).select(*keys, (0.4 * F.col("mean_d") + 0.6 * F.col("seq_d")).alias("distance"))


def transition_model(frames: DataFrame | Tiles, prefix: DataFrame | Tiles, songs: DataFrame) -> DataFrame:
    """Typical step size of each song at each comparison width: (song_id, width, n, median, high).

    ``songs``: song_id, hop_sec, beat_sec, n_frames, widths (array of seconds).  One distance
    per beat between neighbouring stretches; their quantiles are found without sorting a song.
    """
    w = F.array_distinct(
        F.transform("widths", lambda sec: F.greatest(F.lit(4), half_up(sec / F.greatest(F.col("hop_sec"), F.lit(1e-6)))))
    )
    step = F.greatest(F.lit(2), half_up(F.col("beat_sec") / F.greatest(F.col("hop_sec"), F.lit(1e-6))))
    scaled = songs.select("song_id", "n_frames", step.alias("step"), F.explode(w).alias("width"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1 - 2 * F.col("width"), F.col("step"))
    at = (
        scaled.filter(2 * F.col("width") < F.col("n_frames"))
        .select("song_id", "width", F.explode(starts).alias("a0"))
        .withColumn("b0", F.col("a0") + F.col("width"))
    )
    d = span_distance(frames, prefix, at, ["song_id", "width", "a0"])
    ranks = {"median": F.floor((F.col("n") - 1) * 0.5), "high": F.ceil((F.col("n") - 1) * 0.9)}
    return order_statistic(d, ["song_id", "width"], "distance", ranks, bin_width=1e-4)


def continuity(value: Column, median: Column, high: Column) -> Column:
    """A step no rougher than the song's median scores .95; past its rough end it scores low."""
    span = F.greatest(high - median, F.lit(0.02))
    falling = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.95 - (value - median) / span * 0.75))
    return F.when(value <= median + 1e-3, F.lit(0.95)).otherwise(falling)


def join_continuity(
    frames: DataFrame | Tiles, prefix: DataFrame | Tiles, model: DataFrame, spans: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Is the splice end -> start as smooth as an ordinary step of the song (worst scale), 0 when incomparable.

    ``spans``: keys + start_sec, end_sec, hop_sec, n_frames and, when the model holds several
    window widths per song, ``widths`` (array of hops) naming the ones to use.
    """
    keys = list(keys)
    n = F.col("n_frames")
    at = spans.withColumns(
        {"b0": frame_at(F.col("start_sec"), F.col("hop_sec"), n), "__e": frame_at(F.col("end_sec"), F.col("hop_sec"), n)}
    )
    scales = at.join(model.drop("n"), "song_id")
    if "widths" in spans.columns:
        scales = scales.filter(F.array_contains("widths", F.col("width")))
    usable = (
        scales.filter((F.abs(F.col("__e") - F.col("b0")) >= 2 * F.col("width")) & (F.col("n_frames") >= 8))
        .withColumn("a0", F.col("__e") - F.col("width"))
        .filter((F.col("a0") >= 0) & (F.col("b0") + F.col("width") <= n))
    )
    wide = [*keys, "width"]
    d = span_distance(frames, prefix, usable, wide).join(usable.select(*wide, "median", "high"), wide)
    scored = d.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.min(continuity(F.col("distance"), F.col("median"), F.col("high")))).alias("join")
    )
    return spans.select(*keys).join(scored, keys, "left").withColumn("join", F.coalesce("join", F.lit(0.0)))
