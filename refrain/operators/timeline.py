"""Edits over tables of timeline clips, project by project.

``clips`` carries (project_id, clip_id, buffer_id, start_time, row, layer_index, trim_start,
trim_end, gain, fade_in_sec, fade_out_sec, speed, label); selections are boolean columns.
Per-project values come from aggregations joined back, running positions from block scans,
so a project with a large share of all clips is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.clips import (
    FADE_RANGE,
    GAIN_RANGE,
    PROJECT_MIN_SEC,
    SPEED_RANGE,
    clip_duration,
    clip_end,
    fade_multiplier,
    playback_speed,
    source_time,
)
from refrain.functions.exact import clamp
from refrain.operators.ordered import block_of, dense_index, scan
from refrain.schemas import STEM_LABELS

PROJECT = ["project_id"]
CUT_GUARD = 1e-4
EDGE_SEC = 0.001
_CELL_SEC = 16.0


#: Clips whose points are worked out together; their arrays stay in the processor's cache.
_GAIN_ROWS = 64
_GAIN_NUMBERS = ["start_time", "gain", "fade_in_sec", "fade_out_sec", "wall", "fin", "edge"]


def _gain_terms(clips: DataFrame, max_steps: int, min_steps: int, per_second: float) -> DataFrame:
    """The numbers of a clip that its gain depends on."""
    wall = clip_duration()
    steps = F.least(F.lit(max_steps), F.greatest(F.lit(min_steps), F.ceil(wall * per_second).cast("int")))
    return clips.select(
        *PROJECT, "clip_id", "start_time", "gain", "fade_in_sec", "fade_out_sec", wall.alias("wall"), clip_end().alias("fin"),
        F.least(F.lit(EDGE_SEC), F.greatest(F.lit(0.0), wall * 0.5)).alias("edge"), steps.alias("steps"),
    )


def gain_points(clips: DataFrame, max_steps: int = 256, min_steps: int = 8, per_second: float = 40.0) -> DataFrame:
    """Piecewise-linear gain automation of each clip: one row per breakpoint, ordered by ``point``."""
    # Rows grow about a hundredfold here: spread the clips first, by the key later steps group on, so that
    # grouping the points needs no further exchange.  Only what the gain needs travels through the explode.
    base = _gain_terms(clips.repartition(*PROJECT, "clip_id"), max_steps, min_steps, per_second)
    rows = base.withColumn("point", F.explode(F.sequence(F.lit(0), F.when(F.col("wall") > 0, F.col("steps") + 3).otherwise(F.lit(0)))))
    point, n, edge, wall = F.col("point"), F.col("steps"), F.col("edge"), F.col("wall")
    attack, release = F.least(edge, wall), F.greatest(F.lit(0.0), wall - edge)
    inner = ((point - 1) / n) * wall
    offset = (
        F.when(point == 0, F.lit(0.0)).when(point == 1, attack).when(point <= n + 1, inner).when(point == n + 2, release).otherwise(wall)
    )
    keep = (
        F.when(point == 0, F.lit(True))
        .when(point == 1, attack > 0)
        .when(point <= n + 1, (inner > attack + 1e-6) & (inner < release - 1e-6))
        .when(point == n + 2, release > attack + 1e-6)
        .otherwise(F.lit(True))
    )
    t = F.col("start_time") + F.col("offset_sec")
    rising = F.when(t < F.col("start_time") + edge, F.greatest(F.lit(0.0), (t - F.col("start_time")) / edge)).otherwise(F.lit(1.0))
    falling = F.when(t > F.col("fin") - edge, F.greatest(F.lit(0.0), (F.col("fin") - t) / edge)).otherwise(F.lit(1.0))
    edge_gain = F.when(edge > 0, F.least(F.lit(1.0), rising, falling)).otherwise(F.lit(1.0))
    value = F.greatest(F.lit(0.0), F.col("gain") * fade_multiplier(t, F.col("fin")) * edge_gain)
    return (
        rows.filter(keep)
        .withColumn("offset_sec", offset)
        .select(*PROJECT, "clip_id", "point", t.alias("time_sec"), value.alias("value"))
    )


def _ramp(way: np.ndarray, length: np.ndarray, inside: np.ndarray) -> np.ndarray:
    value = way / np.where(length > 0, length, 1.0)
    np.minimum(1.0, np.maximum(0.0, value, out=value), out=value)
    value[~inside] = 1.0
    return value


def _gain_values(t: np.ndarray, start, gain, fade_in, fade_out, fin, edge, edged: bool) -> np.ndarray:
    """The gain at times ``t``, as in ``gain_points``; ``edged``: some may lie in the short ramps at the ends."""
    until, after = (np.where(x > 0, y, z) for x, y, z in ((fade_in, start + fade_in, -np.inf), (fade_out, fin - fade_out, np.inf)))
    since, left = t - start, fin - t
    value = _ramp(since, fade_in, t < until)
    value *= _ramp(left, fade_out, t > after)
    value *= gain
    if edged:
        value *= np.minimum(_ramp(since, edge, (edge > 0) & (t < start + edge)), _ramp(left, edge, (edge > 0) & (t > fin - edge)))
    return np.maximum(0.0, value, out=value)


def _gain_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each clip; values are added up in the order of the points, as sums of symmetric fades often end in a tie."""
    for b in batches:
        steps = b.column("steps").to_numpy().astype(np.int64)
        numbers = [b.column(c).to_numpy() for c in _GAIN_NUMBERS]
        points, total, peak = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
        order = np.argsort(steps, kind="stable")
        for at in range(0, b.num_rows, _GAIN_ROWS):
            rows = order[at : at + _GAIN_ROWS]
            n = steps[rows][:, None]
            start, gain, fade_in, fade_out, wall, fin, edge = (x[rows][:, None] for x in numbers)
            attack, release = np.minimum(edge, wall), np.maximum(0.0, wall - edge)
            i = np.arange(1, n.max() + 1)[None, :]
            inner = (i / n) * wall
            terms = (start, gain, fade_in, fade_out, fin, edge)
            ends = _gain_values(start + np.concatenate((np.zeros_like(wall), attack, release, wall), axis=1), *terms, edged=True)
            # Between attack and release a rounded time can fall into a ramp only where doubles are coarser than the margin of 1e-6.
            between = _gain_values(start + inner, *terms, edged=bool(np.abs(start).max() + wall.max() > 1e6))
            always = np.ones_like(wall, bool)
            inside = (i <= n) & (inner > attack + 1e-6) & (inner < release - 1e-6)
            keep = np.concatenate((always, attack > 0, inside, release > attack + 1e-6, always), axis=1)
            values = np.where(keep, np.concatenate((ends[:, :2], between, ends[:, 2:]), axis=1), 0.0)
            points[rows], total[rows], peak[rows] = keep.sum(axis=1), np.cumsum(values, axis=1)[:, -1], values.max(axis=1)
        yield pa.RecordBatch.from_arrays([b.column("project_id"), b.column("clip_id"), pa.array(points), pa.array(total), pa.array(peak)], ["project_id", "clip_id", "points", "total", "peak"])


def gain_totals(clips: DataFrame, max_steps: int = 256, min_steps: int = 8, per_second: float = 40.0) -> DataFrame:
    """Number, sum and peak of the ``gain_points`` of each clip, without a row per point.

    Clips without a length or with a number that is null or not finite go through ``gain_points`` itself.
    """
    terms = ["start_time", "trim_start", "trim_end", "gain", "fade_in_sec", "fade_out_sec", "speed"]
    clips = clips.select(*PROJECT, "clip_id", *terms)
    usual = clip_duration() > 0
    for c in (clip_duration(), clip_end(), *map(F.col, ("start_time", "gain", "fade_in_sec", "fade_out_sec"))):
        usual = usual & (F.abs(c) < float("inf"))
    usual = F.coalesce(usual, F.lit(False))
    keys = ", ".join(f"{c} {clips.schema[c].dataType.simpleString()}" for c in (*PROJECT, "clip_id"))
    spread = clips.where(usual).repartition(*PROJECT, "clip_id")
    summed = _gain_terms(spread, max_steps, min_steps, per_second).mapInArrow(_gain_totals, f"{keys}, points long, total double, peak double")
    odd = gain_points(clips.where(~usual), max_steps, min_steps, per_second)
    one = odd.select(*PROJECT, "clip_id", F.lit(1).cast("long").alias("points"), F.col("value").alias("total"), F.col("value").alias("peak"))
    return summed.unionByName(one).groupBy(*PROJECT, "clip_id").agg(F.sum("points").alias("points"), F.sum("total").alias("total"), F.max("peak").alias("peak"))


def project_end(clips: DataFrame) -> DataFrame:
    return clips.groupBy(*PROJECT).agg(F.greatest(F.lit(PROJECT_MIN_SEC), F.max(clip_end())).alias("end_sec"))


def split_at(clips: DataFrame, cuts: DataFrame, targets: Column | None = None) -> DataFrame:
    """Cut clips at timeline points (project_id, cut_sec); untouched clips pass through.

    A clip's pieces keep its outer fades and lose the inner ones; ``piece`` numbers them
    from 0.  ``targets`` limits the cut to a selection.  Cuts meet clips per time cell, so
    only cuts inside a clip are paired with it.
    """
    cell = lambda c: F.floor(c / _CELL_SEC).cast("bigint")
    spans = clips.filter(targets) if targets is not None else clips
    spans = spans.withColumn("__end", clip_end())
    points = cuts.select(*PROJECT, "cut_sec").distinct().withColumn("__cell", cell(F.col("cut_sec")))
    src = source_time(F.col("cut_sec"))
    crossing = (
        spans.withColumn("__cell", F.explode(F.sequence(cell(F.col("start_time")), cell(F.col("__end")))))
        .join(points, [*PROJECT, "__cell"])
        .filter(
            (F.col("cut_sec") > F.col("start_time") + CUT_GUARD)
            & (F.col("cut_sec") < F.col("__end") - CUT_GUARD)
            & (src > F.col("trim_start") + CUT_GUARD)
            & (src < F.col("trim_end") - CUT_GUARD)
        )
        .select(*PROJECT, "clip_id", "cut_sec", src.alias("cut_src"))
    )
    # The cuts of one clip: bounded by the clip's length over the smallest cut distance.
    per_clip = crossing.groupBy(*PROJECT, "clip_id").agg(
        F.array_sort(F.collect_list(F.struct("cut_sec", "cut_src"))).alias("__cuts")
    )
    joined = clips.join(per_clip, [*PROJECT, "clip_id"], "left").withColumn("__n", F.coalesce(F.size("__cuts"), F.lit(0)))
    pieces = joined.select("*", F.explode(F.sequence(F.lit(0), F.greatest("__n", F.lit(0)))).alias("piece"))
    at = lambda i, f: F.get(F.col("__cuts"), i)[f]
    first, last = F.col("piece") == 0, F.col("piece") == F.col("__n")
    keep = [c for c in clips.columns if c not in ("start_time", "trim_start", "trim_end", "fade_in_sec", "fade_out_sec")]
    return pieces.select(
        *keep,
        "piece",
        F.when(first, F.col("start_time")).otherwise(at(F.col("piece") - 1, "cut_sec")).alias("start_time"),
        F.when(first, F.col("trim_start")).otherwise(at(F.col("piece") - 1, "cut_src")).alias("trim_start"),
        F.when(last, F.col("trim_end")).otherwise(at(F.col("piece"), "cut_src")).alias("trim_end"),
        F.when(first, F.col("fade_in_sec")).otherwise(F.lit(0.0)).alias("fade_in_sec"),
        F.when(last, F.col("fade_out_sec")).otherwise(F.lit(0.0)).alias("fade_out_sec"),
    )


def duplicate_append(clips: DataFrame, selected: Column) -> DataFrame:
    """Copies of the selected clips, appended per row after the row's last selected end."""
    picked = clips.filter(selected).withColumn("__dur", clip_duration())
    ends = picked.groupBy(*PROJECT, "row").agg(F.max(clip_end()).alias("__from"))
    placed = scan(
        picked,
        [*PROJECT, "row"],
        F.floor(F.col("start_time") / 4096.0).cast("bigint"),
        ["start_time", "clip_id"],
        before={"__played": F.col("__dur")},
    ).join(ends, [*PROJECT, "row"])
    return placed.withColumns(
        {"start_time": F.col("__from") + F.col("__played"), "clip_id": F.concat("clip_id", F.lit("+copy"))}
    ).drop("__dur", "__from", "__played")


def duplicate_layers(clips: DataFrame, selected: Column) -> DataFrame:
    """Copies in place, stacked above the row's top layer in layer order."""
    top = clips.groupBy(*PROJECT, "row").agg(F.greatest(F.lit(0), F.max("layer_index")).alias("__top"))
    picked = clips.filter(selected)
    ordered = dense_index(
        picked, [*PROJECT, "row"], block_of(F.col("layer_index")), ["layer_index", "clip_id"], "__nth"
    ).join(top, [*PROJECT, "row"])
    return ordered.withColumns(
        {"layer_index": F.col("__top") + F.col("__nth") + 1, "clip_id": F.concat("clip_id", F.lit("+layer"))}
    ).drop("__top", "__nth")


def _stem_label(name: Column, kind: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for kv in STEM_LABELS.items() for v in kv])
    return F.concat(name, F.lit(" · "), labels[kind])


def stem_problems(clips: DataFrame, stems: DataFrame, selected: Column) -> DataFrame:
    """Why a layer plan cannot be made: sources with differing stem counts, selected clips without stems."""
    sizes = stems.groupBy("source_buffer_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"))  # one row
    uneven = sizes.crossJoin(F.broadcast(most)).filter("n <> most").select(
        F.lit("incomplete-stems").alias("rule"), F.col("source_buffer_id").alias("id")
    )
    missing = (
        clips.filter(selected)
        .join(stems, F.col("buffer_id") == F.col("source_buffer_id"), "left_anti")
        .select(F.lit("clip-without-stems").alias("rule"), F.col("clip_id").alias("id"))
    )
    return uneven.unionByName(missing)


def layer_plan(clips: DataFrame, buffers: DataFrame, stems: DataFrame, selected: Column, stem_count: int) -> DataFrame:
    """Clips after replacing each selected one by its aligned stems.

    Stem 0 stays on the clip's row; the others take new rows below all used ones, source
    rows in ascending order.  ``stems`` (source_buffer_id, kind, buffer_id, stem_idx).
    """
    marked = clips.withColumn("__sel", selected)
    used = marked.groupBy(*PROJECT, "row").agg(F.max("__sel").alias("__sel"))
    floor = used.groupBy(*PROJECT).agg(F.max("row").alias("__max_row"))
    rows = used.filter("__sel").select(*PROJECT, "row")
    ranked = dense_index(rows, PROJECT, block_of(F.col("row")), ["row"], "__rank").join(floor, PROJECT)
    # One row per buffer with all its stems: clips meet two tables only and become a row per stem after the last join.
    stem = F.struct("kind", "stem_idx", F.col("buffer_id").alias("stem_buffer"))
    parts = stems.groupBy(F.col("source_buffer_id").alias("buffer_id")).agg(F.collect_list(stem).alias("__stems"))
    named = parts.join(buffers.select("buffer_id", F.col("name").alias("__name")), "buffer_id", "left")
    split = marked.filter("__sel").join(ranked, [*PROJECT, "row"]).join(named, "buffer_id").withColumn("__stem", F.explode("__stems"))
    name = F.coalesce("label", "__name", F.lit("Clip"))
    kind, nth = F.col("__stem.kind"), F.col("__stem.stem_idx")
    extra = F.col("__max_row") + 1 + F.col("__rank") * (stem_count - 1) + nth - 1
    layered = split.withColumns(
        {
            "label": _stem_label(name, kind),
            "row": F.when(nth == 0, F.col("row")).otherwise(extra).cast("int"),
            "clip_id": F.concat_ws("#", "clip_id", kind),
            "buffer_id": F.col("__stem.stem_buffer"),
        }
    ).select(*clips.columns)
    return marked.filter(~F.col("__sel")).select(*clips.columns).unionByName(layered)


def layer_plan_buffers(planned: DataFrame, buffers: DataFrame, stems: DataFrame) -> DataFrame:
    """Buffers still in use plus the stem buffers."""
    # Dealt out first: a task then tells apart its share of the ids, not all that occur in its part of the clips.
    named = planned.select("buffer_id").repartition("buffer_id").distinct()
    used = buffers.join(named, "buffer_id", "left_semi")
    names = buffers.select(F.col("buffer_id").alias("source_buffer_id"), F.col("name").alias("__name"))
    added = stems.join(names, "source_buffer_id", "left").select(
        "buffer_id",
        _stem_label(F.coalesce("__name", F.lit("Clip")), F.col("kind")).alias("name"),
        "duration_sec",
    )
    return used.select("buffer_id", "name", "duration_sec").unionByName(added)


def retained_buffers(buffers: DataFrame, *references: DataFrame) -> DataFrame:
    """Buffers that any current or historical snapshot still names (buffer_id)."""
    ids = references[0].select("buffer_id")
    for r in references[1:]:
        ids = ids.unionByName(r.select("buffer_id"))
    return buffers.join(ids.distinct(), "buffer_id", "left_semi")


def remove_clips(clips: DataFrame, buffers: DataFrame, removed: Column) -> tuple[DataFrame, DataFrame]:
    """Remaining clips, and buffers without those only removed clips used."""
    left = clips.filter(~removed)
    orphans = (
        clips.filter(removed).select(*PROJECT, "buffer_id").distinct().join(left, [*PROJECT, "buffer_id"], "left_anti")
    )
    return left, buffers.join(orphans, [*PROJECT, "buffer_id"], "left_anti")


def update_clips(
    clips: DataFrame,
    on: Column | None = None,
    gain: Column | None = None,
    speed: Column | None = None,
    fade_in: Column | None = None,
    fade_out: Column | None = None,
) -> DataFrame:
    """Set properties on all or on selected clips, clamped to their valid ranges."""
    on = F.lit(True) if on is None else on
    wanted = {
        "gain": (gain, GAIN_RANGE), "speed": (speed, SPEED_RANGE),
        "fade_in_sec": (fade_in, FADE_RANGE), "fade_out_sec": (fade_out, FADE_RANGE),
    }
    return clips.withColumns(
        {c: F.when(on, clamp(v, *r)).otherwise(F.col(c)) for c, (v, r) in wanted.items() if v is not None}
    )


def rebase_selection(clips: DataFrame, selected: Column) -> DataFrame:
    """Selected clips moved so the earliest starts at 0, with the render length of the selection."""
    picked = clips.filter(selected)
    span = picked.groupBy(*PROJECT).agg(F.min("start_time").alias("__from"), F.max(clip_end()).alias("__to"))
    return (
        picked.join(span, PROJECT)
        .withColumns(
            {
                "start_time": F.greatest(F.lit(0.0), F.col("start_time") - F.col("__from")),
                "render_sec": F.greatest(F.lit(0.25), F.greatest(F.lit(0.0), F.col("__to")) - F.col("__from") + 0.25),
            }
        )
        .drop("__from", "__to")
    )


def active_at(clips: DataFrame, playheads: DataFrame) -> DataFrame:
    """What to start when playback begins at a playhead (project_id, playhead): delay, offset, length."""
    end = clip_end()
    joined = clips.join(playheads, PROJECT).filter(end > F.col("playhead") + 1e-6)
    ahead = F.col("playhead") < F.col("start_time") - 1e-6
    offset = F.when(ahead, F.col("trim_start")).otherwise(source_time(F.col("playhead")))
    remaining = F.col("trim_end") - offset
    rows = joined.select(
        *PROJECT,
        "clip_id",
        "playhead",
        F.when(ahead, F.col("start_time") - F.col("playhead")).otherwise(F.lit(0.0)).alias("delay_sec"),
        offset.alias("offset_sec"),
        remaining.alias("source_sec"),
        F.when(ahead, end - F.col("start_time")).otherwise(end - F.col("playhead")).alias("wall_sec"),
        playback_speed().alias("speed"),
    )
    return rows.filter(F.col("source_sec") > 1e-6)


def loops_to_rows(loops: DataFrame, clips: DataFrame) -> DataFrame:
    """Place rendered loops below the project's rows, one per row, in ``loop_order``.

    ``loops`` (project_id, loop_order, buffer_id, source_name, tags, bars, length_sec).
    """
    floor = clips.groupBy(*PROJECT).agg(F.max("row").alias("__max"))
    numbered = dense_index(loops, PROJECT, block_of(F.col("loop_order")), ["loop_order"], "__i").join(floor, PROJECT, "left")
    nth = (F.col("__i") + 1).cast("string")
    label = F.concat(
        F.col("source_name"), F.lit(" "), F.concat_ws(" ", "tags"), F.lit(" loop "), nth, F.lit(" ("), F.col("bars").cast("string"), F.lit(" bar)")
    )
    return numbered.select(
        *PROJECT, "loop_order", "buffer_id", label.alias("label"), F.lit(0.0).alias("start_time"),
        (F.coalesce("__max", F.lit(-1)) + 1 + F.col("__i")).cast("int").alias("row"),
        F.lit(0.0).alias("trim_start"), F.col("length_sec").alias("trim_end"),
    )


def song_parts(total_from: Column, total_to: Column, start: Column, end: Column, middle: Column) -> Column:
    """Lead-in, loop and lead-out of a source region as an array of structs; parts under 1 ms are dropped."""
    part = lambda a, b, label: F.struct(a.alias("part_from"), b.alias("part_to"), label.alias("part"))
    parts = F.array(part(total_from, start, F.lit("lead-in")), part(start, end, middle), part(end, total_to, F.lit("lead-out")))
    return F.filter(parts, lambda p: p["part_to"] - p["part_from"] >= 1e-3)


def loops_with_song_to_rows(loops: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per loop holding the untouched source as lead-in, loop and lead-out clips.

    ``loops`` (project_id, loop_order, buffer_id, source_name, bars, start_sec, end_sec, trim_start, trim_end).
    """
    floor = clips.groupBy(*PROJECT).agg(F.max("row").alias("__max"))
    numbered = dense_index(loops, PROJECT, block_of(F.col("loop_order")), ["loop_order"], "__i").join(floor, PROJECT, "left")
    middle = F.concat(F.lit("loop "), (F.col("__i") + 1).cast("string"), F.lit(" ("), F.col("bars").cast("string"), F.lit(" bar)"))
    parts = song_parts(F.col("trim_start"), F.col("trim_end"), F.col("start_sec"), F.col("end_sec"), middle)
    rows = numbered.withColumn("__parts", parts).select("*", F.posexplode("__parts").alias("part_idx", "p"))
    played = F.aggregate(
        F.slice("__parts", F.lit(1), F.col("part_idx")), F.lit(0.0), lambda acc, p: acc + (p["part_to"] - p["part_from"])
    )
    return rows.select(
        *PROJECT, "loop_order", "buffer_id", F.concat_ws(" ", "source_name", "p.part").alias("label"),
        played.alias("start_time"),
        (F.coalesce("__max", F.lit(-1)) + 1 + F.col("__i")).cast("int").alias("row"),
        F.col("p.part_from").alias("trim_start"), F.col("p.part_to").alias("trim_end"),
    )


def validate_projects(clips: DataFrame, buffers: DataFrame, audio: DataFrame) -> DataFrame:
    """Violations of the project rules as (project_id, rule, id); no rows means valid.

    Each table is read once: clips are flagged row by row and summed up per clip id, buffers and audio
    are counted together per buffer id.  An id or project that is null matches nothing.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    broken = lambda bad: F.coalesce(bad, F.lit(True))

    def flagged(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
        """A row per rule that ``df`` breaks; ``df`` has one row per project and key."""
        names = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
        return df.select("project_id", F.explode(names).alias("rule"), F.col(key).cast("string").alias("id"))

    key = ["project_id", "buffer_id"]
    whole = F.col("project_id").isNotNull() & F.col("buffer_id").isNotNull()
    no, one = F.lit(False), F.lit(1).cast("long")
    bad_buffer = ~(finite("duration_sec") & (F.col("duration_sec") >= 0) & F.col("name").isNotNull() & (F.length("buffer_id") > 0))
    bad_length = ~((F.col("byte_length") > 0) & (F.col("byte_length") == F.floor("byte_length")))
    sides = buffers.select(*key, one.alias("buffers"), F.lit(0).cast("long").alias("audio"), broken(bad_buffer).alias("bad_buffer"), no.alias("bad_length")).unionByName(
        audio.select(*key, F.lit(0).cast("long").alias("buffers"), one.alias("audio"), no.alias("bad_buffer"), broken(bad_length).alias("bad_length"))
    )
    sides = sides.groupBy(*key).agg(F.sum("buffers").alias("buffers"), F.sum("audio").alias("audio"), F.max("bad_buffer").alias("bad_buffer"), F.max("bad_length").alias("bad_length"))
    both = whole & (F.col("buffers") > 0) & (F.col("audio") > 0)
    of_buffers = flagged(
        sides,
        "buffer_id",
        {
            "duplicate-buffer": F.col("buffers") > 1,
            "duplicate-audio": F.col("audio") > 1,
            "bad-buffer": F.col("bad_buffer"),
            "buffer-without-audio": (F.col("buffers") > 0) & ~both,
            "audio-without-buffer": (F.col("audio") > 0) & ~both,
            "bad-audio-length": F.col("bad_length"),
        },
    )

    numbers = ["start_time", "row", "layer_index", "trim_start", "trim_end", "gain", "fade_in_sec", "fade_out_sec", "speed"]
    all_finite = F.lit(True)
    for c in numbers:
        all_finite = all_finite & finite(c)
    rules = {
        "bad-number": ~all_finite,
        "bad-trim": ~((F.col("trim_start") >= 0) & (F.col("trim_end") > F.col("trim_start"))),
        "bad-speed": ~(F.col("speed") > 0),
    }
    known = sides.filter((F.col("buffers") > 0) & whole).select(*key, F.lit(True).alias("known"))
    checked = clips.select(*key, "clip_id", *[broken(bad).alias(rule) for rule, bad in rules.items()]).join(known, key, "left")
    per_clip = checked.groupBy("project_id", "clip_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("known").isNull()).alias("clip-without-buffer"), *[F.max(f"`{rule}`").alias(rule) for rule in rules]
    )
    of_clips = flagged(per_clip, "clip_id", {"duplicate-clip": F.col("n") > 1} | {r: F.col(f"`{r}`") for r in ("clip-without-buffer", *rules)})
    return of_buffers.unionByName(of_clips)
