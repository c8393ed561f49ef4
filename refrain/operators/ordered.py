"""Ordered scans over keyed rows that never put a whole key into one task.

A plain ``Window.partitionBy(song)`` sends every row of a song to one task, which fails
once one song (or source, or project) holds a large share of the table.  The operators
here cut each key into blocks by an ordinal, run the window inside ``(key, block)``, and
carry only one summary row per block across blocks.  A key with few rows has one block
and pays one small extra aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that may share a task.
BLOCK_ROWS = 4096
#: Log ordinals that may share a task (votes, clicks); a key has at most this many rows per block.
BLOCK_SEQ = 1 << 18


def block_of(ordinal: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(ordinal / F.lit(rows)).cast("bigint")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    *,
    before: dict[str, Column] | None = None,
    through: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key in ``order``.

    ``before``/``through``: running sums excluding/including the row.
    ``previous``/``latest``: last non-null value before the row / up to and including it.
    ``following``: first non-null value after the row.
    ``highest``: largest value before the row.
    Blocks must be non-decreasing in ``order``; a block is the unit of one task.
    """
    before, through = before or {}, through or {}
    previous, latest, following = previous or {}, latest or {}, following or {}
    highest = highest or {}
    keys = list(keys)
    sums = {**before, **through}
    lasts = {**previous, **latest}
    position = F.struct(*order)

    base = df.withColumn("__block", block)
    in_block = Window.partitionBy(*keys, "__block").orderBy(*order)
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    later = in_block.rowsBetween(1, Window.unboundedFollowing)

    local = {}
    for name, expr in before.items():
        local[f"__in_{name}"] = F.sum(expr).over(earlier)
    for name, expr in through.items():
        local[f"__in_{name}"] = F.sum(expr).over(upto)
    for name, expr in previous.items():
        local[f"__in_{name}"] = F.last(expr, ignorenulls=True).over(earlier)
    for name, expr in latest.items():
        local[f"__in_{name}"] = F.last(expr, ignorenulls=True).over(upto)
    for name, expr in following.items():
        local[f"__in_{name}"] = F.first(expr, ignorenulls=True).over(later)
    for name, expr in highest.items():
        local[f"__in_{name}"] = F.max(expr).over(earlier)
    inner = base.select("*", *[c.alias(n) for n, c in local.items()])

    aggs = [F.sum(e).alias(f"__t_{n}") for n, e in sums.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), position)).alias(f"__t_{n}") for n, e in lasts.items()]
    aggs += [F.min_by(e, F.when(e.isNotNull(), position)).alias(f"__t_{n}") for n, e in following.items()]
    aggs += [F.max(e).alias(f"__t_{n}") for n, e in highest.items()]
    totals = base.groupBy(*keys, "__block").agg(*aggs)

    blocks = Window.partitionBy(*keys).orderBy("__block")
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    future = blocks.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.sum(f"__t_{n}").over(past).alias(f"__c_{n}") for n in sums]
    carried += [F.last(f"__t_{n}", ignorenulls=True).over(past).alias(f"__c_{n}") for n in lasts]
    carried += [F.first(f"__t_{n}", ignorenulls=True).over(future).alias(f"__c_{n}") for n in following]
    carried += [F.max(f"__t_{n}").over(past).alias(f"__c_{n}") for n in highest]
    offsets = totals.select(*keys, "__block", *carried)

    joined = inner.join(offsets, [*keys, "__block"])
    out = [F.col(c) for c in df.columns]
    out += [
        (F.coalesce(F.col(f"__in_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in sums
    ]
    out += [F.coalesce(F.col(f"__in_{n}"), F.col(f"__c_{n}")).alias(n) for n in [*lasts, *following]]
    out += [F.greatest(F.col(f"__in_{n}"), F.col(f"__c_{n}")).alias(n) for n in highest]
    return joined.select(*out)


def dense_index(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], name: str = "idx"
) -> DataFrame:
    """0, 1, 2, … per key in ``order`` (``row_number`` that splits hot keys)."""
    out = scan(df, keys, block, order, before={name: F.lit(1)})
    return out.withColumn(name, F.col(name).cast("int"))


def with_neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, back: int, ahead: int, rows: int = BLOCK_ROWS
) -> tuple[DataFrame, Window]:
    """Copy the rows near a tile edge into the neighbouring tile and return (rows, window).

    Evaluate window expressions reaching at most ``back`` rows before and ``ahead`` rows
    after over the returned window, then keep ``core`` rows only with :func:`core_rows`.
    ``idx`` must be dense per key.
    """
    if max(back, ahead) > rows:
        raise ValueError("the halo must fit into one tile")
    tile = block_of(F.col(idx), rows)
    offset = F.col(idx) % rows
    copies = F.array_compact(
        F.array(
            F.struct(tile.alias("tile"), F.lit(True).alias("core")),
            F.when(offset < ahead, F.struct((tile - 1).alias("tile"), F.lit(False).alias("core"))),
            F.when(offset >= rows - back, F.struct((tile + 1).alias("tile"), F.lit(False).alias("core"))),
        )
    )
    out = df.withColumn("__copy", F.explode(copies)).select(
        *df.columns, F.col("__copy.tile").alias("__tile"), F.col("__copy.core").alias("__core")
    )
    return out, Window.partitionBy(*keys, "__tile").orderBy(idx)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("__core").drop("__tile", "__core")


def order_statistic(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Column],
    bin_width: float,
) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    ``ranks`` maps an output name to a zero-based rank expressed with the column ``n``
    (rows of the key).  Equal values are counted once, counts are rolled up into bins of
    ``bin_width``, and only the values of the bin that holds the wanted rank are ordered.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__bin", F.floor(F.col("__v") / bin_width).cast("bigint"))
    )
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__m").alias("__bm"))
    by_bin = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = bins.select(
        *keys,
        "__bin",
        "__bm",
        F.coalesce(F.sum("__bm").over(by_bin), F.lit(0)).alias("__below"),
        F.sum("__bm").over(whole).alias("n"),
    )
    wanted = placed.select(
        *keys,
        "__bin",
        "__below",
        "n",
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]),
                lambda s: (s["rank"] >= F.col("__below")) & (s["rank"] < F.col("__below") + F.col("__bm")),
            )
        ).alias("__want"),
    )
    in_bin = Window.partitionBy(*keys, "__bin", "__want.name").orderBy("__v")
    hit = (
        counts.join(wanted, [*keys, "__bin"])
        .withColumn("__upto", F.col("__below") + F.sum("__m").over(in_bin))
        .filter((F.col("__upto") > F.col("__want.rank")) & (F.col("__upto") - F.col("__m") <= F.col("__want.rank")))
    )
    return hit.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("__want.name") == k, F.col("__v"))).alias(k) for k in ranks],
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; Spark cuts each input partition to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def asof(
    points: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    point_time: Column,
    grid_time: Column,
    payload: Sequence[str],
    *,
    before: str | None = "at",
    after: str | None = None,
    block_sec: float = 4096.0,
) -> DataFrame:
    """Attach the last grid row at or before each point (``before``) and the first one later (``after``).

    Points and grid are merged on the time axis and scanned block by block, so the cost is
    linear in both and a song's grid is never copied per point.
    """
    keys = list(keys)
    payload_struct = F.struct(*payload)
    p = points.select(
        *keys, point_time.alias("__t"), F.lit(1).alias("__p"), F.struct(*points.columns).alias("__row"),
        F.lit(None).cast(grid.select(payload_struct.alias("g")).schema["g"].dataType).alias("__g"),
    )
    g = grid.select(
        *keys, grid_time.alias("__t"), F.lit(0).alias("__p"),
        F.lit(None).cast(points.select(F.struct(*points.columns).alias("r")).schema["r"].dataType).alias("__row"),
        payload_struct.alias("__g"),
    )
    wanted = {}
    if before:
        wanted["latest"] = {before: F.col("__g")}
    if after:
        wanted["following"] = {after: F.col("__g")}
    block = F.floor(F.col("__t") / block_sec).cast("bigint")
    merged = scan(p.unionByName(g), keys, block, ["__t", "__p"], **wanted)
    return merged.filter("__p = 1").select("__row.*", *[c for c in (before, after) if c])


def top_per_key_tiled(
    df: DataFrame, keys: Sequence[str], tile: Column, order: Sequence[Column], k: Column, name: str = "rank"
) -> DataFrame:
    """``top_per_key`` for a limit that is a column: cut inside small tiles first, then per key."""
    staged = df.withColumn("__tile", tile)
    staged = top_per_key(staged, [*keys, "__tile"], order, k, "__pre").drop("__pre", "__tile")
    return top_per_key(staged, keys, order, k, name)
