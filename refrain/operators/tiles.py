"""Frames packed by tile, for look-ups of single hops that never move the frames.

A tile is one row with the frames of ``TILE_HOPS`` hops of a song.  Stored tiles are written
bucketed by (song, tile), the very keys of a look-up, so a join with them shuffles only the
requests: the frames of a catalogue are dealt out once, however many scores read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.operators.settle import settle_bucketed

#: Hops of a tile, about a quarter of a second to two seconds of audio; some 25 KB of frames.
TILE_HOPS = 64
_CELL = ["song_id", "__tile"]


@dataclass(frozen=True)
class Tiles:
    """``packed``: song_id, __tile, __hops (offsets inside the tile, ascending), __rows (their payloads)."""

    packed: DataFrame


def tiled(frames: DataFrame, payload: Column) -> Tiles:
    """Pack ``payload`` of (song_id, hop_idx, …) by tile; rows of one song and hop must be unique."""
    tile = F.floor(F.col("hop_idx") / TILE_HOPS)
    cells = frames.select("song_id", tile.alias("__tile"), F.struct((F.col("hop_idx") - tile * TILE_HOPS).cast("int").alias("o"), payload.alias("p")).alias("x"))
    packed = cells.groupBy(*_CELL).agg(F.array_sort(F.collect_list("x"), lambda a, b: a["o"] - b["o"]).alias("x"))
    part = lambda name: F.transform("x", lambda x: x[name])
    return Tiles(packed.select(*_CELL, part("o").alias("__hops"), part("p").alias("__rows")))


def stored(tiles: Tiles) -> Tiles:
    """The tiles written once, bucketed by their keys."""
    return Tiles(settle_bucketed(tiles.packed, _CELL))


def at_hop(requests: DataFrame, tiles: Tiles, hop: Column, out: str, how: str = "inner") -> DataFrame:
    """``requests`` (song_id, …) with the payload at ``hop`` as column ``out``; rows without one are dropped, or null with ``how='left'``."""
    tile = F.floor(hop / TILE_HOPS)
    placed = requests.withColumns({"__tile": tile, "__o": (hop - tile * TILE_HOPS).cast("int")})
    found = placed.join(tiles.packed, _CELL, how)
    index = F.array_position("__hops", F.col("__o"))
    got = found.withColumn(out, F.when(index > 0, F.get("__rows", (index - 1).cast("int")))).drop("__tile", "__o", "__hops", "__rows")
    return got if how == "left" else got.filter(F.col(out).isNotNull())
