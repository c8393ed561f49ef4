"""Hard negatives by Fagin's threshold algorithm over tiles of sorted lists.

The candidates are cut into tiles; each tile keeps, for every dimension, its rows sorted by
that component.  An anchor walks the lists of a tile in step, from the top where its own
component is positive and from the bottom where it is negative (sorted access).  Rows met for
the first time get their whole integer score (random access).  The sum of the anchor's
components times the last values met bounds every row not met yet: once that threshold is
strictly below the k-th score of each window that the anchor asks for, no other row of the
tile can matter, also not by a tie.

Two passes: the first finds each anchor's positives, the second one window per positive.
Anchors are the stated query set; they meet the tiles in blocks, one joined row per anchor
block and tile.  Tiles of one stripe follow each other in a task and share the k-th scores
found so far; the best rows of all stripes are merged by a top-k per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.ordered import top_per_key
from refrain.operators.settle import settle

#: Rows of a tile, anchors of a block, tiles of a stripe.
TILE_ROWS = 4096
BLOCK_ANCHORS = 512
STRIPE_TILES = 16
#: Depth of the first round of sorted access; each further round doubles it.
FIRST_DEPTH = 32
#: Components beyond this size (after scaling) would let scores leave 64 bits.
LARGEST = 1 << 26
_LOWEST = -(1 << 62)
#: Ratio of a negative's score to its positive's, at least, in hundredths.
LOWEST_SHARE = 80

_HIT = "anchor long, anchor_row long, anchor_label long, window int, rank int, vec_id long, score long"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null, not finite, or too large."""
    x = lambda v: F.floor(v.cast("double") * scale)
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST / scale, F.lit(False)))
    return F.when(fine, F.transform(vector, lambda v: x(v).cast("int")))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, lowest_share: int = LOWEST_SHARE,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of its quantised vector with the anchor's; higher
    scores come first, ties by smaller id.  An anchor's positives are its first rows of the
    same label and another id.  A positive's negatives are the first rows of another label
    with ``lowest_share`` * positive score <= 100 * score <= 100 * positive score.

    Rows with a null id, label or vector, or with a null, non-finite or huge (2**18 and more)
    component take no part.  Shorter vectors count as filled up with zeros, so an empty one
    scores 0.  Rows that repeat an id are candidates (and anchors) of their own, but never
    for an anchor of that id.  An empty table, or one without anchors, gives no rows.  Other
    columns are neither read nor returned.
    """
    bounded_batches(vectors.sparkSession)
    rows = settle(
        vectors.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col)).alias("q"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row"),
        ).where("id is not null and label is not null and q is not null")
    )
    n, n_anchors, dims, largest = rows.agg(
        F.count(F.lit(1)), F.sum(F.col("is_anchor").cast("long")), F.max(F.size("q")), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))))
    ).first()
    grid = _Grid(n, n_anchors or 0, max(dims or 0, 1), largest or 0)
    tiles = settle(_packed(rows, F.pmod(F.xxhash64("row"), F.lit(grid.tiles)).cast("int").alias("cell"), grid))
    anchor_rows = rows.where("is_anchor").withColumn("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(grid.blocks)).cast("int"))

    blocks = _packed(anchor_rows, F.col("cell"), grid)
    found = _search(tiles, blocks, grid, _same_label, positives)
    first = settle(
        top_per_key(found, ["anchor", "anchor_row"], [F.col("score").desc(), F.col("vec_id"), F.col("rank")], positives, "place")
        .select("anchor", "anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )

    asked = first.groupBy("anchor_row").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    with_windows = anchor_rows.join(asked, anchor_rows["row"] == asked["anchor_row"]).select(*anchor_rows.columns, "windows")
    near = _search(tiles, _packed(with_windows, F.col("cell"), grid, windows=True), grid, _windows(lowest_share), negatives)
    ranked = top_per_key(near, ["anchor", "anchor_row", "window"], [F.col("score").desc(), F.col("vec_id"), F.col("rank")], negatives, "place")
    ranked = ranked.join(asked, "anchor_row").select(
        "anchor", "anchor_row", F.expr("windows[window]").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return first.join(ranked, ["anchor", "anchor_row", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


class _Grid:
    """How many tiles, stripes and anchor blocks there are, and the number type that keeps scores exact."""

    def __init__(self, rows: int, anchors: int, dims: int, largest: int):
        self.dims = dims
        self.tiles = max(1, math.ceil(rows / TILE_ROWS))
        self.stripes = max(1, math.ceil(self.tiles / STRIPE_TILES))
        self.blocks = max(1, math.ceil(anchors / BLOCK_ANCHORS))
        bound = dims * largest * largest
        self.kind = "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64"


def _packed(rows: DataFrame, cell: Column, grid: _Grid, windows: bool = False) -> DataFrame:
    """One row per cell: ids, labels, row numbers and components of its rows as little-endian binaries, ordered by row number.

    Cells are hash-dealt, so each holds about TILE_ROWS rows (BLOCK_ANCHORS for anchors) whatever the labels are.
    """
    dims = grid.dims

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell_id, part in _runs(batches):
            order = np.argsort(part["row"].to_numpy(), kind="stable")
            lists = part["q"].combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            q = np.zeros((len(order), dims), np.int32)
            q[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
            out = [np.full(1, cell_id, np.int32)]
            out += [[part[c].to_numpy()[order].astype("<i8").tobytes()] for c in ("id", "label", "row")] + [[q[order].astype("<i4").tobytes()]]
            names = ["cell", "ids", "labels", "rows", "q"]
            if windows:
                asked = part["windows"].to_pylist()
                out.append([[asked[i] for i in order]])
                names.append("windows")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _types(windows), strict=True)], names)

    schema = "cell int, ids binary, labels binary, rows binary, q binary" + (", windows array<array<long>>" if windows else "")
    picked = rows.select(cell, "id", "label", "row", "q", *(["windows"] if windows else []))
    return picked.repartition("cell").sortWithinPartitions("cell").mapInArrow(pack, schema)


def _types(windows: bool) -> list[pa.DataType]:
    return [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()] + ([pa.list_(pa.list_(pa.int64()))] if windows else [])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each cell; batches are sorted by cell."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        cells = b.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and cells[start] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(cells[start])
            held.append(b.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def _search(tiles: DataFrame, blocks: DataFrame, grid: _Grid, rule: Callable, k: int) -> DataFrame:
    """Best ``k`` rows per anchor and window in each stripe; ``rule`` says which rows an anchor's windows take."""
    left = blocks.select(
        F.col("cell").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(grid.stripes - 1))).alias("stripe"), F.struct(*blocks.columns).alias("anchors")
    )
    right = tiles.select(
        F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1))).alias("block"), F.pmod("cell", F.lit(grid.stripes)).alias("stripe"), F.struct(*tiles.columns).alias("tile")
    )
    return left.join(right.hint("merge"), ["block", "stripe"]).mapInArrow(_walker(grid, rule, k), _HIT)


def _same_label(anchor: dict, windows: list) -> list[tuple[bool, int, int]]:
    return [(True, _LOWEST, -_LOWEST)]


def _windows(lowest_share: int) -> Callable:
    def of(anchor: dict, windows: list) -> list[tuple[bool, int, int]]:
        return [(False, -((-lowest_share * p) // 100), p) for p in windows]

    return of


class _Tile:
    """Components of a tile with its sorted lists."""

    def __init__(self, packed: dict, grid: _Grid):
        self.ids = np.frombuffer(packed["ids"], "<i8")
        self.labels = np.frombuffer(packed["labels"], "<i8")
        q = np.frombuffer(packed["q"], "<i4").reshape(len(self.ids), grid.dims)
        self.q = q.astype(grid.kind)
        self.order = np.argsort(q, axis=0, kind="stable").T.astype(np.int32)  # a list per dimension, ascending
        self.values = np.take_along_axis(self.q.T, self.order, axis=1)


class _Window:
    """Best rows so far of one anchor and window, over the tiles of a stripe."""

    __slots__ = ("same", "low", "high", "k", "best")

    def __init__(self, same: bool, low: int, high: int, k: int):
        self.same, self.low, self.high, self.k = same, low, high, k
        self.best: list[tuple[int, int]] = []  # (-score, id), ascending

    def needed(self) -> int:
        """Rows below this score can't enter; rows at it may, by a tie."""
        return -self.best[-1][0] if len(self.best) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        mine = np.flatnonzero((scores >= self.needed()) & (scores <= self.high) & (same == self.same))
        if len(mine):
            if len(mine) > self.k:
                mine = mine[np.lexsort((ids[mine], -scores[mine]))[: self.k]]
            self.best = sorted([*self.best, *zip((-scores[mine]).tolist(), ids[mine].tolist(), strict=True)])[: self.k]


def walk_tile(tile: _Tile, anchor: np.ndarray, anchor_id: int, label: int, windows: list[_Window]) -> int:
    """The threshold algorithm on one tile; returns how many rows got a score."""
    m = len(tile.ids)
    used = np.flatnonzero(anchor)
    parts, up = anchor[used], anchor[used] > 0
    lists, values = tile.order[used], tile.values[used]
    seen = np.zeros(m, bool)
    depth, step = 0, FIRST_DEPTH
    while depth < m:
        end = min(m, depth + step)
        if len(used):
            met = np.concatenate([lists[up, m - end : m - depth].ravel(), lists[~up, depth:end].ravel()])
            fresh = np.zeros(m, bool)
            fresh[met] = True
            fresh = np.flatnonzero(fresh & ~seen)
        else:  # every score is 0: no list says more than the rows themselves
            end, fresh = m, np.arange(m)
        seen[fresh] = True
        scores = (tile.q[fresh] @ anchor).astype(np.int64)
        ids = tile.ids[fresh]
        other = ids != anchor_id
        same = tile.labels[fresh[other]] == label
        for w in windows:
            w.offer(scores[other], ids[other], same)
        depth, step = end, step * 2
        threshold = int((parts * np.where(up, values[:, m - depth], values[:, depth - 1])).sum()) if len(used) else _LOWEST
        if all(threshold < w.needed() for w in windows):
            break
    return int(seen.sum())


def _walker(grid: _Grid, rule: Callable, k: int):
    """One joined row is an anchor block with a tile; while the stripe stays the same, the windows do."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "stripe", "anchors", "tile")}
                if (row["block"], row["stripe"]) != now:
                    if state:
                        yield _hits(state)
                    now, state = (row["block"], row["stripe"]), _anchors(row["anchors"], grid, rule, k)
                tile = _Tile(row["tile"], grid)
                for a in state:
                    walk_tile(tile, a["q"], a["id"], a["label"], a["windows"])
        if state:
            yield _hits(state)

    return walk


def _anchors(packed: dict, grid: _Grid, rule: Callable, k: int) -> list[dict]:
    ids, labels, rows = (np.frombuffer(packed[c], "<i8").tolist() for c in ("ids", "labels", "rows"))
    q = np.frombuffer(packed["q"], "<i4").reshape(len(ids), grid.dims).astype(grid.kind)
    asked = packed.get("windows") or [[]] * len(ids)
    out = [{"id": i, "label": c, "row": r, "q": v} for i, c, r, v in zip(ids, labels, rows, q, strict=True)]
    for a, w in zip(out, asked, strict=True):
        a["windows"] = [_Window(same, low, high, k) for same, low, high in rule(a, w)]
    return out


def _hits(state: list[dict]) -> pa.RecordBatch:
    rows = [
        (a["id"], a["row"], a["label"], at, rank, vec_id, -less)
        for a in state for at, w in enumerate(a["windows"]) for rank, (less, vec_id) in enumerate(w.best, 1)
    ]
    names = ["anchor", "anchor_row", "anchor_label", "window", "rank", "vec_id", "score"]
    types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
