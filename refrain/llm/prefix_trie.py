"""Prefix trie of conversations by depth-band rollup.

A node is a distinct sequence of first d turns.  A turn's digest is salted with its position
and the digests of a conversation are combined by a running exclusive or, so a node is found
by grouping (depth, 128-bit key) and no conversation is ever held whole: the running value is
taken in blocks of turns and one value per block is carried on.

Subtree totals: the depths are cut into bands of ``BAND`` levels.  A node knows the keys of
its ancestors inside its band and of the band's root just above, at most BAND + 1 in all, and
adds its own weight to each of them; one grouped sum does that for all bands.  What a band
root has gathered below itself is completed through the trie of band roots, which is BAND
times flatter and is rolled up in the same way; a completed root adds its total to its own
ancestors.  A trie of depth D takes log(D) / log(BAND) rounds, and no node becomes more than
BAND + 1 rows in a round.

The list of the conversations that end at a node has no bound.  It is sorted by a range
partitioning, packed into strings of at most ``PACK`` ids, and the packs of a node pass
through one SHA-256 in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.registry import query, table
from refrain.operators.ordered import BLOCK_ROWS, scan
from refrain.operators.settle import settle

#: Levels of a band; a node is exploded to at most this many ancestors and the band's root.
BAND = 16
#: Ids joined in one string on the way to a node's digest.
PACK = 1024
#: Characters of a text by which rows of one turn and role are ordered before its digest.
HEAD = 32

_KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, idx (0, 1, … per conversation), digest of role and text, n_bytes of the text.

    Null role or text counts as empty.  Turns are ordered by ``turn`` (null first); rows of
    one turn by role, the first ``HEAD`` characters of the text and its digest.  Rows with a
    null conversation take no part.  A conversation of any length is cut over many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["turn", "role", "head", "digest"]
    dealt = settle(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    return scan(dealt, ["conv_id"], F.col("part"), order, before={"idx": F.lit(1)}).select("conv_id", F.col("idx").cast("long").alias("idx"), "digest", "n_bytes")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, idx (dense from 0 per conversation), digest and n_bytes;
    ``conversations`` has each conv_id once, also those without turns, which are members of
    the root only.  ``saved_tokens`` sums (n_convs - 1) * n_bytes over the subtree.  Nodes are
    told apart by 128 bits.  Without conversations there is no node.
    """
    paths = settle(_paths(turns, conversations))
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    levels = _with_ancestors(paths)
    nodes = levels.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min_by("ancestors", "conv_id").alias("ancestors")
    )
    nodes = settle(nodes.withColumn("parent", F.when(F.col("depth") > 0, F.get("ancestors", F.size("ancestors") - 2))))
    children = nodes.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), "parent.k1", "parent.k2").agg(F.count(F.lit(1)).alias("n_children"))
    nodes_with_children = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    weighed = settle(
        nodes_with_children.select(
            *_KEY, "conv_id", "parent", "n_convs", "n_children", "ancestors",
            (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        )
    )
    totals = rollup(weighed.select(*_KEY, "ancestors", "leaves", "saved"), paths, ["leaves", "saved"], deepest)
    totals = totals.select(*_KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = weighed.select((F.col("depth") + 1).alias("depth"), F.struct("k1", "k2").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        weighed.drop("ancestors", "leaves", "saved")
        .join(above, ["depth", "parent"], "left")
        .join(totals, _KEY)
        .join(_end_digests(paths.where("last")), _KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
        )
    )


def _paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0: conv_id, depth, k1, k2 (key of the first ``depth`` turns), n_bytes of the last turn, last."""
    salted = [F.xxhash64(F.lit(i), "idx", "digest").alias(k) for i, k in ((1, "k1"), (2, "k2"))]
    rows = turns.select("conv_id", "idx", "n_bytes", *salted).withColumn("block", F.floor(F.col("idx") / BLOCK_ROWS))
    upto = Window.partitionBy("conv_id", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({f"r{i}": F.bit_xor(f"k{i}").over(upto) for i in (1, 2)}).drop("k1", "k2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.max("idx").alias("block_end"))
    whole = Window.partitionBy("conv_id")
    carried = blocks.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)], F.max("block_end").over(whole).alias("end")
    )
    key = lambda i: F.col(f"r{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}")
    deep = inner.join(carried, ["conv_id", "block"]).select("conv_id", (F.col("idx") + 1).alias("depth"), key(1), key(2), "n_bytes", (F.col("idx") == F.col("end")).alias("last"))
    zero = F.lit(0).cast("long")
    ended = conversations.select("conv_id").join(turns.where("idx = 0").select("conv_id", F.lit(True).alias("has_turns")), "conv_id", "left")
    root = ended.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("n_bytes"), F.col("has_turns").isNull().alias("last"))
    return root.unionByName(deep)


def _band(depth: Column) -> Column:
    """Depths 1 to BAND are band 0; the root is above all bands."""
    return F.floor((depth - 1) / BAND)


def _with_ancestors(paths: DataFrame) -> DataFrame:
    """``paths`` with the keys from the band's root down to the row itself; the root has only itself."""
    key = F.struct("k1", "k2")
    depth = F.col("depth")
    # The last level of a band is also the root of the next one.
    bands = F.when((depth > 0) & (depth % BAND == 0), F.array(_band(depth), _band(depth) + 1)).otherwise(F.array(_band(depth)))
    placed = paths.withColumn("band", F.explode(bands))
    so_far = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    top = F.array(F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")))
    within = F.collect_list(key).over(so_far)
    return (
        placed.withColumn("ancestors", F.when(F.col("band") == 0, F.concat(top, within)).otherwise(within))
        .where((F.col("band") == _band(depth)))
        .drop("band")
    )


def rollup(nodes: DataFrame, paths: DataFrame, weights: list[str], deepest: int) -> DataFrame:
    """Sums of ``weights`` over every node's subtree, the node included: depth, k1, k2 and the weights.

    ``nodes`` has depth, k1, k2, ``ancestors`` (see :func:`_with_ancestors`) and the weights;
    ``paths`` has conv_id, depth, k1 and k2 of every conversation; no depth exceeds ``deepest``.
    """
    sums = [F.sum(w).alias(w) for w in weights]
    first = F.col("depth") - F.size("ancestors") + 1  # the band's root; the root's own list is only itself
    shared = nodes.select("depth", first.alias("first"), *weights, F.posexplode("ancestors").alias("at", "key"))
    shared = shared.withColumns({"below": (F.col("at") == 0) & (F.col("depth") > F.col("first")), "depth": F.col("first") + F.col("at")})
    gathered = shared.groupBy("depth", "key.k1", "key.k2", "below").agg(*sums)
    if deepest <= BAND:  # one band, whose root is the root
        return gathered.groupBy(*_KEY).agg(*sums)
    gathered = settle(gathered)

    def flat(df: DataFrame) -> DataFrame:
        return df.where(F.col("depth") % BAND == 0).withColumn("depth", F.floor(F.col("depth") / BAND))

    roots = flat(gathered.where("below").drop("below"))
    fewer_paths = flat(paths.select("conv_id", *_KEY))
    placed = _with_ancestors(fewer_paths).groupBy(*_KEY).agg(F.min_by("ancestors", "conv_id").alias("ancestors"))
    completed = rollup(settle(roots.join(placed, _KEY)), fewer_paths, weights, deepest // BAND)
    completed = completed.withColumn("depth", F.col("depth") * BAND)
    passed_on = (
        nodes.select(*_KEY, "ancestors").join(completed.where("depth > 0"), _KEY)
        .select(first.alias("first"), *weights, F.posexplode("ancestors").alias("at", "key")).where("at > 0")
        .select((F.col("first") + F.col("at")).alias("depth"), "key.k1", "key.k2", *weights)
    )
    parts = gathered.where("not below").drop("below").unionByName(passed_on).unionByName(completed.where("depth = 0"))
    return parts.groupBy(*_KEY).agg(*sums)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end."""
    ids = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    packs = ids.mapInArrow(_pack_ids, "depth long, k1 long, k2 long, first long, ids string")
    return packs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _grouped(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple, list]]:
    """(key, values) of runs of one key, cut at batch ends."""
    for b in batches:
        run, key = [], None
        for *k, v in zip(*(b.column(c).to_pylist() for c in (*_KEY, value)), strict=True):
            if run and tuple(k) != key:
                yield key, run
                run = []
            key = tuple(k)
            run.append(v)
        if run:
            yield key, run


def _pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            (*key, ids[i], ",".join(map(str, ids[i : i + PACK])))
            for key, ids in _grouped([b], "conv_id") for i in range(0, len(ids), PACK)
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], [*_KEY, "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()

    def done(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*_KEY, "ends_sha256"])

    for b in batches:
        rows = []
        for key, packs in _grouped([b], "ids"):
            if key != now:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(packs[0].encode())
                packs = packs[1:]
            for p in packs:
                digest.update(b"," + p.encode())
        yield done(rows)
    if now is not None:
        yield done([(*now, digest.hexdigest())])


def with_shared_openings(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share openings: (turns, conversations) as :func:`prefix_trie` takes them.

    Conversation c starts with the first h turns of conversation c - c % ``group`` (all if it
    has fewer, none if it is absent) and goes on with its own turns after its first h, where
    h is the unsigned crc32 of c's decimal digits modulo ``most``.  ``%`` takes the sign of c, as in SQL.
    """
    own = settle(turns)
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("source"), taken.alias("h"))
    sources = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    convs = settle(convs.join(sources, "source", "left").withColumn("opening", F.least("h", F.coalesce("source_n", F.lit(0)))))
    openings = own.where(F.col("idx") < most).withColumnRenamed("conv_id", "source").join(convs.where("opening > 0").select("conv_id", "source", "opening"), "source")
    openings = openings.where("idx < opening").select("conv_id", "idx", "digest", "n_bytes")
    rest = own.join(convs.select("conv_id", "h", "opening"), "conv_id").where("idx >= h")
    rest = rest.select("conv_id", (F.col("idx") - F.col("h") + F.col("opening")).alias("idx"), "digest", "n_bytes")
    return settle(openings.unionByName(rest)), convs.select("conv_id")


#: Every node's subtree is found by listing all prefixes of its own prefix; crc32 is spelt out bit by bit.
_SQL = """
    WITH t AS (
        SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS item,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, list(item ORDER BY place) AS items,
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
                   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
        FROM t GROUP BY conv_id
    ), r AS (
        SELECT c.conv_id, list_concat(coalesce(b.items[1:c.h], []), c.items[c.h + 1:]) AS path
        FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
    ), p AS (
        SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM r
    ), n AS (
        SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
        FROM p GROUP BY 1, 2
    ), k AS (
        SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2
    ), w AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children,
               CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.prefix[n.depth].text) END AS saved
        FROM n LEFT JOIN k ON n.depth = k.depth AND n.prefix = k.prefix
    ), s AS (
        SELECT up AS depth, prefix[1:up] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
        FROM (SELECT w.*, unnest(range(0, depth + 1)) AS up FROM w) GROUP BY 1, 2
    )
    SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
           CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
    FROM w JOIN s ON w.depth = s.depth AND w.prefix = s.prefix
    LEFT JOIN n a ON a.depth = w.depth - 1 AND a.prefix = w.prefix[1:w.depth - 1]
    """


@query("op13_prefix_trie", _SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_openings(ordered_turns(table(spark, sf_dir, "conversations"))))
