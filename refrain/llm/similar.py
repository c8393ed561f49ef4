"""Near-duplicates by exact similarity of word shingles.

Two texts are linked if the multiset Jaccard similarity of their word shingles is at least
``similarity``.  Pairs to compare come first from SimHash: each text's shingles give a 64-bit
fingerprint, and the chains of the pigeonring filter join those at RADIUS or fewer differing
bits (``simhash.linked_fingerprints``).  Few pairs at 0.8 are that near, so MinHash adds the
others: BANDS keys of BAND_ROWS minima each, where a pair at similarity s shares no key with
probability (1 - s ** BAND_ROWS) ** BANDS, 3e-6 at 0.8 and less above.  Every pair that links
has been compared shingle by shingle.

Only components are wanted, so not every pair of a large group is compared.  Equal bags are
one text from the start, and each text is compared with the first text that shares its
fingerprint, the first of the next fingerprint below its own that the chains join to it, and
the first text it shares a key with; pairs of the same fingerprints that these leave out are
as alike as pairs that share keys, and are settled with them.
What is left open forms crowds: texts connected over shared keys.  The median of a crowd has
the shingles of more than half its texts, and a text's difference are the shingles that it
has and the median hasn't, or the reverse.  Two bags of a and b shingles are similar at s if
at most c * (a + b), c = (1 - s) / (1 + s), shingles are in one of them only.  With
e = size of the difference - c * size of the bag, this is

* sure for two texts whose e add up to zero or less, so all these link to the text of least e;
* else only possible if the differences share at least (e_a + e_b) / 2 shingles, so they
  share one among the rarest of each (a prefix), with that many still to come after it.

The edits of a copy are rare and come first, so the copies of one template meet only where
they share edits.  Pairs that meet are decided by their differences, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm import pages as P
from refrain.llm.batches import bounded_batches
from refrain.llm.components import component_labels
from refrain.llm.decontaminate import shingle_hashes
from refrain.llm.simhash import BITS, linked_fingerprints
from refrain.operators.settle import settle

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
BANDS = 24
BAND_ROWS = 4
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A crowd's texts meet its median in this many groups.
_SALTS = 32
#: Hashes that a fingerprint takes at once.
_CHUNK = 1 << 15


def bag(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles; the n-th repeat of a shingle has a hash of its own, so bags compare as sets."""
    hashes = np.sort(shingle_hashes(text, shingle)[0])
    if len(hashes) > 1:
        places = np.arange(len(hashes))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], hashes[1:] != hashes[:-1])), places, 0))
        hashes = hashes + (places - first).astype(np.uint64) * _MIX
        hashes = np.sort((hashes ^ (hashes >> np.uint64(32))) * _MIX)
    return hashes


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def band_keys(bags: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each bag, none of them empty."""
    together, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    keys = np.zeros((len(bags), BANDS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(together * factor, starts)
        at = k // BAND_ROWS
        keys[:, at] = (keys[:, at] ^ least) * _MIX
        keys[:, at] ^= keys[:, at] >> np.uint64(31)
    return keys


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of a bag as a signed long: bits set in over half the hashes; an empty bag gives zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


_SKETCH = "row long, bag binary, size long, fp long, keys array<long>"


def _sketches(shingle: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag(t.as_py(), shingle) for t in b.column("text")]
            some = [x for x in bags if len(x)]
            keys = iter(band_keys(some).view(np.int64).tolist() if some else [])
            columns = [b.column("row"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in bags], pa.binary()), pa.array(list(map(len, bags)), pa.int64()), pa.array(list(map(fingerprint_of, bags)), pa.int64())]
            columns.append(pa.array([next(keys) if len(x) else [] for x in bags], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["row", "bag", "size", "fp", "keys"])

    return sketch


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)
            near = [similarity(bag(x, shingle), bag(y, shingle)) >= least - 1e-12 for x, y in sides]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}"))
    return settle(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long"))


def _bags(shingle: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = pa.array([bag(t.as_py(), shingle).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.select(["node", "size", "part", "crowd"]).columns, bags], ["node", "size", "part", "crowd", "bag"])

    return hashed


def _crowds(rest: DataFrame) -> DataFrame:
    """(node, size, part, crowd) of the texts of ``rest`` (node, head, tried, size, part); two texts already compared are no crowd."""
    named = component_labels(rest.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("label", "crowd")
    members = settle(rest.select("node", "tried", "size", "part").distinct().join(named, "node"))
    pair = F.max_by("tried", "node") == F.min("node")
    whole = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), pair.alias("pair")).where("n > 2 or not pair")
    return members.join(whole, "crowd").select("node", "size", "part", "crowd")


def _differences(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, part, crowd, diff) of ``members``: ``diff`` are the shingles that only one of the text and its crowd's median has."""
    bags = settle(members.join(texts.withColumnRenamed("row", "node"), "node").mapInArrow(_bags(shingle), "node long, size long, part long, crowd long, bag array<long>"))
    counts = bags.select("crowd", F.explode("bag").alias("h")).groupBy("crowd", "h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    often = counts.join(members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")), "crowd").where("2 * f > n")
    median = settle(often.groupBy("crowd").agg(F.collect_list("h").alias("median")))
    dealt = median.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    # Merged, as are the joins of exploded rows below: Spark sizes them as if nothing were exploded, and would collect them for a broadcast.
    met = bags.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(dealt.hint("merge"), ["crowd", "salt"], "left")
    median_or_none = F.coalesce("median", F.array().cast("array<long>"))
    diff = F.concat(F.array_except("bag", median_or_none), F.array_except(median_or_none, "bag"))
    return settle(met.select("node", "size", "part", "crowd", diff.alias("diff")))


def _crowd_links(differences: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect the similar texts of each crowd."""
    slope = (1 - least) / (1 + least)
    known = differences.select("node", "size", "part", "crowd", F.size("diff").alias("n"), (F.size("diff") - F.col("size") * slope).alias("e"))
    lowest = known.groupBy("crowd").agg(F.min(F.struct("e", "node")).alias("low")).select("crowd", F.col("low.e").alias("low_e"), F.col("low.node").alias("low_node"))
    sided = known.join(lowest, "crowd").withColumn("star", F.col("e") + F.col("low_e") <= 1e-9)
    stars = settle(sided.where("star and node <> low_node").select(F.col("node").alias("a"), F.col("low_node").alias("b")))
    # parts with a text in the star are one part from here on
    drawn = sided.where("star and node <> low_node").select("crowd", "part").union(sided.where("star and node = low_node").join(stars.select(F.col("b").alias("node")).distinct(), "node").select("crowd", "part"))
    drawn = drawn.distinct().withColumn("drawn", F.lit(True))
    parted = settle(sided.join(drawn, ["crowd", "part"], "left").select("node", "size", "crowd", "n", "e", "low_e", F.when(F.col("drawn"), -1).otherwise(F.col("part")).alias("part")))

    one = differences.select("node", "crowd", F.explode("diff").alias("h"))
    shared = one.groupBy("crowd", "h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rarest = Window.partitionBy("node").orderBy(F.desc("f"), F.desc("h"))
    to_come = one.hint("merge").join(shared.hint("merge"), ["crowd", "h"]).withColumn("left", F.row_number().over(rarest)).drop("f", "crowd")
    prefix = settle(to_come.hint("merge").join(parted, "node").where("left >= greatest(1, (low_e + e) / 2 - 1e-6)").drop("low_e"))
    side = lambda name: prefix.select("crowd", "h", *(F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "part", "n", "e", "left")))
    need = (F.col("e_a") + F.col("e_b")) / 2
    met = side("a").where("left_a >= e_a - 1e-6").join(side("b").hint("merge"), ["crowd", "h"])
    met = met.where("part_a <> part_b").where((F.col("e_a") < F.col("e_b")) | (F.col("e_a") == F.col("e_b")) & (F.col("node_a") < F.col("node_b")))
    met = met.where(F.least("left_a", "left_b") >= need - 1e-6)
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-6  # a smaller share can't be similar
    pairs = settle(met.where(fits).select("node_a", "node_b").distinct())
    whole = lambda name: differences.select(F.col("node").alias(f"node_{name}"), F.col("size").alias(f"size_{name}"), F.col("diff").alias(f"diff_{name}"))
    apart = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    both = F.col("size_a") + F.col("size_b")
    near = pairs.join(whole("a"), "node_a").join(whole("b"), "node_b").where((both - apart) / (both + apart) >= least - 1e-12)
    return stars.union(settle(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))


def _near_fingerprints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``prints`` (node, fp) that SimHash takes for alike: a text and the first one of its fingerprint, the first texts of two fingerprints that the chains join.

    Of the fingerprints joined to one, only the least is taken: pairs are proposals here, and grow with the texts.
    """
    firsts = settle(prints.groupBy("fp").agg(F.min("node").alias("first")))
    near = linked_fingerprints(firsts.select("fp"), RADIUS).groupBy("b").agg(F.min("a").alias("a"))
    first = lambda name: firsts.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}"))
    apart = near.join(first("a"), "a").join(first("b"), "b").select("first_a", "first_b")
    same = prints.join(firsts, "fp").where("first < node").select(F.col("first").alias("first_a"), F.col("node").alias("first_b"))
    return settle(apart.union(same).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def similar_groups(rows: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(row, group) of every row of ``rows`` (row, text): ``group`` is the smallest row reachable over similar texts.

    ``row`` is a non-negative long that no two rows share.  A-Z is lower-cased, words end at
    ASCII white space, texts of fewer than ``shingle`` words are one shingle.  Null and
    wordless texts are equal to each other and to nothing else.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    sketches = settle(rows.select("row", "text").mapInArrow(_sketches(shingle), _SKETCH))
    node_of = settle(sketches.groupBy("bag").agg(F.min("row").alias("node")))
    own = sketches.join(node_of, "bag")
    nodes = own.where("row = node").select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = nodes.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    crowds = settle(nodes.hint("merge").join(shared.hint("merge"), ["band", "key"]))
    proposed = _near_fingerprints(own.where("row = node and size > 0").select("node", "fp"))
    P.drop_shuffles(spark)
    open_nodes = crowds.select(F.col("node").alias("row")).union(proposed.select("a")).union(proposed.select("b")).distinct()
    texts = settle(rows.join(open_nodes.hint("merge"), "row", "left_semi").select("row", "text"))
    P.drop_shuffles(spark)

    tried = settle(crowds.where("head < node").groupBy(F.col("node").alias("b")).agg(F.min("head").alias("a")).select("a", "b"))
    links = _linked(tried.union(proposed).distinct(), texts, shingle, least)
    found = component_labels(links).withColumnRenamed("label", "part")
    before = tried.select(F.col("b").alias("node"), F.col("a").alias("tried"))
    parted = settle(crowds.join(found, "node", "left").join(before, "node", "left").withColumn("part", F.coalesce("part", "node")))
    mixed = parted.groupBy("band", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band", "key")
    rest = settle(parted.join(mixed, ["band", "key"]).select("node", "head", "tried", "size", "part").distinct())
    differences = _differences(settle(_crowds(rest)), texts, shingle)
    links = links.union(_crowd_links(differences, least))

    labels = settle(component_labels(links))
    grouped = own.join(labels, "node", "left").select("row", F.coalesce("label", "node").alias("group"))
    P.drop_shuffles(spark)
    return settle(grouped)
