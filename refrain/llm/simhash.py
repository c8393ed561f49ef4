"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into radius + 1 segments in a ring.  If two fingerprints differ in at
most ``radius`` bits, then from some segment on every chain of l consecutive segments
differs in at most l * radius / (radius + 1) bits, rounded down l - 1: the first segment is
equal, the first two differ in one bit at most, the first three in two, and so on.  The
first two conditions are a join key (one side lists the second segment as it is, the other
with no or one bit changed), the longer chains prune the joined candidates, and the full
Hamming distance is tested last.

Copies share a fingerprint, so everything after the hashing works on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.batches import bounded_batches
from refrain.llm.components import component_labels
from refrain.llm.registry import query, table
from refrain.operators.settle import settle

BITS = 64
_HASH_SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; no words: zero.  A-Z is lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], _HASH_SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint's bits as a long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], ["id", "fp"])

    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each of radius + 1 segments."""
    m = radius + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, part: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, part[0]).bitwiseAND((1 << part[1]) - 1)


def linked_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the fingerprints in column ``fp`` that differ in at most ``radius`` bits, each once."""
    parts = segments(radius)
    m = len(parts)
    if m < 3:
        raise ValueError("chains need a radius of at least 2")

    def keys(fp: Column, flips: bool) -> Column:
        out = []
        for i, part in enumerate(parts):
            nxt = parts[(i + 1) % m]
            for bit in [None, *range(nxt[1])] if flips else [None]:
                second = _segment(fp, nxt)
                if bit is not None:
                    second = second.bitwiseXOR(F.lit(1 << bit).cast("long"))
                key = F.shiftleft(_segment(fp, part), nxt[1]).bitwiseOR(second)
                out.append(F.struct(F.lit(i).alias("ring"), key.alias("key")))
        return F.array(*out)

    left = distinct.select(F.col("fp").alias("a"), F.explode(keys(F.col("fp"), False)).alias("k")).select("a", "k.ring", "k.key")
    right = distinct.select(F.col("fp").alias("b"), F.explode(keys(F.col("fp"), True)).alias("k")).select("b", "k.ring", "k.key")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(m):
        holds = F.col("ring") == i
        for length in range(3, m):
            counted = sum((F.bit_count(_segment(diff, parts[(i + j) % m])) for j in range(length)), F.lit(0))
            holds = holds & (counted <= length * radius // m)
        chain = chain | holds
    # Spark sizes the sides as if nothing were exploded, and would collect the flips (some 68 rows a fingerprint) for a broadcast.
    candidates = left.hint("merge").join(right.hint("merge"), ["ring", "key"]).where(F.col("a") != F.col("b")).where(chain)
    near = candidates.where(F.bit_count(diff) <= radius)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the
    smallest id among all rows reachable over links, null if all their ids are null.  Null
    and wordless texts have fingerprint zero and are linked like others.  Repeated rows give
    repeated results, an empty table none.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    edges = settle(linked_fingerprints(distinct, radius))
    labels = component_labels(edges)
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = settle(labelled.join(smallest, "label").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
