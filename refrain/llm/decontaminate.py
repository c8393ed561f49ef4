"""Benchmark decontamination by item-sized SimHash windows.

A benchmark item is a bag of word shingles.  A document is contaminated by it if some window
of as many words has a weighted (multiset) Jaccard similarity of at least ``similarity`` to
the item.  Windows are found in three steps:

1. A similar window must share most of its shingles with the item, so only windows with that
   many shingles of items of their size are fingerprinted (an exact condition, no loss).
2. Their 128-bit SimHash fingerprints are looked up in a multi-index: fingerprints within
   ``RADIUS`` bits agree up to RADIUS // BLOCKS bits in at least one of BLOCKS blocks.
3. Items within the radius are compared with the window exactly, shingle by shingle.

The benchmark travels to the tasks in parts of bounded size; documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table

SHINGLE = 5
SIMILARITY = 0.8
#: Of 128 bits.  Two bags at similarity 0.8 differ in 19 bits on average, with a deviation of 4; unrelated ones in 64, with 6.
RADIUS = 40
BLOCKS = 8
#: Items and words of the benchmark sent to the tasks at once; larger benchmarks go in several parts, each over all documents.
PART_ITEMS = 10_000
PART_WORDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, int]:
    """(hash of each shingle, number of words).  A-Z lower-cased, words end at ASCII white space; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64), len(words)


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits of each shingle."""
    second = hashes * _MIX
    second ^= second >> np.uint64(29)
    both = np.stack([hashes, second * _MIX], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1).astype(np.int32) * 2 - 1


def _packed(totals: np.ndarray) -> np.ndarray:
    """Rows of eight 16-bit blocks."""
    return np.packbits(totals > 0, axis=-1).view(np.uint16)


class ItemIndex:
    """Fingerprints and shingles of one part of the benchmark."""

    def __init__(self, items: list[tuple], width: int, similarity: float):
        self.width, self.similarity = width, similarity
        parsed = [(key, *shingle_hashes(text, width)) for key, text in items]
        parsed = [p for p in parsed if p[2]]
        self.keys = [p[0] for p in parsed]
        self.words = np.array([p[2] for p in parsed], np.int64)
        self.totals = np.array([len(p[1]) for p in parsed], np.int64)
        self.bags = [Counter(p[1].tolist()) for p in parsed]
        self.known = np.unique(np.concatenate([p[1] for p in parsed])) if parsed else np.zeros(0, np.uint64)
        self.prints = np.array([_packed(votes(p[1]).sum(axis=0)) for p in parsed], np.uint16).reshape(-1, BLOCKS)
        self.sizes = sorted(set(self.words.tolist()))
        self.of_size = np.zeros((len(self.sizes), len(self.known)), bool)  # known shingles of the items of each size
        for key_hashes, size in ((p[1], p[2]) for p in parsed):
            self.of_size[self.sizes.index(size), np.searchsorted(self.known, key_hashes)] = True
        self._near = lru_cache(maxsize=1 << 16)(self._block_items)

    def _block_items(self, block: int, value: int) -> frozenset[int]:
        return frozenset(np.flatnonzero(np.bitwise_count(self.prints[:, block] ^ np.uint16(value)) <= RADIUS // BLOCKS).tolist())

    def within_radius(self, fingerprint: np.ndarray) -> list[int]:
        found: set[int] = set()
        for block, value in enumerate(fingerprint.tolist()):
            found |= self._near(block, value)
        some = np.fromiter(found, np.int64, len(found))
        return some[np.bitwise_count(self.prints[some] ^ fingerprint).sum(axis=1) <= RADIUS].tolist() if len(some) else []

    def matches(self, hashes: np.ndarray, places: np.ndarray, n_words: int) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item; ``places`` are those of known shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        which = self.of_size[:, np.searchsorted(self.known, hashes[places])]
        full_width = min(self.width, n_words)
        for of_size in np.flatnonzero(which.any(axis=1)).tolist():
            size = self.sizes[of_size]
            words = min(size, n_words)
            k = words - full_width + 1 if words >= full_width else 1
            item_k = max(size - self.width + 1, 1)
            # similarity >= s needs an overlap of s / (1 + s) of both bags together
            need = int(np.ceil(self.similarity / (1 + self.similarity) * (k + item_k) - 1e-9))
            hits = np.zeros(len(hashes) + 1, np.int64)
            hits[places[which[of_size]] + 1] = 1
            hits = np.cumsum(hits)
            starts = np.flatnonzero(hits[k:] - hits[: len(hits) - k] >= max(need, 1))
            for at in np.split(starts, np.flatnonzero(np.diff(starts) > k) + 1) if len(starts) else []:
                first, last = int(at[0]), int(at[-1]) + k
                sums = np.concatenate((np.zeros((1, 128), np.int32), np.cumsum(votes(hashes[first:last]), axis=0)))
                prints = _packed(sums[at - first + k] - sums[at - first])
                for start, fingerprint in zip(at.tolist(), prints, strict=True):
                    for item in self.within_radius(fingerprint):
                        if self.words[item] != size:
                            continue
                        bag = self.bags[item]
                        window = Counter(x for x in hashes[start : start + k].tolist() if x in bag)
                        both = sum(min(c, bag[x]) for x, c in window.items())
                        value = both / (k + item_k - both)
                        if value >= self.similarity and (item not in best or value > best[item][0]):
                            best[item] = (value, start, words)
        return [(item, *found) for item, found in sorted(best.items())]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    width: int = SHINGLE, similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per document row and benchmark row that match: id, item_id, similarity, first_word, n_words of the best (first) window.

    A document shorter than an item is one window.  Null and wordless texts match nothing on
    either side.  Texts of fewer than ``width`` words are one shingle.  Repeated rows on
    either side give repeated results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_text is not null")
    n_items, n_words = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("item_text", r"\s+"))), F.lit(0))).first()
    parts = max(1, -(-n_items // PART_ITEMS), -(-n_words // PART_WORDS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), keyed.schema["item_id"].dataType.simpleString()
    schema = f"id {id_type}, item_id {item_type}, similarity double, first_word int, n_words int"
    found = None
    for part in range(parts):
        some = keyed.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part).collect()
        scan = rows.mapInArrow(_scanner([tuple(r) for r in some], width, similarity), schema)
        found = scan if found is None else found.union(scan)
    return found.select(F.col("id").alias(id_col), "item_id", "similarity", "first_word", "n_words")


def _scanner(items: list[tuple], width: int, similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, width, similarity)
        for b in batches:
            hashed = [shingle_hashes(t.as_py(), width) for t in b.column("text")]
            counts = np.array([len(h) for h, _ in hashed], np.int64)
            together = np.concatenate([h for h, _ in hashed]) if hashed else np.zeros(0, np.uint64)
            known = _member(together, index.known)
            ends = np.cumsum(counts)
            held = np.concatenate(([0], np.cumsum(known)))
            rows: list[tuple[int, int, float, int, int]] = []
            for i in np.flatnonzero(held[ends] > held[ends - counts]).tolist():
                hashes, n_words = hashed[i]
                places = np.flatnonzero(known[ends[i] - counts[i] : ends[i]])
                rows += [(i, *m) for m in index.matches(hashes, places, n_words)]
            taken = pa.array([r[0] for r in rows], pa.int64())
            key_type = pa.array([r[0] for r in items]).type if items else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(taken),
                    pa.array([index.keys[r[1]] for r in rows], key_type),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int32()),
                    pa.array([r[4] for r in rows], pa.int32()),
                ],
                ["id", "item_id", "similarity", "first_word", "n_words"],
            )

    return scan


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    # most values are absent: a table of the low 20 bits settles nearly all of them
    table = np.zeros(1 << 20, bool)
    table[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
    out = table[(values & np.uint64(0xFFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
    out[at] = known[place] == values[at]
    return out


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
