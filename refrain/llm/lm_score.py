"""Language-model scores by stupid backoff.

The corpus scores itself: each word gets the share of its longest n-gram that occurs in other
documents, times ``BACKOFF`` for every order that had to be given up.  A document's own
n-grams are taken off all counts, so a document isn't called likely because of itself.

Counts are tables partitioned by n-gram hash (``pages``): every page of documents explodes
into its distinct n-grams, the owner of a hash adds up the pages' counts, and the totals join
the page's n-grams again, to be summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import pages as P
from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.settle import settle

ORDER = 2
BACKOFF = 0.4

_ARROW_ANSWER = pa.schema([("page", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary())])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        seen: dict[bytes, int] = {}
        lengths, indexes = [], []
        for t in b.column("text"):
            words = (t.as_py() or "").encode().lower().split()
            lengths.append(len(words))
            indexes.append(np.array([seen.setdefault(w, len(seen)) for w in words], "<u4"))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in seen], "<u8")
        words = np.concatenate(indexes) if indexes else np.zeros(0, "<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | at]), pa.array([b.column("id").to_pylist()], pa.list_(b.column("id").type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([len(words)]), pa.array([P.pack(words)]), pa.array([hashes.tobytes()])],
            ["page", "ids", "lengths", "n_words", "words", "hashes"],
        )
        at += 1


class _Grams:
    """The n-grams of a page: for each order the page's distinct ones and which one ends at each word."""

    def __init__(self, row: dict, order: int):
        words = P.unpack(row["words"], "<u4").astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        hashes = np.frombuffer(row["hashes"], "<u8")
        self.distinct, self.at, gram = [hashes], [words], hashes[words] if len(words) else np.zeros(0, np.uint64)
        last = gram
        for n in range(2, order + 1):
            grown = np.zeros(len(words), np.uint64)
            grown[1:] = _mixed(gram[:-1], last[1:])
            ok = self.place >= n - 1
            found, at = np.unique(grown[ok], return_inverse=True)
            index = np.full(len(words), -1)
            index[ok] = at
            self.distinct.append(found)
            self.at.append(index)
            gram = grown
        self.all = np.concatenate(self.distinct)
        self.order = np.argsort(self.all, kind="stable")

    def counts(self) -> np.ndarray:
        return np.concatenate([np.bincount(at[at >= 0], minlength=len(d)) for at, d in zip(self.at, self.distinct, strict=True)])

    def own(self, n: int) -> np.ndarray:
        """At each word, how often the document has the n-gram that ends there."""
        out = np.zeros(len(self.document), np.int64)
        ok = self.at[n] >= 0
        _, at, counts = np.unique(self.document[ok] * max(len(self.distinct[n]), 1) + self.at[n][ok], return_inverse=True, return_counts=True)
        out[ok] = counts[at]
        return out


def _requests(order: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                grams = _Grams(row, order)
                hashes, counts = grams.all[grams.order], grams.counts()[grams.order].astype("<u4")
                cuts = P.bucket_cuts(hashes, bits)
                spans = [(i, x, y) for i, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if y > x]
                entries = [(y - x).to_bytes(4, "little") + P.pack_sorted(hashes[x:y], i, bits) + P.pack(counts[x:y]) for i, x, y in spans]
                yield P.to_batch([(row["page"], i, e) for (i, _, _), e in zip(spans, entries, strict=True)], _ARROW_ANSWER)

    return ask


def _totals(bits: int):
    def total(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        sizes = [int.from_bytes(e[:4], "little") for _, e in rows]
        parts = [P.unpack_sorted(e[4:], n, bucket, bits) for (_, e), n in zip(rows, sizes, strict=True)]
        hashes = np.concatenate([h for h, _ in parts])
        counts = np.concatenate([P.unpack(rest, "<u4") for _, rest in parts]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        firsts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        totals = np.empty(len(hashes), "<i8")
        totals[order] = np.repeat(np.add.reduceat(counts[order], firsts), np.diff(np.append(firsts, len(hashes))))
        ends = np.cumsum(sizes).tolist()
        for (page, _), end, n in zip(rows, ends, sizes, strict=True):
            yield page, bucket, P.pack(totals[end - n : end])

    return total


def _scores(order: int, backoff: float, corpus_words: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield _score_page(row, b.schema.field("ids").type.value_type, order, backoff, corpus_words)

    return score


def _score_page(row: dict, id_type: pa.DataType, order: int, backoff: float, corpus_words: int) -> pa.RecordBatch:
    grams = _Grams(row, order)
    totals = np.zeros(len(grams.all), np.int64)
    totals[grams.order] = P.answered(row["answers"], "<i8")
    starts = np.cumsum([0] + [len(d) for d in grams.distinct])
    n_words = len(grams.document)
    others = []  # per order, occurrences in other documents of the n-gram that ends at each word
    for n in range(order):
        at = grams.at[n]
        counts = np.where(at >= 0, totals[starts[n] + np.maximum(at, 0)] if starts[n + 1] > starts[n] else 0, 0) - grams.own(n)
        others.append(counts)
    rest = np.maximum(corpus_words - grams.lengths, 1)[grams.document]
    shares = np.maximum(others[0], 1) / rest  # a word no other document has counts as seen once, one order further down
    logs = np.log(shares) + np.where(others[0] > 0, 0.0, np.log(backoff))
    used = np.where(others[0] > 0, 1, 0)
    for n in range(1, order):
        context = np.concatenate(([0], others[n - 1][:-1])) if n_words else others[n - 1]
        ok = others[n] > 0
        better = np.log(np.where(ok, others[n], 1) / np.where(ok, context, 1))
        logs = np.where(ok, better, logs + np.where(grams.place >= n, np.log(backoff), 0.0))
        used = np.where(ok, n + 1, used)
    size = len(grams.lengths)
    sums = np.bincount(grams.document, logs, size)
    full = np.bincount(grams.document, used == order, size).astype(np.int64)
    means = [s / n if n else None for s, n in zip(sums.tolist(), grams.lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], id_type), pa.array(grams.lengths), pa.array(full), pa.array(sums), pa.array(means, pa.float64())],
        ["id", "n_words", "n_full_order", "log_score", "mean_log_score"],
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per document row: id, n_words, n_full_order (words scored at the highest order), log_score, mean_log_score.

    Words are lower-cased (A-Z) and end at ASCII white space.  A word whose n-grams occur in no
    other document backs off to its share of all other words; a word that no other document
    has counts as seen once, with one more backoff.  The first words of a document have
    shorter contexts and no backoff for that.  Null and wordless texts score 0 with a null
    mean.  Rows that repeat a document are other documents to each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    pages = settle(rows.mapInArrow(_pages, f"page long, ids array<{id_type}>, lengths array<int>, n_words long, words binary, hashes binary"))
    corpus_words = pages.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = P.bucket_bits(spark)
    totals = settle(P.by_bucket(pages.mapInArrow(_requests(order, bits), P.REQUEST), _totals(bits), _ARROW_ANSWER, P.REQUEST))
    P.drop_shuffles(spark)
    schema = f"id {id_type}, n_words long, n_full_order long, log_score double, mean_log_score double"
    return P.with_answers(pages, totals).mapInArrow(_scores(order, backoff, corpus_words), schema).withColumnRenamed("id", id_col)


@query(
    "op8_lm_score",
    r"""
    WITH t AS (
        SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS words
        FROM documents
    ), w AS (
        SELECT * FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM t) WHERE word <> ''
    ), b AS (
        SELECT doc_id, place, word, lag(word) OVER (PARTITION BY doc_id ORDER BY place) AS prior FROM w
    ), counted AS (
        SELECT *,
               count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
               count(*) OVER (PARTITION BY prior, word) - count(*) OVER (PARTITION BY doc_id, prior, word) AS c2,
               count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
        FROM b
    ), withcontext AS (
        SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY place) AS c0 FROM counted
    ), s AS (
        SELECT doc_id, prior IS NOT NULL AND c2 > 0 AS hit,
               CASE WHEN prior IS NOT NULL AND c2 > 0 THEN ln(c2 / c0)
                    ELSE ln(greatest(c1, 1) / greatest(rest, 1)) + CASE WHEN c1 > 0 THEN 0 ELSE ln(0.4) END + CASE WHEN prior IS NULL THEN 0 ELSE ln(0.4) END END AS score
        FROM withcontext
    )
    SELECT t.doc_id, count(score) AS n_words, count(*) FILTER (hit) AS n_full_order,
           round(coalesce(sum(score), 0), 3) AS log_score, round(sum(score) / count(score), 6) AS mean_log_score
    FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id
    """,
)
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_full_order", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))
