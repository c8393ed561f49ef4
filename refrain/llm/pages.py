"""Questions about hashes, asked and answered per page.

A page is one row with the documents of one Arrow batch in packed form.  A stage that has to
know something about every hash of the corpus (how often an n-gram occurs, whether a
fingerprint occurs twice) sends each page's distinct hashes, cut by their top bits into
buckets, to the task that owns the bucket, and gets the answers back in the same order.  A
hash is sent once per page however often it occurs there, so a hot hash costs each bucket no
more than one entry per page, and no join key is ever hot.
"""

from __future__ import annotations

import gc
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a request: page, bucket, and the packed columns of the bucket's entries.
REQUEST = "page long, bucket int, entries binary"


def bucket_bits(spark: SparkSession) -> int:
    """Enough buckets for four per shuffle partition."""
    return max(4, int(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def bucket_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Ends of each bucket in sorted unsigned 64-bit ``hashes``, with a leading zero."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(hashes, tops), [len(hashes)]))


def pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype)


def by_bucket(rows: DataFrame, answer: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple]], columns: pa.Schema, ddl: str) -> DataFrame:
    """Bring the request rows of each bucket together and yield what ``answer(bucket, [(page, entries), ...])`` yields."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for b in batches:
            for page, bucket, entries in zip(b.column("page").to_pylist(), b.column("bucket").to_pylist(), b.column("entries"), strict=True):
                if bucket != current and held:
                    yield from _batches(answer(current, held), columns)
                    held = []
                current = bucket
                held.append((page, entries.as_py()))
        if held:
            yield from _batches(answer(current, held), columns)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "page").mapInArrow(grouped, ddl)


def _batches(rows: Iterator[tuple], columns: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield to_batch(held, columns)
            held = []
    if held:
        yield to_batch(held, columns)


def to_batch(rows: list[tuple], columns: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)], schema=columns)


def with_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Each page with its answers (bucket, entries) as one array; pages without any have null."""
    per_page = answers.groupBy("page").agg(F.collect_list(F.struct("bucket", "entries")).alias("answers"))
    return pages.join(per_page, "page", "left")


def answered(answers: list[dict] | None, dtype: str) -> np.ndarray:
    """All answers of one page in the order of its sorted hashes."""
    parts = [unpack(a["entries"], dtype) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def pack_sorted(hashes: np.ndarray, bucket: int, bits: int) -> bytes:
    """Sorted hashes of one bucket as their steps, each in as many bytes as the largest needs; the first byte is that number."""
    steps = np.diff(hashes, prepend=np.uint64(bucket) << np.uint64(64 - bits)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view("u1").reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes, n: int, bucket: int, bits: int) -> tuple[np.ndarray, bytes]:
    """(hashes, what follows them in ``data``)."""
    width = data[0]
    steps = np.zeros((n, 8), "u1")
    steps[:, :width] = np.frombuffer(data, "u1", n * width, 1).reshape(n, width)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64) + (np.uint64(bucket) << np.uint64(64 - bits)), data[1 + n * width :]


def drop_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of finished stages now.

    Spark removes them when the driver happens to collect its garbage.  A plan whose result
    has been written stays referenced until its end event has passed the listeners, so the
    second round finds what the first could not.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
