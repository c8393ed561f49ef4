"""Appended lines of live logs as a stream.

The offset is the end of the last whole line of each file, so a line is read once it is
complete, exactly once, and a torn tail waits for the rest.  What was appended since the last
batch is cut into byte ranges that are read in parallel; a line belongs to the range in which
it starts.

    register(spark)
    lines = spark.readStream.format("refrain_log").option("path", folder).load()

Options: ``path`` (a file or a folder, by path or uri), ``pattern`` of file names (default
``*``), ``rangeBytes`` (default 64 MB).  A log rotates by going on in a file of a new name: a
file that shrinks, or is written anew under its old name, ends the stream with an error, as
its lines could be lost or read twice.  A file that is removed is not read further.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from refrain.sources.files import at, listed

FORMAT = "refrain_log"
SCHEMA = "seq struct<file: string, byte: bigint>, value string"
RANGE_BYTES = 64 << 20
_SEARCH = 64 << 10
_BATCH_BYTES = 4 << 20
_ARROW = pa.schema([("seq", pa.struct([("file", pa.string()), ("byte", pa.int64())])), ("value", pa.string())])


@dataclass
class LineRange(InputPartition):
    """Lines that start in [first, last) of the new part [start, end) of a file; ``start`` and ``end`` are line starts."""

    file: str
    start: int
    end: int
    first: int
    last: int


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogTailReader:
        return LogTailReader(self.options)


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = at(self.path)
        ends = dict(self.known)
        for file, size in listed(self.path, self.pattern):
            known = ends.get(file, 0)
            if size < known:
                raise RuntimeError(f"{file} shrank from {known} to {size} bytes; a log must rotate to a new name")
            ends[file] = line_end(store, file, known, size)
        self.known = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            out += [LineRange(file, begin, stop, a, min(a + self.range_bytes, stop)) for a in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = at(self.path)
        with store.open_input_file(partition.file) as f:
            yield from _batches(partition.file, lines_of(f, partition))


def line_end(store, file: str, known: int, size: int) -> int:
    """The position after the last line feed of a file, searched back from its end to ``known``."""
    if size == known:
        return known
    with store.open_input_file(file) as f:
        stop = size
        while stop > known:
            begin = max(known, stop - _SEARCH)
            f.seek(begin)
            if (found := f.read(stop - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            stop = begin
    return known


def lines_of(f, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """(first byte, line without its end) of the lines that start in a range."""
    f.seek(part.first if part.first == part.start else part.first - 1)
    buffered = io.BufferedReader(f, 1 << 20)
    now = part.first if part.first == part.start else part.first - 1 + len(buffered.readline())
    while now < part.last:
        line = buffered.readline()
        if not line.endswith(b"\n"):
            raise RuntimeError(f"{part.file} ends before byte {part.end}; a log must not be cut")
        yield now, line[:-1].removesuffix(b"\r")
        now += len(line)


def _batches(file: str, lines: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for byte, line in lines:
        held.append(({"file": file, "byte": byte}, line.decode("utf-8", "replace")))
        held_bytes += len(line) + 64
        if held_bytes >= _BATCH_BYTES:
            yield _batch(held)
            held, held_bytes = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def stream_log_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of a log, or of all logs of a folder, as they are completed: (seq, value); ``seq`` orders by file name and byte."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format(FORMAT).options(path=path, pattern=pattern, rangeBytes=range_bytes).load()
