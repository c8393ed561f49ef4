"""Token ids as range-coded binary files, and their reader.

Documents are range-partitioned and sorted by id, encoded, and written as segments of whole
documents: one row per segment with the documents' ids and lengths, and blocks of 2,048 ids
that are coded and checksummed each on its own (``range_coder``).  The container is Parquet,
so Spark's commit protocol covers lost executors and repeated tasks.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm import range_coder
from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.settle import shared_dir

SEGMENT = 1 << 19
#: Bytes of text cut into pieces at once, which takes some ten times their memory.
SLICE = 8 << 20
FILE_SCHEMA = (
    "part int, segment int, part_start long, n_tokens long, vocabulary int, "
    "doc_ids array<long>, doc_tokens array<long>, block_bytes array<int>, block_crc32 array<long>, payload binary"
)
READ_SCHEMA = "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long"

#: White space that cuts, and marks before which a tokenizer with punctuation splits always cuts after a letter or digit.
_SPACES = b" \n"
_MARKS = np.isin(np.arange(256), list(b".,!|#$%&*?;:"))
#: By byte: the lower case of ASCII, and 1 for a letter or digit, 2 for white space that cuts.
_LOWER = bytes(range(256)).lower()
_KIND = bytes(2 if c in _SPACES else chr(c).isalnum() and c < 128 for c in range(256))
#: By second byte of a Latin-1 letter in UTF-8, whose first is 0xC3: its lower case, and which are letters then.
_LATIN = 0xC3
_LATIN_LOWER = np.array([c + 0x20 if 0x80 <= c <= 0x9E and c != 0x97 else c for c in range(256)], np.uint8)
_LATIN_LETTER = np.isin(np.arange(256), [c for c in range(0x9F, 0xC0) if c != 0xB7])
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts as bytes, and for each text the number of pieces before it, with their total at the end.

    Texts are cut at spaces and line feeds, which go, and between a letter or digit and a mark.
    Letters of ASCII and Latin-1 become lower case.  Between spaces, whatever has a character
    beyond Latin-1 (it may combine with the one before) or ``<|`` (it may be a special token)
    stays whole and as it is.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(len(bounds), np.int64)
    plain = raw.tobytes()
    data = np.frombuffer(bytearray(plain.translate(_LOWER)), np.uint8)
    kind = np.frombuffer(plain.translate(_KIND), np.uint8)
    letter, space = kind == 1, kind == 2
    second = np.flatnonzero(raw[:-1] == _LATIN) + 1
    data[second] = _LATIN_LOWER.take(raw.take(second))
    letter[second] = _LATIN_LETTER.take(data.take(second))
    spaced = np.ones(len(raw), bool)
    spaced[1:] = space[:-1]
    spaced[bounds[:-1][bounds[:-1] < len(raw)]] = True
    begins = spaced.copy()
    marks = np.flatnonzero(letter[:-1] > letter[1:]) + 1
    begins[marks[_MARKS.take(raw.take(marks))]] = True
    odd = raw > _LATIN
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    if odd.any():
        starts = np.flatnonzero(spaced)
        whole = np.repeat(np.logical_or.reduceat(odd, starts), np.diff(starts, append=len(raw)))
        np.copyto(data, raw, where=whole)
        begins &= spaced | ~whole
    begins &= ~space
    before = np.searchsorted(np.flatnonzero(begins), bounds)
    flags = begins.view(np.uint8) | space.view(np.uint8) << 1
    flags, data = flags.tobytes().translate(None, b"\x02"), data.tobytes().translate(None, _SPACES)  # white space goes
    starts = np.append(np.flatnonzero(np.frombuffer(flags, bool)), len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]), before


class CachedTokenizer:
    """Ids of whole texts through a cache of the pieces between white space and before marks.

    Only for tokenizers that drop white space, lower-case, split letters from punctuation, map
    bytes to characters and mark word ends with ``</w>``; then the ids of a text are those of its
    pieces in a row.  ``plain`` has the same model for lower-case words, which need no
    normalizing and are split at spaces alone.  Each batch looks up its different pieces once.
    """

    MOST = 1 << 20
    JOINED = 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would wait busily
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, pieces: list[bytes]) -> None:
        """Put pieces that differ into the cache."""
        if len(self.cache) > self.MOST // 2:  # what is still in use comes back from the older half
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        if older:
            cache.update((piece, older[piece]) for piece in pieces if piece in older)
            pieces = [piece for piece in pieces if piece not in cache]
        plain = list(filter(_WORD.fullmatch, pieces))
        for at in range(0, len(plain), self.JOINED):
            some = plain[at : at + self.JOINED]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
                cache.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for piece in pieces:
            if piece not in cache:
                cache[piece] = self._ids(piece.decode()).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(texts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles: collections would only walk the cache
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, before = _pieces(texts)
        if not len(pieces):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        different, nth = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.cache.get, different))
        if None in found:
            gaps = [i for i, ids in enumerate(found) if ids is None]
            missing = [different[i] for i in gaps]
            self._learn(missing)
            for i, ids in zip(gaps, map(self.cache.get, missing), strict=True):
                found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        starts = np.cumsum(sizes) - sizes
        sizes = sizes.take(nth)
        ends = np.cumsum(sizes)
        at = np.repeat(starts.take(nth) - ends + sizes, sizes)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), self.dtype).take(at)
        return ids, np.diff(np.append(0, ends).take(before))


_tokenizers: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker, so its cache outlives a task."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


class _Writer:
    """Gathers the documents of one partition and cuts them into segments."""

    def __init__(self, part: int, vocabulary: int):
        self.part, self.vocabulary = part, vocabulary
        self.segment, self.start = 0, 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.arrays: list[np.ndarray] = []
        self.pending = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths += lengths.tolist()
        self.arrays.append(ids)
        self.pending += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        ids, cuts, filled = np.concatenate(self.arrays), [0], 0
        for i, n in enumerate(self.lengths):
            filled += n
            if filled >= SEGMENT:
                cuts.append(i + 1)
                filled = 0
        if cuts[-1] < len(self.lengths):
            cuts.append(len(self.lengths))
        spans = list(zip(cuts, cuts[1:], strict=False))
        ends = np.cumsum([0, *self.lengths])
        streams = [ids[ends[a] : ends[b]] for a, b in spans]
        blocks = [[s[i : i + range_coder.BLOCK] for i in range(0, len(s), range_coder.BLOCK)] for s in streams]
        coded = iter(range_coder.encode_blocks([x for b in blocks for x in b], self.vocabulary))
        for (a, b), own in zip(spans, blocks, strict=True):
            payloads = [next(coded) for _ in own]
            n = sum(self.lengths[a:b])
            row = {
                "part": self.part, "segment": self.segment, "part_start": self.start, "n_tokens": n, "vocabulary": self.vocabulary,
                "doc_ids": self.ids[a:b], "doc_tokens": self.lengths[a:b], "block_bytes": [len(p) for p in payloads],
                "block_crc32": [range_coder.checksum(x) for x in own], "payload": b"".join(payloads),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW_FILE)
            self.segment += 1
            self.start += n
        self._clear()


_ARROW_FILE = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("vocabulary", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("block_bytes", pa.list_(pa.int32())),
    ("block_crc32", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of rows whose texts have at most SLICE bytes; a longer text is alone."""
    first, filled = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > first and filled + n > SLICE:
            yield first, i - first
            first, filled = i, 0
        filled += n
    if first < len(texts):
        yield first, len(texts) - first


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending id order below ``path``.

    A null text has no ids but the end id.  Null ids come last; rows that repeat an id follow
    each other in the order of their texts.  An empty table writes no segments.  Ids must be
    whole numbers.  ``tokenizer`` is a file's path on every machine.
    """
    bounded_batches(docs.sparkSession)
    order = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        writer = _Writer(TaskContext.get().partitionId(), words.vocabulary)
        for b in batches:
            for at, n in _slices(b.column("text")):
                ids, lengths = words.encode_column(b.column("text").slice(at, n))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                writer.add(b.column("doc_id").slice(at, n).to_pylist(), ids, lengths + 1)
                if writer.pending >= range_coder.LANES * range_coder.BLOCK:
                    yield from writer.flush()
        if writer.pending:
            yield from writer.flush()

    rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def segment_ids(row: dict) -> np.ndarray:
    """The ids of one segment row, checked against the blocks' checksums."""
    return _segments_ids([row])[0]


def _segments_ids(rows: list[dict]) -> list[np.ndarray]:
    payloads, lengths, sums = [], [], []
    for r in rows:
        at, left = 0, r["n_tokens"]
        for size in r["block_bytes"]:
            payloads.append(r["payload"][at : at + size])
            lengths.append(min(range_coder.BLOCK, left))
            at, left = at + size, left - range_coder.BLOCK
        sums += r["block_crc32"]
    ids = range_coder.decode_blocks(payloads, lengths, rows[0]["vocabulary"]) if rows else []
    for i, (block, want) in enumerate(zip(ids, sums, strict=True)):
        if range_coder.checksum(block) != want:
            raise ValueError(f"checksum of block {i} is wrong")
    out, at = [], 0
    for r in rows:
        n = len(r["block_bytes"])
        out.append(np.concatenate(ids[at : at + n]) if n else np.zeros(0, np.int32))
        at += n
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts the ids of all documents before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written file
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    many = range_coder.LANES * range_coder.BLOCK

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                held += b.slice(i, 1).to_pylist()
                if sum(r["n_tokens"] for r in held) >= many:
                    yield _documents(held)
                    held = []
        if held:
            yield _documents(held)

    documents = files.mapInArrow(read, READ_SCHEMA)
    return documents.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def _documents(rows: list[dict]) -> pa.RecordBatch:
    columns: dict[str, list] = {"doc_id": [], "part": [], "in_part": [], "n_tokens": [], "ids_crc32": []}
    for r, ids in zip(rows, _segments_ids(rows), strict=True):
        at = 0
        for doc_id, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
            columns["doc_id"].append(doc_id)
            columns["part"].append(r["part"])
            columns["in_part"].append(r["part_start"] + at)
            columns["n_tokens"].append(n)
            columns["ids_crc32"].append(range_coder.checksum(ids[at : at + n]))
            at += n
    types = {"doc_id": pa.int64(), "part": pa.int32(), "in_part": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], list(columns))


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files to the shared folder and return what the reader finds in them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/refrain/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer or public_tokenizer("word_bpe_49k.json"), end_id, id_col, text_col)
    return read_token_files(spark, path)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
