"""Repeated byte strings by external induced suffix sorting.

A byte is removed if a LENGTH-byte string that covers it also starts earlier (smaller id, or
the same document further up).  Sorting every suffix of the corpus is not needed:

1. Winnowing selects sample positions: of each LENGTH-byte string, those of its GRAM-byte
   grams with the smallest hash.  Equal strings have samples at equal places.  Samples whose
   gram occurs once in the corpus can't lie in a repeated string and end here.
2. The rest of a string that contains a sample lies in the sample's context, LENGTH -
   GRAM bytes before it and LENGTH bytes from it on.  Of samples with equal contexts all but
   the first lie in text that came before; their whole context is removed.
3. The first samples of different contexts of one gram are sorted by the text from the sample
   on, with the common prefix of neighbours (Spark's external sort merges spilled runs through
   a priority queue).  From this order the order of the suffixes one byte further left is
   induced, by that byte and the rank so far, common prefixes being carried along, and so on
   for each byte of left context.  Neighbours with LENGTH common bytes are equal strings.
4. Grams with more than COLD contexts would make one group too large for a task.  Their
   strings are compared one by one through hash buckets instead, where a string that many
   documents share is one entry per page.

Steps 1, 2 and 4 ask their questions per page (``pages``); no key is hot in any of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import pages as P
from refrain.llm.batches import bounded_batches
from refrain.llm.registry import query, table
from refrain.operators.settle import settle, shared_dir

LENGTH = 100
GRAM = 52
LEFT = LENGTH - GRAM
COLD = 200
PAGE_BYTES = 4 << 20
#: Pages that Spark's Parquet reader may decode at once; a batch never reaches beyond its row group.
GROUP_PAGES = 4
_SLICE = 1 << 18
#: Rows of one induction, at least, where there are as many; a group is never cut.
_CHUNK = 20_000
#: Sorts after every id; null ids count as the last ones.
_NULL_ID = (1 << 63) - 1

_PAGE = "page long, ids array<long>, lengths array<long>, text binary"
_ARROW_PAGE = pa.schema([("page", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())])
_ARROW_REQUEST = pa.schema([("page", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary())])
_STEP = "kind int, page long, bucket int, entries binary, gram long, doc long, place long, at long, left_bytes int, right_bytes int, before binary, after binary"
_ARROW_STEP = pa.schema([
    ("kind", pa.int32()), ("page", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary()), ("gram", pa.int64()), ("doc", pa.int64()),
    ("place", pa.int64()), ("at", pa.int64()), ("left_bytes", pa.int32()), ("right_bytes", pa.int32()), ("before", pa.binary()), ("after", pa.binary()),
])
_KNOWN, _HOT, _CONTEXT, _HOT_STARTS = range(4)

_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, -(-GRAM // 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _digests(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit cryptographic digest of each row of bytes; rows with equal digests count as equal, whatever a text was made for."""
    data, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1]
    digest = hashlib.blake2b
    whole = b"".join([digest(data[a : a + width], digest_size=16).digest() for a in range(0, len(data), width)])
    both = np.frombuffer(whole, "<u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


# ---- pages -----------------------------------------------------------------------------


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        docs = sorted(zip((_NULL_ID if i is None else i for i in b.column("id").to_pylist()), b.column("text").to_pylist(), strict=True))
        held, size = [], 0
        for k, (i, text) in enumerate(docs):
            raw = text.encode()
            held.append((i, raw))
            size += len(raw)
            if size >= PAGE_BYTES or k == len(docs) - 1:
                row = (part << 32 | at, [i for i, _ in held], [len(r) for _, r in held], b"".join(r for _, r in held))
                yield P.to_batch([row], _ARROW_PAGE)
                held, size, at = [], 0, at + 1


class _Page:
    """The bytes of a page with, for each document, where it starts and ends."""

    def __init__(self, row: dict):
        self.page = row["page"]
        self.ids = np.array(row["ids"], np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.stops = np.cumsum(self.lengths)
        self.starts = self.stops - self.lengths
        self.text = np.frombuffer(row["text"], np.uint8)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stops, at, side="right")

    def same_place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether positions are the same place of the same id."""
        x, y = self.document(a), self.document(b)
        return (self.ids[x] == self.ids[y]) & (a - self.starts[x] == b - self.starts[y])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram hashes) selected by winnowing, in text order."""
        n, found, hashes = len(self.text), [], []
        padded = np.concatenate([self.text, np.zeros(LENGTH + 8, np.uint8)])
        for a in range(0, n, _SLICE):
            b = min(a + _SLICE, n)  # strings that start in [a, b)
            grams = _gram_hashes(padded, a, b + LEFT)
            fits = np.zeros(b - a, bool)
            for start, stop in zip(*self._inside(a, b), strict=True):
                fits[start:stop] = True
            least = np.where(fits, _sliding(grams, LEFT + 1, np.minimum)[: b - a], np.uint64(0))
            edge = np.zeros(LEFT, np.uint64)
            most = _sliding(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum)
            at = np.flatnonzero((most == grams) & (most > 0))
            found.append(at + a)
            hashes.append(grams[at])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, first = np.unique(np.concatenate(found), return_index=True)
        return at, _finish(np.concatenate(hashes)[first])  # selected hashes are small ones; mixed again they fill all buckets alike

    def _inside(self, a: int, b: int) -> tuple[list[int], list[int]]:
        """Where strings that start in [a, b) end within their document, relative to a."""
        lo, hi = np.searchsorted(self.stops, a, side="right"), np.searchsorted(self.starts, b, side="left")
        starts, stops = np.maximum(self.starts[lo:hi], a) - a, np.minimum(self.stops[lo:hi] - LENGTH + 1, b) - a
        ok = stops > starts
        return starts[ok].tolist(), stops[ok].tolist()

    def context(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(before, after, left bytes, right bytes): bytes + 1, those before the sample backwards, zeros outside the document."""
        doc = self.document(at)
        left = np.minimum(at - self.starts[doc], LEFT)
        right = np.minimum(self.stops[doc] - at, LENGTH)
        back, ahead = np.arange(1, LEFT + 1), np.arange(LENGTH)
        last = max(len(self.text) - 1, 0)
        before = np.where(back <= left[:, None], self.text[np.maximum(at[:, None] - back, 0)] + 1, 0).astype(np.uint8)
        after = np.where(ahead < right[:, None], self.text[np.minimum(at[:, None] + ahead, last)] + 1, 0).astype(np.uint8)
        return before, after, left, right


def _gram_hashes(padded: np.ndarray, a: int, b: int) -> np.ndarray:
    """Nonzero hash of the GRAM bytes from each position of [a, b) on."""
    words = np.ndarray((b - a + GRAM - 8,), "<u8", padded[a:].tobytes() + bytes(GRAM), strides=(1,)).astype(np.uint64)
    n, out = b - a, np.zeros(b - a, np.uint64)
    for k, shift in enumerate([*range(0, GRAM - 8, 8), GRAM - 8]):
        out += words[shift : shift + n] * _RANDOM[k]
    return _finish(out) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ask(page: int, hashes: np.ndarray, columns: list[np.ndarray], bits: int, kind: int | None = None) -> pa.RecordBatch:
    """Request rows for sorted ``hashes``; the entries of a bucket are its hashes and then each further 8-byte column."""
    cuts = P.bucket_cuts(hashes, bits)
    rows = []
    for bucket, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
        if y > x:
            entries = b"".join(c[x:y].astype("<u8").tobytes() for c in [hashes, *columns])
            rows.append((page, bucket, entries) if kind is None else (kind, page, bucket, entries, *[None] * 8))
    return P.to_batch(rows, _ARROW_REQUEST if kind is None else _ARROW_STEP)


def _gathered(rows: list[tuple[int, bytes]], columns: int) -> tuple[np.ndarray, list[int]]:
    """(columns x entries of all pages, entries of each page)."""
    tables = [np.frombuffer(e, "<u8").reshape(columns, -1) for _, e in rows]
    return np.concatenate(tables, axis=1), [t.shape[1] for t in tables]


def _dealt_back(bucket: int, rows: list[tuple[int, bytes]], sizes: list[int], flags: np.ndarray) -> Iterator[tuple]:
    ends = np.cumsum(sizes).tolist()
    for (page, _), end, n in zip(rows, ends, sizes, strict=True):
        yield page, bucket, P.pack(flags[end - n : end].astype(np.uint8))


# ---- 1: which grams occur twice --------------------------------------------------------


def _ask_grams(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _page_rows(batches):
            grams, counts = np.unique(_Page(row).samples()[1], return_counts=True)
            yield _ask(row["page"], grams, [np.minimum(counts, 2)], bits)

    return ask


def _repeated_grams(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
    (grams, counts), sizes = _gathered(rows, 2)
    _, at = np.unique(grams, return_inverse=True)
    yield from _dealt_back(bucket, rows, sizes, (np.bincount(at, counts) >= 2)[at])


def _repeated_samples(row: dict, page: _Page) -> tuple[np.ndarray, np.ndarray]:
    at, grams = page.samples()
    distinct, index = np.unique(grams, return_inverse=True)
    again = P.answered(row["answers"], "<u1").astype(bool)[index] if len(distinct) else np.zeros(0, bool)
    return at[again], grams[again]


# ---- 2: which contexts came before, and which grams have several -----------------------


class _Contexts:
    """The distinct contexts of the repeated samples of a page."""

    def __init__(self, row: dict, page: _Page):
        self.at, self.grams = _repeated_samples(row, page)
        n = len(self.at)
        first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for a in range(0, n, _CHUNK):
            some = slice(a, a + _CHUNK)
            before, after, left, right = page.context(self.at[some])
            whole = np.empty((len(left), LEFT + LENGTH + 2), np.uint8)
            whole[:, :LEFT], whole[:, LEFT : LEFT + LENGTH] = before, after
            whole[:, -2], whole[:, -1] = left, right
            first[some], second[some] = _digests(whole)
        order = np.lexsort((self.at, second, first))  # documents lie in id order, so position is order in the page
        new = np.ones(n, bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        self.firsts = order[new]
        self.of = np.empty(n, np.int64)  # sample to context
        self.of[order] = np.cumsum(new) - 1
        self.first, self.second = first[self.firsts], second[self.firsts]

    def gram_contexts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(grams, [smallest and largest context hash, number of contexts])."""
        grams = self.grams[self.firsts]
        order = np.lexsort((self.first, grams))
        grams, hashes = grams[order], self.first[order]
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(grams))
        return grams[starts], [hashes[starts], hashes[stops - 1], stops - starts] if len(grams) else [hashes, hashes, starts]


def _ask_contexts(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _page_rows(batches):
            page = _Page(row)
            found = _Contexts(row, page)
            at = found.at[found.firsts]
            doc = page.document(at)
            yield _ask(row["page"], found.first, [found.second, page.ids[doc].view(np.uint64), at - page.starts[doc]], bits, 0)
            grams, columns = found.gram_contexts()
            yield _ask(row["page"], grams, columns, bits, 1)

    return ask


def _earlier_places(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
    (first, second, ids, places), sizes = _gathered(rows, 4)
    ids, places = ids.view(np.int64), places.astype(np.int64)
    order = np.lexsort((places, ids, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    flags = np.zeros(len(order), np.uint8)
    flags[order] = (ids[leader] != ids[order]) | (places[leader] != places[order])
    yield from _dealt_back(bucket, rows, sizes, flags)


def _gram_kinds(cold: int):
    """0: one context; 1: several; 2: more than ``cold``."""

    def kinds(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple]:
        (grams, low, high, counts), sizes = _gathered(rows, 4)
        distinct, at = np.unique(grams, return_inverse=True)
        least, most = np.full(len(distinct), np.uint64(2**64 - 1)), np.zeros(len(distinct), np.uint64)
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, high)
        several = (least != most).astype(np.uint8) * (1 + (np.bincount(at, counts) > cold))
        yield from _dealt_back(bucket, rows, sizes, several[at])

    return kinds


# ---- 3 and 4: known repeats, contexts to sort, strings of hot grams --------------------


def _split_contexts(bits: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _page_rows(batches):
            page = _Page(row)
            found = _Contexts(row, page)
            came_before = P.answered(row["context_answers"], "<u1").astype(bool)
            grams = np.unique(found.grams)
            kinds = P.answered(row["gram_answers"], "<u1")
            doc = page.document(found.at)
            leader = found.firsts[found.of]
            is_first = page.same_place(found.at, found.at[leader]) & ~came_before[found.of]
            starts = np.maximum(found.at - LEFT, page.starts[doc])
            stops = np.minimum(found.at + LENGTH, page.stops[doc])
            known = ~is_first & (stops - starts >= LENGTH)
            kind = kinds[np.searchsorted(grams, found.grams)] if len(grams) else np.zeros(0, np.uint8)
            for some in _slices(np.flatnonzero(is_first & (kind == 1) & (stops - starts >= LENGTH))):
                yield _context_rows(page, found, some, doc)
            hot = np.flatnonzero(is_first & (kind == 2) & (stops - starts >= LENGTH))
            first, second, at, copies = _strings(page, found.at[hot])
            yield _step(_KNOWN, row["page"], entries=_pack_spans(np.append(starts[known], copies), np.append(stops[known], copies + LENGTH)))
            doc = page.document(at)
            yield _ask(row["page"], first, [second, page.ids[doc].view(np.uint64), at - page.starts[doc]], bits, _HOT)
            yield _step(_HOT_STARTS, row["page"], entries=P.pack(at.astype("<i8")))

    return split


def _slices(values: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(values), _CHUNK):
        yield values[a : a + _CHUNK]


def _step(kind: int, page: int, entries: bytes) -> pa.RecordBatch:
    return P.to_batch([(kind, page, None, entries, *[None] * 8)], _ARROW_STEP)


def _pack_spans(starts: np.ndarray, stops: np.ndarray) -> bytes:
    return P.pack(np.concatenate([starts, stops]).astype("<i8"))


def _unpack_spans(data: bytes) -> np.ndarray:
    return P.unpack(data, "<i8").reshape(2, -1)


def _context_rows(page: _Page, found: _Contexts, some: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    at = found.at[some]
    before, after, left, right = page.context(at)
    n, owner = len(some), doc[some]
    columns = {
        "kind": pa.array(np.full(n, _CONTEXT, np.int32)), "page": pa.array(np.full(n, page.page, np.int64)), "bucket": pa.nulls(n, pa.int32()), "entries": pa.nulls(n, pa.binary()),
        "gram": pa.array(found.grams[some].view(np.int64)), "doc": pa.array(page.ids[owner]), "place": pa.array(at - page.starts[owner]), "at": pa.array(at),
        "left_bytes": pa.array(left.astype(np.int32)), "right_bytes": pa.array(right.astype(np.int32)),
        "before": pa.array([r.tobytes() for r in before], pa.binary()), "after": pa.array([r.tobytes() for r in after], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=_ARROW_STEP)


def _strings(page: _Page, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes, position) of the distinct strings around the samples, sorted by hash, and the positions of their later copies in the page."""
    starts = np.unique((at[:, None] - np.arange(LEFT + 1)).ravel())
    starts = starts[starts >= 0]
    starts = starts[page.starts[page.document(starts)] <= starts]
    doc = page.document(starts)
    starts = starts[starts + LENGTH <= page.stops[doc]]
    first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), _CHUNK):
        some = slice(a, a + _CHUNK)
        first[some], second[some] = _digests(page.text[starts[some, None] + np.arange(LENGTH)])
    order = np.lexsort((starts, second, first))
    first, second, starts = first[order], second[order], starts[order]
    new = np.ones(len(starts), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    leader = starts[np.flatnonzero(new)][np.cumsum(new) - 1] if len(starts) else starts
    own = page.same_place(starts, leader)
    return first[own], second[own], starts[own], starts[~own]


def induced_repeats(group: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, rows): rows whose LENGTH-byte string that starts ``offset`` bytes before the sample also occurs at a row of the same group with smaller ``rank``.

    Rows come sorted by group and ``after``.  The order of the suffixes at offset + 1 is
    induced from that at offset; ``common`` holds the common prefix of each with the one before.
    """
    n = len(group)
    same = group[1:] == group[:-1]
    differs = after[1:] != after[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common = np.minimum(common, np.minimum(right[1:], right[:-1]))
    common = np.concatenate(([-1], np.where(same, common, -1)))
    rows = np.arange(n)
    for offset in range(LEFT + 1):
        runs = np.flatnonzero(common < LENGTH)
        if len(rows):
            least = np.repeat(np.minimum.reduceat(rank[rows], runs), np.diff(np.append(runs, len(rows))))
            again = rows[rank[rows] > least]
            if len(again):
                yield offset, again
        if offset == LEFT:
            return
        # a row whose best neighbour can't reach LENGTH in the bytes that are left is done
        beside = np.maximum(common, np.append(common[1:], -1)) + (LEFT - offset)
        go = np.flatnonzero((left[rows] > offset) & (beside >= LENGTH))
        if not len(go):
            return
        key = group[rows[go]].astype(np.int64) << 8 | before[rows[go], offset]
        go = go[np.argsort(key, kind="stable")]
        key = group[rows[go]].astype(np.int64) << 8 | before[rows[go], offset]
        bounds = np.column_stack([go[:-1] + 1, go[1:] + 1]).ravel()
        between = np.minimum.reduceat(np.append(common, -1), np.append(bounds, len(common)))[:-1:2] if len(go) > 1 else np.zeros(0, np.int64)
        carried = np.where(key[1:] == key[:-1], between + 1, -1)
        rows, common = rows[go], np.concatenate(([-1], carried))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole groups from rows sorted by gram and text after the sample."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= _CHUNK:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            grams = whole.column("gram").to_numpy()
            cut = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if (grams != grams[-1]).any() else 0
            if cut:
                yield from _induced(whole.slice(0, cut))
            held, size = [whole.slice(cut)], whole.num_rows - cut
    if held:
        yield from _induced(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _induced(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = b.num_rows
    column = lambda name: b.column(name).to_numpy()
    matrix = lambda name, width: np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(n, width)
    gram, at, page = column("gram"), column("at"), column("page")
    group = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    order = np.lexsort((column("place"), column("doc")))
    rank = np.empty(n, np.int64)
    doc, place = column("doc")[order], column("place")[order]
    rank[order] = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))))
    hit = np.zeros((n, LEFT + 3), bool)  # offsets with an empty column on either side
    for offset, rows in induced_repeats(group, matrix("before", LEFT), matrix("after", LENGTH), column("left_bytes"), column("right_bytes"), rank):
        hit[rows, offset + 1] = True
    edges = np.diff(hit.astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)  # row by row, so in pairs with the lows
    yield pa.RecordBatch.from_arrays([pa.array(page[row]), pa.array(at[row] - high + 1), pa.array(at[row] - low + LENGTH)], ["page", "start", "stop"])


# ---- result ----------------------------------------------------------------------------


def _cut_documents(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _page_rows(batches):
            page = _Page(row)
            spans = [_unpack_spans(s) for s in row["known"] or []]
            induced = row["induced"] or []
            spans.append(np.array([[s["start"] for s in induced], [s["stop"] for s in induced]], np.int64).reshape(2, -1))
            hot = np.concatenate([P.unpack(s, "<i8") for s in row["hot_starts"] or []] or [np.zeros(0, np.int64)])
            hot = hot[P.answered(row["hot_answers"], "<u1").astype(bool)] if len(hot) else hot
            spans.append(np.stack([hot, hot + LENGTH]))
            starts, stops = np.concatenate(spans, axis=1)
            yield _results(page, starts, stops, with_text)

    return cut


def _results(page: _Page, starts: np.ndarray, stops: np.ndarray, with_text: bool) -> pa.RecordBatch:
    depth = np.zeros(len(page.text) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    gone = np.cumsum(depth[:-1]) > 0
    touched = np.zeros(len(page.ids), bool)
    touched[page.document(starts)] = True
    rows = []
    for i, (doc_id, a, b) in enumerate(zip(page.ids.tolist(), page.starts.tolist(), page.stops.tolist(), strict=True)):
        kept, spans = page.text[a:b], []
        if touched[i]:
            edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).tolist()
            spans = [{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            kept = kept[~gone[a:b]]
        raw = kept.tobytes()
        rows.append((None if doc_id == _NULL_ID else doc_id, b - a, b - a - len(raw), spans, hashlib.sha256(raw).hexdigest(), raw if with_text else None))
    return P.to_batch(rows, _ARROW_RESULT)


_RESULT = "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string, kept binary"
_ARROW_RESULT = pa.schema([
    ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("kept_sha256", pa.string()), ("kept", pa.binary()),
])


def _settle_pages(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/refrain/{uuid.uuid4().hex}"
    rows.mapInArrow(_pages, _PAGE).write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_PAGES).parquet(path)
    return spark.read.schema(_PAGE).parquet(path)


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, cold: int = COLD) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, spans (maximal removed runs), kept_sha256, kept (the rest, if ``with_text``).

    Texts are UTF-8 bytes, null as empty.  Strings are judged on the input and never cross
    documents; texts of fewer than LENGTH bytes keep everything.  Ids are whole numbers; null
    ids come last and count as one document, and so do rows that repeat an id: a string isn't
    earlier than the same place of the same id.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = P.bucket_bits(spark)
    pages = _settle_pages(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    grams = settle(P.by_bucket(pages.mapInArrow(_ask_grams(bits), P.REQUEST), _repeated_grams, _ARROW_REQUEST, P.REQUEST))
    P.drop_shuffles(spark)

    asked = settle(P.with_answers(pages, grams).mapInArrow(_ask_contexts(bits), _STEP).select("kind", "page", "bucket", "entries"))
    P.drop_shuffles(spark)
    request = lambda table, kind: table.where(F.col("kind") == kind).select("page", "bucket", "entries")
    contexts = settle(P.by_bucket(request(asked, 0), _earlier_places, _ARROW_REQUEST, P.REQUEST))
    kinds = settle(P.by_bucket(request(asked, 1), _gram_kinds(cold), _ARROW_REQUEST, P.REQUEST))

    answers = _per_page(grams, "answers").join(_per_page(contexts, "context_answers"), "page", "left").join(_per_page(kinds, "gram_answers"), "page", "left")
    steps = settle(pages.join(answers, "page", "left").mapInArrow(_split_contexts(bits), _STEP))
    P.drop_shuffles(spark)
    hot = settle(P.by_bucket(request(steps, _HOT), _earlier_places, _ARROW_REQUEST, P.REQUEST))
    to_sort = steps.where(F.col("kind") == _CONTEXT).drop("kind", "bucket", "entries")
    induced = settle(to_sort.repartition("gram").sortWithinPartitions("gram", "after").mapInArrow(_induce, "page long, start long, stop long"))
    P.drop_shuffles(spark)

    packed = lambda kind, name: steps.where(F.col("kind") == kind).groupBy("page").agg(F.collect_list("entries").alias(name))
    spans = induced.groupBy("page").agg(F.collect_list(F.struct("start", "stop")).alias("induced"))
    known = packed(_KNOWN, "known").join(packed(_HOT_STARTS, "hot_starts"), "page", "left").join(spans, "page", "left").join(_per_page(hot, "hot_answers"), "page", "left")
    return pages.join(known, "page", "left").mapInArrow(_cut_documents(with_text), _RESULT).withColumnRenamed("id", id_col)


def _per_page(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("page").agg(F.collect_list(F.struct("bucket", "entries")).alias(name))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
