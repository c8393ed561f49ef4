"""Adaptive context-mixing range coder for blocks of token ids, many blocks side by side.

Each block starts from an empty model, so blocks decode alone.  The model predicts the next
id from the last two ids (order 2), from the last id (order 1), and from the ids in use
(order 0: a cache of ids by id modulo 256).  How often each order was right so far, at the
confidence it now has, gives the mixed probabilities of four events: the id of order 2, that
of order 1, one of the cached ids, or any id at all.  One range-coder step codes the event
and the id together.

A Python step per token would be far too slow, so step t of all blocks of a batch is done by
one set of numpy operations ("lanes").  Carries are left in the emitted digits and resolved
once at the end.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
_TOTAL_BITS = 24
_DIGIT = 16
#: Low and range lie in a window of three digits; the range is kept above one third of it in bits.
_WINDOW = 48
_TOP = np.uint64(_WINDOW - _DIGIT)
_LEAST_SPAN = 1 << (_WINDOW - _DIGIT)
_LOW = np.uint64(_LEAST_SPAN)
_SHIFT = np.uint64(_DIGIT)
_MASK = np.uint64((1 << (_WINDOW - _DIGIT)) - 1)
_UNIT = np.uint64(_TOTAL_BITS)
_SLOTS = 512
_CACHE = 256
#: From lane to lane; not a power of two, else the slots that all lanes use most would compete for the same lines of the processor's cache.
_SLOTS_APART, _CACHE_APART = _SLOTS + 16, _CACHE + 16
_RATE = 5
#: Shares of the three orders are packed in one integer of three fields, scaled by 16 in use.
_FIELD = 21
_FIELD_MASK = (1 << 20) - 1
#: Mixed shares of the orders stay below this; the rest belongs to plain ids, so each of them has a share.
_MOST = (1 << 20) - (1 << 14) - (1 << 13)
_ALL_FIELDS = sum(((1 << (20 - _RATE)) - 1) << (_FIELD * k) for k in range(3))
_GAIN = np.array([(_MOST >> _RATE) << (_FIELD * k) for k in range(3)] + [0], np.int64)
_LEAST = 512
#: By confidence, after a hit and after a miss.
_SURER = np.array([1, 2, 1, 0, 0, 0, -1, -1], np.int32)
_BY_LAST, _BY_BEFORE = np.int32(40503), np.int32(9973)
#: By event, the bits of the id that place it inside the event.
_PLACED = np.array([0, 0, 255, -1], np.int32)
#: Lanes worked on at once, more or less; each holds about 5 KB of model.
LANES = 4096


class _Model:
    """Predictions of all lanes; lanes are ordered by falling length and drop out at the end.

    A prediction is ``id << 2 | confidence``.  ``shares`` has for each pair of confidences of
    order 2 and order 1 how often order 2, order 1 and the cache were the first to be right.
    Ids are 32-bit integers; the hash of two ids may overflow, as only its low bits count.
    """

    def __init__(self, lanes: int, vocabulary: int):
        self.lanes, self.vocabulary = lanes, vocabulary
        self.table2 = np.zeros(lanes * _SLOTS_APART, np.int32)
        self.table1 = np.zeros(lanes * _SLOTS_APART, np.int32)
        self.cache = np.zeros(lanes * _CACHE_APART, np.int32)
        prior = [(c2 + 1) * _MOST // 8 | (c1 + 1) * _MOST // 16 << _FIELD | _MOST // 8 << 2 * _FIELD for c2 in range(4) for c1 in range(4)]
        self.shares = np.tile(np.array(prior, np.int64), lanes)
        self.all_starts, self.all_sizes = np.zeros((4, lanes), np.int64), np.zeros((4, lanes), np.int64)
        self.flat_starts, self.flat_sizes = self.all_starts.reshape(-1), self.all_sizes.reshape(-1)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.narrow(lanes)

    def narrow(self, n: int) -> None:
        """From now on only the first ``n`` lanes go on."""
        self.n = n
        self.last, self.before = self.last[:n], self.before[:n]
        self.lane = np.arange(n)
        self.slot_base, self.cache_base, self.share_base = self.lane * _SLOTS_APART, self.lane * _CACHE_APART, self.lane * 16
        self.starts, self.sizes = self.all_starts[:, :n], self.all_sizes[:, :n]

    def predict(self) -> None:
        """Ids and event shares of the lanes."""
        last = self.last
        mixing = last * _BY_LAST
        mixing += self.before * _BY_BEFORE
        mixing >>= 5
        mixing &= _SLOTS - 1
        self.at2 = self.slot_base + mixing
        self.at1 = self.slot_base + (last & (_SLOTS - 1))
        self.entry2, self.entry1 = self.table2.take(self.at2, mode="clip"), self.table1.take(self.at1, mode="clip")
        self.guess2, self.guess1 = self.entry2 >> 2, self.entry1 >> 2
        sure = self.entry2 & 3
        sure <<= 2
        sure |= self.entry1 & 3
        self.at = self.share_base + sure
        self.mixed = mixed = self.shares.take(self.at, mode="clip")
        size2, size1, size0, plain = self.sizes
        _, after2, after1, after0 = self.starts
        np.bitwise_and(mixed, _FIELD_MASK, out=size2)
        size2 <<= 4
        size2 += _LEAST
        np.right_shift(mixed, _FIELD, out=size1)
        size1 &= _FIELD_MASK
        size1 <<= 4
        size1 += _LEAST
        np.right_shift(mixed, 2 * _FIELD + 4, out=size0)  # scaled by 16, for each of 256 cached ids
        size0 += _LEAST >> 4
        after2[:] = size2
        np.add(size2, size1, out=after1)
        np.left_shift(size0, 8, out=after0)
        after0 += after1
        np.subtract(1 << _TOTAL_BITS, after0, out=plain)
        plain //= self.vocabulary

    def span(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of each lane's event, before the place of the id inside it."""
        at = event * self.lanes
        at += self.lane
        return self.flat_starts.take(at, mode="clip"), self.flat_sizes.take(at, mode="clip")

    def update(self, ids: np.ndarray, event: np.ndarray, slot: np.ndarray, miss2: np.ndarray, miss1: np.ndarray) -> None:
        mixed = self.mixed
        faded = mixed >> _RATE
        faded &= _ALL_FIELDS
        mixed -= faded
        mixed += _GAIN.take(event, mode="clip")
        self.shares[self.at] = mixed
        fresh = ids << 2
        for table, at, entry, miss in ((self.table2, self.at2, self.entry2, miss2), (self.table1, self.at1, self.entry1, miss1)):
            sure = entry & 3
            step = _SURER.take(sure + 4 * miss.view(np.int8), mode="clip")  # a hit is surer, a miss less sure
            lost = miss & (sure < 2)
            table[at] = _either(lost, fresh, entry + step)
        self.cache[slot] = ids
        self.before, self.last = self.last, ids


def _either(choice: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.where`` without a jump per lane, which the processor can't foresee."""
    a = a - b
    a *= choice
    a += b
    return a


def _active(lengths: np.ndarray) -> np.ndarray:
    """Lanes still running at each step; ``lengths`` fall."""
    steps = int(lengths[0]) if len(lengths) else 0
    return np.searchsorted(-lengths, -np.arange(steps), side="left")


def _runs(n: int) -> list[range]:
    """Equal runs of about LANES blocks, at most half as many again: a run of few lanes takes nearly as long."""
    cuts = np.linspace(0, n, max(1, round(n / LANES)) + 1).astype(int).tolist()
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """One payload per block of at most BLOCK ids below ``vocabulary``; an empty block has an empty payload."""
    out: list[bytes] = [b""] * len(blocks)
    for run in _runs(len(blocks)):
        order = sorted(run, key=lambda i: -len(blocks[i]))
        for i, payload in zip(order, _encode([blocks[i] for i in order], vocabulary), strict=True):
            out[i] = payload
    return out


def _turned(rows: np.ndarray, dtype: type | str = np.int32) -> np.ndarray:
    """The transpose, copied in strips that stay in the processor's cache."""
    out = np.empty(rows.shape[::-1], dtype)
    for i in range(0, len(rows), 64):
        out[:, i : i + 64] = rows[i : i + 64].T
    return out


def _by_step(blocks: list[np.ndarray], lengths: np.ndarray, steps: int) -> np.ndarray:
    """The ids of all blocks, longest first, one row per step; shorter blocks are filled up with zeros."""
    rows = np.zeros((len(blocks), steps), np.int32)
    full = int((lengths == steps).sum())
    rows[:full].reshape(-1)[:] = np.concatenate(blocks[:full])
    for i in range(full, len(blocks)):
        rows[i, : lengths[i]] = blocks[i]
    return _turned(rows)


def _events(miss2: np.ndarray, miss1: np.ndarray, miss0: np.ndarray) -> np.ndarray:
    """0 to 3: the first of order 2, order 1, the cache and any id that has the id."""
    event = miss2.view(np.int8).copy()
    missed = miss2 & miss1
    event += missed.view(np.int8)
    missed &= miss0
    event += missed.view(np.int8)
    return event.astype(np.int64)


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks], np.int64)
    active = _active(lengths).tolist()
    lanes, steps = len(blocks), len(active)
    by_step = _by_step(blocks, lengths, steps)
    model = _Model(lanes, vocabulary)
    all_low, all_span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << _WINDOW, np.uint64)
    low, span = all_low, all_span
    width = steps * 3 // 2 + 8  # an id takes less than 1.5 digits; three more close the block
    digits = np.zeros(width * lanes, np.uint32)  # a row per place, as lanes are at about the same place
    filled = np.arange(lanes)
    for step, n in enumerate(active):
        if n != model.n:
            model.narrow(n)
            low, span = all_low[:n], all_span[:n]
        ids = by_step[step, :n]
        model.predict()
        slot = model.cache_base + (ids & (_CACHE - 1))
        miss2, miss1 = model.guess2 != ids, model.guess1 != ids
        event = _events(miss2, miss1, model.cache.take(slot, mode="clip") != ids)
        start, size = model.span(event)
        start += size * (_PLACED.take(event, mode="clip") & ids)
        unit = span >> _UNIT
        low += unit * start.view(np.uint64)
        np.multiply(unit, size.view(np.uint64), out=span)
        model.update(ids, event, slot, miss2, miss1)
        small = np.flatnonzero(span < _LOW)
        while len(small):
            part = low.take(small)
            at = filled.take(small)
            digits[at] = part >> _TOP
            at += lanes
            filled[small] = at
            part &= _MASK
            part <<= _SHIFT
            low[small] = part
            part = span.take(small)
            part <<= _SHIFT
            span[small] = part
            small = small[part < _LOW]
    for _ in range(3):
        digits[filled] = all_low >> _TOP
        filled += lanes
        all_low = (all_low & _MASK) << _SHIFT
    used = filled // lanes if lanes else filled
    digits = digits.reshape(width, lanes)[: int(used.max(initial=0))]
    words = np.empty(digits.shape, ">u2")
    carry = np.zeros(lanes, np.uint32)
    for place in range(len(digits) - 1, -1, -1):
        carry += digits[place]
        words[place] = carry & 0xFFFF
        carry >>= 16
    words = _turned(words, ">u2")
    return [words[i, : used[i]].tobytes() if lengths[i] else b"" for i in range(lanes)]


def decode_blocks(payloads: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    for run in _runs(len(payloads)):
        order = sorted(run, key=lambda i: -lengths[i])
        for i, ids in zip(order, _decode([payloads[i] for i in order], np.array([lengths[i] for i in order], np.int64), vocabulary), strict=True):
            out[i] = ids
    return out


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole quotients, rounded down, of numbers that stay below 2**48 with quotients up to 2**24: exact in doubles, whose rounding is finer than the step from one quotient to the next."""
    return np.divide(a, b).astype(np.int64)


def _decode(payloads: list[bytes], lengths: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    active = _active(lengths).tolist()
    lanes, steps = len(payloads), len(active)
    words = np.concatenate([np.frombuffer(b"".join(payloads), ">u2").astype(np.uint16), np.zeros(8, np.uint16)])
    place = np.cumsum([0] + [len(p) // 2 for p in payloads[:-1]]).astype(np.int64)
    code, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _WINDOW, np.int64)
    for _ in range(3):
        code = (code << _DIGIT) | words.take(place, mode="clip")
        place += 1
    model = _Model(lanes, vocabulary)
    by_step = np.zeros((steps, lanes), np.int32)
    for step, n in enumerate(active):
        if n != model.n:
            model.narrow(n)
            code, span = code[:n], span[:n]
        model.predict()
        unit = span >> _TOTAL_BITS
        value = _quotient(code, unit)
        np.minimum(value, (1 << _TOTAL_BITS) - 1, out=value)
        _, after2, after1, after0 = model.starts
        miss2, miss1, miss0 = value >= after2, value >= after1, value >= after0
        event = _events(miss2, miss1, miss0)
        start, size = model.span(event)
        value -= start
        nth = _quotient(value, size)
        np.minimum(nth, vocabulary - 1, out=nth)
        start += size * nth
        start *= unit
        code -= start
        np.multiply(unit, size, out=span)
        ids = by_step[step, :n]
        nth32 = nth.astype(np.int32)
        cached = model.cache.take(model.cache_base + (nth & (_CACHE - 1)), mode="clip")
        ids[:] = _either(miss1, _either(miss0, nth32, cached), _either(miss2, model.guess1, model.guess2))
        model.update(ids, event, model.cache_base + (ids & (_CACHE - 1)), model.guess2 != ids, model.guess1 != ids)
        small = np.flatnonzero(span < _LEAST_SPAN)
        while len(small):
            at = place.take(small)
            part = code.take(small)
            part <<= _DIGIT
            part |= words.take(at, mode="clip")
            code[small] = part
            at += 1
            place[small] = at
            part = span.take(small)
            part <<= _DIGIT
            span[small] = part
            small = small[part < _LEAST_SPAN]
    by_lane = _turned(by_step)
    return [by_lane[i, : lengths[i]] for i in range(lanes)]


def checksum(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
