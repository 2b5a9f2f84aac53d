"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checked one by one.

Three orders predict an id. Order 2 names one id, the last that followed the two ids before, with a
confidence (how often it has followed without fail). Order 1 gives each id that has followed the id
before its share of those counts, order 0 each id of the block so far its share of all. An id that none
of them knows is written as it is. The orders are mixed by weights: in each class of confidence (order
2's, and how often order 1's context has been seen) they are the shares of the ids that the orders
were the first to know, highest order first, with the shares of like classes as a prior. Weight and prediction give the interval that is coded.

The model learns in rounds: what it knows is counted anew whenever the block has doubled. Between
rounds it stands still, so an id's interval does not wait for the ids beside it, and a round is parted into lanes
that are coded in step, each array with one entry a lane. A lane begins without context. All
arithmetic is on whole numbers, so files read alike everywhere.

Layout of the result (little-endian): ``TWID``, version, block length, ids, blocks; per block its ids, its lanes, the bits
of an unknown id, the length of its code in 16-bit units and the crc32 of its ids; then for each block the units of every lane and the lanes' units.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TWID", 2
BLOCK_IDS = 1 << 21
#: Ids of the first round; lanes at most, and the ids that a lane has at least before there are more.
FIRST, LANES, LANE_IDS = 512, 2048, 64
_UNIT, _REST = 16, 46
_LEAST, _MASK = 1 << _REST, (1 << _REST) - 1
_WEIGHT_BITS, _PRIOR = 12, 16
_CONTEXTS, _PLACES = 1 << 17, 1 << 18
#: Bits of ids up to which a block counts them in a table of all.
_DENSE_BITS = 20
_SURE = 15
#: Order 2 is asked in a class only where at least one in this many of its predictions came true.
_WORTH = 8


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1]


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole quotients of numbers that are not negative; without signs they take two thirds of the time."""
    return (a.view(np.uint64) // b.view(np.uint64)).view(np.int64)


def _places(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return ((last * 0x9E3779B1 + before * 0x85EBCA77) >> 7) & (_PLACES - 1)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(ordered)))


def _ranks(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of up to ``bits`` bits in order, and each key's place among them."""
    room = len(keys).bit_length()
    if bits + room < 64:  # each with its number in its low bits
        packed = keys << room
        packed |= np.arange(len(keys))
        packed.sort()
        ordered, number = packed >> room, packed & ((1 << room) - 1)
    else:
        number = np.argsort(keys)
        ordered = keys[number]
    begin, count = _runs(ordered)
    rank = np.empty(len(keys), np.int32)
    rank[number] = np.repeat(np.arange(len(begin), dtype=np.int32), count)
    return ordered[begin], rank


def _add(counts: np.ndarray, at: np.ndarray) -> None:
    if len(at) < len(counts) >> 3:
        np.add.at(counts, at, 1)
    else:
        counts += np.bincount(at, minlength=len(counts)).astype(counts.dtype)


class _Model:
    """What a block's ids so far say of the next ones, but for the counts of orders 1 and 0. Kinds: 0 to 2 for orders 2 to 0, 3 for none.

    What is asked for together stands in one number, as tables are read in no order: ``two`` holds a guess and its confidence (4 bits),
    ``after`` a context's first slot, its ids so far (26 bits) and its class (4 bits).
    """

    def __init__(self, bits: int):
        self.bits, self.known = bits, 0
        self.two = np.zeros(_PLACES, np.int32 if bits < 27 else np.int64)
        self.followed, self.after = np.zeros(_CONTEXTS, np.int32), np.zeros(_CONTEXTS, np.int64)
        self.worth = np.zeros((16, 16, 4), np.int64)  # by confidence and order-1 class: ids by the order that knew them
        self._weigh()

    def _follow(self, at: np.ndarray, now: np.ndarray) -> None:
        """Order 2: of equal places the last id stays."""
        touched, place = (slice(None), at) if len(at) > _PLACES >> 3 else np.unique(at, return_inverse=True)
        old = self.two[touched].copy()
        self.two[at] = now << 4
        new = self.two[touched] >> 4
        seen = np.bincount(place, minlength=len(old))
        wrong = np.bincount(place[self.two.take(at) >> 4 != now], minlength=len(old))
        conf = np.where(wrong > 0, 1, np.minimum(np.where(old >> 4 == new, old & 15, 0) + seen, _SURE))
        self.two[touched] = np.where(seen > 0, new << 4 | conf, old)

    def learn(self, ids: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """A round's end: its ids, and the ones before each."""
        self.known += len(ids)
        self._follow(_places(last, before), ids)
        _add(self.followed, last & (_CONTEXTS - 1))
        self.after = self.followed.cumsum()
        self.after -= self.followed
        self.after <<= 26
        self.after |= self.followed
        self.after <<= 4
        self.after |= np.minimum(_bit_length(self.followed), 15)
        self._weigh()

    def _weigh(self) -> None:
        # The prior: order 2's worth at this confidence in any context, and what the others share at this order-1 class or the one below.
        sure = self.worth.sum(axis=1)
        sure = ((sure[:, 0] * 8 + 1) << 10) // (sure.sum(axis=1) * 8 + 4)
        rest = self.worth.sum(axis=0)[:, 1:]
        rest = rest * 4 + np.roll(rest, 1, axis=0) + 1
        prior = np.empty_like(self.worth)
        prior[:, :, 0] = sure[:, None] + 1
        prior[:, :, 1:] = ((1 << 10) - sure)[:, None, None] * rest // rest.sum(axis=1, keepdims=True) + 1
        mixed = self.worth * (1024 // _PRIOR) + prior
        own = self.worth.sum(axis=2)
        mixed[:, :, 0] = np.where(self.worth[:, :, 0] * _WORTH >= own, mixed[:, :, 0], 0)
        mixed[0, :, 0] = 0  # no guess
        mixed[:, 0, 1] = 0  # no successors
        if not self.known:
            mixed[:, :, :3] = 0
        room = (1 << _WEIGHT_BITS) - 4
        scaled = np.where(mixed > 0, 1 + mixed * room // mixed.sum(axis=2, keepdims=True), 0)
        scaled[:, :, 3] += (1 << _WEIGHT_BITS) - scaled.sum(axis=2)
        start = scaled.cumsum(axis=2) - scaled
        self.asks, self.bounds = scaled[:, :, 0].ravel() > 0, [np.ascontiguousarray(start[:, :, k]).ravel() for k in (1, 2, 3)]
        self.share, self.share_start = scaled.ravel(), start.ravel()

    def look(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is known of order 1's context, order 2's guess and the class of confidence."""
        two, after = self.two.take(_places(last, before)), self.after.take(last & (_CONTEXTS - 1))
        classes = (two & 15) << 4
        return after, two >> 4, classes | (after & 15)

    def count(self, own: np.ndarray, right: np.ndarray) -> None:
        """``own``: the class of an id, and in the two lowest bits the order below 2 that knew it first; ``right``: where order 2 did."""
        self.worth += np.bincount(np.where(right, own & ~3, own), minlength=1024).reshape(16, 16, 4)


class _Slots:
    """The counts of orders 1 and 0 as the reader asks for them: a slot for each id so far by context and id, then by id, then one for what needs none.

    A slot tells where its id's slots begin, counted from the first of the context's, or order 0's, their number, and the id.
    """

    def __init__(self, ids: np.ndarray, bits: int):
        n = len(ids)
        pairs = np.concatenate([[0], ids[:-1]])[:n] & (_CONTEXTS - 1)
        contexts = np.bincount(pairs, minlength=_CONTEXTS)
        pairs <<= bits
        pairs |= ids
        pairs.sort()
        begin, count = _runs(pairs)
        pairs = pairs[begin]
        begin -= (contexts.cumsum() - contexts).take(pairs >> bits)
        if bits <= _DENSE_BITS:
            times = np.bincount(ids)
            single = np.flatnonzero(times)
            count0 = times[single]
            begin0 = count0.cumsum() - count0
        else:
            single = np.sort(ids)
            begin0, count0 = _runs(single)
            single = single[begin0]
        start, count = np.concatenate([begin, begin0, [0]]), np.concatenate([count, count0, [1]])
        each = np.concatenate([pairs & ((1 << bits) - 1), single, [0]])
        self.wide = bits > _DENSE_BITS or n > BLOCK_IDS
        self.room = 31 if self.wide else 22
        span = start << self.room | count
        self.ids = np.repeat(each, count) if self.wide else None
        self.spans = np.repeat(span if self.wide else span << _DENSE_BITS | each, count)
        # By kind, as ``after``: the first slot, and how many.
        self.of_kind = np.array([2 * n << 26 | 1, 0, n << 26 | max(n, 1), 1 << min(bits, 16)], np.int64)
        self.none = 2 * n

    def read(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, count and id."""
        span = self.spans.take(slots)
        if self.wide:
            ids = self.ids.take(slots)
        else:
            ids = span & ((1 << _DENSE_BITS) - 1)
            span >>= _DENSE_BITS
        return span >> self.room, span & ((1 << self.room) - 1), ids


class _Counts:
    """The same as the writer asks for them, who knows which pairs and ids the block will have."""

    def __init__(self, ids: np.ndarray, last: np.ndarray, bits: int):
        self.bits = bits
        self.keys, self.pair = _ranks((last & (_CONTEXTS - 1)) << bits | ids, bits + 17)
        self.single, n = (ids, 1 << bits) if bits <= _DENSE_BITS else (lambda keys, rank: (rank, len(keys)))(*_ranks(ids, bits))
        self.pairs, self.singles = np.zeros(len(self.keys) + 1, np.int32), np.zeros(n, np.int32)  # the last pair never comes

    def learn(self, begin: int, end: int) -> None:
        _add(self.pairs, self.pair[begin:end])
        _add(self.singles, self.single[begin:end])

    def intervals(self, model: _Model, ids: np.ndarray, last: np.ndarray, before: np.ndarray, begin: int, heads: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per id of a round the place of its order's weight, the order's total, and the id's start and count in it, and where no order knows it; what the ids say is counted. ``heads``: ids without context."""
        after, guess, classes = model.look(last, before)
        pair, single = self.pair[begin : begin + len(ids)].copy(), self.single[begin : begin + len(ids)]
        wanted = ids[heads]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        pair[heads] = np.where(self.keys[at] == wanted, at, len(self.keys))
        count, count0 = self.pairs.take(pair), self.singles.take(single)
        first, plain = count > 0, count0 == 0
        own = classes << 2
        own += np.where(plain, np.int8(3), np.int8(2))
        own[first] &= ~2  # the first order that knows an id: a pair's id is a single, too
        own[first] |= 1
        right = (classes >= 16) & (guess == ids)
        model.count(own, right)
        right &= model.asks.take(classes)
        start = self.pairs.cumsum(dtype=np.int32)
        start -= self.pairs
        start = start.take(pair) - (after >> 30)
        start0 = self.singles.cumsum(dtype=np.int32)
        start0 -= self.singles
        np.copyto(start, start0.take(single), where=~first)
        total = np.where(first, (after >> 4) & ((1 << 26) - 1), max(model.known, 1))
        np.copyto(count, count0, where=~first)
        plain &= ~right
        if plain.any():
            total[plain], count[plain], start[plain] = 1 << min(self.bits, 16), 1, ids[plain] >> max(self.bits - 16, 0)
        np.copyto(own, own & ~3, where=right)
        for values, sure in ((total, 1), (count, 1), (start, 0)):
            np.copyto(values, sure, where=right)
        return own, total, start.astype(np.int32), count, plain


def _rounds(n: int):
    """(begin, end, steps, lanes) of a block's rounds; every lane has ``steps`` ids, the last one the rest."""
    begin, end = 0, min(FIRST, n)
    while begin < n:
        steps = -(-(end - begin) // min(LANES, max(1, (end - begin) // LANE_IDS)))
        yield begin, end, steps, -(-(end - begin) // steps)
        begin, end = end, min(2 * end, n)


def _grid(values: np.ndarray, steps: int, lanes: int, fill: int) -> np.ndarray:
    """A round's values by step and lane."""
    short = steps * lanes - len(values)
    if short:
        values = np.concatenate([values, np.full(short, fill, values.dtype)])
    return np.ascontiguousarray(values.reshape(lanes, steps).T)


class _Writer:
    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << (_REST + _UNIT), np.int64)
        self.most, self.units = most, np.zeros(lanes * most, np.int32)
        self.at = np.arange(lanes) * most

    def _renew(self, lanes: np.ndarray) -> None:
        while len(lanes):
            low = self.low[lanes]
            self.units[self.at[lanes]] = low >> _REST
            self.at[lanes] += 1
            self.low[lanes] = (low & _MASK) << _UNIT
            wide = self.range[lanes] << _UNIT
            self.range[lanes] = wide
            lanes = lanes[wide < _LEAST]

    def put(self, n: int, weight_start, weight, total, start, count) -> None:
        part = self.range[:n] >> _WEIGHT_BITS
        low = self.low[:n]
        low += part * weight_start
        part *= weight
        part = _divided(part, total)
        low += part * start
        part *= count
        self.range[:n] = part
        self._renew(np.flatnonzero(part < _LEAST))

    def put_bits(self, lanes: np.ndarray, value: np.ndarray, bits: int) -> None:
        part = self.range[lanes] >> bits
        self.low[lanes] += part * value
        self.range[lanes] = part
        self._renew(lanes[part < _LEAST])

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Units of each lane, and all lanes' units; the two last ones name a part of the interval, whatever follows them."""
        half = _REST - _UNIT
        value = (self.low + (1 << half) - 1) >> half
        self.units[self.at], self.units[self.at + 1] = value >> _UNIT, value & 0xFFFF
        used = self.at + 2 - np.arange(len(self.at)) * self.most
        rows = self.units.reshape(len(used), self.most)
        for k in range(int(used.max()) - 1, 0, -1):  # carries
            rows[:, k - 1] += rows[:, k] >> _UNIT
        inside = np.arange(self.most) < used[:, None]
        return used, (rows[inside] & 0xFFFF).astype("<u2")


def _encode_block(ids: np.ndarray, bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    n, rounds = len(ids), list(_rounds(len(ids)))
    lanes = max(r[3] for r in rounds)
    last, before = np.concatenate([[0], ids[:-1]]), np.concatenate([[0, 0], ids[:-2]])[:n]
    model, counts, out = _Model(bits), _Counts(ids, last, bits), _Writer(lanes, 3 * sum(r[2] for r in rounds) + 4)
    for begin, end, steps, used in rounds:
        a, b = last[begin:end].copy(), before[begin:end].copy()
        a[::steps] = b[::steps] = b[1::steps] = 0  # a lane begins without context
        *found, plain = counts.intervals(model, ids[begin:end], a, b, begin, np.arange(0, end - begin, steps))
        grids = [_grid(x, steps, used, fill) for x, fill in zip(found, (0, 1, 0, 1), strict=True)]
        short = used * steps - (end - begin)  # steps that the last lane does not have
        low_bits = max(bits - 16, 0)
        raw = _grid(np.where(plain, ids[begin:end] & ((1 << low_bits) - 1), -1), steps, used, -1) if low_bits and plain.any() else None
        for step in range(steps):
            m = used - 1 if step >= steps - short else used
            own, *rest = (g[step, :m] for g in grids)
            out.put(m, model.share_start.take(own), model.share.take(own), *rest)
            if raw is not None and len(at := np.flatnonzero(raw[step, :m] >= 0)):
                out.put_bits(at, raw[step, at], low_bits)
        if end < n:
            counts.learn(begin, end)
            model.learn(ids[begin:end], last[begin:end], before[begin:end])
    return lanes, *out.done()


class _Reader:
    def __init__(self, used: np.ndarray, units: np.ndarray):
        stream = np.concatenate([units, np.zeros(8, "<u2")]).astype(np.int64)
        begin = used.cumsum() - used
        self.code = (stream[begin] << _REST) | (stream[begin + 1] << 30) | (stream[begin + 2] << 14) | (stream[begin + 3] >> 2)
        self.stream = ((stream[:-1] & 3) << 14) | (stream[1:] >> 2)
        self.at, self.range = begin + 3, np.full(len(used), 1 << (_REST + _UNIT), np.int64)

    def renew(self, lanes: np.ndarray) -> None:
        last = len(self.stream) - 1
        while len(lanes):
            at = self.at[lanes]
            self.code[lanes] = (self.code[lanes] << _UNIT) | self.stream.take(np.minimum(at, last))
            self.at[lanes] = at + 1
            wide = self.range[lanes] << _UNIT
            self.range[lanes] = wide
            lanes = lanes[wide < _LEAST]

    def bits(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        part = self.range[lanes] >> bits
        value = np.minimum(self.code[lanes] // part, (1 << bits) - 1)
        self.code[lanes] -= part * value
        self.range[lanes] = part
        self.renew(lanes[part < _LEAST])
        return value


def _decode_block(n: int, bits: int, used_units: np.ndarray, units: np.ndarray) -> np.ndarray:
    ids, model, source = np.empty(n, np.int64), _Model(bits), _Reader(used_units, units)
    low_bits = max(bits - 16, 0)
    for begin, end, steps, used in _rounds(n):
        slots = _Slots(ids[:begin], bits)
        found = np.zeros((steps, used), np.int64)
        owns, guesses = np.zeros((2, steps, used), np.int64) if end < n else (None, None)
        short = used * steps - (end - begin)
        a = b = np.zeros(used, np.int64)
        for step in range(steps):
            m = used - 1 if step >= steps - short else used
            if m < len(a):
                a, b = a[:m], b[:m]
            after, guess, own = model.look(a, b)
            part = source.range[:m] >> _WEIGHT_BITS
            code = source.code[:m]
            value = _divided(code, part)
            at = own << 2
            for bound in model.bounds:
                at += value >= bound.take(own)
            kind = at & 3
            code -= part * model.share_start.take(at)
            part *= model.share.take(at)
            room = slots.of_kind.take(kind)
            after >>= 4
            np.copyto(room, after, where=kind == 1)
            total = room & ((1 << 26) - 1)
            part = _divided(part, total)
            total -= 1
            value = np.minimum(_divided(code, part), total)
            room >>= 26
            room += value
            plain = np.flatnonzero(kind == 3)
            if len(plain):
                room[plain] = slots.none
            start, count, now = slots.read(room)
            np.copyto(now, guess, where=kind == 0)
            if len(plain):
                start[plain], now[plain] = value[plain], value[plain] << low_bits
            code -= part * start
            part *= count
            source.range[:m] = part
            source.renew(np.flatnonzero(part < _LEAST))
            if low_bits and len(plain):
                now[plain] |= source.bits(plain, low_bits)
            found[step, :m] = now
            if end < n:
                owns[step, :m], guesses[step, :m] = at, guess
            a, b = now, a
        flat = lambda x: x.T.ravel()[: end - begin]
        ids[begin:end] = flat(found)
        if end < n:
            own, guess, last = flat(owns), flat(guesses), np.append(0, ids[max(begin - 1, 0) : end - 1])[-(end - begin) :]
            model.count(own, (own >= 64) & (guess == ids[begin:end]))
            model.learn(ids[begin:end], last, np.concatenate([[0, 0], ids[max(begin - 2, 0) : end - 2]])[-(end - begin) :])
    return ids.astype("<u4")


def compress(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """Ids of up to 32 bits to the layout above."""
    ids = np.ascontiguousarray(ids, "<u4")
    heads, bodies = [], []
    for k in range(0, len(ids), block):
        own = ids[k : k + block]
        bits = max(1, int(own.max()).bit_length())
        lanes, used, units = _encode_block(own.astype(np.int64), bits)
        heads.append(struct.pack("<IIIII", len(own), lanes, bits, len(units), zlib.crc32(own.tobytes())))
        bodies += [used.astype("<u4").tobytes(), units.tobytes()]
    return b"".join([MAGIC, struct.pack("<IIQI", VERSION, block, len(ids), len(heads)), *heads, *bodies])


def expand(data: bytes) -> np.ndarray:
    """The ids; raises ValueError where a checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("these are no coded ids")
    version, _, n, count = struct.unpack_from("<IIQI", data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at, out = 24 + 20 * count, []
    for k in range(count):
        own, lanes, bits, length, crc = struct.unpack_from("<IIIII", data, 24 + 20 * k)
        used = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
        units = np.frombuffer(data, "<u2", length, at + 4 * lanes)
        at += 4 * lanes + 2 * length
        try:
            ids = _decode_block(own, bits, used, units)
        except (IndexError, ZeroDivisionError):
            ids = np.empty(0, "<u4")
        if zlib.crc32(ids.tobytes()) != crc or int(used.sum()) != length:
            raise ValueError(f"block {k} is damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.empty(0, "<u4")
