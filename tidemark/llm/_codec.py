"""Context-mixing range coder for token ids, many independent blocks in step.

A segment holds ids cut into blocks of BLOCK.  Each block starts from a fresh
model and has its own payload and checksum, so a block can be read alone.  Up to
LANES blocks are coded side by side, one id of each at a time: the recursion
runs along a block, the arrays across blocks, and memory has that bound whatever
the segment's length.

Model of one block.  Ids are numbered as they are met.  Order 2 and order 1
predict the id that followed the same two ids, or the same id, last time, with a
confidence that rises by hits and starts again by a miss.  Order 0 gives each id
met its count so far.  An id not met yet costs its share of a fixed distribution
that falls with the id, as merges come in order of frequency.  An id is thus one of
four events (order-2 hit, order-1 hit, met, new); how often each came is counted
by the confidences of both predictions and whether they agree.  Both kinds of counts
are read anew at growing distances (_RENEW at most), events as shares of 4096; ids
met since then count once.

What happened between two readings changes no probability, so the encoder finds
predictions, events and shares of many steps at once, the predictions by sorting a
block's places by context; only the intervals go step by step.  The decoder keeps
one table for the predictions.

Segment: MAGIC, version, flags, blocks, ids (little-endian 32-bit words), then
for each block payload words, crc32 of the payload, crc32 of the ids; then the
payloads.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC, VERSION = 0x4B4D4454, 4
#: Ids in a block, and blocks coded side by side.
_PLACE = 12
BLOCK, LANES = 1 << _PLACE, 1 << 11
U = np.uint64
_H2 = 11  # bits of an order-2 context
_MIX = 0x9E3779B1
_F13, _F16, _LOW = U(0x1FFF), U(0xFFFF), U(0xFFFFFFFF)
_4, _12, _16, _31, _32 = U(4), U(12), U(16), U(31), U(32)
#: Contexts of the events (two confidences of 2 bits, agreement), and what their counts begin with and rise by.
_STATES, _FRESH, _STEP = 32, np.array([2, 2, 8, 4], np.uint32), 6
#: Greatest distance between two readings of the counts; steps that are prepared at once.
_RENEW, _AHEAD = 128, 16
#: Count of an id met since the last reading.
_LATE = 2
_IDS = np.arange(1 << 16, dtype=np.int64)
_FALL = np.concatenate([[0], np.cumsum(1 + (1 << 15) // (_IDS + 700))]).astype(U)  # below 2**18 in all
_FALLEN = np.repeat(_IDS, np.diff(_FALL.astype(np.int64))).astype(np.uint16)  # id by place among these
#: An interval begins below _WHOLE and is no wider; 32 bits go out when it is narrower than _NARROW.
_WHOLE, _NARROW, _REST = U(1 << 63), U(1 << 31), U((1 << 31) - 1)
#: Blocks whose tables are turned over at once; twice as many are counted.
_STRIP = 32


class _Model:
    """Counts of some blocks, numbers from 1: entry j of lane l lies at j * lanes + l, so what all lanes use often (early numbers, common contexts) lies together."""

    def __init__(self, lanes: int, steps: int, x: np.ndarray, mark: np.ndarray, inverse: bool):
        self.every, self.lanes, self.inverse = np.arange(lanes), lanes, inverse
        self.lane = self.every  # those that go on
        self.x, self.mark = x, mark  # numbers and 4 * state + event of the steps so far
        self.met = np.zeros(lanes, np.int64)
        self.steps = self.summed = 0
        self.counts = np.zeros((steps + 2) * lanes, np.uint32)  # rows of numbers not met are never touched
        self.events = np.tile(np.repeat(_FRESH, lanes), _STATES)
        self.share = np.empty((steps + 2 + _RENEW) * lanes, np.uint32)
        self.renew()

    def keep(self, m: int) -> None:
        """Only the first m lanes go on."""
        self.lane = self.lane[:m]

    def renew(self) -> None:
        """Reads the counts.  Of each state, where its events end (``word``, 16 bits each, of 4096).  Of all numbers met, and those to come, the sum of counts before and the own count (``share``, 13 bits); with ``inverse``, numbers by place."""
        lanes, n, new = self.lanes, int(self.met.max()) + 1, slice(self.summed, self.steps)
        self.summed = self.steps
        np.add.at(self.counts, (self.x[new] * np.int64(lanes) + self.every).reshape(-1), np.uint32(1))
        np.add.at(self.events, (self.mark[new] * np.int64(lanes) + self.every).reshape(-1), np.uint32(_STEP))
        counts, before = self.counts[: n * lanes].reshape(n, lanes), np.zeros((n + 1, lanes), np.uint32)
        for own, row, to in zip(counts, before, before[1:]):  # by rows: a sum down the columns would leave the caches
            np.add(row, own, out=to)
        np.add(before[:-1] << np.uint32(13), counts, out=self.share[: n * lanes].reshape(n, lanes))
        if self.inverse:  # a number begins where the sum before it says, as all met have a count
            places = np.zeros((self.summed + _LATE * _RENEW, lanes), np.uint16)
            self.by_place = places.reshape(-1)
            self.by_place[(before[1:] * np.int64(lanes) + self.every).reshape(-1)] = 1
            for row, to in zip(places, places[1 : self.summed]):
                np.add(row, to, out=to)
            # those met since come last
            np.add(self.met.astype(np.uint16), np.repeat(np.arange(1, 1 + _RENEW, dtype=np.uint16), _LATE)[:, None], out=places[self.summed :])
        own = self.events.reshape(_STATES, 4, lanes)
        own = (own * (4092 / own.sum(axis=1, keepdims=True))).astype(U) + U(1)
        second = own[:, 0] + own[:, 1]
        self.word = (own[:, 0] | second << _16 | (U(4096) - own[:, 3]) << _32 | U(4096 << 48)).reshape(-1)
        self.known = self.met.copy()
        self.next = self.steps + min(_RENEW, max(8, self.steps))


def _followers(context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each place in rows of numbers: 4 * the number that came last time in this context + confidence (1 to 3), 0 where there was none."""
    m, n = x.shape
    key = np.sort((context << np.uint32(_PLACE)) + np.arange(n, dtype=np.uint32), axis=1)
    flat = (key & np.uint32((1 << _PLACE) - 1)) + np.arange(0, m * n, n, dtype=np.uint32)[:, None]
    flat = flat.reshape(-1).astype(np.int64)
    key >>= np.uint32(_PLACE)
    own = x.reshape(-1).take(flat).reshape(m, n)
    last = np.zeros((m, n), np.uint16)
    np.multiply(own[:, :-1], key[:, 1:] == key[:, :-1], out=last[:, 1:])
    hit = (last == own).view(np.uint8)
    k = (last > 0).view(np.uint8)
    k[:, 1:] += hit[:, :-1] & k[:, 1:]
    k[:, 2:] += hit[:, 1:-1] & hit[:, :-2] & (k[:, 2:] > 1)
    last <<= np.uint16(2)
    last += k
    out = np.empty(m * n, np.uint16)
    out[flat] = last.reshape(-1)
    return out.reshape(m, n)


def _marked(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Of rows of numbers, with those met first: 4 * state + event."""
    q = x.astype(np.uint32)
    before = np.zeros_like(q)
    before[:, 1:] = q[:, :-1]
    q *= np.uint32(_MIX)
    both = np.zeros_like(q)
    both[:, 1:] = q[:, :-1] >> np.uint32(7)
    both[:, 2:] ^= q[:, :-2] >> np.uint32(13)
    one, two = _followers(before, x), _followers(both & np.uint32((1 << _H2) - 1), x)
    p1, p2 = one >> np.uint16(2), two >> np.uint16(2)
    event = np.uint8(2) - (p1 == x).view(np.uint8)
    event *= (p2 != x).view(np.uint8)
    event += fresh.view(np.uint8)
    state = (two & np.uint16(3)) << np.uint16(2) | one & np.uint16(3)
    return state.astype(np.uint8) << np.uint8(2) | (p1 == p2).view(np.uint8) << np.uint8(6) | event


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of ids, one column a row: numbers in order of first meeting (from 1), how many were met before, 4 * state + event; then the ids by row and number, and their count in each row."""
    lanes, n = ids.shape
    numbers, before, marks, names, many = np.empty((n, lanes), np.uint16), np.empty((n, lanes), np.uint16), np.empty((n, lanes), np.uint8), [], []
    for at in range(0, lanes, _STRIP):
        kind = np.uint32 if ids.dtype == np.uint16 else U  # 16 bits, or 32, and the place in the block
        own = ids[at : at + _STRIP].astype(kind)
        m = len(own)
        key = np.sort((own << kind(_PLACE)) + np.arange(n, dtype=kind), axis=1)
        place, kind = (key & kind((1 << _PLACE) - 1)).astype(np.int64), key >> kind(_PLACE)
        first = np.ones(key.shape, bool)
        first[:, 1:] = kind[:, 1:] != kind[:, :-1]
        flat = (place + np.arange(m)[:, None] * n).reshape(-1)
        starts = np.flatnonzero(first)
        fresh = np.zeros(m * n, bool)
        fresh[flat[starts]] = True
        count = np.cumsum(fresh.reshape(m, n), axis=1, dtype=np.uint16).reshape(-1)
        size = np.diff(np.append(starts, m * n))
        out = np.empty(m * n, np.uint16)
        out[flat] = np.repeat(count[flat[starts]], size)
        out = out.reshape(m, n)
        numbers[:, at : at + m] = out.T
        before[:, at : at + m] = (count - fresh).reshape(m, n).T
        marks[:, at : at + m] = _marked(out, fresh.reshape(m, n)).T
        names.append(ids[at : at + m].reshape(-1)[fresh])
        many.append(count[n - 1 :: n].astype(np.int64))
    return numbers, before, marks, np.concatenate(names), np.concatenate(many)


def _carried(words: np.ndarray) -> np.ndarray:
    """Words of 32 bits whose carries (bit 32) have gone into the word before; a lane's first word has none."""
    j = (words > _LOW).nonzero()[0]
    while len(j):
        words[j] &= _LOW
        j = j - 1
        words[j] += U(1)
        j = j[words[j] > _LOW]
    return words


def _encode_group(ids: np.ndarray, wide: bool) -> list[bytes]:
    """Payloads of the blocks of ids."""
    n = len(ids)
    lanes = -(-n // BLOCK)
    steps, rest = (BLOCK if lanes > 1 else n), n - (lanes - 1) * BLOCK  # rest: ids in the last block
    rows = np.zeros(lanes * steps, ids.dtype)
    rows[:n] = ids
    grid, before, marks, names, many = _numbered(rows.reshape(lanes, steps))
    begins = np.cumsum(many) - many - 1
    model = _Model(lanes, steps, grid, marks, False)
    low, span = np.zeros(lanes, U), np.full(lanes, _WHOLE)
    owners, words = [], []  # what goes out: lanes, and words of 32 bits with a carry until the end

    def push(of, add: np.ndarray, size: np.ndarray) -> None:
        """Go on with the part of each interval that begins ``add`` further and has this size; ``of``: lanes."""
        more = low[of] + add
        out = (size < _NARROW).nonzero()[0]
        if len(out):
            at = out if isinstance(of, slice) else of[out]
            own = more.take(out)
            owners.append(at.astype(np.uint16))
            words.append(own >> _31)
            more[out] = (own & _REST) << _32
            size[out] <<= _32
        low[of], span[of] = more, size

    def shares(i: int, to: int) -> tuple[np.ndarray, ...]:
        """Of some steps: where the event begins, and its share; where the id begins in it, its share, and all these; where ids are new (flat), and these."""
        x, m = grid[i:to, : len(model.lane)], len(model.lane)
        mark, known = marks[i:to, :m], model.known[:m]
        shift = (mark & np.uint8(3)).astype(U) << _4
        word = model.word.take((mark >> np.uint8(2)) * np.int64(lanes) + model.lane)
        start = word << _16 >> shift & _F16
        own = (word >> shift & _F16) - start
        all_ = (model.summed - _LATE * known).astype(np.int32) + np.int32(_LATE) * before[i:to, :m]
        late = x > known.astype(np.uint16)
        share = model.share.take(x * np.int64(lanes) + model.lane)
        share = np.where(late, (np.int32(_LATE) * x + (model.summed - _LATE * (known + 1)).astype(np.int32) << 13) + _LATE, share)
        simple = shift < U(32)  # a hit, or where the id follows by itself
        new = (shift == U(48)).reshape(-1).nonzero()[0]
        if wide:
            simple |= shift == U(48)
        share[simple], all_[simple] = 1, 1
        first, part, all_ = (share >> 13).astype(U), share.astype(U) & _F13, all_.astype(U)
        y = names.take(begins.take(new % m) + x.reshape(-1).take(new)).astype(np.int64)
        if not wide:
            low_y = _FALL.take(y)
            first.reshape(-1)[new], part.reshape(-1)[new], all_.reshape(-1)[new] = low_y, _FALL.take(y + 1) - low_y, _FALL[-1]
        return start, own, first, part, all_, new, y

    i = 0
    while i < steps:
        if i == rest and lanes > 1:
            model.keep(lanes - 1)
        m = len(model.lane)
        to = min(i + _AHEAD, model.next, steps, rest if i < rest else steps)
        *each, new, y = shares(i, to)
        at = np.searchsorted(new, np.arange(to - i + 1) * m)
        for j, (start, own, first, part, all_) in enumerate(zip(*each)):
            r = span[:m] >> _12
            own *= r
            start *= r
            r = own // all_
            first *= r
            first += start
            part *= r
            push(slice(0, m), first, part)
            if wide and at[j] < at[j + 1]:
                some, own = new[at[j] : at[j + 1]] - j * m, y[at[j] : at[j + 1]]
                for half in (own >> 16, own & 0xFFFF):
                    r = span[some] >> _16
                    push(some, r * half.astype(U), r)
        i = model.steps = to
        if i == model.next:
            model.met = before[i - 1].astype(np.int64) + (marks[i - 1] & 3 == 3)
            model.renew()
    for last in (low >> _31, (low & _REST) << U(1)):
        owners.append(np.arange(lanes, dtype=np.uint16))
        words.append(last)
    owner = np.concatenate(owners)
    own = np.concatenate(words)[np.argsort(owner, kind="stable")]
    own, ends = _carried(own).astype("<u4"), np.cumsum(np.bincount(owner, minlength=lanes))
    return [x.tobytes() for x in np.split(own, ends[:-1])]


def encode(ids: np.ndarray, wide: bool = False) -> bytes:
    """A segment with these ids (below 65536 unless wide)."""
    ids = ids.astype(np.uint32 if wide else np.uint16, copy=False)
    payloads: list[bytes] = []
    for at in range(0, len(ids), BLOCK * LANES):
        payloads += _encode_group(ids[at : at + BLOCK * LANES], wide)
    head = np.zeros((len(payloads), 3), "<u4")
    for k, p in enumerate(payloads):
        head[k] = len(p) // 4, zlib.crc32(p), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes())
    return np.array([MAGIC, VERSION, int(wide), len(payloads), len(ids)], "<u4").tobytes() + head.tobytes() + b"".join(payloads)


def _decode_group(payloads: list[bytes], n: int, wide: bool) -> np.ndarray:
    """The n ids of some blocks."""
    lanes = len(payloads)
    steps, rest = (BLOCK if lanes > 1 else n), n - (lanes - 1) * BLOCK
    used = np.array([len(p) // 4 for p in payloads])
    words = np.frombuffer(b"".join([*payloads, bytes(8)]), "<u4").astype(U)
    begun = np.cumsum(used) - used
    code = words[begun] << _31 | words[begun + 1] >> U(1)
    words[:-1] = (words[:-1] & U(1)) << _31 | words[1:] >> U(1)  # an interval has 63 bits
    at = begun + 1
    grid, marks = np.zeros((steps, lanes), np.uint16), np.zeros((steps, lanes), np.uint8)
    model = _Model(lanes, steps, grid, marks, True)
    span = np.full(lanes, _WHOLE)
    owners, names = [], []  # ids met first: lanes, and ids
    # 4 * number + confidence, 0: none; order 1 by number, then order 2 by hash
    table = np.zeros(lanes * (steps + 2 + (1 << _H2)), np.uint16)

    def pull(of, c: np.ndarray, size: np.ndarray) -> None:
        """Go on in intervals of this size, with ``c`` the code's distance from their beginning; ``of``: lanes."""
        out = (size < _NARROW).nonzero()[0]
        if len(out):
            j = out if isinstance(of, slice) else of[out]
            c[out] = (c[out] << _32) | words.take(at[j], mode="clip")
            at[j] += 1
            size[out] <<= _32
        code[of], span[of] = c, size

    for i in range(steps):
        if i == rest and lanes > 1:
            model.keep(lanes - 1)
        if i == 0 or i == rest:  # the lanes that go on
            m, lane, met_ = len(model.lane), model.lane, model.met[: len(model.lane)]
            b2, where, q, h = lane + lanes * (steps + 2), np.empty((2, m), np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            where[0] = lane
            if i:
                where[0] += grid[i - 1, :m] * np.int64(lanes)
                q = grid[i - 1, :m] * np.int64(_MIX)
                h = grid[i - 2, :m] * np.int64(_MIX) >> 13 if i > 1 else h
        if model.summed == i or i == rest:
            total = (model.summed + _LATE * (met_ - model.known[:m])).astype(U)
        slot = q >> 7
        slot ^= h
        slot &= (1 << _H2) - 1
        slot *= lanes
        np.add(slot, b2, out=where[1])
        e = table.take(where)
        p, k = e >> np.uint16(2), e & np.uint16(3)
        state = k[1] << np.uint16(2)
        state |= k[0]
        state |= (p[0] == p[1]).astype(np.uint16) << np.uint16(4)
        word = model.word.take(state * np.int64(lanes) + lane)
        c, r = code[:m], span[:m] >> _12
        event = (c >= r * (word & _F16)).view(np.int8) + (c >= r * (word >> _16 & _F16)).view(np.int8)
        event += (c >= r * (word >> _32 & _F16)).view(np.int8)
        shift = event.astype(U) << _4
        start = word << _16 >> shift & _F16
        size = word >> shift & _F16
        size -= start
        size *= r
        start *= r
        c = c - start
        x = p[0] ^ ((p[0] ^ p[1]) & -(event == 0).astype(np.uint16))
        met = (event == 2).nonzero()[0]
        if len(met):
            own, all_ = c.take(met), total.take(met)
            r = size.take(met) // all_
            t = own // r
            np.minimum(t, all_ - U(1), out=t)
            t *= U(lanes)
            number = model.by_place.take(t.view(np.int64) + met)
            x[met] = number
            share = model.share.take(number * np.int64(lanes) + met).astype(U)
            c[met] = own - r * (share >> U(13))
            size[met] = r * (share & _F13)
        some = (event == 3).nonzero()[0]
        if len(some):
            new = met_[some]
            x[some] = new + 1
            model.share[(new + 1) * lanes + some] = (model.summed + _LATE * (new - model.known[some]) << 13) + _LATE
            met_[some] = new + 1
            total[some] += U(_LATE)
            if not wide:
                r = size[some] // _FALL[-1]
                own = c[some]
                y = _FALLEN.take(np.minimum(own // r, _FALL[-1] - U(1)).view(np.int64)).astype(np.int64)
                low_y = _FALL.take(y)
                c[some] = own - r * low_y
                size[some] = r * (_FALL.take(y + 1) - low_y)
        pull(slice(0, m), c, size)
        if len(some):
            if wide:
                y = U(0)
                for _ in range(2):
                    r = span[some] >> _16
                    half = np.minimum(code[some] // r, _F16)
                    pull(some, code[some] - r * half, r)
                    y = y << _16 | half
            owners.append(some.astype(np.uint16))
            names.append(y.astype(np.uint32))
        grid[i, :m] = x
        np.add(state.astype(np.uint8) << np.uint8(2), event.view(np.uint8), out=marks[i, :m])
        np.minimum(k, np.uint16(2), out=k)
        k &= -(p == x).astype(np.uint16)
        k += np.uint16(1)
        k += x << np.uint16(2)
        table[where] = k
        h = q >> 13
        x = x.astype(np.int64)
        q = x * _MIX
        np.add(x * lanes, lane, out=where[0])
        model.steps = i + 1
        if model.steps == model.next:
            model.renew()
    owner = np.concatenate(owners)
    names = np.concatenate(names)[np.argsort(owner, kind="stable")]
    begins = np.cumsum(model.met) - model.met - 1
    out = np.empty((lanes, steps), np.uint32)
    for lo in range(0, lanes, _STRIP):
        names.take(grid[:, lo : lo + _STRIP].T + begins[lo : lo + _STRIP, None], out=out[lo : lo + _STRIP], mode="clip")
    return out.reshape(-1)[:n]


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; ValueError where a checksum does not fit."""
    magic, version, wide, blocks, n = np.frombuffer(segment, "<u4", 5).tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of token ids")
    head = np.frombuffer(segment, "<u4", 3 * blocks, 20).reshape(blocks, 3)
    ends = 20 + 12 * blocks + 4 * np.cumsum(head[:, 0].astype(np.int64))
    out = np.empty(n, np.uint32)
    for lo in range(0, blocks, LANES):
        payloads = [segment[ends[k] - 4 * int(head[k, 0]) : ends[k]] for k in range(lo, min(blocks, lo + LANES))]
        for k, p in enumerate(payloads, lo):
            if zlib.crc32(p) != head[k, 1]:
                raise ValueError(f"block {k}: payload checksum")
        own = out[lo * BLOCK : (lo + LANES) * BLOCK]
        own[:] = _decode_group(payloads, len(own), bool(wide))
    for k in range(blocks):
        if zlib.crc32(out[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != head[k, 2]:
            raise ValueError(f"block {k}: id checksum")
    return out
