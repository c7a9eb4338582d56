"""Adaptive context-mixing range coder for token ids, in blocks that are coded side by side.

Each block starts from a fresh model, so it can be decoded without the others. Numpy runs one step of all blocks at a time ("lanes").

An id is told in one coding step of two parts. First, which prediction holds: the id last seen after the same two ids
(order 2), the id last seen after the same id (order 1), or neither. Each order has adaptive shares of these three
outcomes, orders 1 and 2 by their state; the shares are mixed with weights that follow how well each order has told the
outcomes before. All this learns at every id. An id that neither order predicts is told by its share of the ids of the
frame (order 0): the frame's first block begins with the table of these shares, which all its blocks use.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
LEAST_IDS = 256
LANES = 4096
MAGIC = b"TKM2"
FRAME, HEAD, TABLE = struct.Struct("<4sBI"), struct.Struct("<III"), struct.Struct("<I")

_ORDER2, _ORDER1 = 10, 9
_ID_BITS = 24
_ID_MASK = np.uint32((1 << _ID_BITS) - 1)
_ONE, _SURE = np.uint32(1 << _ID_BITS), np.uint32(3 << _ID_BITS)
_HASH2, _HASH1 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
_RATE, _KEEP = np.float32(0.04), np.float32(1 - 0.04)
_FADE, _FLOOR, _LEAST_FIT = np.float32(0.95), np.float32(0.05 / 3), np.float32(1e-6)
#: Ranges stay within 2**44 and 2**60, so one step can have shares of 2**36: 2**12 for the outcome, 2**24 for the id.
_LEAST, _TOP, _BITS = 1 << 44, 1 << 60, 36
_WHOLE, _SLOT, _FLAT = 1 << 24, 1 << 8, 1 << 16
#: What stands for the number of times an id is in a frame: eight values for each power of two, eighths of an id.
_WEIGHTS = np.array([m << k for k in range(28) for m in range(8, 16)], np.int64)


class _Shares:
    """Shares of 2**24 of the ids of a frame, by rank; the most frequent id is rank 0.

    ``classes`` holds for each id 0 if it is absent, else the place of its weight from 1. An id of a slot's share or more has
    whole slots; shares of rarer ones are powers of two, and ids in the same slot have equal shares.
    """

    def __init__(self, classes: np.ndarray):
        present = np.flatnonzero(classes)
        self.ids = present[np.argsort(255 - classes.take(present), kind="stable")].astype(np.uint32)
        if not self._lay(_WEIGHTS.take(classes.take(self.ids).astype(np.int64) - 1)):
            self._lay(np.ones(len(self.ids), np.int64))

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Shares, bytes]:
        """The shares and the bytes of the table they are read from; no bytes: few ids of two bytes, which all have the same share."""
        counts = np.zeros(int(ids.max()) + 1, np.int64)
        for first in range(0, len(ids), 1 << 20):
            some = np.bincount(ids[first : first + (1 << 20)])
            counts[: len(some)] += some
        classes = np.searchsorted(_WEIGHTS, 8 * counts, "right").astype(np.uint8)
        own, table = cls(classes), zlib.compress(classes.tobytes(), 6)
        bits = 8 * len(table) + (counts.take(own.ids) * np.log2(_WHOLE / own.sizes)).sum()
        if len(counts) <= _FLAT and bits > 16 * len(ids):
            own, table = cls(np.ones(_FLAT, np.uint8)), b""
        return own, table

    @classmethod
    def read(cls, table: bytes) -> _Shares:
        if not table:
            return cls(np.ones(_FLAT, np.uint8))
        try:
            classes = np.frombuffer(zlib.decompress(table), np.uint8)
        except zlib.error:
            raise ValueError("the table of shares is broken") from None
        if not len(classes) or not 0 < classes.max() <= len(_WEIGHTS):
            raise ValueError("the table of shares is broken")
        return cls(classes)

    def _lay(self, weights: np.ndarray) -> bool:
        """Give all ids their places; False if they need more than there are."""
        shares = weights * _WHOLE // weights.sum()
        many = int(np.searchsorted(-shares, -_SLOT, "right"))
        shifts = np.searchsorted(1 << np.arange(1, 8), shares[many:], "right")
        starts, slots, at, place = [], [], many, 0
        for k in range(7, -1, -1):
            n = int((shifts == k).sum())
            own = -(-n >> (8 - k))
            starts.append(_SLOT * place + (np.arange(n) << k))
            slots.append((at + (np.arange(own) << (8 - k))) | (k << _ID_BITS))
            at, place = at + n, place + own
        room = _WHOLE // _SLOT - place
        if room < many:
            return False
        exact = weights[:many] * room
        total = max(1, int(weights[:many].sum()))
        whole = np.maximum(exact // total, 1)
        left = room - int(whole.sum()) if many else 0
        if left >= 0:
            whole[np.argsort(-(exact % total), kind="stable")[:left]] += 1
        elif whole[0] + left < 1:
            return False
        else:
            whole[0] += left
        ends = np.cumsum(whole)
        above = int(ends[-1]) if many else 0
        self.starts = np.concatenate([_SLOT * (ends - whole), *(_SLOT * above + s for s in starts)])
        self.sizes = np.concatenate([_SLOT * whole, 1 << shifts])
        slots = np.concatenate([np.repeat(np.arange(many), whole) | (8 << _ID_BITS), *slots])
        self.slots = np.zeros(_WHOLE // _SLOT, np.int64)
        self.slots[: len(slots)] = slots
        return True

    def ranks(self) -> np.ndarray:
        """Rank of each id."""
        out = np.zeros(int(self.ids.max()) + 1, np.uint32)
        out[self.ids] = np.arange(len(self.ids), dtype=np.uint32)
        return out

    def find(self, place: np.ndarray) -> np.ndarray:
        """Rank whose share holds each place."""
        slot = self.slots.take(place >> 8, mode="clip")
        return np.minimum((slot & int(_ID_MASK)) + ((place & 255) >> (slot >> _ID_BITS)), len(self.ids) - 1)


class _Writer:
    """Range encoders of all lanes: words of 16 bits at [place, lane], carries stay on top of a word and are settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.words = np.zeros((steps * 34 // 16 + 12, lanes), np.uint32)
        self.flat = self.words.reshape(-1)
        self.at = np.arange(lanes, dtype=np.int64) + lanes
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, _TOP - 1, np.int64)

    def part(self) -> np.ndarray:
        return self.range >> _BITS

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        self.low += start
        self.range = size
        out = size < _LEAST  # most steps fill up a word: all lanes write, those that are not ready write again
        self.flat[self.at] = self.low >> 44
        self.at += out * self.lanes
        shift = out * 16
        np.copyto(self.low, (self.low & (_LEAST - 1)) << 16, where=out)
        self.range <<= shift
        small = np.flatnonzero(self.range < _LEAST)
        while len(small):
            low, at, size = self.low.take(small), self.at.take(small), self.range.take(small) << 16
            self.flat[at] = low >> 44
            self.low[small], self.at[small], self.range[small] = (low & (_LEAST - 1)) << 16, at + self.lanes, size
            small = small[size < _LEAST]

    def bodies(self) -> list[bytes]:
        for part in (self.low >> 44, (self.low >> 28) & 0xFFFF, (self.low >> 12) & 0xFFFF, (self.low << 4) & 0xFFFF):
            self.flat[self.at] = part
            self.at += self.lanes
        size = (self.at // self.lanes).tolist()
        carry = np.zeros(self.lanes, np.uint32)
        short = np.empty((max(size), self.lanes), "<u2")
        for k in range(max(size) - 1, -1, -1):
            row = self.words[k] + carry
            short[k], carry = row, row >> 16
        return [row[1:n].tobytes() for row, n in zip(_turned(short), size)]


class _Reader:
    """Range decoders of all lanes. Codes and ranges stand four bits higher than the writer's, so that words fit whole."""

    def __init__(self, bodies: list[bytes]):
        size = np.array([len(b) // 2 for b in bodies])
        self.flat = np.zeros(int(size.sum()) + len(bodies) * 4 + 8, np.uint16)
        begin = np.cumsum(size + 4) - size - 4
        for at, body in zip(begin.tolist(), bodies):
            self.flat[at : at + len(body) // 2] = np.frombuffer(body[: len(body) // 2 * 2], "<u2")
        self.at = begin + 4
        a, b, c, d = (self.flat[begin + k].astype(np.uint64) for k in range(4))
        self.code = (a << 48) | (b << 32) | (c << 16) | d
        self.range = np.full(len(bodies), (_TOP - 1) << 4, np.uint64)

    def part(self) -> np.ndarray:
        return (self.range >> (_BITS + 4)) << 4

    def take(self, size: np.ndarray) -> None:
        """Go on after the code was made less by the start: ``size`` is the new range."""
        out = size < _LEAST << 4
        word = self.flat.take(self.at, mode="clip")
        self.at += out
        shift = out.view(np.uint8) << np.uint8(4)
        self.code <<= shift
        word *= out
        self.code |= word
        self.range = size << shift
        small = np.flatnonzero(self.range < _LEAST << 4)
        while len(small):
            at, size = self.at.take(small), self.range.take(small) << 16
            self.code[small] = (self.code.take(small) << 16) | self.flat.take(at, mode="clip")
            self.at[small], self.range[small] = at + 1, size
            small = small[size < _LEAST << 4]


# The next three are not used by the coder any more; an existing test holds them.


def _search(rows: np.ndarray, first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of the value among each row's 16 shares."""
    flat, value = rows.reshape(-1), value.astype(np.int16)
    at = first + ((flat.take(first + 7) <= value) << 3)
    for shift in (2, 1, 0):
        at += (flat.take(at + ((1 << shift) - 1)) <= value) << shift
    return at - first


def _span(rows: np.ndarray, first: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and share of a place in each row."""
    flat, at = rows.reshape(-1), first + half
    start = flat.take(at - 1) * (half > 0)
    return start.astype(np.int64), (flat.take(at) - start).astype(np.int64)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` for a below 2**36 and b from 1 to 2**12: the quotient of doubles is too near to the true one to pass a whole number."""
    return (a / b).astype(np.int64)


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, copied in strips that stay near."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for first in range(0, len(rows), 32):
        out[:, first : first + 32] = rows[first : first + 32].T
    return out


def _run(lanes: int, steps: int, table: _Shares, ids: np.ndarray | None, reader: _Reader | None):
    """Code the ranks ``ids`` [step, lane], or decode them with ``reader``; the model moves alike in both."""
    writer = _Writer(lanes, steps) if reader is None else None
    found = np.empty((steps, lanes), np.uint32) if reader is not None else None
    lane = np.arange(lanes, dtype=np.int64)
    store2, store1 = (np.zeros(lanes << b, np.uint32) for b in (_ORDER2, _ORDER1))
    base2, base1 = lane << _ORDER2, lane << _ORDER1
    row8, row4 = lane * 8, lane * 4
    # shares of the first two outcomes, side by side; shares [outcome, order, lane] are those of this step
    shares2, shares1 = (np.full((lanes * n, 2), 1 / 3, np.float32).view(np.uint64).reshape(-1) for n in (8, 4))
    shares = np.full((2, 3, lanes), 1 / 3, np.float32)
    weights = np.full((3, lanes), 1 / 3, np.float32)
    before1 = before2 = np.zeros(lanes, np.uint32)
    for step in range(steps):
        # what the orders say
        hashed = before1 * _HASH1
        at1 = base1 + (hashed >> (32 - _ORDER1))
        at2 = base2 + ((before2 * _HASH2 + hashed) >> (32 - _ORDER2))
        kept2, kept1 = store2.take(at2), store1.take(at1)
        told2, told1 = kept2 & _ID_MASK, kept1 & _ID_MASK
        state2 = row8 + ((kept2 >> _ID_BITS) + ((told2 == told1).view(np.uint8) << np.uint8(2)))
        state1 = row4 + (kept1 >> _ID_BITS)
        own2, own1 = shares2.take(state2), shares1.take(state1)
        pairs2, pairs1 = own2.view(np.float32).reshape(lanes, 2), own1.view(np.float32).reshape(lanes, 2)
        shares[:, 0], shares[:, 1] = pairs2.T, pairs1.T
        fits = shares * weights
        mixed = fits[:, 0] + fits[:, 1]
        mixed += fits[:, 2]
        mixed *= np.float32(4080)
        bounds = mixed.astype(np.int64)
        bounds += 4
        first, second = bounds[0], bounds[1]

        if reader is None:
            value = ids[step]
            right2, right1 = told2 == value, told1 == value
            only1 = right1 & ~right2
            neither = ~(right1 | right2)
            part = writer.part()
            both = first + second
            start = first * only1
            np.copyto(start, both, where=neither)
            share = np.where(only1, second, first)
            np.copyto(share, 4096 - both, where=neither)
            scaled = part * share
            inner = table.starts.take(value)
            inner *= neither
            size = np.where(neither, table.sizes.take(value), _WHOLE)
            writer.put(part * (start << 24) + scaled * inner, scaled * size)
        else:
            part = reader.part()
            wide = (part << 24) * bounds.view(np.uint64)
            edge = wide[0] + wide[1]
            only1 = reader.code >= wide[0]
            neither = reader.code >= edge
            only1 ^= neither
            less = wide[0] * only1
            np.copyto(less, edge, where=neither)
            reader.code -= less
            share = np.where(only1, second, first)
            np.copyto(share, 4096 - first - second, where=neither)
            scaled = part * share.view(np.uint64)
            rank = table.find((reader.code // scaled).view(np.int64))
            inner = table.starts.take(rank)
            inner *= neither
            size = np.where(neither, table.sizes.take(rank), _WHOLE)
            reader.code -= scaled * inner.view(np.uint64)
            reader.take(scaled * size.view(np.uint64))
            value = found[step]
            value[:] = np.where(only1, told1, told2)
            np.copyto(value, rank, where=neither, casting="unsafe")
            right2, right1 = told2 == value, told1 == value

        # learn
        fit = weights - fits[0]
        fit -= fits[1]
        np.maximum(fit, _LEAST_FIT, out=fit)
        np.copyto(fit, fits[1], where=only1)
        np.copyto(fit, fits[0], where=right2)
        scale = fit[0] + fit[1]
        scale += fit[2]
        np.divide(_FADE, scale, out=scale)
        np.multiply(fit, scale, out=weights)
        weights += _FLOOR
        shares *= _KEEP
        shares[0] += right2 * _RATE
        shares[1] += only1 * _RATE
        pairs2[:], pairs1[:] = shares[:, 0].T, shares[:, 1].T
        shares2[state2], shares1[state1] = own2, own1
        for store, at, kept, told, right in ((store2, at2, kept2, told2, right2), (store1, at1, kept1, told1, right1)):
            kept += _ONE
            np.minimum(kept, told | _SURE, out=kept)
            store[at] = np.where(right, kept, value)
        before2, before1 = before1, value
    return found if writer is None else writer.bodies()


def _groups(count: int) -> list[tuple[int, int]]:
    """First block and number of blocks of each group that is coded side by side: at most a quarter more than LANES, none much smaller."""
    n = -(-4 * count // (5 * LANES))
    ends = [k * count // max(1, n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A frame: the ids cut into blocks, each with its number of ids, bytes and CRC-32, coded from a fresh model.

    A short frame takes shorter blocks (256 ids at least), so that steps are few. Ids are below 2**24.
    """
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << _ID_BITS):
        raise ValueError("ids must be from 0 to 2**24 - 1")
    ids = ids.astype(np.uint32)
    block = min(block, max(LEAST_IDS, -(-len(ids) // LANES)))
    count = -(-len(ids) // block)
    out = [FRAME.pack(MAGIC, 1, count)]
    if count:
        shares, table = _Shares.of(ids)
        ranks = shares.ranks()
        table = TABLE.pack(len(table)) + table
    for first, lanes in _groups(count):
        own = ids[first * block : (first + lanes) * block]
        padded = np.zeros(lanes * block, np.uint32)
        ranks.take(own, out=padded[: len(own)], mode="clip")
        steps = min(block, len(own))
        bodies = _run(lanes, steps, shares, _turned(padded.reshape(lanes, block))[:steps], None)
        for k, body in enumerate(bodies):
            part = own[k * block : (k + 1) * block].astype("<u4", copy=False)
            body = table + body if first + k == 0 else body
            out += [HEAD.pack(len(part), len(body), zlib.crc32(part.tobytes())), body]
    return b"".join(out)


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises if a block does not match its checksum."""
    magic, _, count = FRAME.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    heads, bodies, at = [], [], FRAME.size
    for _ in range(count):
        if at + HEAD.size > len(frame):
            raise ValueError("the frame ends early")
        n, size, check = HEAD.unpack_from(frame, at)
        at += HEAD.size
        if at + size > len(frame):
            raise ValueError("the frame ends early")
        heads.append((n, check))
        bodies.append(frame[at : at + size])
        at += size
    out = [np.zeros(0, np.uint32)]
    if count:
        end = TABLE.size + TABLE.unpack_from(bodies[0])[0] if len(bodies[0]) >= TABLE.size else 0
        shares = _Shares.read(bodies[0][TABLE.size : end])
        bodies[0] = bodies[0][end:]
    for first, lanes in _groups(count):
        some = heads[first : first + lanes]
        found = _turned(_run(lanes, max(n for n, _ in some), shares, None, _Reader(bodies[first : first + lanes])))
        for (n, check), ranks in zip(some, found):
            ids = shares.ids.take(ranks[:n], mode="clip").astype("<u4", copy=False)
            if zlib.crc32(ids.tobytes()) != check:
                raise ValueError("a block does not match its checksum")
            out.append(ids)
    return np.concatenate(out)
