"""Packing by minimum bin slack: each window takes the remaining lengths that fill it closest to its capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .bytescan import flat_bytes
from .common import fields
from .pieces import word_encoder

POOL_WINDOWS = 64
LEFT_PER_TASK = 100_000
EMIT_ROWS = 20_000


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how often) of a multiset from ``counts`` with the largest sum of at most ``capacity``, the longest length among it.

    A bitset has a bit for each sum that can be reached. Lengths come in descending order, each in binary shares of its
    count, and every share keeps the sums from before it. As soon as the capacity is reached no more are looked at.
    The way back goes through the shares in reverse: one is taken where the sum could not be reached without it.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    if not lengths:
        return []
    most = (1 << (capacity + 1)) - 1
    reached = 1 << lengths[0]  # the longest is in the window for sure
    shares = []
    for n in lengths:
        left = counts[n] - (n == lengths[0])
        left, share = min(left, capacity // n), 1
        while left and not reached >> capacity & 1:
            share = min(share, left)
            shares.append((n, share, reached))
            reached |= (reached << (n * share)) & most
            left, share = left - share, 2 * share
        if reached >> capacity & 1:
            break
    total = reached.bit_length() - 1
    taken = {lengths[0]: 1}
    for n, share, before in reversed(shares):
        if not before >> total & 1:
            taken[n] = taken.get(n, 0) + share
            total -= n * share
    return list(taken.items())


class Windows:
    """Pieces that wait, by length, and the windows made of them.

    A piece is (document's fields, start, length). Longer documents give full windows right away; what is left waits. When
    the waiting pieces hold more than ``POOL_WINDOWS`` windows, half of these are made.
    """

    def __init__(self, capacity: int, most: int = POOL_WINDOWS):
        self.capacity, self.most, self.tokens = capacity, most * capacity, 0
        self.waiting: dict[int, list] = {}

    def add(self, piece, length: int) -> None:
        self.waiting.setdefault(length, []).append(piece)
        self.tokens += length

    def one(self) -> tuple[list, int]:
        """The pieces of the next window, and its length."""
        window, total = [], 0
        for n, times in fullest({n: len(p) for n, p in self.waiting.items()}, self.capacity):
            own = self.waiting[n]
            window += [(own.pop(), n) for _ in range(times)]
            total += n * times
            if not own:
                del self.waiting[n]
        self.tokens -= total
        return window, total

    def ready(self) -> Iterator[tuple[list, int]]:
        if self.tokens > self.most:
            while 2 * self.tokens > self.most:
                yield self.one()


def _schema(docs: DataFrame, key: str) -> list[T.StructField]:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return [*fields(docs, [key]), *[T.StructField(c, T.LongType()) for c in names]]


class _Placed:
    """Windows as rows; a window that is not full is filled up by cutting a waiting piece."""

    def __init__(self, schema: pa.Schema, first_sequence: int, capacity: int):
        self.schema, self.sequence, self.capacity = schema, first_sequence, capacity
        self.windows, self.rows = Windows(capacity), []

    def document(self, key, ids: np.ndarray) -> None:
        """Full windows of a document's ids; the rest waits with its ids."""
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self.place([((key, ids[start : start + self.capacity], start, len(ids)), self.capacity)])
        if full < len(ids):
            self.windows.add((key, ids[full:], full, len(ids)), len(ids) - full)

    def place(self, window: list) -> None:
        offset = 0
        for (key, ids, start, whole), n in window:
            self.rows.append((key, start, n, zlib.crc32(ids.tobytes()), whole, self.sequence, offset))
            offset += n
        self.sequence += 1

    def fill(self, window: list, total: int) -> None:
        """Place a window; if no choice of waiting pieces fills it, the shortest one that is longer than the gap is cut to fit."""
        gap = self.capacity - total
        if gap:
            n = min((n for n in self.windows.waiting if n > gap), default=0)
            if n:
                own = self.windows.waiting[n]
                key, ids, start, whole = own.pop()
                if not own:
                    del self.windows.waiting[n]
                self.windows.tokens -= n
                window = [*window, ((key, ids[:gap], start, whole), gap)]
                self.windows.add((key, ids[gap:], start + gap, whole), n - gap)
        self.place(window)

    def ready(self) -> None:
        for window, total in self.windows.ready():
            self.fill(window, total)

    def finish(self) -> Iterator[tuple]:
        """Make all windows that can be full; returns what is left, less than one window."""
        while self.windows.tokens >= self.capacity:
            self.fill(*self.windows.one())
        return ((piece, n) for n, own in self.windows.waiting.items() for piece in own)

    def halves(self, left: list) -> None:
        """What is left, less than one window, in sequences whose lengths are powers of two, the longest first."""
        total = sum(n for _, n in left)
        for bit in reversed(range(total.bit_length())):
            size, window = total & (1 << bit), []
            while size:
                (key, ids, start, whole), n = left.pop()
                take = min(n, size)
                window.append(((key, ids[:take], start, whole), take))
                if take < n:
                    left.append(((key, ids[take:], start + take, whole), n - take))
                size -= take
            if window:
                self.place(window)

    def full(self, least: int = EMIT_ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows = []


def pack_windows(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its text under the word-level tokenizer file ``tokenizer`` and ``end_id``. Its full windows are
    sequences of their own; its rest waits with those of the task's other documents, at most 64 windows of them. Each further
    window takes the longest waiting rest and the multiset of others that fills it best (subset sums). Where
    no choice fills it, one more rest is cut to fit. So all sequences but the last are full. What is left at a
    task's end, less than one window, meets in a second round with its ids, in as many tasks as there are 100,000 such pieces;
    what is left there becomes sequences of 1024, 512, ... ids, so that no sequence needs padding to ``capacity`` or to a power
    of two (where ``capacity`` is one). What the first round placed is written, so both rounds see the same.

    Null and empty texts are the end id alone. Rows with equal or null keys are documents of their own. Other columns
    are not read. An empty table gives no rows.
    """
    pieces = _schema(docs, key)
    extra = [T.StructField("left", T.BinaryType())]

    def out_schema(kind: pa.DataType) -> pa.Schema:
        return pa.schema([(f.name, kind if i == 0 else pa.int64()) for i, f in enumerate(pieces)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = None
        for batch in batches:
            if placed is None:
                placed = _Placed(out_schema(batch.schema.field(1).type), TaskContext.get().partitionId() << 32, capacity)
            keys, at = batch.column(1).to_pylist(), 0
            for ids, sizes in word_encoder(tokenizer).texts(*flat_bytes(batch.column(0))):
                low = 0
                for size in sizes.tolist():
                    placed.document(keys[at], np.append(ids[low : low + size], end_id).astype("<u4"))
                    low, at = low + size, at + 1
                    placed.ready()
                yield from map(with_left, placed.full())
        if placed is not None:
            left = list(placed.finish())
            yield from map(with_left, placed.full(1))
            placed.rows = [(k, start, n, 0, whole, 0, 0) for (k, _, start, whole), n in left]
            held = pa.array([ids.tobytes() for (_, ids, _, _), _ in left], pa.binary())
            yield from (with_left(b, held) for b in placed.full(1))

    def with_left(batch: pa.RecordBatch, left: pa.Array | None = None) -> pa.RecordBatch:
        return batch.append_column("left", pa.nulls(len(batch), pa.binary()) if left is None else left)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = None
        for batch in batches:
            if placed is None:
                placed = _Placed(out_schema(batch.schema.field(0).type), (1 << 62) + (TaskContext.get().partitionId() << 32), capacity)
            for k, start, n, whole, ids in zip(*(batch.column(c).to_pylist() for c in (key, "start", "length", "doc_tokens", "left"))):
                placed.windows.add((k, np.frombuffer(ids, "<u4"), start, whole), n)
                placed.ready()
            yield from placed.full()
        if placed is not None:
            placed.halves(list(placed.finish()))
            yield from placed.full(1)

    once = write_table(docs.select(F.col(text).alias("_text"), key).mapInArrow(first, T.StructType([*pieces, *extra])), "windows")
    left = once.filter("left is not null")
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))
    again = left.repartition(tasks).sortWithinPartitions(F.desc("length"), key, "start", "left")
    return once.filter("left is null").drop("left").unionByName(again.mapInArrow(second, T.StructType(pieces)))
