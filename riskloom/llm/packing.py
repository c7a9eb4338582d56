"""Bounded-space online best-fit packing of token sequences."""

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
from .pieces import encoder

OPEN_BINS = 1024
LEFT_PER_TASK = 100_000
EMIT_ROWS = 20_000


class OpenBins:
    """A fixed number of open bins, found by a bitset whose bit f tells that a bin has f places free.

    A piece goes to the open bin with the least free space that still takes it. If none does, a new bin opens;
    if too many are open then, the fullest closes. A bin without space closes at once.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open = capacity, most, 0
        self.bits = 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return one

    def put(self, piece, length: int) -> list[list]:
        """Place one piece; returns the bins that closed."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.capacity, []
        into.append((piece, self.capacity - free))
        free -= length
        if not free:
            return [into]
        self.by_free[free].append(into)
        self.bits |= 1 << free
        self.open += 1
        if self.open > self.most:
            return [self._take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def rest(self) -> list[list]:
        return [b for bins in self.by_free for b in bins]


def _piece_fields(docs: DataFrame, key: str) -> list[T.StructField]:
    return [
        *fields(docs, [key]),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]


class _Rows:
    """Placed pieces as Arrow batches."""

    def __init__(self, schema: pa.Schema, first_sequence: int):
        self.schema, self.sequence, self.rows = schema, first_sequence, []

    def bin(self, pieces: list, *more) -> None:
        for piece, offset in pieces:
            self.rows.append((*piece, self.sequence, offset, *more))
        self.sequence += 1

    def full(self, least: int = EMIT_ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows = []


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: (key, piece, start, length, ids_crc32, sequence_id, offset).

    A document is the ids of its text and ``end_id``. Only one longer than ``capacity`` is cut: the first
    piece takes the remainder, the others are full. Every task packs its documents in the order they come, with at
    most ``open_bins`` open. The pieces of bins that are open at a task's end (so at most that many bins a
    task) meet in a second round, the longest first, in as many tasks as there are 100,000 of them; ids are
    never sent along. What the first round placed is written, so both rounds see the same.

    Null and empty texts are the end id alone. Rows with equal or null keys are documents of their own. Other columns
    are not read. An empty table gives no rows.
    """
    pieces = _piece_fields(docs, key)
    placed = T.StructType([*pieces, T.StructField("closed", T.BooleanType())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        rows = None
        for batch in batches:
            if rows is None:
                names = [(f.name, batch.schema.field(1).type if i == 0 else {T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}.get(f.dataType, pa.int64())) for i, f in enumerate(placed)]
                rows = _Rows(pa.schema(names), TaskContext.get().partitionId() << 32)
            keys, at = batch.column(1).to_pylist(), 0
            for ids, sizes in encoder(tokenizer).texts(*flat_bytes(batch.column(0))):
                low = 0
                for size in sizes.tolist():
                    own = np.append(ids[low : low + size], end_id).astype("<u4")
                    low, n, start = low + size, size + 1, 0
                    end = n % capacity or min(n, capacity)
                    for number in range(-(-n // capacity)):
                        piece = (keys[at], number, start, end - start, zlib.crc32(own[start:end].tobytes()))
                        for closed in bins.put(piece, end - start):
                            rows.bin(closed, True)
                        start, end = end, end + capacity
                    at += 1
                yield from rows.full()
        if rows is not None:
            for left in bins.rest():
                rows.bin(left, False)
            yield from rows.full(1)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        rows = None
        for batch in batches:
            if rows is None:
                rows = _Rows(batch.schema, (1 << 62) + (TaskContext.get().partitionId() << 32))
            for piece in zip(*(c.to_pylist() for c in batch.columns[:5])):
                for closed in bins.put(piece, piece[3]):
                    rows.bin(closed)
                yield from rows.full()
        if rows is not None:
            for left in bins.rest():
                rows.bin(left)
            yield from rows.full(1)

    once = write_table(docs.select(F.col(text).alias("_text"), key).mapInArrow(first, placed), "packed")
    left = once.filter(~F.col("closed")).drop("closed")
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))
    again = left.repartition(tasks).sortWithinPartitions(F.desc("length"), key, "piece", "start", "ids_crc32")
    return once.filter("closed").drop("closed").unionByName(again.mapInArrow(second, T.StructType(pieces)))
