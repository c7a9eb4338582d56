"""Alignment of two tokenizers' tokens over the same bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .bytescan import flat_bytes, runs_of_bytes
from .common import fields
from .pieces import PieceEncoder, file_encoder, gap_cuts

CHUNK_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
KEPT_PIECES = 500_000
PAIR_BITS = 20

_RESULT = ["n_a", "n_b", "n_groups", "n_links"]


class TokenBytes:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        return self.data[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.starts[ids] - total + sizes, sizes)]


def byte_level_entries(library) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, whose characters stand for bytes: printable ones of Latin-1 for themselves,
    the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    entries = []
    for i in range(library.get_vocab_size()):
        token = library.id_to_token(i) or ""
        entries.append(bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
    return entries


def piece_entries(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece vocabulary: byte pieces as their byte, the low line for a space as a space."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.vocab_size())
    ]


def _model_encoder(model) -> PieceEncoder:
    """Ids of pieces that begin with a space (which the library adds itself) or a line end (where that space is taken off again).

    No entry of the vocabulary goes on behind its own leading spaces with another one, nor over a line end, so ids do not cross the cuts.
    """
    space = model.piece_to_id("▁")

    def encode(texts: list[str]) -> list[list[int]]:
        ids = model.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
        return [[space] if t == " " else x if t.startswith(" ") else x[1:] for t, x in zip(texts, ids)]

    return PieceEncoder(encode, gap_cuts, kept=KEPT_PIECES)


_sides: dict[tuple[str, str], tuple] = {}


def _both(tokenizer: str, model: str):
    """The worker's encoders and vocabularies of both sides, kept between tasks."""
    if (tokenizer, model) not in _sides:
        import sentencepiece
        from tokenizers import Tokenizer

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        _sides[tokenizer, model] = (
            file_encoder(tokenizer, gap_cuts, special=False, kept=KEPT_PIECES), TokenBytes(byte_level_entries(Tokenizer.from_file(tokenizer))),
            _model_encoder(pieces), TokenBytes(piece_entries(pieces)),
        )
    return _sides[tokenizer, model]


def _ids(encoder: PieceEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = list(encoder.texts(data, offsets))
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate([f[0] for f in found]).astype(np.int64), np.concatenate([f[1] for f in found])


def covering(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (in a, in b) whose tokens overlap; both sides cover each document's bytes without gaps.

    Each start finds the other side's token that covers it, the last one of the document that begins there or before. What both
    directions find together are the overlaps: of two overlapping tokens one holds the other's start.
    """
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    in_b = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    in_a = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    new = start_a[in_a] != start_b  # with equal starts the pair is there already
    return np.append(a["a"].to_numpy(), in_a[new]), np.append(in_b, b["b"].to_numpy()[new])


class _Digits:
    """Decimal digits of ids, in rows of equal width with room for a separator."""

    def __init__(self, n: int):
        self.width = len(str(max(n - 1, 0))) + 1
        self.sizes = np.array([len(str(i)) for i in range(n)], np.int64)
        self.rows = np.frombuffer("".join(str(i).ljust(self.width) for i in range(n)).encode(), np.uint8).reshape(n, self.width)

    def text(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, each followed by its byte of ``after`` unless that is 0; and where each one begins (one more: the end)."""
        rows, sizes = self.rows[ids], self.sizes[ids]
        rows[np.arange(len(ids)), sizes] = after
        sizes = sizes + (after > 0)
        return rows[np.arange(self.width) < sizes[:, None]], np.append(0, np.cumsum(sizes))


_digits: dict[int, _Digits] = {}


class _Aligned:
    """What one document has so far."""

    def __init__(self):
        self.counts = np.zeros(4, np.int64)
        self.sha, self.pairs, self.times, self.valid = hashlib.sha256(), [], [], True

    def row(self):
        if not self.valid or not self.counts[0]:
            return [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        if len(self.pairs) > 1:
            pairs, where = np.unique(pairs, return_inverse=True)
            times = np.bincount(where, weights=times).astype(np.int64)
        return self.counts.tolist(), self.sha.hexdigest(), pairs, times


def align_batch(sides, data: np.ndarray, offsets: np.ndarray, docs: list[_Aligned]) -> None:
    """Add the alignment of some texts (each with its leading space; empty: none), or of one stretch of a text, to ``docs``."""
    encode_a, bytes_a, encode_b, bytes_b = sides
    (ids_a, many_a), (ids_b, many_b) = _ids(encode_a, data, offsets), _ids(encode_b, data, offsets)
    number = np.arange(len(docs))
    size = np.diff(offsets)
    doc_a, doc_b = np.repeat(number, many_a), np.repeat(number, many_b)
    lengths_a, lengths_b = bytes_a.sizes[ids_a], bytes_b.sizes[ids_b]
    good = (np.bincount(doc_a, lengths_a, len(docs)) == size) & (np.bincount(doc_b, lengths_b, len(docs)) == size)
    keep = np.repeat(good, size)
    for ids, doc, table in ((ids_a, doc_a, bytes_a), (ids_b, doc_b, bytes_b)):
        wrong = np.flatnonzero(table.joined(ids[good[doc]]) != data[keep])
        if len(wrong):
            good[np.repeat(number, size)[keep][wrong]] = False
            keep = np.repeat(good, size)
    for k in np.flatnonzero(~good):
        docs[k].valid = False
    ids_a, lengths_a, doc_a = ids_a[good[doc_a]], lengths_a[good[doc_a]], doc_a[good[doc_a]]
    ids_b, lengths_b, doc_b = ids_b[good[doc_b]], lengths_b[good[doc_b]], doc_b[good[doc_b]]
    if not len(ids_a):
        return
    end_a, end_b = np.cumsum(lengths_a), np.cumsum(lengths_b)  # the good texts end to end, so ends of different texts differ
    in_a, in_b = covering(doc_a, end_a - lengths_a, doc_b, end_b - lengths_b)

    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    order = np.lexsort((np.append(np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8)), np.append(group_a, group_b)))
    after = np.append(np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))).astype(np.uint8)
    after[len(ids_a) + np.flatnonzero(np.diff(doc_b, append=-1))] = 0
    n = max(len(bytes_a.sizes), len(bytes_b.sizes))
    if n not in _digits:
        _digits[n] = _Digits(n)
    text, at = _digits[n].text(np.append(ids_a, ids_b)[order], after[order])

    n_a, n_b, n_links = (np.bincount(d, minlength=len(docs)) for d in (doc_a, doc_b, doc_a[in_a]))
    n_groups = np.bincount(doc_a[last_a], minlength=len(docs))
    pair = ids_a[in_a] << PAIR_BITS | ids_b[in_b]
    distinct, where = np.unique(pair, return_inverse=True)
    mine, times = np.unique(doc_a[in_a] * len(distinct) + where, return_counts=True)
    bounds = np.searchsorted(mine, np.arange(len(docs) + 1) * len(distinct))
    ends = np.append(0, np.cumsum(n_a + n_b))
    raw = memoryview(np.ascontiguousarray(text))
    for k in np.flatnonzero(n_a):
        one = docs[k]
        if one.counts[0]:
            one.sha.update(b";")
        one.counts += (n_a[k], n_b[k], n_groups[k], n_links[k])
        one.sha.update(raw[at[ends[k]] : at[ends[k + 1]]])
        one.pairs.append(distinct[mine[bounds[k] : bounds[k + 1]] % len(distinct)])
        one.times.append(times[bounds[k] : bounds[k + 1]])


def _with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that is not empty with one space before it."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 32), offsets + np.append(0, np.cumsum(some))


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, lowest first, as many as the largest value needs."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _values(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if n:
        for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(-1, n)):
            out |= plane.astype(np.int64) << (8 * k)
    return out


def align_tokens(docs: DataFrame, tokenizer: str, model: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text.

    Side A: space and text by the byte-level file ``tokenizer``, special strings as plain text; side B: the text by the sentencepiece
    file ``model``, which adds the space. Byte offsets where tokens of both end cut them into groups; every pair of tokens
    whose byte ranges overlap is a link. A pair of ids counts as often as it is linked in all documents; ``count_sum`` adds
    these counts over a text's links, ``n_best`` counts the links whose pair is the most frequent of its B id (ties
    included). ``groups_sha256`` is the hash of the groups written as ``a1,a2|b1;a3|b2,b3``.

    Texts are tokenised and aligned in batches of about 1 MB; a longer text comes in stretches cut before a space or line end that
    follows other characters, where no token of either side can cross. About 8 MB of text make a chunk, which names each of its pairs once;
    pairs are counted over all chunks, and each chunk gets the counts of its own pairs back. A document's links are held as places in the
    chunk's pairs and written, so the second step reads that table only. Only the best count of each B id is broadcast, bounded by
    the vocabulary. An endless run of characters without such a cut is aligned whole.

    Null and empty texts, and texts that either side does not give back byte for byte, have zeros and an empty hash. Equal rows count
    each. Other columns are not read. An empty table gives an empty one.
    """
    counted = [T.StructField(c, T.LongType()) for c in _RESULT]
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("key", docs.schema[key].dataType), *counted, T.StructField("sha", T.StringType()),
        T.StructField("at", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("links", T.LongType()),
        T.StructField("pairs", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])

    def chunk_rows(chunk: int, keys: list[pa.Array], done: list[_Aligned]) -> pa.RecordBatch:
        rows = [d.row() for d in done]
        all_pairs = np.concatenate([r[2] for r in rows])
        distinct, where = np.unique(all_pairs, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([r[3] for r in rows]), minlength=len(distinct)).astype(np.int64)
        order = np.argsort(-n, kind="stable")  # frequent pairs get small places
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, ends = [], np.cumsum([len(r[2]) for r in rows])
        times = []
        for r, end in zip(rows, ends):
            own = rank[where[end - len(r[2]) : end]]
            inner = np.argsort(own)
            at.append(_planes(np.diff(own[inner], prepend=0)) if len(own) else b"")
            times.append(_planes(r[3][inner]) if len(own) else b"")
        lead = [None] * (len(rows) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), chunk)), pa.concat_arrays(keys), *[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)],
             pa.array([r[1] for r in rows], pa.string()), pa.array(at, pa.binary()), pa.array(times, pa.binary()), pa.array([len(r[2]) for r in rows], pa.int64()),
             pa.array([distinct[order].astype("<i8").tobytes(), *lead], pa.binary()), pa.array([n[order].astype("<i8").tobytes(), *lead], pa.binary())],
            [f.name for f in schema],
        )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, size, number = _both(tokenizer, model), 0, TaskContext.get().partitionId() << 32
        keys, done = [], []
        for batch in batches:
            data, offsets = _with_space(*flat_bytes(batch.column(0)))
            for first, last in runs_of_bytes(offsets, BATCH_BYTES):
                new, at = [_Aligned() for _ in range(first, last)], offsets[first : last + 1]
                low = int(at[0])
                if last - first > 1:
                    align_batch(sides, data[low : int(at[-1])], at - low, new)
                else:
                    for high in sides[0].stretches(data, low, int(at[-1]), BATCH_BYTES):
                        align_batch(sides, data[low:high], np.array([0, high - low]), new)
                        low = high
                keys.append(batch.column(1).slice(first, last - first))
                done += new
                size += int(at[-1] - at[0])
                if size >= chunk_bytes:
                    yield chunk_rows(number, keys, done)
                    keys, done, size, number = [], [], 0, number + 1
        if done:
            yield chunk_rows(number, keys, done)

    aligned = write_table(docs.select(F.col(text).alias("_text"), key).mapInArrow(align, schema), "aligned")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "counts"))):
                pairs, n = np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(pairs), pa.array(n)], ["chunk", "place", "pair", "n"])

    named = aligned.filter("pairs is not null").select("chunk", "pairs", "counts").mapInArrow(spread, "chunk long, place int, pair long, n long")
    totals = write_table(named.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    best = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("best"))  # at most one row an id of B
    marked = totals.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("best")).alias("is_best"))
    answers = named.select("chunk", "place", "pair").join(marked, "pair").select("chunk", "place", "total", "is_best")

    result = T.StructType([*fields(docs, [key]), *counted, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("groups_sha256", T.StringType())])

    def add(group, rows: pa.Table, found: pa.Table) -> pa.Table:
        total, is_best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        places = found["place"].to_numpy()
        total[places], is_best[places] = found["total"].to_numpy(), found["is_best"].to_numpy()
        sums, bests = [], []
        for n, at, times in zip(*(rows[c].to_pylist() for c in ("links", "at", "times"))):
            at, times = np.cumsum(_values(at, n)), _values(times, n)
            sums.append(int((total[at] * times).sum()))
            bests.append(int((is_best[at] * times).sum()))
        columns = [rows["key"], *[rows[c] for c in _RESULT], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), rows["sha"]]
        return pa.table(columns, names=[f.name for f in result])

    kept = aligned.drop("pairs", "counts")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, result)
