"""Deleted interpolation: n-gram shares mixed by the frequency of their context."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .bytescan import LOWER_AZ, flat_bytes, mix, span_hash, words
from .common import crc32_of, fields, give_back

CHUNK_BYTES = 8 << 20
FOLDS = 10
HELD_OUT, DEVELOPMENT = 0, 1
ROUNDS = 12
BASE_COUNT = 0.1
KEY_BYTES = 6
_END, _BEGIN = np.uint64(0xA5A5_1E4D_0000_0001), np.uint64(0xA5A5_1E4D_0000_0002)

RESULT = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _packed(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes a value that hold the largest, byte planes one after another."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    """Values of byte planes, in 32 bits where they need no more than three planes."""
    small = len(raw) <= 3 * n
    out = np.zeros((n, 4 if small else 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<i4" if small else "<i8")


def _all_unpacked(column: pa.ChunkedArray, n: list[int]) -> np.ndarray:
    """The values of all rows of a column of byte planes end to end."""
    return np.concatenate([_unpacked(raw.as_buffer(), k) for raw, k in zip(column, n)])


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts end to end, each text closed by one end, and the number of tokens of each."""
    data, offsets = flat_bytes(column)
    data = LOWER_AZ[data]
    starts, ends, counts = words(data, offsets)
    sizes = counts + 1
    tokens = np.empty(int(sizes.sum()), np.uint64)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), bool)
    inner[last] = False
    tokens[inner] = span_hash(data, starts, ends)
    tokens[last] = _END
    return tokens, sizes


def _ngrams(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Keys of single tokens and of pairs (token before, token); a text begins with a mark of its own."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(sizes) - sizes)] = _BEGIN
    return [mix(tokens, 1), mix(mix(before, 2) + tokens, 3)]


def _blocks(keys: np.ndarray, buckets: int):
    """Distinct keys in order of (bucket, shortened key), where each position finds its own, and bounds of the buckets."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    short = keys & np.uint64((1 << 8 * KEY_BYTES) - 1)
    order = np.lexsort((short, bucket)) if buckets > 1 << 16 else np.argsort((bucket << np.uint64(48)) | short)
    b, s = bucket[order], short[order]
    del bucket, short
    new = np.append(True, (b[1:] != b[:-1]) | (s[1:] != s[:-1])) if len(keys) else np.zeros(0, bool)
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return b[new].astype(np.int64), s[new], where


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Tokens are the words of the text in lower-case A-Z, then one end. Training rows are those whose
    CRC-32 of the key as text is not 0 modulo 10. P(w | h) = a0/(V+1) + a1 c(w)/N + a2 c(h,w)/c(h), with weights for each
    bucket of the context's count c(h) (its bit length). The weights come from expectation-maximisation on the training
    rows with remainder 1, scored with the counts of the other training rows (held-out counts); the
    model itself counts all training rows. Base: unigrams with 0.1 added to each count.

    Rows are dealt to chunks of about 8 MB by their place in the input, so equal rows spread like others; ``docs`` must come in the
    same order when read again, as tables do. A chunk sends each distinct n-gram once, with its counts,
    as packed blocks of sorted keys' gaps to the n-gram's bucket and gets back the totals over all rows; a frequent n-gram is one entry of
    a block like any other. What a position needs (two counts) is written, so training the weights and
    scoring read that table only. An n-gram stands for itself by 48 bits besides its bucket.

    Null and empty texts are one end token. Rows of equal key and text are scored and counted each; a null key counts as an empty one. Other columns are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    fold = F.pmod(crc32_of(F.col(key)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), fold.alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // chunk_bytes))
    # by place, so that equal rows spread; both readers take one shuffle, and files come in the same order when they are read again
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)))

    def send(table: pa.Table) -> pa.Table:
        tokens, sizes = text_tokens(table["text"])
        folds = np.repeat(table["fold"].combine_chunks().to_numpy(), sizes)
        chunk = table["chunk"][0].as_py()
        out = {name: [] for name in ("chunk", "kind", "bucket", "n", "keys", "train", "dev")}
        for kind, keys in enumerate(_ngrams(tokens, sizes)):
            bucket, short, where = _blocks(keys, chunks)
            train = np.bincount(where[folds != HELD_OUT], minlength=len(short))
            dev = np.bincount(where[folds == DEVELOPMENT], minlength=len(short))
            bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for a, b in zip(bounds[:-1], bounds[1:]):
                out["chunk"].append(chunk)
                out["kind"].append(kind)
                out["bucket"].append(int(bucket[a]))
                out["n"].append(int(b - a))
                out["keys"].append(_packed(np.diff(short[a:b], prepend=np.uint64(0))))
                out["train"].append(_packed(train[a:b]))
                out["dev"].append(_packed(dev[a:b]))
            del bucket, short, where, train, dev
        give_back()
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())]))

    def total(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        at = np.append(0, np.cumsum(n))
        keys = np.concatenate([np.cumsum(_unpacked(raw.as_buffer(), k), dtype=np.int64) for raw, k in zip(table["keys"], n)])
        distinct, where = np.unique(keys, return_inverse=True)
        size, where = len(distinct), where.astype(np.int32)
        del keys, distinct
        out = {c: table[c] for c in ("chunk", "kind", "bucket", "n")}
        for name in ("train", "dev"):  # one column at a time
            own = _all_unpacked(table[name], n)
            sums = np.bincount(where, weights=own, minlength=size).astype(np.int64)
            seen = int((sums > 0).sum()) if name == "train" else seen
            spread = sums[where]
            if name == "dev":  # only the chunk's own development rows ask for these
                spread[own == 0] = 0
            out[name] = pa.array([_packed(spread[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())
            del own, sums, spread
        known = np.zeros(len(n), np.int64)
        known[int(np.argmin(table["chunk"].to_numpy()))] = seen if table["kind"][0].as_py() == 0 else 0
        out["known"] = pa.array(known)
        del where
        give_back()
        return pa.table(out)

    def receive(group, table: pa.Table, totals: pa.Table) -> pa.Table:
        tokens, sizes = text_tokens(table["text"])
        totals = totals.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        found = []
        for kind, keys in enumerate(_ngrams(tokens, sizes)):
            own = totals.filter(pa.compute.equal(totals["kind"], kind))
            n = own["n"].to_pylist()
            where = _blocks(keys, chunks)[2]
            for c in ("train", "dev"):
                found.append(_all_unpacked(own[c], n)[where])
            del where, keys, own
        at = np.append(0, np.cumsum(sizes))
        spans = list(zip(at[:-1], at[1:]))
        known = np.zeros(len(sizes), np.int64)
        known[0] = pa.compute.sum(totals["known"]).as_py() or 0
        fold_of = table["fold"].to_pylist()
        out = {"key": table["key"], "fold": table["fold"], "n_tokens": pa.array(sizes), "known": pa.array(known)}
        for name, values in zip(("word", "dev_word", "pair", "dev_pair"), found):
            keep = [f == DEVELOPMENT for f in fold_of] if name.startswith("dev") else [True] * len(spans)
            out[name] = pa.array([_packed(values[a:b]) if k else b"" for (a, b), k in zip(spans, keep)], pa.binary())
        del found, values, tokens
        give_back()
        return pa.table(out)

    parts = "chunk long, kind int, bucket long, n long"
    sent = chunked.groupBy("chunk").applyInArrow(send, f"{parts}, keys binary, train binary, dev binary")
    totals = sent.groupBy("kind", "bucket").applyInArrow(total, f"{parts}, train binary, dev binary, known long")
    position_schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("fold", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("word", "dev_word", "pair", "dev_pair")],
    ])
    path = scratch_path(spark, "positions")
    met = chunked.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(receive, position_schema)
    met.write.option("compression", "zstd").parquet(path)
    positions = spark.read.schema(position_schema).parquet(path)

    facts = positions.agg(
        F.sum(F.when(F.col("fold") != HELD_OUT, F.col("n_tokens"))).alias("tokens"),
        F.sum(F.when(F.col("fold") == DEVELOPMENT, F.col("n_tokens"))).alias("dev_tokens"),
        F.count(F.when(F.col("fold") != HELD_OUT, 1)).alias("texts"),
        F.count(F.when(F.col("fold") == DEVELOPMENT, 1)).alias("dev_texts"),
        F.sum("known").alias("known"),
    ).first()
    n_train, n_dev, known = facts["tokens"] or 0, facts["dev_tokens"] or 0, facts["known"] or 0
    weights = _learn(positions, n_train - n_dev, facts["texts"] - facts["dev_texts"], known, rounds)

    schema = T.StructType([
        *fields(docs, [key]), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    texts = facts["texts"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, word, pair, before = _counts(batch, "word", "pair", texts)
            at = np.cumsum(n) - n
            base = np.log10((word + BASE_COUNT) / (n_train + BASE_COUNT * (known + 1)))
            mixed = np.log10((_shares(word, pair, before, n_train, known) * weights[_bucket(before)]).sum(axis=1))
            sums = [np.add.reduceat(v, at) if len(v) else np.zeros(0, v.dtype) for v in ((word > 0).astype(np.int64), base, mixed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.compute.equal(batch.column("fold"), HELD_OUT), batch.column("n_tokens"), pa.array(sums[0]),
                 pa.array(np.full(len(n), n_train)), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())],
                [f.name for f in schema],
            )

    return positions.select("key", "fold", "n_tokens", "word", "pair").mapInArrow(score, schema)


def _counts(batch: pa.RecordBatch, word: str, pair: str, texts: int):
    """Tokens of each text; counts of tokens, pairs and contexts of all positions."""
    n = batch.column("n_tokens").to_numpy()
    both = [
        np.concatenate([_unpacked(raw, k) for raw, k in zip(batch.column(c).to_pylist(), n.tolist())]) if len(n) else np.zeros(0, np.int64)
        for c in (word, pair)
    ]
    before = np.empty_like(both[0])
    before[1:] = both[0][:-1]
    before[np.cumsum(n) - n] = texts
    return n, *both, before


def _bucket(before: np.ndarray) -> np.ndarray:
    return np.where(before > 0, np.frexp(before.astype(np.float64))[1], 0)


def _shares(word: np.ndarray, pair: np.ndarray, before: np.ndarray, tokens: int, known: int) -> np.ndarray:
    return np.stack([np.full(len(word), 1 / (known + 1)), word / max(tokens, 1), pair / np.maximum(before, 1)], axis=1)


def _learn(positions: DataFrame, tokens: int, texts: int, known: int, rounds: int) -> np.ndarray:
    """[bucket, component] mixture weights; 64 buckets of one vector of sums per round reach the driver."""
    weights = np.full((65, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0)
    dev = positions.filter(F.col("fold") == DEVELOPMENT).select("n_tokens", "word", "pair", "dev_word", "dev_pair")
    for _ in range(rounds):
        now = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, fit = np.zeros((65, 3)), 0.0
            for batch in batches:
                counts = _counts(batch, "word", "pair", 0)
                less = _counts(batch, "dev_word", "dev_pair", 0)
                word, pair, before = (a - b for a, b in zip(counts[1:], less[1:]))
                before[np.cumsum(counts[0]) - counts[0]] = texts
                bucket = _bucket(before)
                parts = _shares(word, pair, before, tokens, known) * now[bucket]
                whole = parts.sum(axis=1)
                fit += float(np.log(whole).sum())
                for k in range(3):
                    sums[:, k] += np.bincount(bucket, weights=parts[:, k] / whole, minlength=65)
            yield pa.RecordBatch.from_pydict({"bucket": list(range(65)), "a": sums[:, 0], "b": sums[:, 1], "c": sums[:, 2]})

        found = dev.mapInArrow(expect, "bucket long, a double, b double, c double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "abc"])
        for r in found.collect():
            seen = np.array([r["a"], r["b"], r["c"]]) + (1, 1, 1 if r["bucket"] else 0)
            weights[r["bucket"]] = seen / seen.sum()
        if np.abs(weights - now).max() < 1e-4:
            break
    return weights
