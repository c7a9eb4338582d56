"""Token-id files: documents in order of their key, ids in frames of independently coded, checksummed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running_totals
from .bytescan import flat_bytes
from .common import fields
from .mixed_coder import BLOCK_IDS, LANES, decode, encode
from .pieces import encoder

PART_BYTES = 32 << 20
FRAME_IDS = LANES * BLOCK_IDS


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text",
                      part_bytes: int = PART_BYTES, frame_ids: int = FRAME_IDS) -> None:
    """Write the ids of each text, then ``end_id``, in ascending order of the key (null first).

    The folder ``path`` gets one Parquet file for each range of keys. Its rows are frames: ``part`` and ``number`` (their order),
    ``n_ids``, the keys and numbers of ids of the documents in it, and ``body``, the coded blocks. A frame ends with
    the document with which it reaches ``frame_ids``. Rows of equal key come in order of a hash of their text. Null and empty
    texts are the end id alone; other columns are not read; an empty table gives an empty folder with the schema.

    Texts cross the network once, to their range; every task codes its own range, frame by frame.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    own = docs.select(F.col(text).alias("text"), F.col(key).alias("key")).withColumn("tie", F.xxhash64("text"))
    placed = own.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("number", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType()),
    ])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, keys, sizes, ids, held, kind = TaskContext.get().partitionId(), 0, [], [], [], 0, None

        def frame() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            values = [[part], [number], [len(whole)], [keys], [sizes], [encode(whole)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], schema.names)

        for batch in batches:
            kind = batch.schema.field(1).type
            names, at = batch.column(1).to_pylist(), 0
            for found, counts in encoder(tokenizer).texts(*flat_bytes(batch.column(0))):
                ends = np.cumsum(counts)
                ids.append(np.insert(found, ends, end_id))
                keys += names[at : at + len(counts)]
                sizes += (counts + 1).tolist()
                at, held = at + len(counts), held + len(ids[-1])
                if held >= frame_ids:
                    yield frame()
                    number, keys, sizes, ids, held = number + 1, [], [], [], 0
        if keys:
            yield frame()

    placed.mapInArrow(code, schema).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document: (key, start, n_tokens, ids_crc32), decoded from the files; broken blocks raise.

    ``start`` counts the ids of all documents before it; running totals of the frames' sizes give it, in range partitions.
    """
    frames = spark.read.parquet(path)
    schema = T.StructType([
        *fields(frames, ["part", "number"]), T.StructField(key, frames.schema["keys"].dataType.elementType), T.StructField("within", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                keys, sizes = one.column("keys").flatten(), one.column("sizes").flatten().to_numpy()
                raw = decode(one.column("body")[0].as_py()).astype("<u4").tobytes()
                start = np.cumsum(sizes) - sizes
                check = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), sizes.tolist())]
                same = [pa.array(np.full(len(keys), one.column(c)[0].as_py())) for c in ("part", "number")]
                yield pa.RecordBatch.from_arrays([*same, keys, pa.array(start), pa.array(sizes), pa.array(check, pa.int64())], schema.names)

    before = running_totals(frames.select("part", "number", "n_ids"), [], ["part", "number"], ["n_ids"], before=True)
    found = frames.select("part", "number", "keys", "sizes", "body").mapInArrow(read, schema)
    joined = found.join(before.select("part", "number", F.col("cum_n_ids").alias("before")), ["part", "number"])
    return joined.select(key, (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
