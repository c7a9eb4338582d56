"""Token counts: lengths only, from batches of balanced bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import flat_bytes
from .common import fields, without
from .pieces import encoder


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` of each text under the tokenizer file ``tokenizer``.

    No begin, end or other added token, no truncation. A worker takes each Arrow batch in runs of about
    2 MB, splits longer texts at places where no token can cross, and gives the library only pieces that it has
    not met before; ids are counted and dropped. One narrow pass, no shuffle.

    ``keep`` names the columns that come along (default: all). Null and empty texts have 0 and 0. An input column
    with the name of a result is replaced. Equal rows stay as many as they are; an empty table gives an empty one.
    """
    carried = [c for c in without(docs, ["n_bytes", "n_tokens"]) if keep is None or c in keep]
    schema = T.StructType([*fields(docs, carried), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column(0))
            lengths = encoder(tokenizer).lengths(data, offsets)
            out = [batch.column(i + 1) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(offsets)), pa.array(lengths)], [*carried, "n_bytes", "n_tokens"])

    return docs.select(F.col(text).alias("_text"), *carried).mapInArrow(count, schema)
