"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the built-in's fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but for ``names``: an operator's own columns replace the input's of the same name."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


def fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType, True) for c in names]


def crc32_of(key: Column) -> Column:
    """Unsigned CRC-32 of the key as text; null counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def give_back() -> None:
    """Return the memory that a worker has freed to the machine, where the C library can; a reused worker else keeps its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
