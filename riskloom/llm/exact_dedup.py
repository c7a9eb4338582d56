"""Exact de-duplication: a Bloom filter of the repeated hashes decides which rows have to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import fresh, lower_az, without

MOST_WORDS = 1 << 20
ROWS_PER_WORD = 2
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def _mask(h: Column) -> Column:
    """Three bits of one 64-bit word."""
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if identical after lower-casing A-Z. Of equal texts the row with the largest key stays (null is
    smallest; of equal keys one row stays). Null counts as an empty text. ``carry`` names the columns that come
    along (default: all); an input column with the name of a result is replaced.

    Pass 1 writes the digest of each row, counts filter signatures (a word of the filter and three bits
    in it; two numbers a row, combined before the shuffle) and sets the bits of those that occur twice. Pass 2
    tests every row: one whose bits are not all set is surely single and passes straight through. Only the others
    meet by digest. Their groups are written, so that a group of any size is joined back by a plain join, whose
    large keys Spark splits.

    The filter has one 64-bit word for two rows and at most 2**20 words (8 MB), so it can be broadcast at any
    input size; beyond about 10 million rows more single rows hit it by chance and take the shuffle, the result stays.
    """
    carried = [c for c in without(docs, RESULT) if carry is None or c in carry]
    names = {n: fresh(docs, n) for n in ("_row", "_word", "_mask", "_bits", "_sha")}
    row, word, mask, bits, sha = names.values()
    hashed = write_table(
        docs.select(*carried, F.col(key).alias(fresh(docs, "_key")), F.sha2(lower_az(F.coalesce(F.col(text), F.lit(""))), 256).alias(sha))
        .withColumn(row, F.monotonically_increasing_id()),
        "digests",
    )
    own = fresh(docs, "_key")
    rows, words = hashed.count(), 1
    while words < MOST_WORDS and words * ROWS_PER_WORD < rows:
        words *= 2
    signed = hashed.withColumn(word, F.pmod(F.xxhash64(sha), F.lit(words))).withColumn(mask, _mask(F.xxhash64(sha, F.lit(1))))
    repeated = signed.groupBy(word, mask).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    bloom = repeated.groupBy(word).agg(F.bit_or(mask).alias(bits))
    tested = signed.join(F.broadcast(bloom), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    maybe, single = tested.filter(hit), tested.filter(~hit)
    groups = write_table(
        maybe.groupBy(sha).agg(F.max(F.struct(F.col(own), F.col(row))).alias("_last"), F.count(F.lit(1)).alias("group_size"))
        .select(sha, F.col(f"_last.{own}").alias("keep_id"), F.col(f"_last.{row}").alias("_kept_row"), "group_size"),
        "groups",
    )
    return single.select(
        *carried, F.col(own).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col(sha).alias("text_sha256")
    ).unionByName(
        maybe.join(groups, sha).select(*carried, "keep_id", "group_size", (F.col(row) == F.col("_kept_row")).alias("kept"), F.col(sha).alias("text_sha256"))
    )
