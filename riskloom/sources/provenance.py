"""Fingerprints and provenance records of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import named
from ..functions.vocabulary import PIPELINE_VERSION
from .csv_files import files_below

#: Digests are polynomials over the whole numbers below this prime: sum of (hash of line i) x base^i.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 40_014_111, 742_938_285, 1_226_874_159)
DIGIT_BITS, DIGITS = 6, 6  # line numbers below 2^36 in digits of 6 bits


def _times(a: Column, b: Column) -> Column:
    """Product below the prime; both factors are, so it fits 62 bits."""
    return F.pmod(a * b, F.lit(PRIME))


def _power(base: int, exponent: Column) -> Column:
    """base^exponent below the prime, from a table of powers for each digit of the exponent."""
    out = None
    for digit in range(DIGITS):
        powers = ", ".join(f"{pow(base, k << (DIGIT_BITS * digit), PRIME)}L" for k in range(1 << DIGIT_BITS))
        at = F.shiftright(exponent, DIGIT_BITS * digit).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
        factor = F.get(F.expr(f"array({powers})"), at)
        out = factor if out is None else _times(out, factor)
    return out


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One digest per CSV file (path, digest): the same rule for files of any size and any splits of them.

    The digest is over the lines and their order: a polynomial in four bases whose coefficients are the four words of each line's MD5.
    Polynomials of two neighbouring stretches combine by a shift (a power of the base) and a sum, so every split of a file
    is summed on its own in the one pass over the lines, and only one row a split is ordered.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts the lines of a task, which may read several splits
    lines = spark.read.options(**options).text(folder).select(
        F.md5("value").alias("h"), row.alias("at"), _plain(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    terms = [_times(F.pmod(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint"), F.lit(PRIME)), _power(base, F.col("at")))
             for i, base in enumerate(BASES)]
    split = lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"),
        *[F.pmod(F.sum(t), F.lit(PRIME)).alias(f"s{i}") for i, t in enumerate(terms)],
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = split.withColumn("before", before)
    moved = [
        _times(_times(F.col(f"s{i}"), _power(pow(base, -1, PRIME), F.col("first"))), _power(base, F.col("before")))
        for i, base in enumerate(BASES)
    ]
    whole = placed.groupBy("path").agg(F.sum("n").alias("n"), *[F.pmod(F.sum(m), F.lit(PRIME)).alias(f"s{i}") for i, m in enumerate(moved)])
    digests = whole.select("path", F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(len(BASES))]), 256).alias("digest"))
    # scans skip empty files, the listing does not
    names = spark.createDataFrame([(p,) for p in files_below(spark, folder)], "path string")
    return names.join(digests, "path", "left").withColumn("digest", F.coalesce("digest", F.sha2(F.lit(""), 256)))


def _plain(uri: Column) -> Column:
    """Column twin of the path form used by the file listing."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def _word(digest: Column, at: int) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")


def content_fingerprint(spark: SparkSession, folder: str, sources: int | None = None) -> DataFrame:
    """One row: digest over names and contents of all CSV files, their number, and their sorted paths.

    The digest changes with any name or content (see :func:`file_digests`); per-file hashes are summed like
    those of lines, so no task needs all names. ``sources`` limits the list of paths; ``n_sources`` always counts all.
    """
    files = file_digests(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    entry = F.md5(F.concat_ws(":", "name", "digest"))
    listed = F.sort_array(F.collect_list("path"))
    return files.agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(_word(entry, 1)), F.sum(_word(entry, 9)), F.sum(_word(entry, 17))), 256)
        .alias("content_sha256"),
        F.count(F.lit(1)).alias("n_sources"),
        (listed if sources is None else F.slice(listed, 1, sources)).alias("sources"),
    )


def table_fingerprint(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """Row count and sums of row hashes: independent of row order and partitioning.

    A row is hashed as JSON, so nulls, empty texts and separators inside cells differ. The sums are kept
    as decimals, as they pass 64 bits from some four billion rows on.
    """
    columns = columns or [named(c) for c in df.columns]
    digest = F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)])))
    return df.select(digest.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(_word(F.col("h"), 1)).cast("string").alias("hash_a"),
        F.sum(_word(F.col("h"), 9)).cast("string").alias("hash_b"),
    )


def provenance_record(spark: SparkSession, folder: str) -> DataFrame:
    """One row: dataset id, digest, sources, time, version and metadata."""
    return content_fingerprint(spark, folder).select(
        F.concat(F.lit("cert_batch:"), F.substring("content_sha256", 1, 16)).alias("dataset_id"),
        "content_sha256",
        "n_sources",
        "sources",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_utc"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        F.create_map(F.lit("root"), F.lit(folder)).alias("metadata"),
    )


def table_provenance(df: DataFrame, source: str, columns: list[Column] | None = None) -> DataFrame:
    """The same record for a table that is not a CSV folder."""
    digest = F.sha2(F.concat_ws(":", "n_rows", "hash_a", "hash_b"), 256)
    return table_fingerprint(df, columns).select(
        F.concat(F.lit("table:"), F.substring(digest, 1, 16)).alias("dataset_id"),
        digest.alias("content_sha256"),
        F.array(F.lit(source)).alias("sources"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_utc"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        F.create_map(F.lit("root"), F.lit(source)).alias("metadata"),
    )
