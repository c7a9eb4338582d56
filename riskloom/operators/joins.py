"""Lookup joins that hold for any size of the lookup and any skew of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_ROWS = 1_000_000
STREAM_SALTS = 16


def fits_broadcast(lookup: DataFrame) -> bool:
    """True when a count shows that the lookup, with all its columns, stays under the broadcast bound."""
    size = (
        lookup.select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
        .limit(BROADCAST_ROWS + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, how: str = "left", small: bool | None = None,
                counted: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join each row with the at most one lookup row of its key.

    A lookup of checked size is broadcast. Otherwise both sides are shuffled, and a key with more than ``hot_rows`` rows is
    spread over as many tasks as it has that many rows; so no task gets more of one key. Keys are counted
    in ``counted`` (default ``df``), the only extra pass. The lookup is read up to twice and should be a written table. The
    keys of a stream are not known beforehand, so there every key is spread over 16 salts.
    """
    if small is None:
        small = fits_broadcast(lookup)
    if small:
        return df.join(F.broadcast(lookup), key, how)
    if df.isStreaming:
        salts = F.lit(STREAM_SALTS)
        return _salted_join(df.withColumn("_salts", salts), lookup.withColumn("_salts", salts), key, how)
    counted = df if counted is None else counted
    hot = write_table(
        counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
        .select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")),
        "hot",
    )
    if not fits_broadcast(hot):
        salts = F.lit(STREAM_SALTS)
        return _salted_join(df.withColumn("_salts", salts), lookup.withColumn("_salts", salts), key, how)
    known = F.coalesce("_salts", F.lit(1))
    left, right = (x.join(F.broadcast(hot), key, "left").withColumn("_salts", known) for x in (df, lookup))
    return _salted_join(left, right, key, how)


def _salted_join(df: DataFrame, lookup: DataFrame, key: str, how: str) -> DataFrame:
    """Both sides say in ``_salts`` over how many places a key goes; rows without a key go to any."""
    atoms = ("long", "integer", "string", "double")
    rest = [F.col(c).cast("string") for c in df.columns if c not in (key, "_salts") and df.schema[c].dataType.typeName() in atoms]
    places = F.when(F.col(key).isNull(), STREAM_SALTS * 16).otherwise(F.col("_salts"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(rest or [F.col(key)])), places).cast("int")).drop("_salts")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def merge_user_tables(tables: list[DataFrame]) -> DataFrame:
    """Full outer merge of per-user tables on ``user_id``, missing values 0.

    Union plus one aggregate: a single shuffle for any number of tables, with map-side combine.
    """
    if not tables:
        raise ValueError("no tables to merge")
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    values = [c for c in stacked.columns if c != "user_id"]
    return stacked.groupBy("user_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values])


def label_from_answers(users: DataFrame, answers: DataFrame, key: str = "user_id") -> DataFrame:
    """``y`` = 1 where the user is in the answer set, compared as exact text."""
    marked = write_table(answers.select(F.col(key).cast("string").alias(key)).na.drop().distinct().withColumn("_hit", F.lit(1)), "answers")
    joined = lookup_join(users.withColumn(key, F.col(key).cast("string")), marked, key)
    return joined.withColumn("y", F.coalesce(F.col("_hit"), F.lit(0)).cast("int")).drop("_hit")
