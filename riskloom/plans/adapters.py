"""The generic tables of a data folder in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.scalars import flag
from ..operators.events import event_features

SEED = 42
LOG_TYPES = {"signup": "logon", "click": "logoff", "view": "device", "purchase": "email", "error": "file"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    return event_columns(table(spark, folder, "events"))


def event_columns(events: DataFrame) -> DataFrame:
    """Raw events, batch or stream, with the roles of an event schema."""
    events, k = events.withColumn("_k", _k()), F.col("_k")  # the text is parsed once a row
    place = F.when(k % 4 == 0, "Bangalore").when(k % 4 == 1, " bangalore ").when(k % 4 == 2, "Pune").otherwise("Delhi")
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("pc"), (k % 7).cast("string")).alias("device"),
        place.alias("location"),
        (F.col("value") * 5.0).alias("data_volume_mb"),
        (k % 6).alias("failed_attempts"),
        F.when(F.col("user_id") % 10 == 0, "Admin").otherwise("user").alias("privilege_level"),
    )


def labelled_events(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    frame, meta = event_features(event_table(spark, folder), SEED)
    return frame, {**meta, "categorical": ["action", "device", "location"]}


def log_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Four raw log tables made from the event types."""
    events = table(spark, folder, "events")
    user = F.col("user_id").cast("string").alias("user")
    activity = F.when(F.col("event_type") == "signup", "Logon").otherwise("Logoff")
    return {
        "logon": events.filter(F.col("event_type").isin("signup", "click")).select(
            F.col("event_id").alias("id"), F.col("ts").alias("date"), user, activity.alias("activity")
        ),
        "device": events.filter("event_type = 'view'").select(user, F.col("ts").alias("date")),
        "email": events.filter("event_type = 'purchase'").select(F.col("ts").alias("date"), user.alias("from")),
        "file": events.filter("event_type = 'error'").select(user, F.col("ts").alias("date")),
    }


def answer_set(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").filter("user_id % 10 = 0").select(F.col("user_id").cast("string").alias("user_id"))


def order_table(spark: SparkSession, folder: str) -> DataFrame:
    """A wide table with several rows per customer and no label."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("price"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("string")).otherwise("n.a.").alias("mostly"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise("n.a.").alias("rarely"),
    )


def given_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with deterministic probability, error and trust in the place of model output."""
    return (
        event_table(spark, folder)
        .select("row_id", "user_id")
        .withColumns(
            {
                "p": uniform(SEED, "p", "row_id"),
                "err": uniform(SEED, "err", "row_id"),
                "trust": F.greatest(F.lit(0.15), uniform(SEED, "trust", "user_id")),
                "y": flag(uniform(SEED, "y", "row_id") < 0.2),
            }
        )
    )


def planted_signal(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """Twelve features from the embeddings, shifted where a seeded label is 1."""
    base = table(spark, folder, "embeddings").withColumn("y", flag(uniform(SEED, "y", "vec_id") < 0.12))
    columns = [(F.col("embedding")[i].cast("double") * 8.0 + F.col("y")).alias(f"f{i}") for i in range(12)]
    frame = base.select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("U"), F.col("vec_id").cast("string")).alias("user_id"), *columns, "y"
    )
    return frame, {"label_source": "n/a", "categorical": []}


def drift_table(spark: SparkSession, folder: str) -> DataFrame:
    """Event values of the first and second half of the month, and the same with a planted shift."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    value = F.col("value")
    return table(spark, folder, "events").select(
        late.cast("int").alias("side"),
        F.array(value, value + F.when(late, 20.0).otherwise(0.0), F.lit(1.0)).alias("features"),
    )


def activity_stream_columns(events: DataFrame) -> DataFrame:
    """Raw events, batch or stream, as activities of a log."""
    kind = F.lit(None).cast("string")
    for event_type, activity in LOG_TYPES.items():
        kind = F.when(F.col("event_type") == event_type, activity).otherwise(kind)
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), kind.alias("activity")
    )


def scored_activity(events: DataFrame, *kept: str) -> DataFrame:
    """Raw events, batch or stream, with given probability, error and label, and the columns ``kept``."""
    key = "event_id"
    return events.select(
        *kept,
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"),
        uniform(SEED, "p", key).alias("p"), uniform(SEED, "err", key).alias("err"),
        flag(uniform(SEED, "y", key) < 0.2).alias("y"),
    )
