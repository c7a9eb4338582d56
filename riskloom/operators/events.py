"""Features and labels of an event table (one row per event)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.scalars import binarize_label, flag, hour_or_noon, to_number, to_text
from ..functions.vocabulary import ALLOWED_LOCATIONS, DEFAULT_LOCATION, EVENT_NUMERIC_COLUMNS
from ..session import write_table
from .joins import lookup_join
from .schema import column_or_default, dtype_of, event_roles


def resolve_events(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rename the columns of any accepted event schema to the canonical roles."""
    role = event_roles(df.columns)
    if not (role["user"] and role["time"]):
        raise ValueError("an event table needs a user and a time column")
    picked = [F.col(row_id).alias("row_id"), F.trim(to_text(column_or_default(role["user"], ""))).alias("user_id")]
    picked.append(hour_or_noon(column_or_default(role["time"], ""), dtype_of(df, role["time"])).alias("hour"))
    picked += [
        _text_or_default(role["action"], "unknown").alias("action"),
        _text_or_default(role["device"], "unknown").alias("device"),
        _text_or_default(role["location"], DEFAULT_LOCATION).alias("location"),
    ]
    for name, output in (("volume", "data_volume_mb"), ("failed", "failed_attempts")):
        value = to_number(column_or_default(role[name], "0"), dtype_of(df, role[name]))
        picked.append(F.coalesce(value, F.lit(0.0)).alias(output))
    privilege = F.lower(F.trim(_text_or_default(role["privilege"], "user")))
    picked.append(flag(privilege == "admin").cast("double").alias("privilege_level"))
    if role["label"]:
        picked.append(binarize_label(column_or_default(role["label"], 0), dtype_of(df, role["label"])).alias("y"))
    return df.select(*picked)


def _text_or_default(name: str | None, default: str) -> Column:
    return to_text(column_or_default(name, default)) if name else F.lit(default)


def seeded_columns(seed=42, row_id: str = "row_id") -> dict[str, Column]:
    """Noise features: whole minutes 1..120 and a level 0..2, unrelated to the row's content."""
    key = row_id
    return {
        "session_duration": F.lit(1.0) + F.floor(F.lit(120.0) * uniform(seed, "session_duration", key)),
        "file_sensitivity": F.floor(F.lit(3.0) * uniform(seed, "file_sensitivity", key)).cast("double"),
    }


def rule_score() -> Column:
    """Weighted sum of four risk conditions over canonical event columns."""
    risky_place = ~F.lower(F.trim("location")).isin(*ALLOWED_LOCATIONS)
    return (
        flag(F.col("failed_attempts") > 3) * F.lit(0.4)
        + flag(F.col("data_volume_mb") > 500) * F.lit(0.3)
        + flag(risky_place) * F.lit(0.2)
        + flag(F.col("privilege_level") == 1) * F.lit(0.1)
    )


def rule_label(seed=42, row_id: str = "row_id") -> Column:
    """1 where the rule score plus uniform noise in (-0.2, 0.2) exceeds 0.5."""
    noise = F.lit(0.4) * uniform(seed, "rule_noise", row_id) - F.lit(0.2)
    return flag(rule_score() + noise > 0.5)


def row_features(resolved: DataFrame, seed=42) -> DataFrame:
    """The features that need one row only; also valid on a stream."""
    return resolved.withColumns(
        {
            "is_night": flag(F.col("hour") < 6).cast("double"),
            "high_data_transfer": flag(F.col("data_volume_mb") > 500).cast("double"),
            "hour": F.col("hour").cast("double"),
            **seeded_columns(seed),
        }
    )


def login_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("login_frequency"))


def login_frequency(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Events of the same user, on every row: pre-aggregated counts and a skew-safe lookup."""
    counts = write_table(login_counts(df), "counts") if counts is None else counts
    return lookup_join(df, counts, "user_id", "left")


def event_features(df: DataFrame, seed=42, row_id: str = "row_id") -> tuple[DataFrame, dict]:
    """Canonical feature rows with ``y``, and the facts about them.

    A label column is used when present, otherwise the rule label.
    """
    resolved = resolve_events(df, row_id)
    provided = "y" in resolved.columns
    rows = login_frequency(row_features(resolved, seed))
    if not provided:
        rows = rows.withColumn("y", rule_label(seed))
    columns = ["action", "device", "location", *EVENT_NUMERIC_COLUMNS]
    meta = {
        "label_source": "provided" if provided else "probabilistic_rules",
        "feature_columns": columns,
        "schema": "custom_insider_events",
    }
    return rows.select("row_id", "user_id", *columns, "y"), meta
