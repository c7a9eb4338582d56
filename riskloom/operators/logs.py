"""Per-user features from raw log tables and from wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import binarize_label, flag, hour_or_noon, is_number, named, row_sum, to_text
from ..functions.vocabulary import MIN_TABULAR_ROWS
from ..session import write_table
from .joins import label_from_answers
from .quantile import exact_percentile
from .schema import coerce_mostly_numeric, dtype_of, log_roles, tabular_roles

COUNT_NAMES = {"device": "device_events", "email": "email_events", "file": "file_events"}
LABEL_PERCENTILE = 0.92


def after_hours(hour: Column) -> Column:
    """1 before 07:00 and from 20:00 on."""
    return flag((hour < 7) | (hour > 19))


def log_rows(df: DataFrame, kind: str) -> DataFrame:
    """One row per log record: ``user_id`` and its contribution to each count."""
    role = log_roles(df.columns, kind)
    user = to_text(named(role["user"])).alias("user_id")
    if kind != "logon":
        return df.select(user, F.lit(1).cast("bigint").alias(COUNT_NAMES[kind]))
    if role["activity"]:
        activity = F.lower(to_text(named(role["activity"])))
        on, off = flag(activity == "logon"), flag(activity == "logoff")
    else:
        on, off = F.lit(1), F.lit(0)
    if role["time"]:
        late = after_hours(hour_or_noon(named(role["time"]), dtype_of(df, role["time"])))
    else:
        late = F.lit(0)
    return df.select(
        user,
        on.cast("bigint").alias("logon_count"),
        off.cast("bigint").alias("logoff_count"),
        late.cast("bigint").alias("after_hours"),
    )


def log_features(df: DataFrame, kind: str) -> DataFrame:
    """Counts per user of one log table."""
    rows = log_rows(df, kind)
    return rows.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "user_id"])


def user_log_features(logs: dict[str, DataFrame | list[DataFrame]]) -> DataFrame:
    """All log tables (one or several of a kind) to one row per user: one union and one aggregate, so one shuffle."""
    stacked = None
    for kind, df in ((k, df) for k, dfs in logs.items() for df in (dfs if isinstance(dfs, list) else [dfs])):
        rows = log_rows(df, kind)
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no log tables")
    values = [c for c in stacked.columns if c != "user_id"]
    return stacked.groupBy("user_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values])


def percentile_label(df: DataFrame, features: list[str], q: float = LABEL_PERCENTILE) -> DataFrame:
    """``y`` = 1 where the row sum of the features reaches its q-percentile.

    The rows are written first, because the percentile needs several passes over their sums.
    """
    df = write_table(df, "unlabelled")
    threshold = exact_percentile(df, row_sum(features), q)
    limit = F.lit(threshold).cast("double")
    return df.withColumn("y", flag(F.coalesce(row_sum(features) >= limit, F.lit(False))))


def user_means(df: DataFrame, user_col: str, features: list[str], label: str | None = None) -> DataFrame:
    """Mean of each feature per user (nulls skipped) and, with a label column, its maximum."""
    user = F.trim(to_text(named(user_col))).alias("user_id")
    aggregates = [F.avg(named(c).cast("double")).alias(c) for c in features]
    if label:
        aggregates.append(F.max(binarize_label(named(label), df.schema[label].dataType)).alias("y"))
    return df.groupBy(user).agg(*aggregates)


def tabular_user_features(df: DataFrame, answers: DataFrame | None = None, min_rows: int = MIN_TABULAR_ROWS) -> tuple[DataFrame, dict] | None:
    """Wide table to labelled user rows; None when it has too few rows, no user or no feature.

    Labels come from the label column, else the answer set, else the percentile rule.
    """
    role = tabular_roles(df.columns)
    if role["user"] is None:
        return None
    skip = tuple(c for c in (role["user"], role["label"], "row_id") if c)
    converted, features, n = coerce_mostly_numeric(df, skip)
    if n < min_rows or not features:
        return None
    users = user_means(converted, role["user"], features, role["label"])
    source = "label_column"
    if not role["label"]:
        if answers is not None and not answers.isEmpty():
            users, source = label_from_answers(users, answers), "answers"
        else:
            users, source = percentile_label(users, features), "percentile"
    meta = {"label_source": source, "label_column": role["label"], "feature_columns": features, "n_rows": n}
    return users.select("user_id", *[named(c) for c in features], "y"), meta


def is_usable_table(df: DataFrame, min_rows: int = MIN_TABULAR_ROWS) -> bool:
    """At least ``min_rows`` rows, a user column and at least one numeric feature."""
    role = tabular_roles(df.columns)
    if role["user"] is None:
        return False
    skip = tuple(c for c in (role["user"], role["label"]) if c)
    _, features, n = coerce_mostly_numeric(df, skip)
    return n >= min_rows and bool(features)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]
