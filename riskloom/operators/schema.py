"""Column roles: aliases, defaults and numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_number, named, to_number
from ..functions.vocabulary import (
    EVENT_ALIASES,
    LEAKAGE_NAMES,
    LOG_TIME_ALIASES,
    LOG_USER_ALIASES,
    TABULAR_LABEL_ALIASES,
    TABULAR_USER_ALIASES,
)


_JOINERS = str.maketrans(" -", "__")


def normal_name(name: str) -> str:
    """Lower case, blanks around it dropped, blanks and hyphens inside as underscores."""
    return name.strip().translate(_JOINERS).lower()


def first_alias(by_name: dict[str, str], aliases: tuple[str, ...]) -> str | None:
    return next((by_name[a] for a in aliases if a in by_name), None)


def event_roles(columns: list[str]) -> dict[str, str | None]:
    """Actual column per role of an event table, None where the role is absent."""
    by_name = {normal_name(c): c for c in columns}
    return {role: first_alias(by_name, aliases) for role, aliases in EVENT_ALIASES.items()}


def has_event_columns(columns: list[str]) -> bool:
    """User, time and at least one of volume, failures, location, privilege."""
    role = event_roles(columns)
    context = ("volume", "failed", "location", "privilege")
    return bool(role["user"] and role["time"] and any(role[r] for r in context))


def is_event_schema(df: DataFrame) -> bool:
    return has_event_columns(df.columns) and not df.isEmpty()


def log_roles(columns: list[str], kind: str) -> dict[str, str | None]:
    """User, activity and time columns of a log table; the user column always resolves."""
    lowered = {c.lower(): c for c in columns}
    position = 2 if kind == "logon" and len(columns) >= 3 else 0  # where such logs have the user if no name tells
    return {
        "user": first_alias(lowered, LOG_USER_ALIASES[kind]) or columns[position],
        "activity": lowered.get("activity"),
        "time": first_alias(lowered, LOG_TIME_ALIASES),
    }


def tabular_roles(columns: list[str]) -> dict[str, str | None]:
    """User and label columns of a wide table."""
    by_name = {c.strip().lower(): c for c in columns}
    user = first_alias(by_name, TABULAR_USER_ALIASES) or next(
        (c for low, c in by_name.items() if "user" in low or low.endswith("_id")), None
    )
    return {"user": user, "label": first_alias(by_name, TABULAR_LABEL_ALIASES)}


def column_or_default(name: str | None, default) -> Column:
    return named(name) if name else F.lit(default)


def dtype_of(df: DataFrame, name: str | None) -> T.DataType:
    return df.schema[name].dataType if name else T.StringType()


def numeric_feature_columns(df: DataFrame, user_col: str = "user_id", also_not: tuple = ("row_id",)) -> list[str]:
    """Numeric columns in order, without keys and label-like names; booleans do not count."""
    skip = {user_col, *also_not}
    return [
        f.name
        for f in df.schema
        if is_number(f.dataType) and f.name not in skip and normal_name(f.name) not in LEAKAGE_NAMES
    ]


def coerce_mostly_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], int]:
    """Turn columns that are mostly numbers into doubles.

    A column is kept when at least max(3, int(0.85 n)) cells are numbers; its other cells become
    null. All columns are judged in one aggregate. Returns the frame, the feature columns in
    order, and n.
    """
    fields = [f for f in df.schema if f.name not in exclude]
    texts = [f for f in fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(to_number(named(f.name), f.dataType)).alias(f"c{i}") for i, f in enumerate(texts)],
    ).first()
    need = max(3, int(0.85 * counted["n"]))
    dropped = {f.name for i, f in enumerate(texts) if counted[f"c{i}"] < need}
    features = [f.name for f in fields if f.name not in dropped]
    converted = {f.name: to_number(named(f.name), f.dataType) for f in fields if f.name in set(features)}
    return df.withColumns(converted) if converted else df, features, counted["n"]
