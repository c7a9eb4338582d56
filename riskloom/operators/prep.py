"""Split, encode and scale: labelled rows to model rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import named, to_number, to_text
from ..session import write_table
from .joins import fits_broadcast, lookup_join
from .ordering import running_totals
from .schema import numeric_feature_columns
from .selection import split_by_group, stratified_split


def value_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """Code table (name, value, code): position of each value among the sorted distinct ones."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), to_text(named(c)).alias("value")) for c in columns])
    distinct = train.select(F.explode(cells).alias("c")).select("c.name", "c.value").distinct()
    ranked = running_totals(distinct.withColumn("one", F.lit(1).cast("bigint")), ["name"], ["value"], ["one"])
    return write_table(ranked.select("name", "value", (F.col("cum_one") - 1).cast("double").alias("code")), "codes")


def ordinal_encode(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>_enc``; values that are not in the code table become -1.

    Keys are counted in the input as it came, so a column adds at most one scan of it.
    """
    small, base = fits_broadcast(codes), df
    for c in columns:
        table = codes.filter(F.col("name") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"{c}_enc"))
        df = lookup_join(df.withColumn(f"_{c}", to_text(named(c))), table, f"_{c}", "left", small,
                         None if small else base.select(to_text(named(c)).alias(f"_{c}")))
        df = df.withColumn(f"{c}_enc", F.coalesce(F.col(f"{c}_enc"), F.lit(-1.0))).drop(f"_{c}")
    return df


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; constant columns (smallest = largest) are divided by 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Scaler":
        row = df.agg(
            *[(F.min(named(c)) == F.max(named(c))).alias(f"same{i}") for i, c in enumerate(columns)],
            *[F.avg(named(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(named(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        means, scales = [], []
        for i in range(len(columns)):
            mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
            means.append(mean)
            scales.append(1.0 if row[f"same{i}"] or not std else std)
        return Scaler(tuple(columns), tuple(means), tuple(scales))

    def features(self):
        """The scaled columns as one ``array<double>``."""
        parts = zip(self.columns, self.means, self.scales)
        return F.array(*[(named(c) - F.lit(m)) / F.lit(s) for c, m, s in parts])


@dataclass(frozen=True)
class Preparation:
    """Fitted encoding and scaling, reusable on test rows, new batches and streams."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    codes: DataFrame | None
    scaler: Scaler

    @property
    def names(self) -> list[str]:
        return list(self.scaler.columns)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return _encoded(df, self.numeric, self.categorical, self.codes).select(*keep, self.scaler.features().alias("features"))


def _encoded(df: DataFrame, numeric, categorical, codes) -> DataFrame:
    filled = {c: F.coalesce(to_number(named(c), df.schema[c].dataType), F.lit(0.0)) for c in numeric}
    df = df.withColumns(filled) if filled else df
    return ordinal_encode(df, codes, list(categorical)) if categorical else df


def prepare(df: DataFrame, categorical: list[str] | tuple = (), seed=42, test_size: float = 0.25,
            split_by: str = "row") -> tuple[DataFrame, Preparation]:
    """Split rows, fit encoder and scaler on the train side, and return the model rows.

    Result columns: row_id, user_id, y, split, features. The frame is written once, because
    every later stage reads it. ``split_by`` is ``row``, or ``user`` to keep all rows of a user on one side.
    """
    if split_by not in ("row", "user"):
        raise ValueError(f"unknown split {split_by!r}")
    categorical = [c for c in categorical if c in df.columns]
    numeric = [c for c in numeric_feature_columns(df) if c not in categorical]
    split = split_by_group(df, "user_id", seed, test_size) if split_by == "user" else stratified_split(df, seed, test_size)
    train = split.filter(F.col("split") == "train")
    codes = value_codes(train, categorical) if categorical else None
    encoded = _encoded(split, numeric, categorical, codes)
    columns = numeric + [f"{c}_enc" for c in categorical]
    scaler = Scaler.fit(encoded.filter(F.col("split") == "train"), columns)
    fitted = Preparation(tuple(numeric), tuple(categorical), codes, scaler)
    rows = encoded.select("row_id", "user_id", "y", "split", scaler.features().alias("features"))
    return write_table(rows, "prepared"), fitted
