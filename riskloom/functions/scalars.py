"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import POSITIVE_WORDS, TIME_LAYOUTS


def named(name: str) -> Column:
    """Column by its literal name, also with dots or blanks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def clip(x: Column, low: float, high: float) -> Column:
    """Keep x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_number(x: Column, dtype: T.DataType) -> Column:
    """Double, or null where the cell is no number."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = x.cast("double")
    else:
        text = F.trim(x.cast("string"))
        # Java also reads "5d" and "5f" as numbers
        value = F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def to_text(x: Column) -> Column:
    """Text of the cell; a missing cell becomes the word ``nan``."""
    return F.coalesce(x.cast("string"), F.lit("nan"))


def hour_or_null(x: Column, dtype: T.DataType) -> Column:
    """Hour of day; null where the time is missing or unreadable."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        stamp = x
    elif isinstance(dtype, T.DateType):
        stamp = x.cast("timestamp_ntz")
    else:
        text = F.trim(x.cast("string"))
        stamp = F.coalesce(
            text.try_cast("timestamp_ntz"),
            *[F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in TIME_LAYOUTS],
        )
    return F.hour(stamp)


def hour_or_noon(x: Column, dtype: T.DataType) -> Column:
    """Hour of day; 12 where the time is missing or unreadable."""
    return F.coalesce(hour_or_null(x, dtype), F.lit(12)).cast("int")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("int")


def binarize_label(x: Column, dtype: T.DataType) -> Column:
    """0/1 label: numbers are truncated and clipped, texts are looked up in the positive words."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = x.cast("double")
        return flag(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)) >= 1)
    return flag(F.coalesce(F.lower(F.trim(x.cast("string"))), F.lit("nan")).isin(*POSITIVE_WORDS))


def row_sum(columns: list[str]) -> Column:
    """Sum over the columns of a row, missing cells skipped."""
    return reduce(
        lambda a, b: a + b, [F.coalesce(named(c).cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0)
    )
