"""Null rules, edges of hours and labels, and the seeded draw."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import hash32, normal, uniform, uniform_scalar
from riskloom.functions.scalars import binarize_label, clip, hour_or_noon, row_sum, to_number
from riskloom.operators.logs import after_hours
from riskloom.operators.prep import Scaler
from riskloom.operators.respond import risk_score


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_hash_is_the_published_integer(spark):
    df = spark.createDataFrame([("x",)], "k string")
    assert column(df, hash32(42, "salt", "k")) == [int(uniform_scalar(42, "salt", "x") * 2**32)]
    assert column(df, uniform(42, "o'cl\\ock", "k")) == [uniform_scalar(42, "o'cl\\ock", "x")]
    expected = uniform_scalar(42, "salt", "x")
    assert column(df, uniform(42, "salt", "k")) == [expected]


def test_draws_do_not_depend_on_partitions(spark):
    one = column(spark.range(0, 500, numPartitions=1).orderBy("id"), normal(1, "n", "id"))
    many = column(spark.range(0, 500, numPartitions=7).orderBy("id"), normal(1, "n", "id"))
    assert one == many
    mean = sum(one) / 500
    assert abs(mean) < 0.2 and 0.8 < sum((v - mean) ** 2 for v in one) / 500 < 1.2


def test_hours_of_texts_and_stamps(spark):
    rows = [("2024-01-02 05:59:59",), ("01/02/2024 19:30",), ("1/2/2024 7:05:09",), ("junk",), (None,), ("2024-01-02T20:00:00",)]
    df = spark.createDataFrame(rows, "t string")
    assert column(df, hour_or_noon(F.col("t"), T.StringType())) == [5, 19, 7, 12, 12, 20]
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 6, 59),), (None,)], "t timestamp")
    assert column(df, hour_or_noon(F.col("t"), T.TimestampType())) == [6, 12]


def test_after_hours_edges(spark):
    df = spark.createDataFrame([(h,) for h in (6, 7, 19, 20, 12)], "h int")
    assert column(df, after_hours(F.col("h"))) == [1, 0, 0, 1, 0]


def test_numeric_labels_truncate_and_clip(spark):
    df = spark.createDataFrame([(0.9,), (2.0,), (-1.0,), (None,), (float("nan"),), (1.0,)], "v double")
    assert column(df, binarize_label(F.col("v"), T.DoubleType())) == [0, 1, 0, 0, 0, 1]


def test_text_labels_use_the_word_list(spark):
    df = spark.createDataFrame([(" YES ",), ("Attack",), ("2",), (None,), ("1",), ("no",)], "v string")
    assert column(df, binarize_label(F.col("v"), T.StringType())) == [1, 1, 0, 0, 1, 0]


def test_numbers_of_texts(spark):
    df = spark.createDataFrame([(" 5 ",), ("1e3",), ("5d",), ("x",), ("nan",), (None,)], "v string")
    assert column(df, to_number(F.col("v"), T.StringType())) == [5.0, 1000.0, None, None, None, None]


def test_row_sum_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 2)], "a double, b double, c int")
    assert column(df, row_sum(["a", "b", "c"])) == [3.0]


def test_clip_and_risk_keep_nulls(spark):
    row = spark.range(1).select(
        clip(F.lit(None).cast("double"), 0.0, 1.0).alias("a"), clip(F.lit(7.0), 0.0, 1.0).alias("b"),
        risk_score(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.9), 1.0).alias("c"), risk_score(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.9), 1.0).alias("d"),
    ).first()
    assert tuple(row) == (None, 1.0, None, None)


def test_scaler_with_a_large_mean(spark):
    df = spark.range(1000).select((F.lit(1.7e9) + F.col("id") % 2).alias("t"), F.lit(5.5).alias("c"))
    scaler = Scaler.fit(df, ["t", "c"])
    assert scaler.scales[0] == pytest.approx(0.5) and scaler.scales[1] == 1.0
