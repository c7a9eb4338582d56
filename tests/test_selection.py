"""Exact-size selection, splits, percentiles and running totals against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.hashing import uniform_scalar
from riskloom.operators import quantile, selection
from riskloom.operators.ordering import as_of_join, running_totals
from riskloom.operators.quantile import exact_percentile, exact_percentiles
from riskloom.operators.selection import random_k, split_by_group, split_quotas, stratified_split


@pytest.mark.parametrize("k", [0, 1, 137, 999, 1000, 2000])
def test_random_k_is_exact(spark, k):
    df = spark.range(0, 1000, numPartitions=5).withColumnRenamed("id", "row_id")
    got = {r[0] for r in df.filter(random_k(df, lambda n: k, 42, "s")).collect()}
    order = sorted(range(1000), key=lambda i: (uniform_scalar(42, "s", i), i))
    assert got == set(order[: min(k, 1000)])


def test_random_k_with_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(selection, "hash32", lambda seed, salt, key: F.pmod(key, F.lit(3)).cast("bigint"))
    df = spark.range(0, 90).withColumnRenamed("id", "row_id")
    got = {r[0] for r in df.filter(random_k(df, lambda n: 40, 1, "s")).collect()}
    assert got == {i for i in range(90) if i % 3 == 0} | set([i for i in range(90) if i % 3 == 1][:10])


def test_random_k_of_eligible_rows_only(spark):
    df = spark.range(0, 200).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).alias("ok"))
    hits = df.filter(random_k(df, lambda n: n // 2, 7, "s", eligible=F.col("ok"))).collect()
    assert len(hits) == 25 and all(r.ok for r in hits)


def test_split_quotas_largest_remainder():
    assert split_quotas({0: 700, 1: 100}) == {0: 175, 1: 25}
    sizes = {0: 88, 1: 13}
    test = split_quotas(sizes)
    assert sum(test.values()) == math.ceil(0.25 * 101)
    with pytest.raises(ValueError):
        split_quotas({0: 50, 1: 1})


def test_split_is_stable_over_partitions(spark):
    base = spark.range(0, 400).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    one = sorted(map(tuple, stratified_split(base.coalesce(1)).collect()))
    assert one == sorted(map(tuple, stratified_split(base.repartition(8)).collect()))
    counts = {(r.y, r.split): r["count"] for r in stratified_split(base).groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 270, (0, "test"): 90, (1, "train"): 30, (1, "test"): 10}


def test_single_class_split(spark):
    base = spark.range(0, 40).select(F.col("id").alias("row_id"), F.lit(0).alias("y"))
    assert stratified_split(base).filter("split = 'test'").count() == 10


@pytest.mark.parametrize("limit", [5, 20_000])
def test_percentiles_match_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(quantile, "FETCH_VALUES", limit)
    rng = np.random.default_rng(0)
    data = np.stack([rng.normal(size=4000), rng.integers(0, 6, 4000).astype(float), np.exp(3 * rng.normal(size=4000))], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double").repartition(6)
    for q in (0.0, 0.5, 0.9, 0.95, 1.0):
        got = exact_percentiles(df, {c: (F.col(c), q) for c in "abc"})
        for i, c in enumerate("abc"):
            assert got[c] == pytest.approx(np.percentile(data[:, i], 100 * q), rel=1e-12)


def test_narrowing_is_really_used(spark, monkeypatch):
    df = spark.range(0, 50_000).select(F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(quantile, "FETCH_VALUES", 10)
    assert exact_percentile(df, F.col("v"), 0.92) == pytest.approx(np.percentile(np.arange(50_000), 92))


@pytest.mark.parametrize("q", [0.3, 0.5, 0.5005, 0.9])
def test_percentile_between_heavy_values(spark, monkeypatch, q):
    monkeypatch.setattr(quantile, "FETCH_VALUES", 10)
    data = np.concatenate([np.zeros(30_000), np.linspace(0.1, 0.9, 700), np.ones(30_000)])
    df = spark.createDataFrame([(float(v),) for v in data], "v double").repartition(4)
    assert exact_percentile(df, F.col("v"), q) == pytest.approx(np.percentile(data, 100 * q), rel=1e-12)
    two = df.filter("v = 0 or v = 1")
    assert exact_percentile(two, F.col("v"), 0.5) == 0.5


def test_percentile_skips_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_percentile(df, F.col("v"), 0.5) == 2.0
    assert exact_percentile(df.filter("v > 100 and not isnan(v)"), F.col("v"), 0.5) is None


def test_running_totals_over_partitions(spark):
    rows = [(g, i, (i * 7) % 11) for g in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(5)
    got = {(r.g, r.o): r.cum_v for r in running_totals(df, ["g"], ["o"], ["v"]).collect()}
    for g in range(3):
        total = 0
        for i in range(200):
            total += (i * 7) % 11
            assert got[g, i] == total
    top = {r.o: r.cum_v for r in running_totals(df.filter("g = 0"), [], ["o"], ["v"], how="max", before=True).collect()}
    assert top[0] is None and top[5] == max((i * 7) % 11 for i in range(5))


def test_percentile_with_infinite_values(spark):
    df = spark.range(60_000).select(F.when(F.col("id") >= 57_012, F.lit(float("inf"))).otherwise(F.col("id").cast("double")).alias("x"))
    assert exact_percentile(df, F.col("x"), 0.95) == pytest.approx(56_999.05)
    assert exact_percentile(df, F.col("x"), 0.999) == float("inf")


def test_percentiles_of_many_columns(spark):
    df = spark.range(2000).select(*[(F.col("id") * (k + 1)).cast("double").alias(f"c{k}") for k in range(45)])
    got = exact_percentiles(df, {f"c{k}": (F.col(f"c{k}"), 0.5) for k in range(45)})
    assert all(got[f"c{k}"] == pytest.approx(999.5 * (k + 1)) for k in range(45))


def test_as_of_join_against_brute_force(spark):
    """A hot key over many partitions, ties at one time, gaps, missing keys and times."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"k{i % 9}", rng.randrange(200), "x") for i in range(3000)]
    rows += [(3000 + i, "hot", 77, None) for i in range(500)] + [(4000, None, 5, "y"), (4001, "hot", None, "y"), (4002, "alone", 9, "y")]
    versions = [("hot", t, t / 7) for t in range(50, 200, 3)] + [(f"k{i}", 60 + i, float(i)) for i in range(0, 9, 2)]
    versions += [("hot", 77, 99.0), ("hot", 80, None), (None, 1, 5.0), ("k1", None, 5.0), ("unused", 3, 1.0)]
    left = spark.createDataFrame(rows, "row_id long, k string, t int, value string")
    right = spark.createDataFrame(versions, "k string, at int, value double")
    got = as_of_join(left.repartition(5), right, "k", "t", "value", version_time="at")
    assert got.columns == ["row_id", "k", "t", "value"]

    def brute(k, t):
        known = [(at, v) for key, at, v in versions if None not in (k, t, key, at, v) and key == k and at <= t]
        return max(known)[1] if known else None

    assert {r.row_id: r.value for r in got.collect()} == {i: brute(k, t) for i, k, t, _ in rows}
    assert got.count() == len(rows)
    assert as_of_join(left, right.limit(0), "k", "t", "value", version_time="at").filter("value is not null").isEmpty()
    assert as_of_join(left.limit(0), right, "k", "t", "value", version_time="at").isEmpty()


@pytest.fixture(scope="module")
def owned(spark):
    """Users of 1 to 40 rows and one with a third of all rows; labels by user."""
    rng = np.random.default_rng(8)
    users = [f"u{k}" for k, n in enumerate(rng.integers(1, 40, 120)) for _ in range(n)]
    users += ["hot"] * (len(users) // 2) + [None] * 7
    rows = [(i, u, None if u is None else int(u.endswith("7"))) for i, u in enumerate(users)]
    return spark.createDataFrame(rows, "row_id long, user_id string, y int").cache()


def test_split_by_group_keeps_users_whole(owned):
    largest = owned.groupBy("user_id").count().agg(F.max("count")).first()[0]
    total = owned.count()
    for seed in range(4):
        split = split_by_group(owned, seed=seed)
        assert split.columns == [*owned.columns, "split"] and split.count() == total
        assert split.groupBy("user_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
        assert abs(split.filter("split = 'test'").count() - 0.25 * total) < largest


def test_split_by_group_is_exact_without_hot_users(owned):
    small = owned.filter("user_id <> 'hot'")
    split = split_by_group(small)
    assert abs(split.filter("split = 'test'").count() - 0.25 * small.count()) <= 20
    sides = {(r.split, r.y) for r in split.filter("y is not null").collect()}
    assert len(sides) == 4


def test_split_by_group_does_not_depend_on_partitions(owned):
    one, many = ({r.row_id: r.split for r in split_by_group(owned.repartition(n)).collect()} for n in (1, 9))
    assert one == many
    again = split_by_group(split_by_group(owned))
    assert {r.row_id: r.split for r in again.collect()} == one


def test_split_by_group_raises_on_one_group(owned):
    for rows in (owned.filter("user_id = 'hot'"), owned.limit(0)):
        with pytest.raises(ValueError):
            split_by_group(rows)
