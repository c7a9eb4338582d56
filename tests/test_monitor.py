"""Drift, overfit messages and decisions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.monitor import _ks_exact_p, ks_drift, overfit_flags, realism_summary, top_features
from riskloom.operators.respond import decide, threat_columns, threat_level_counts, trust_lookup


def brute_ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), grid, side="right") / len(a) - np.searchsorted(np.sort(b), grid, side="right") / len(b)).max()


def brute_p(d, n1, n2):
    hit = total = 0
    for ones in itertools.combinations(range(n1 + n2), n1):
        i = j = 0
        worst = 0.0
        for k in range(n1 + n2):
            if k in ones:
                i += 1
            else:
                j += 1
            worst = max(worst, abs(i / n1 - j / n2))
        total += 1
        hit += worst >= d - 1e-12
    return hit / total


@pytest.mark.parametrize("n1,n2", [(4, 4), (5, 3), (6, 4), (3, 7)])
def test_exact_p_counts_paths(n1, n2):
    for h in range(1, n1 * n2 + 1, 3):
        d = h / (n1 * n2)
        reachable = {abs(i / n1 - j / n2) for i in range(n1 + 1) for j in range(n2 + 1)}
        nearest = min(reachable, key=lambda v: abs(v - d))
        if nearest > 0:
            assert _ks_exact_p(nearest, n1, n2) == pytest.approx(brute_p(nearest, n1, n2), abs=1e-12)


def test_exact_p_of_large_samples_is_near_the_series():
    d, n1, n2 = 0.03, 6000, 4000
    z2 = d * d * n1 * n2 / (n1 + n2)
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z2) for k in range(1, 50))
    assert _ks_exact_p(d, n1, n2) == pytest.approx(series, rel=0.1)


def test_exact_p_beyond_200000_rows_on_a_side(spark):
    """Sides of equal size have a closed form by reflection; other sizes run through the query's path."""
    n, k = 1_000_000, 1200
    ratios = [1.0]
    for j in range(1, 10 * k + 1):  # C(2n, n - j) / C(2n, n)
        ratios.append(ratios[-1] * (n - j + 1) / (n + j))
    assert _ks_exact_p(k / n, n, n) == pytest.approx(2 * sum((-1) ** (j - 1) * ratios[j * k] for j in range(1, 11)), abs=1e-9)
    assert _ks_exact_p(0.5, n, n + 1) == 0.0
    m = F.col("id")
    df = spark.range(430_000).select((m % 2).cast("int").alias("side"), F.array((m % 1009).cast("double"), F.floor(m / 2) % 7 + 3.0 * (m % 2)).alias("features"))
    got = {r.feature: r for r in ks_drift(df, ["same", "moved"], F.col("side"), method="exact").collect()}
    assert got["same"].p_value > 0.99 and got["moved"].p_value == 0.0 and got["moved"].drift_flag


def test_drift_of_features(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=(200, 3)), 1)
    b = np.round(rng.normal(size=(150, 3)) + [0, 1, 0], 1)
    a[:, 2] = 4.0
    rows = [(0, [float(v) for v in r]) for r in a] + [(1, [float(v) for v in r]) for r in b]
    df = spark.createDataFrame(rows, "side int, features array<double>").repartition(5)
    got = {r.feature: r for r in ks_drift(df, ["same", "moved", "constant"], F.col("side"), method="exact").collect()}
    assert got["same"].ks_statistic == pytest.approx(brute_ks(a[:, 0], b[:, 0]))
    assert got["moved"].ks_statistic == pytest.approx(brute_ks(a[:, 1], b[:, 1]))
    assert got["moved"].drift_flag and not got["same"].drift_flag
    assert (got["constant"].ks_statistic, got["constant"].p_value) == (0.0, 1.0)
    self_test = df.filter("side = 0").unionByName(df.filter("side = 0").withColumn("side", F.lit(1)))
    assert all(r.ks_statistic == 0.0 and r.p_value == 1.0 for r in ks_drift(self_test, list("abc"), F.col("side"), method="exact").collect())


def test_overfit_messages(spark):
    rows = [("accuracy", 0.99), ("f1", 0.98), ("roc_auc", float("nan")), ("recall", 1.0)]
    metrics = spark.createDataFrame(rows, "metric string, value double")
    got = sorted(r.message for r in overfit_flags(metrics).collect())
    assert len(got) == 2 and any("accuracy of 0.990 is above 0.98" in m for m in got)
    assert overfit_flags(metrics.filter("metric = 'f1'")).count() == 0
    row = realism_summary(metrics, 0.08, 5, True).first()
    assert len(row.overfitting_warnings) == 2 and row.labels_randomly_flipped_after_load == 5


def test_levels_at_their_bounds(spark):
    df = spark.createDataFrame([(0.78,), (0.7799,), (0.55,), (0.5499,), (0.35,), (0.3499,)], "r double")
    got = df.withColumns(threat_columns(F.col("r"))).collect()
    assert [r.threat_level for r in got] == ["critical", "elevated", "elevated", "watch", "watch", "normal"]
    assert got[0].actions[0] == "block_high_risk_session" and got[5].actions == ["allow"]


def test_risk_uses_default_trust_and_clipped_error(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("b", 0.0, 0.0)], "user_id string, p double, err double")
    trust = spark.createDataFrame([("a", 0.15)], "user_id string, trust double")
    got = {r.user_id: r for r in decide(trust_lookup(rows, trust), 1.0).collect()}
    assert got["a"].risk_score == pytest.approx(0.42 + 0.38 + 0.2 * 0.85) and got["b"].risk_score == pytest.approx(0.03)
    assert {r.threat_level: r.n for r in threat_level_counts(decide(trust_lookup(rows, trust), 1.0)).collect()} == {"critical": 1, "normal": 1}


def test_top_features_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, mean_abs double")
    assert [r.feature for r in top_features(df, 2).collect()] == ["c", "a"]
