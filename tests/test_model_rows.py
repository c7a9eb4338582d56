"""Encoding, scaling, corruption, reconstruction, metrics, trust and attribution against plain NumPy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.anomaly import (
    LinearScorer,
    _batches,
    _forward,
    _gradient,
    _unpack,
    anomalies,
    benign_subset,
    fit_linear,
    fit_network,
    initial_weights,
)
from riskloom.operators.attribution import feature_attribution, with_shapley
from riskloom.operators.corrupt import damped_columns, feature_noise, feature_poison, label_noise, label_poison
from riskloom.operators.learn import confusion_metrics, evaluate, fit_classifier, roc_auc
from riskloom.operators.prep import Scaler, prepare
from riskloom.operators.trust import (
    init_trust,
    log_loss,
    refine_round,
    trust_after_anomaly,
    trust_after_loss,
    trust_map,
    trust_summary,
    trust_weights,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(300) < 0.2).astype(int)
    x = rng.normal(size=(300, 4)) + 1.5 * y[:, None] * np.array([1, 0.5, 0, 0])
    data = [(i, f"u{i % 50}", int(y[i]), [float(v) for v in x[i]]) for i in range(300)]
    return spark.createDataFrame(data, "row_id long, user_id string, y int, features array<double>").cache()


def arrays(df):
    got = df.orderBy("row_id").select("y", "features").collect()
    return np.array([r.y for r in got]), np.array([r.features for r in got])


def test_prepare_encodes_and_scales(spark):
    data = [(i, f"u{i}", "abc"[i % 3], float(i), 7.5, i % 2) for i in range(80)] + [(80, "u80", "zz", None, 7.5, 0)]
    frame = spark.createDataFrame(data, "row_id long, user_id string, action string, v double, same double, y int")
    prepared, fitted = prepare(frame, ["action", "absent"])
    assert fitted.names == ["v", "same", "action_enc"]
    train = np.array([r.features for r in prepared.filter("split = 'train'").collect()])
    assert np.allclose(train.mean(axis=0), 0, atol=1e-12)
    assert np.allclose(train.std(axis=0)[[0, 2]], 1) and np.allclose(train[:, 1], 0)
    again = {r.row_id: r.features for r in fitted.transform(frame, ["row_id"]).collect()}
    assert all(np.allclose(again[r.row_id], r.features) for r in prepared.collect())


def test_prepare_can_keep_users_whole(spark):
    data = [(i, f"u{i % 20}", float(i), i % 20 % 2) for i in range(200)]
    frame = spark.createDataFrame(data, "row_id long, user_id string, v double, y int")
    prepared, _ = prepare(frame, split_by="user")
    assert prepared.groupBy("user_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert 40 <= prepared.filter("split = 'test'").count() <= 60
    with pytest.raises(ValueError, match="unknown split"):
        prepare(frame, split_by="day")


def test_unseen_category_is_minus_one(spark):
    data = [(i, f"u{i}", "b" if i % 2 else "a", float(i), i % 2) for i in range(40)]
    frame = spark.createDataFrame(data, "row_id long, user_id string, action string, v double, y int")
    _, fitted = prepare(frame, ["action"])
    new = spark.createDataFrame([(1, "u", "never", 0.0), (2, "u", "a", 0.0), (3, "u", None, 0.0)], "row_id long, user_id string, action string, v double")
    mean, scale = fitted.scaler.means[1], fitted.scaler.scales[1]
    codes = [r.features[1] * scale + mean for r in fitted.transform(new, ["row_id"]).orderBy("row_id").collect()]
    assert np.allclose(codes, [-1, 0, -1])


def test_scaler_constant_column_with_rounding(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.lit(0.1).alias("c"))
    assert Scaler.fit(df, ["c"]).scales == (1.0,)


def test_label_noise_flips_exactly_k(rows):
    noisy = label_noise(rows, 0.08, 3)
    both = noisy.alias("n").join(rows.select("row_id", F.col("y").alias("old")), "row_id")
    assert both.filter("y <> old").count() == 24 == noisy.filter("label_flipped").count()
    assert both.filter("label_flipped and y = old").count() == 0
    assert label_noise(rows, 0.0, 3).filter("label_flipped").count() == 0
    assert label_noise(rows.limit(3), 0.01, 3).filter("label_flipped").count() == 1


def test_label_poison_hits_benign_rows_only(rows):
    benign = rows.filter("y = 0").count()
    poisoned = label_poison(rows, 0.14, True, 1)
    assert poisoned.filter("poisoned").count() == int(benign * 0.14)
    assert poisoned.filter("poisoned and y = 0").count() == 0
    assert label_poison(rows, 0.0, True, 1).filter("poisoned").count() == 1
    with pytest.raises(ValueError):
        label_poison(rows.filter("y = 1"), 0.1, True, 1)


def test_feature_noise_rules(spark):
    df = spark.createDataFrame([(i, 0.0, 100.0, 4.0) for i in range(400)], "row_id long, failed_attempts double, data_volume_mb double, x double")
    noisy = feature_noise(df, ["failed_attempts", "data_volume_mb", "x"], 5)
    values = noisy.select("failed_attempts", "data_volume_mb", "x").toPandas()
    assert set(values.failed_attempts) == {0.0, 1.0}
    assert 40 < values.data_volume_mb.std() < 60
    assert 0.12 < values.x.std() < 0.18  # 0.03 * (4 + 1)


def test_feature_poison_moves_chosen_rows_only(rows):
    malicious = rows.filter("y = 1").count()
    out = feature_poison(rows, 4, 0.0, 0.6, 9)
    assert out.filter("tampered").count() == int(malicious * 0.6)
    before = {r.row_id: r.features for r in rows.collect()}
    damped = damped_columns(4, 9)
    assert len(damped) == 2
    for r in out.collect():
        factor = np.array([0.3 if r.tampered and i in damped else 1.0 for i in range(4)])
        assert np.allclose(r.features, np.array(before[r.row_id]) * factor)
    assert feature_poison(rows.filter("y = 0"), 4).filter("tampered").count() == 0


def test_linear_errors_match_svd(rows):
    y, x = arrays(rows)
    benign = x[y == 0]
    scorer = fit_linear(benign_subset(rows), 4, 2)
    got = [r.err for r in scorer.with_error(rows).orderBy("row_id").collect()]
    mean = benign.mean(axis=0)
    _, _, v = np.linalg.svd(benign - mean, full_matrices=False)
    rebuilt = (x - mean) @ v[:2].T @ v[:2] + mean
    assert np.allclose(got, ((x - rebuilt) ** 2).mean(axis=1))
    assert isinstance(scorer, LinearScorer)


def test_network_does_not_depend_on_partitions(rows):
    a, b = (fit_network(benign_subset(rows).repartition(n), 4, rounds=8, shard_rows=60) for n in (1, 8))
    assert np.abs(a.flat - b.flat).max() < 1e-9 and a.updates == b.updates


def test_network_learns(rows):
    benign = rows.filter("y = 0").repartition(2, "row_id")
    early = fit_network(benign, 4, rounds=5).with_error(benign).agg(F.avg("err")).first()[0]
    late = fit_network(benign, 4, rounds=40).with_error(benign).agg(F.avg("err")).first()[0]
    assert late < early


def test_network_shards_match_one_machine(rows):
    """Averaged shards reach the error of the same schedule on one machine, written here as a plain loop."""
    benign = rows.filter("y = 0")
    x = arrays(benign)[1]
    flat = initial_weights(4, 2, 42)
    m, v, t, rng = np.zeros(flat.size), np.zeros(flat.size), 0, np.random.default_rng(1)
    for _ in range(45):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 16):
            g = _gradient(x[order[low : low + 16]], _unpack(flat, 4, 2))
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - 1e-2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    want = ((_forward(x, _unpack(flat, 4, 2))[-1] - x) ** 2).mean()
    for shard_rows in (10**6, len(x) // 3):
        scorer = fit_network(benign, 4, 2, rounds=45, rate=1e-2, batch=16, shard_rows=shard_rows)
        got = scorer.with_error(benign).agg(F.avg("err")).first()[0]
        assert got < 1.1 * want
        assert scorer.updates >= 45 * (len(x) // 16)


def test_network_batches():
    """Every row is in one batch of its shard; the order changes with the epoch and repeats with the seed."""
    frames = [pd.DataFrame({"shard": s, "features": [np.array([float(i)]) for i in r]}) for s, r in ((0, range(7)), (0, range(7, 9)), (3, range(9, 30)))]
    got = [[(s, *x.ravel()) for s, x in _batches(iter(frames), 1, epoch, 4)] for epoch in (0, 0, 1)]
    assert got[0] == got[1] != got[2]
    assert sorted(i for _, *x in got[0] for i in x) == list(range(30)) and max(len(b) for b in got[0]) == 5
    assert all(max(x) < 9 if s == 0 else min(x) >= 9 for s, *x in got[0])


def test_network_rows_without_features_or_key(spark):
    schema = "features array<double>"
    empty = fit_network(spark.createDataFrame([(None,)], schema), 2)
    assert empty.updates == 0 and np.array_equal(empty.flat, initial_weights(2, 2, 42))
    equal = fit_network(spark.createDataFrame([([1.0, 2.0],)] * 30 + [(None,)], schema), 2, rounds=5, batch=10, shard_rows=10)
    assert equal.updates == 15


def test_benign_subset_falls_back_to_all(rows):
    few = rows.filter("y = 1 or row_id < 8")
    n_benign = few.filter("y = 0").count()
    assert n_benign < 10 and benign_subset(few).count() == few.count()
    assert benign_subset(rows).filter("y = 1").count() == 0


def test_equal_error_is_no_anomaly(spark):
    df = spark.createDataFrame([(0.8,), (0.8000001,), (0.1,)], "err double")
    assert anomalies(df, 0.8).count() == 1


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0)], "p double, y int")
    got = {r.metric: r.value for r in evaluate(df, "m").collect()}
    assert got["accuracy"] == 1.0 and got["precision"] == got["recall"] == got["f1"] == 0.0 and math.isnan(got["roc_auc"])
    row = confusion_metrics(df.withColumn("q", F.lit(1)), F.col("q"), F.col("y")).first()
    assert row.accuracy == 0.0 and row.precision == 0.0


def test_auc_shares_tied_ranks(spark):
    p, y = [0.1, 0.4, 0.4, 0.4, 0.9, 0.2], [0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame(list(zip(p, y)), "p double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a, t in zip(p, y) if t for b, s in zip(p, y) if not s]
    assert roc_auc(df) == pytest.approx(np.mean(pairs))


def test_classifiers_use_weights(rows):
    weighted = rows.withColumn("w", F.when(F.col("y") == 1, 50.0).otherwise(1.0))
    for kind in ("logistic", "trees"):
        plain = fit_classifier(rows, kind, trees=5, depth=2).score(rows).agg(F.avg("p")).first()[0]
        heavy = fit_classifier(weighted, kind, weight="w", trees=5, depth=2).score(rows).agg(F.avg("p")).first()[0]
        assert heavy > plain
    constant = fit_classifier(rows.filter("y = 0"))
    assert constant.kind == "constant" and constant.score(rows).agg(F.max("p")).first()[0] == 0.0


def brute_trust(trust, p, y, err, rate, step, threshold):
    p = np.clip(p, 1e-7, 1 - 1e-7)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    relative = np.clip(loss / (np.percentile(loss, 90) + 1e-8), 0, 1)
    trust = np.clip(trust - rate * (relative - relative.mean()), 0.15, 1)
    lower = np.where((y == 0) & (err > threshold), step, np.where((y == 1) & (err <= threshold), step / 2, 0))
    return np.clip(trust - lower, 0.15, 1)


def test_refine_round_matches_numpy(spark):
    rng = np.random.default_rng(2)
    p, err, trust = rng.random(500), rng.random(500), 0.15 + 0.85 * rng.random(500)
    y = (rng.random(500) < 0.3).astype(int)
    data = [(i, float(p[i]), float(err[i]), float(trust[i]), int(y[i])) for i in range(500)]
    df = spark.createDataFrame(data, "row_id long, p double, err double, trust double, y int")
    got = [r.trust for r in refine_round(df, 0.7, 0.15, 0.06).orderBy("row_id").collect()]
    want = brute_trust(trust, p, y, err, 0.15, 0.06, 0.7)
    assert np.allclose(got, want)
    weights = [r.weight for r in trust_weights(df, 1.6).orderBy("row_id").collect()]
    raised = np.clip(trust, 1e-3, 1) ** 1.6
    assert np.allclose(weights, raised / (raised.mean() + 1e-8)) and np.mean(weights) == pytest.approx(1)


def test_low_loss_gains_trust(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 9.0)], "trust double, loss double")
    low, high = [r.trust for r in trust_after_loss(df).orderBy("loss").collect()]
    assert low > 0.5 > high


def test_anomaly_update_edges(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (0, 0.5, 0.5), (1, 0.5, 0.5), (1, 1.0, 0.5), (0, 1.0, 0.16)], "y int, err double, trust double")
    got = [round(r.trust, 6) for r in trust_after_anomaly(df, 0.5).collect()]
    assert got == [0.42, 0.5, 0.46, 0.5, 0.15]


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (1.0, 0)], "p double, y int")
    got = [r[0] for r in df.select(log_loss(F.col("p"), F.col("y"))).collect()]
    assert got[0] == pytest.approx(-math.log(1e-7)) and got[1] == pytest.approx(0, abs=1e-6) and got[2] == pytest.approx(-math.log(1e-7), rel=1e-6)


def test_trust_map_and_summary(spark):
    df = spark.createDataFrame([(1, "a", 0.2, True), (5, "a", 0.8, False), (2, "b", 0.5, False)], "row_id long, user_id string, trust double, poisoned boolean")
    assert {r.user_id: r.trust for r in trust_map(df).collect()} == {"a": 0.8, "b": 0.5}
    assert {r.user_id: r.trust for r in trust_map(df, "mean").collect()} == {"a": 0.5, "b": 0.5}
    row = trust_summary(df).first()
    assert row.mean_trust_flipped == 0.2 and row.mean_trust_other == pytest.approx(0.65)
    assert math.isnan(trust_summary(df.filter("not poisoned")).first().mean_trust_flipped)
    assert init_trust(df).agg(F.min("trust")).first()[0] == 1.0


def test_tree_shapley_matches_subsets(rows):
    model = fit_classifier(rows, "trees", trees=4, depth=3)
    sample = rows.orderBy("row_id").limit(15)
    background = np.array([r.features for r in sample.collect()])
    explained = with_shapley(model.score(rows.limit(12)), model, sample, 4).collect()

    def margin(points):
        df = rows.sparkSession.createDataFrame([([float(v) for v in p],) for p in points], "features array<double>")
        p = np.array([r.p for r in model.score(df).collect()])
        return np.log(p / (1 - p))

    points, keys = [], []
    subsets = [s for k in range(5) for s in itertools.combinations(range(4), k)]
    for n, r in enumerate(explained):
        for s in subsets:
            for b in background:
                point = b.copy()
                point[list(s)] = np.array(r.features)[list(s)]
                points.append(point)
                keys.append((n, s))
    value = {}
    for key, m in zip(keys, margin(points)):
        value.setdefault(key, []).append(m)
    value = {k: np.mean(v) for k, v in value.items()}
    for n, r in enumerate(explained):
        for i in range(4):
            total = 0.0
            for s in subsets:
                if i not in s:
                    weight = math.factorial(len(s)) * math.factorial(3 - len(s)) / math.factorial(4)
                    total += weight * (value[n, tuple(sorted(s + (i,)))] - value[n, s])
            assert r.shapley[i] == pytest.approx(total, abs=1e-9)


def test_linear_attribution_sums_to_score(rows):
    model = fit_classifier(rows, "logistic")
    background = np.array([r.features for r in rows.collect()])
    scored = with_shapley(model.score(rows), model, rows, 4).limit(5).collect()
    mean = np.mean(background @ model.model.coefficients.toArray() + model.model.intercept)
    for r in scored:
        assert sum(r.shapley) == pytest.approx(math.log(r.p / (1 - r.p)) - mean)
    top = feature_attribution(with_shapley(rows, model, rows, 4), list("abcd"))
    assert top.count() == 4
