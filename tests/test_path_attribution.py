"""Attribution by path shares against all subsets of features, and additivity for deep trees."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import attribution
from riskloom.operators import attribution
from riskloom.operators.attribution import node_counts, path_values, tree_leaves, with_shapley
from riskloom.operators.learn import fit_classifier


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(int)
    data = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, features array<double>, y int").cache()


def over_subsets(value, k):
    """Shapley values of a set function by its definition."""
    out = np.zeros(k)
    for i in range(k):
        others = [j for j in range(k) if j != i]
        for n in range(k):
            weight = math.factorial(n) * math.factorial(k - 1 - n) / math.factorial(k)
            for s in itertools.combinations(others, n):
                out[i] += weight * (value({*s, i}) - value(set(s)))
    return out


def test_product_of_factors():
    rng = np.random.default_rng(2)
    for k in range(1, 8):
        shares = rng.random(k) * (rng.random(k) > 0.2)
        met = (rng.random((3, k)) > 0.5).astype(float)
        for row, got in zip(met, path_values(met, shares)):
            want = over_subsets(lambda s: math.prod(row[j] if j in s else shares[j] for j in range(k)), k)
            assert np.allclose(got, want, atol=1e-12)


def descend(tree, counts, x, known, node=0):
    """What a tree is expected to give when only the features ``known`` are: both sides of the other splits by their shares."""
    feature, threshold, value = tree
    f = feature[node]
    if f < 0:
        return value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return descend(tree, counts, x, known, right if x[f] > threshold[node] else left)
    share = counts[left] / counts[node] if counts[node] else 0.5
    return share * descend(tree, counts, x, known, left) + (1 - share) * descend(tree, counts, x, known, right)


def test_matches_all_subsets(rows):
    model = fit_classifier(rows, trees=3, depth=6)
    background = rows.filter("row_id % 3 > 0")
    counts = node_counts(background, model.model)
    assert counts[0, 0] == background.count()
    trees = list(zip(model.model.feature, model.model.threshold, model.model.value))
    for r in with_shapley(rows.filter("row_id < 8"), model, background, 4, "path").collect():
        want = sum(over_subsets(lambda s: descend(t, n, r.features, s), 4) for t, n in zip(trees, counts))
        assert np.allclose(r.shapley, want, atol=1e-9)


def test_node_counts_do_not_depend_on_partitions(rows):
    model = fit_classifier(rows, trees=3, depth=4).model
    one, many = (node_counts(rows.repartition(n), model) for n in (1, 7))
    assert (one == many).all()
    for tree, n in zip(zip(model.feature, model.threshold, model.value), one):
        assert sum(n[node] for _, _, node in tree_leaves(*tree)) == 240


def test_deep_trees_add_up(spark, monkeypatch):
    """Twelve levels; the tables of the other method raise for more features on a path than they may have."""
    monkeypatch.setattr(attribution, "MOST_CONDITIONS", 4)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, size=(4000, 14)).astype(float)
    y = (x.sum(axis=1) + rng.normal(size=4000) > 7).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "row_id long, features array<double>, y int").cache()
    model = fit_classifier(df, trees=5, depth=12)
    odds = F.log(F.col("p") / (1 - F.col("p")))
    mean = model.score(df).agg(F.avg(odds)).first()[0]
    for r in with_shapley(model.score(df.limit(300)), model, df, 14, "path").collect():
        assert sum(r.shapley) == pytest.approx(math.log(r.p / (1 - r.p)) - mean, abs=1e-8)
    with pytest.raises(ValueError, match="path"):
        with_shapley(df, model, df, 14)
    with pytest.raises(ValueError, match="unknown method"):
        with_shapley(df, model, df, 14, "other")


def test_empty_sides(rows):
    model = fit_classifier(rows, trees=2, depth=3)
    assert with_shapley(rows.limit(0), model, rows, 4, "path").count() == 0
    without = with_shapley(rows.limit(5), model, rows.limit(0), 4, "path").collect()
    assert all(np.isfinite(r.shapley).all() for r in without)


def test_conditions_share_comparisons_and_keep_patterns():
    """Patterns of conditions on one batch come from one comparison a threshold, also where few are kept."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)).round(1)
    x[3, 2] = np.nan
    for most in (4096, 2):
        attribution.MOST_COMPARISONS, kept = most, attribution.MOST_COMPARISONS
        try:
            rows = attribution._Conditions(np.ascontiguousarray(x.T))
            for k in (1, 5, 9, 17):
                features = rng.integers(0, 5, k)
                low = np.where(rng.random(k) < 0.5, -np.inf, rng.normal(size=k).round(1) - 1)
                high = np.where(np.isinf(low) | (rng.random(k) < 0.5), rng.normal(size=k).round(1) + 1, np.inf)
                met = ~(x[:, features] <= low) & ~(x[:, features] > high)
                assert (rows.patterns(features, low, high) == met @ (1 << np.arange(k)))[np.arange(200) != 3].all()
            assert len(rows.beyond) <= most
        finally:
            attribution.MOST_COMPARISONS = kept
