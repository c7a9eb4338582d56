"""Boosted trees: same model for any partitioning, sums of leaves, falling loss, scores of plain and weighted rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting
from riskloom.operators.boosting import _cell, fit_trees, thresholds


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.4 * rng.normal(size=300) > 0.3).astype(int)
    data = [(i, [float(v) for v in r], int(c), float(1 + i % 3)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, features array<double>, y int, w double").cache()


def test_cells_keep_the_order():
    x = np.sort(np.concatenate([np.random.default_rng(1).normal(size=500) * 10.0 ** np.arange(-250, 250), [0.0, -np.inf, np.inf]]))
    assert (np.diff(_cell(x)) >= 0).all()


def test_thresholds(rows):
    every = thresholds(rows, 4)
    few = thresholds(rows, 4, bins=8)
    x = np.array([r.features for r in rows.collect()])
    for j in range(4):
        values = np.unique(x[:, j])
        assert all(values[0] <= t < values[-1] for t in every[j]) and len(few[j]) <= 7
        sizes = np.bincount(np.searchsorted(few[j], x[:, j]))
        assert sizes.max() <= 2.5 * 300 / 8
    again = thresholds(rows.repartition(7), 4)
    assert all((a == b).all() for a, b in zip(every, again))


def test_same_model_for_any_partitioning(rows):
    """Also from several tasks of one barrier stage, which exchange histograms."""
    one = fit_trees(rows, 4, weight="w", trees=2, depth=2)
    for df, tasks in ((rows.repartition(5).orderBy(F.desc("row_id")), 1), (rows, 3)):
        other = fit_trees(df, 4, weight="w", trees=2, depth=2, tasks=tasks)
        for name in ("feature", "threshold", "value", "g", "h", "losses"):
            assert (getattr(one, name) == getattr(other, name)).all()


def test_several_tasks_do_not_wait_for_a_barrier(rows):
    """Ten trees of three levels over two tasks: an exchange of a barrier stage took a second."""
    started = time.monotonic()
    several = fit_trees(rows, 4, trees=10, depth=3, tasks=2)
    assert time.monotonic() - started < 25
    assert (several.value == fit_trees(rows, 4, trees=10, depth=3).value).all()


def test_state_is_computed_again_from_the_first_blocks(rows, monkeypatch):
    one = fit_trees(rows, 4, trees=5, depth=2)
    monkeypatch.setattr(boosting, "REBASE_TREES", 2)
    monkeypatch.setattr(boosting, "MOST_CELLS", 1)  # a node at a time
    several = fit_trees(rows, 4, trees=5, depth=2, tasks=3)
    assert all((getattr(one, c) == getattr(several, c)).all() for c in ("feature", "threshold", "value", "g", "h", "losses"))


def test_first_tree_against_plain_sums(rows):
    model = fit_trees(rows, 4, weight="w", trees=1, depth=3, share=1.0)
    data = rows.collect()
    x, y, w = (np.array([r[c] for r in data]) for c in ("features", "y", "w"))
    p = (w * y).sum() / w.sum()
    assert model.base == pytest.approx(np.log(p / (1 - p)))
    margins = model.margin(x) - model.base
    for value in np.unique(margins):
        own = margins == value
        assert value == pytest.approx(-0.08 * (w * (p - y))[own].sum() / ((w * p * (1 - p))[own].sum() + 1), abs=1e-6)
    best = max(  # the root's split is the best of all
        sum((w * (p - y))[s].sum() ** 2 / ((w * p * (1 - p))[s].sum() + 1) for s in (x[:, j] <= t, x[:, j] > t))
        for j in range(4) for t in np.unique(x[:, j])[:-1] if min((w * p * (1 - p))[x[:, j] <= t].sum(), (w * p * (1 - p))[x[:, j] > t].sum()) >= 1
    )
    root = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert sum((w * (p - y))[s].sum() ** 2 / ((w * p * (1 - p))[s].sum() + 1) for s in (root, ~root)) == pytest.approx(best)


def test_loss_falls_and_scores_match(rows):
    model = fit_trees(rows, 4, trees=40)
    assert (np.diff(model.losses) < 0).all()
    scored = rows.select("features", "y", model.probability(F.col("features")).alias("p")).collect()
    p = 1 / (1 + np.exp(-model.margin(np.array([r.features for r in scored]))))
    assert np.allclose(p, [r.p for r in scored])
    y = np.array([r.y for r in scored])
    assert -np.mean(np.log(np.where(y == 1, p, 1 - p))) == pytest.approx(model.losses[-1], rel=1e-5)


def test_rows_without_label_or_weight_take_no_part(rows, spark):
    more = rows.unionByName(spark.createDataFrame([(900, [9.0] * 4, None, 1.0), (901, [9.0] * 4, 1, None), (902, [9.0] * 4, 1, 0.0)], rows.schema))
    a, b = (fit_trees(df, 4, weight="w", trees=2, depth=2) for df in (rows, more))
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all()


def test_tasks_exchange_their_sums_within_one_job(rows, spark):
    """A fit over several tasks takes a handful of jobs, not one for each level of a tree; its files are gone afterwards."""
    one = fit_trees(rows, 4, weight="w", trees=12, depth=3)
    apart = fit_trees(rows, 4, weight="w", trees=12, depth=3, tasks=2, exchange=False)
    spark.sparkContext.setJobGroup("exchange", "fit")
    together = fit_trees(rows, 4, weight="w", trees=12, depth=3, tasks=3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("exchange")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 15
    for name in ("feature", "threshold", "value", "g", "h", "losses"):
        assert (getattr(one, name) == getattr(together, name)).all() and (getattr(one, name) == getattr(apart, name)).all()


def test_scores_by_ranks_and_by_steps_agree():
    """Also for values on a threshold, missing ones, and trees with leaves above the last level."""
    rng = np.random.default_rng(5)
    size, trees = 15, 20
    feature, threshold = rng.integers(0, 3, (trees, size)), rng.integers(-3, 4, (trees, size)) / 2
    feature[:, 7:] = -1
    feature[3] = feature[4, 2] = feature[4, 5:7] = feature[5, 4] = -1
    model = boosting.Trees(0.25, 3, feature, threshold, rng.normal(size=(trees, size)), *(np.zeros((trees, size)),) * 2, losses=np.zeros(trees + 1))
    x = rng.integers(-4, 5, (5000, 3)) / 2
    x[::7, 1] = np.nan
    plain = np.full(len(x), 0.25)
    for f, t, v in zip(feature, threshold, model.value):
        for i, row in enumerate(x):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + bool(row[f[at]] > t[at])
            plain[i] += v[at]
    assert np.allclose(model.margin(x), plain, atol=1e-12) and np.allclose(model._by_steps(x) + 0.25, plain, atol=1e-12)


def test_features_are_counted_in_bundles_exactly():
    rng = np.random.default_rng(2)
    n, sizes = 3000, [2, 300, 5, 3, 40, 2]
    bins = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint16)
    plan = boosting._Plan([np.arange(s - 1.0) for s in sizes], -1.0, 2.0**20, 1, 3, 0.1, 1.0, 1.0, 1)
    assert len(plan.bundles) < len(sizes)
    rows = boosting._Rows(bins, rng.integers(0, 2, n).astype(float), np.ones(n), np.arange(n, dtype=np.uint64), np.full(n, -1.0), 3)
    rows.start(0, plan)
    rows.descend(np.array([4, -1, -1] + [-1] * 12), np.array([17] + [0] * 14))
    columns = np.array([0, 1, 3, 4])
    found = rows.histogram(np.array([1, 2]), columns, plan)
    for node in (1, 2):
        for k, f in enumerate(columns):
            for side, values in enumerate((rows.g, rows.h)):
                own = rows.at == node
                assert (found[side, node - 1, k, : sizes[f]] == np.bincount(bins[f][own], values[own], sizes[f])).all()
