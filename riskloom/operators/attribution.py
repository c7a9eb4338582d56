"""Which features drive a model's score: Shapley values against background rows.

For every leaf only the conditions on its path matter. There are two ways to say what a feature that is not known does:

* ``background``: it takes the values of the background rows. A row meets some conditions; a background row meets some of
  them. How much each feature moves the score depends on nothing but these two sets, so all background rows are counted
  by pattern and folded into one table of 2^k rows per leaf. Scoring a row is then a table lookup per leaf.
* ``path``: a row goes down both sides of a split, in the shares in which the background rows that came there did. A leaf then
  is a product of one factor a feature, and its Shapley values are integrals of polynomials of degree below k, which
  k / 2 points of Gauss and Legendre give exactly. Time and memory grow with k^2, so trees may have any depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees
from .learn import Classifier

MOST_COMPARISONS = 4096  # comparisons of a batch that are kept
MOST_BITS = 14  # conditions whose patterns are told apart by a table of places
TABLE_BITS = 6  # conditions for whose patterns a task keeps all values
MOST_CONDITIONS = 10  # features on a path that the tables of the background method may have


@dataclass(frozen=True)
class _Leaf:
    features: np.ndarray  # features on the path
    low: np.ndarray  # a row meets the condition when low < x <= high
    high: np.ndarray
    table: np.ndarray  # [pattern of met conditions, feature on the path]


def tree_leaves(feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> list[tuple[float, dict[int, tuple[float, float]], int]]:
    """Value, path conditions (low < x <= high) and node of every leaf of a tree, from its node arrays."""
    leaves = []
    open_nodes = [(0, {})]
    while open_nodes:
        node, path = open_nodes.pop()
        f, t = int(feature[node]), float(threshold[node])
        if f < 0:
            leaves.append((float(value[node]), path, node))
            continue
        low, high = path.get(f, (-math.inf, math.inf))
        open_nodes.append((2 * node + 1, {**path, f: (low, min(high, t))}))
        open_nodes.append((2 * node + 2, {**path, f: (max(low, t), high)}))
    return leaves


def _columns(x: pd.Series) -> np.ndarray:
    """[feature, row] of a column of arrays; none without rows."""
    return np.ascontiguousarray(np.stack(x.to_numpy()).T) if len(x) else np.zeros((0, 0))


class _Conditions:
    """Which conditions the rows of a batch meet. Leaves of one tree share the comparisons with its thresholds."""

    def __init__(self, columns: np.ndarray):
        self.columns, self.beyond = columns, {}

    def _above(self, feature: int, threshold: float) -> np.ndarray:
        if (feature, threshold) not in self.beyond:
            if len(self.beyond) >= MOST_COMPARISONS:
                self.beyond.clear()
            self.beyond[feature, threshold] = self.columns[feature] > threshold
        return self.beyond[feature, threshold]

    def met(self, features, low, high) -> Iterator[np.ndarray]:
        """For each condition low < x <= high the rows that meet it; a missing number meets only low."""
        for f, a, b in zip(features, low, high):
            inside = self._above(f, a) if a > -math.inf else None
            below = ~self._above(f, b) if b < math.inf else None
            yield below if inside is None else inside if below is None else inside & below

    def patterns(self, features, low, high) -> np.ndarray:
        """The met conditions of each row as bits of a whole number."""
        kind = np.uint8 if len(features) <= 8 else np.uint16 if len(features) <= 16 else np.int64
        out = np.zeros(self.columns.shape[1], kind)
        for k, met in enumerate(self.met(features, low, high)):
            out |= np.multiply(met, kind(1 << k), dtype=kind)
        return out.astype(np.intp)


def _leaf_table(value: float, counts: np.ndarray, k: int) -> np.ndarray:
    """Mean contribution over the background for each of the 2^k row patterns."""
    full, patterns = (1 << k) - 1, np.arange(1 << k)
    row, back = patterns[:, None], patterns[None, :]
    only_row, only_back = row & ~back, back & ~row
    a, b = np.bitwise_count(only_row).astype(int), np.bitwise_count(only_back).astype(int)
    factorial = np.array([math.factorial(i) for i in range(2 * k + 1)], float)
    # a condition that neither side meets: the leaf is never reached
    weight = np.where((row | back) == full, counts[None, :], 0) / factorial[a + b]
    gain, loss = weight * factorial[np.maximum(a - 1, 0)] * factorial[b], weight * factorial[a] * factorial[np.maximum(b - 1, 0)]
    table = np.stack([(gain * (only_row >> i & 1)).sum(axis=1) - (loss * (only_back >> i & 1)).sum(axis=1) for i in range(k)], axis=1)
    return value * table / max(counts.sum(), 1)


def _background_counts(background: DataFrame, leaves: list[_Leaf]) -> list[np.ndarray]:
    """Of each leaf, how many background rows meet each pattern of its conditions: one pass over all rows.

    Tasks count their rows first; what comes back is bounded by leaves and patterns.
    """
    shared = background.sparkSession.sparkContext.broadcast(leaves)

    def count(frames):
        totals = [np.zeros(1 << len(leaf.features), np.int64) for leaf in shared.value]
        for frame in frames:
            if len(frame):
                rows = _Conditions(_columns(frame["features"]))
                for leaf, total in zip(shared.value, totals):
                    total += np.bincount(rows.patterns(leaf.features, leaf.low, leaf.high), minlength=len(total))
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            if len(at):
                yield pd.DataFrame({"leaf": k, "pattern": at, "n": total[at]})

    counted = background.select("features").mapInPandas(count, "leaf long, pattern long, n long").groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << len(leaf.features), np.int64) for leaf in leaves]
    for r in counted.collect():
        out[r["leaf"]][r["pattern"]] = r["n"]
    return out


def node_counts(background: DataFrame, model: Trees) -> np.ndarray:
    """[tree, node]: how many background rows come to each node, in one pass over all rows.

    Tasks count first; what comes back is bounded by the nodes of the model.
    """
    shared = background.sparkSession.sparkContext.broadcast(model)

    def count(frames):
        model = shared.value
        totals = np.zeros(model.feature.shape, np.int64)
        for frame in frames:
            x = np.stack(frame["features"].to_numpy()) if len(frame) else np.zeros((0, 1))
            rows = np.arange(len(x))
            for feature, threshold, total in zip(model.feature, model.threshold, totals) if len(x) else ():
                at = np.zeros(len(x), np.int64)
                inside = rows
                total[0] += len(x)
                for _ in range(model.depth):
                    inside = inside[feature[at[inside]] >= 0]
                    node = at[inside]
                    at[inside] = 2 * node + 1 + (x[inside, feature[node]] > threshold[node])
                    total += np.bincount(at[inside], minlength=len(total))
        tree, node = np.nonzero(totals)
        yield pd.DataFrame({"tree": tree, "node": node, "n": totals[tree, node]})

    found = background.select("features").mapInPandas(count, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(model.feature.shape, np.int64)
    out[found["tree"].to_numpy(), found["node"].to_numpy()] = found["n"].to_numpy()
    return out


def path_shares(feature: np.ndarray, counts: np.ndarray, leaf: int) -> dict[int, float]:
    """For each feature on the path to a leaf the share of the background that its splits send on towards the leaf.

    Where no background row came to a split, each side gets half.
    """
    shares: dict[int, float] = {}
    while leaf:
        parent = (leaf - 1) // 2
        share = counts[leaf] / counts[parent] if counts[parent] else 0.5
        f = int(feature[parent])
        shares[f] = shares.get(f, 1.0) * share
        leaf = parent
    return shares


def path_values(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of the product over features of (met if known, else share) for each row of ``met`` [row, feature].

    A value is the integral over t in [0, 1] of (met - share) times the other factors t met + (1 - t) share. The products
    leave one factor out by running products from both ends, as a factor may be zero.
    """
    k = len(shares)
    points, weights = np.polynomial.legendre.leggauss((k + 1) // 2)
    out = np.zeros(met.shape)
    for point, weight in zip((points + 1) / 2, weights / 2):
        factors = point * met + (1 - point) * shares
        before = np.cumprod(np.column_stack([np.ones(len(met)), factors[:, :-1]]), axis=1)
        after = np.cumprod(np.column_stack([np.ones(len(met)), factors[:, :0:-1]]), axis=1)[:, ::-1]
        out += weight * before * after
    return out * (met - shares)


def _with_path_shapley(df: DataFrame, model: Trees, background: DataFrame, d: int) -> DataFrame:
    counts = node_counts(background, model)
    leaves = []
    for feature, threshold, value, n in zip(model.feature, model.threshold, model.value, counts):
        for leaf_value, path, node in tree_leaves(feature, threshold, value):
            if path and leaf_value:
                shares = path_shares(feature, n, node)
                features = np.array(sorted(path))
                low, high = (np.array([path[f][side] for f in features]) for side in (0, 1))
                leaves.append((leaf_value, features, low, high, np.array([shares[f] for f in features])))
    shared = df.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("array<double>")
    def shapley(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables: list[np.ndarray | None] = [None] * len(shared.value)  # of all patterns, where these are few
        for column in columns:
            out, rows = np.zeros((d, len(column))), _Conditions(_columns(column))
            for number, (value, features, low, high, shares) in enumerate(shared.value if len(column) else ()):
                k = len(features)
                if k <= MOST_BITS:
                    pattern = rows.patterns(features, low, high)
                    if k <= TABLE_BITS:
                        if tables[number] is None:
                            tables[number] = value * path_values(_bits(np.arange(1 << k), k), shares)
                        table = tables[number]
                    else:  # rows that meet the same conditions have the same values
                        found = np.flatnonzero(np.bincount(pattern, minlength=1 << k))
                        place = np.zeros(1 << k, np.intp)
                        place[found] = np.arange(len(found))
                        table, pattern = value * path_values(_bits(found, k), shares), place.take(pattern)
                else:
                    met = np.packbits(np.stack(list(rows.met(features, low, high)), axis=1), axis=1)
                    different, pattern = np.unique(met, axis=0, return_inverse=True)
                    table, pattern = value * path_values(np.unpackbits(different, axis=1, count=k).astype(float), shares), pattern.ravel()
                for f, values in zip(features, np.ascontiguousarray(table.T)):
                    out[f] += values.take(pattern)
            yield pd.Series(list(out.T.copy()), dtype="object")

    return df.withColumn("shapley", shapley(F.col("features")))


def _bits(patterns: np.ndarray, k: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(k) & 1).astype(float)


def with_shapley(df: DataFrame, classifier: Classifier, background: DataFrame, d: int, method: str = "background") -> DataFrame:
    """Add ``shapley``: one value per feature, in log-odds; they sum to score minus mean background score.

    The background is all rows of ``background``. ``method`` says how trees treat features that are not known: ``background``
    takes their values from the background rows together, for at most ten different features on a path, and raises beyond;
    ``path`` takes the shares of the background rows at each split, for any depth. Without background rows the values of
    ``background`` are zero, and ``path`` takes equal shares.
    """
    if method not in ("background", "path"):
        raise ValueError(f"unknown method {method!r}")
    if classifier.kind == "constant":
        return df.withColumn("shapley", F.array_repeat(F.lit(0.0), d))
    if classifier.kind == "logistic":
        weights = F.array(*[F.lit(float(w)) for w in classifier.model.coefficients.toArray()])
        mean = background.agg(*[F.avg(F.col("features")[j]).alias(f"m{j}") for j in range(d)]).first()
        means = F.array(*[F.lit(float(m or 0.0)) for m in mean])
        centred = F.zip_with(F.col("features"), means, lambda x, m: x - m)
        return df.withColumn("shapley", F.zip_with(centred, weights, lambda x, w: x * w))

    if method == "path":
        return _with_path_shapley(df, classifier.model, background, d)
    leaves: list[_Leaf] = []
    model = classifier.model
    for tree in zip(model.feature, model.threshold, model.value):
        for value, path, _ in tree_leaves(*tree):
            if not path:
                continue
            if len(path) > MOST_CONDITIONS:
                raise ValueError(f"{len(path)} features on a path: use method='path'")
            features = np.array(sorted(path))
            low = np.array([path[f][0] for f in features])
            high = np.array([path[f][1] for f in features])
            leaves.append(_Leaf(features, low, high, np.array(value)))
    counts = _background_counts(background, leaves)
    leaves = [replace(leaf, table=_leaf_table(float(leaf.table), n, len(leaf.features))) for leaf, n in zip(leaves, counts)]
    shared = df.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("array<double>")
    def shapley(column: pd.Series) -> pd.Series:
        if column.empty:
            return pd.Series([], dtype="object")
        out, rows = np.zeros((d, len(column))), _Conditions(_columns(column))
        for leaf in shared.value:
            pattern = rows.patterns(leaf.features, leaf.low, leaf.high)
            for f, values in zip(leaf.features, leaf.table.T):
                out[f] += values.take(pattern)
        return pd.Series(list(out.T.copy()))

    return df.withColumn("shapley", shapley(F.col("features")))


def feature_attribution(explained: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute Shapley value per feature over all given rows."""
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return (
        explained.select(F.posexplode("shapley").alias("j", "value"))
        .groupBy("j")
        .agg(F.avg(F.abs("value")).alias("mean_abs"))
        .select(label.alias("feature"), "mean_abs")
    )
