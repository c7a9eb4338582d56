"""Reconstruction-error scoring of rows against their benign majority."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag
from ..session import write_table
from .quantile import exact_percentile

MIN_BENIGN = 10
SHARD_ROWS = 250_000
#: Rows that are put in a drawn order together.
SHUFFLE_ROWS = 20_000
log = logging.getLogger(__name__)


def benign_subset(df: DataFrame, label: str = "y", least: int = MIN_BENIGN) -> DataFrame:
    """Rows labelled 0, or all rows when fewer than ``least`` are (logged)."""
    benign = df.filter(F.col(label) == 0)
    if benign.limit(least).count() >= least:
        return benign
    log.warning("fewer than %d benign rows: all rows are used", least)
    return df


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v)


def reconstruction_error(features: Column, rebuilt: Column) -> Column:
    """Mean squared difference between a row and its reconstruction."""
    return squared_norm(F.zip_with(features, rebuilt, lambda a, b: a - b)) / F.size(features)


@dataclass(frozen=True)
class LinearScorer:
    """Reconstruction from the leading principal components.

    The components are orthonormal, so the squared error is the squared norm of the centred row
    minus that of its projection; the reconstruction itself is never built.
    """

    model: PCAModel
    mean: tuple[float, ...]

    def with_error(self, df: DataFrame, features: str = "features", out: str = "err") -> DataFrame:
        weights = self.model.pc.toArray()
        shift = F.array(*[F.lit(float(v)) for v in np.asarray(self.mean) @ weights])
        mean = F.array(*[F.lit(v) for v in self.mean])
        projected = self.model.transform(df.withColumn("_vector", array_to_vector(F.col(features))))
        centred = F.zip_with(F.col(features), mean, lambda a, b: a - b)
        kept = F.zip_with(vector_to_array(F.col("_projected")), shift, lambda a, b: a - b)
        error = F.greatest(F.lit(0.0), squared_norm(centred) - squared_norm(kept)) / F.size(features)
        return projected.withColumn(out, error).drop("_vector", "_projected")


def fit_linear(benign: DataFrame, d: int, latent: int = 8) -> LinearScorer:
    vectors = benign.select(array_to_vector("features").alias("_vector"))
    mean = vectors.select(Summarizer.mean(F.col("_vector")).alias("m")).first()["m"]
    model = PCA(k=min(latent, d), inputCol="_vector", outputCol="_projected").fit(vectors)
    return LinearScorer(model, tuple(float(v) for v in mean.toArray()))


# A small bottleneck network d -> h -> L -> h -> d with ReLU after the first three layers.


def _shapes(d: int, latent: int) -> list[tuple[int, int]]:
    h = max(2 * latent, 16)
    return [(d, h), (h, latent), (latent, h), (h, d)]


def _unpack(flat: np.ndarray, d: int, latent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, cols in _shapes(d, latent):
        layers.append((flat[at : at + rows * cols].reshape(rows, cols), flat[at + rows * cols : at + (rows + 1) * cols]))
        at += (rows + 1) * cols
    return layers


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    steps = [x]
    for i, (w, b) in enumerate(layers):
        z = steps[-1] @ w + b
        steps.append(np.maximum(z, 0.0) if i < 3 else z)
    return steps


def _gradient(x: np.ndarray, layers) -> np.ndarray:
    steps = _forward(x, layers)
    delta = 2.0 * (steps[-1] - x) / x.size
    parts: list[np.ndarray] = []
    for i in range(3, -1, -1):
        parts = [(steps[i].T @ delta).ravel(), delta.sum(axis=0)] + parts
        if i:
            delta = (delta @ layers[i][0].T) * (steps[i] > 0)
    return np.concatenate(parts)


@dataclass(frozen=True)
class NetworkScorer:
    """Weights of a trained network; ``updates`` says how many steps on a batch all shards made together."""

    flat: np.ndarray
    d: int
    latent: int
    updates: int = 0

    def with_error(self, df: DataFrame, features: str = "features", out: str = "err") -> DataFrame:
        flat, d, latent = self.flat, self.d, self.latent

        @F.pandas_udf("double")
        def error(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype="float64")
            rows = np.stack(x.to_numpy())
            rebuilt = _forward(rows, _unpack(flat, d, latent))[-1]
            return pd.Series(((rebuilt - rows) ** 2).mean(axis=1))

        return df.withColumn(out, error(F.col(features)))


def initial_weights(d: int, latent: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    start = []
    for rows, cols in _shapes(d, latent):
        bound = 1.0 / np.sqrt(rows)
        start += [rng.uniform(-bound, bound, rows * cols), rng.uniform(-bound, bound, cols)]
    return np.concatenate(start)


@dataclass
class _Adam:
    """Weights, both moments and the number of steps behind them, as one vector ``state`` of 3 w + 1 numbers."""

    state: np.ndarray
    rate: float

    def step(self, x: np.ndarray, d: int, latent: int) -> None:
        size = (len(self.state) - 1) // 3
        flat, m, v = (self.state[i * size : (i + 1) * size] for i in range(3))
        g = _gradient(x, _unpack(flat, d, latent))
        self.state[-1] += 1
        t = self.state[-1]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        flat -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _batches(frames: Iterator[pd.DataFrame], seed: int, epoch: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) of at most ``size`` rows in an order drawn anew for each window of rows and epoch; a batch has rows of one shard."""
    held: list[np.ndarray] = []
    shard, window = None, 0

    def drain() -> Iterator[tuple[int, np.ndarray]]:
        x = np.concatenate(held)
        order = np.random.default_rng([seed, epoch, shard, window]).permutation(len(x))
        for low in range(0, len(x), size):
            yield shard, x[order[low : low + size]]

    for frame in frames:
        for own, part in frame.groupby("shard", sort=False):
            if held and (own != shard or sum(map(len, held)) + len(part) > SHUFFLE_ROWS):
                yield from drain()
                held.clear()
                window = window + 1 if own == shard else 0
            elif own != shard:
                window = 0
            shard = int(own)
            held.append(np.stack(part["features"].to_numpy()))
    if held:
        yield from drain()


def train_epoch(frames: Iterator[pd.DataFrame], state: np.ndarray, d: int, latent: int, seed: int, epoch: int, rate: float,
                size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(rows, updates, state) of each shard after one pass over its rows in batches, from the common ``state`` on."""
    shard, adam, rows, updates = None, None, 0, 0
    for own, x in _batches(frames, seed, epoch, size):
        if own != shard:
            if rows:
                yield rows, updates, adam.state
            shard, adam, rows, updates = own, _Adam(state.copy(), rate), 0, 0
        adam.step(x, d, latent)
        rows, updates = rows + len(x), updates + 1
    if rows:
        yield rows, updates, adam.state


def fit_network(benign: DataFrame, d: int, latent: int = 8, rounds: int = 45, rate: float = 1e-3, seed=42, batch: int = 128,
                key: str = "row_id", shard_rows: int = SHARD_ROWS) -> NetworkScorer:
    """Train the network by Adam on seeded batches of at most ``batch`` rows: local updates, averaged after each epoch.

    Rows are dealt once by a hash of ``key`` and features to shards of about ``shard_rows``, sorted by it and written. An epoch is one
    job: every shard starts from the common weights, moments and step number, makes its own updates batch by batch, and the mean over
    the shards, weighted by rows, is where the next epoch starts. So the number of updates grows with the rows, a task holds a window of
    rows whatever its shard's size, a lost task repeats one shard of one epoch, and the driver gets three times the network's weights.
    Up to ``shard_rows`` rows this is plain training on one machine. The model does not depend on the partitioning of the
    input as long as keys tell rows apart; rows without a key column are dealt evenly.

    Rows with null features take no part. Without any row the network keeps its first weights.
    """
    latent = min(latent, d)
    start = initial_weights(d, latent, seed)
    state = np.concatenate([start, np.zeros(2 * start.size + 1)])
    rows = benign.filter("features is not null")
    shards = max(1, -(-rows.count() // shard_rows))
    keyed = key in rows.columns
    rows = rows.select("features", (F.xxhash64(key, "features") if keyed else F.xxhash64("features")).alias("k"))
    rows = rows.withColumn("shard", F.pmod("k", F.lit(shards)).cast("int")).repartition(shards, "shard") if keyed else (
        rows.repartition(shards).withColumn("shard", F.spark_partition_id()))
    placed = write_table(rows.sortWithinPartitions("shard", "k"), "shards").select("shard", "features")
    updates = 0
    for epoch in range(max(5, rounds)):
        common = benign.sparkSession.sparkContext.broadcast(state)

        def train(frames, common=common, epoch=epoch):
            for n, steps, after in train_epoch(frames, common.value, d, latent, seed, epoch, rate, batch):
                yield pd.DataFrame({"n": [n], "steps": [steps], "state": [after * n]})

        sums = (
            placed.mapInPandas(train, "n long, steps long, state array<double>")
            .select("n", "steps", F.posexplode("state").alias("i", "value"))
            .groupBy("i").agg(F.sum("value").alias("value"), F.sum("n").alias("n"), F.sum("steps").alias("steps")).toPandas().sort_values("i")
        )
        common.unpersist()
        if sums.empty:
            break
        state = sums["value"].to_numpy() / sums["n"].to_numpy()
        updates += int(sums["steps"].iloc[0])
    return NetworkScorer(state[: start.size], d, latent, updates)


def fit_scorer(benign: DataFrame, d: int, kind: str = "linear", latent: int = 8, seed=42, rounds: int = 45):
    """``linear`` (principal components) or ``network``."""
    if kind == "linear":
        return fit_linear(benign, d, latent)
    if kind == "network":
        return fit_network(benign, d, latent, rounds=rounds, seed=seed)
    raise ValueError(f"unknown scorer {kind!r}")


def anomaly_threshold(scored: DataFrame, err: str = "err", q: float = 0.95) -> float:
    """Percentile of the benign training errors."""
    return exact_percentile(scored, F.col(err), q)


def anomalies(df: DataFrame, threshold: float, err: str = "err") -> DataFrame:
    """Rows whose error is above the threshold; equal does not count."""
    return df.filter(F.col(err) > F.lit(threshold))


def with_anomaly_flag(df: DataFrame, threshold: float, err: str = "err") -> DataFrame:
    return df.withColumn("anomalous", flag(F.col(err) > F.lit(threshold)))
