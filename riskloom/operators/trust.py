"""Trust per training row: weights, updates, and the training loop that uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.vocabulary import TRUST_CEILING, TRUST_FLOOR
from ..session import write_table
from .boosting import thresholds
from .learn import Classifier, fit_classifier
from .quantile import exact_percentile

EPSILON = 1e-8


def log_loss(p: Column, y: Column) -> Column:
    """Log loss of one row, probabilities clipped to [1e-7, 1 - 1e-7]."""
    q = clip(p, 1e-7, 1 - 1e-7)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def init_trust(df: DataFrame, value: float = 1.0) -> DataFrame:
    return df.withColumn("trust", F.lit(float(value)))


def trust_weights(df: DataFrame, power: float = 1.0) -> DataFrame:
    """Add ``weight``: clipped trust to the given power, divided by its mean."""
    raised = F.pow(clip(F.col("trust"), 1e-3, 1.0), F.lit(float(power)))
    mean = df.agg(F.avg(raised)).scalar()
    return df.withColumn("weight", raised / (mean + F.lit(EPSILON)))


def relative_loss(loss: Column, high: float) -> Column:
    return clip(loss / F.lit(high), 0.0, 1.0)


def trust_after_loss(df: DataFrame, rate: float = 0.15, low: float = TRUST_FLOOR, high: float = TRUST_CEILING) -> DataFrame:
    """Lower the trust of rows with a loss above the average, raise it below.

    The loss is taken relative to its 90th percentile.
    """
    p90 = exact_percentile(df, F.col("loss"), 0.90) + EPSILON
    relative = relative_loss(F.col("loss"), p90)
    mean = df.agg(F.avg(relative)).scalar()
    return df.withColumn("trust", clip(F.col("trust") - F.lit(float(rate)) * (relative - mean), low, high))


def anomaly_penalty(y: Column, err: Column, threshold: float, step: float) -> Column:
    """``step`` for benign rows that look anomalous, half of it for malicious rows that do not."""
    anomalous = err > F.lit(float(threshold))
    return (
        F.when((y == 0) & anomalous, F.lit(step)).when((y == 1) & ~anomalous, F.lit(step * 0.5)).otherwise(F.lit(0.0))
    )


def trust_after_anomaly(df: DataFrame, threshold: float, step: float = 0.08, low: float = TRUST_FLOOR, high: float = TRUST_CEILING) -> DataFrame:
    penalty = anomaly_penalty(F.col("y"), F.col("err"), threshold, step)
    return df.withColumn("trust", clip(F.col("trust") - penalty, low, high))


def refine_round(scored: DataFrame, threshold: float | None = None, rate: float = 0.12, step: float = 0.06) -> DataFrame:
    """One trust update from the probabilities ``p`` of a given model, and from ``err`` if a threshold is given.

    The rows with their loss are written once: the percentile, the mean and the update then read
    columns instead of scoring the rows again.
    """
    with_loss = write_table(scored.withColumn("loss", log_loss(F.col("p"), F.col("y"))), "losses")
    updated = trust_after_loss(with_loss, rate)
    if threshold is not None:
        updated = trust_after_anomaly(updated, threshold, step)
    return updated.drop("loss", "p")


def trust_training(df: DataFrame, threshold: float | None, rounds: int = 3, power: float = 1.5, seed=42,
                   kind: str = "trees", **fit) -> tuple[Classifier, DataFrame]:
    """Fit with trust weights, update trust, repeat.

    ``df`` has row_id, user_id, y, features and, with a threshold, err. Trust is updated once
    more after the last fit. Everything stays in one frame, so nothing is joined; each round
    writes one table. Features do not change, so the places where trees may split are found once.
    """
    if kind == "trees":
        known = df.filter("y is not null")
        size = known.agg(F.max(F.size("features"))).first()[0]
        fit = {**fit, "cuts": thresholds(known, size) if size else None}
    state = init_trust(df)
    model = None
    for r in range(max(1, rounds)):
        model = fit_classifier(trust_weights(state, power), kind, weight="weight", seed=seed + r, **fit)
        state = refine_round(model.score(state), threshold, rate=0.12 + 0.03 * r, step=0.06)
    return model, write_table(state, "trust")


def trust_summary(df: DataFrame, mask: str = "poisoned") -> DataFrame:
    """Mean trust of the flipped and of the other rows; NaN for an empty side."""
    return df.agg(
        F.coalesce(F.avg(F.when(F.col(mask), F.col("trust"))), F.lit(float("nan"))).alias("mean_trust_flipped"),
        F.coalesce(F.avg(F.when(~F.col(mask), F.col("trust"))), F.lit(float("nan"))).alias("mean_trust_other"),
    )


def trust_map(df: DataFrame, policy: str = "last", order: str = "row_id") -> DataFrame:
    """Trust per user: of the user's last training row, or the mean over its rows."""
    value = F.max_by("trust", order) if policy == "last" else F.avg("trust")
    return df.groupBy("user_id").agg(value.alias("trust"))
