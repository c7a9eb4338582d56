"""Drift between two sides, suspicious metrics and top features."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocabulary import OVERFIT_MESSAGE, OVERFIT_SUMMARY
from ..session import write_table
from .ordering import running_totals

SERIES_TERMS = 100
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097")
STIRLING = ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9))


def ks_statistics(df: DataFrame, names: list[str], current: Column, features: str = "features") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of every feature in one pass.

    Values are counted per side first, so ties collapse before any ordering; the cumulative
    counts come from running totals that spread one feature over many tasks. A feature with
    fewer than two distinct values on a side has distance 0 and is marked ``constant``.
    """
    cells = F.posexplode(F.col(features)).alias("j", "value")
    counted = (
        df.select(current.cast("int").alias("side"), cells)
        .filter(F.col("value").isNotNull())
        .groupBy("j", "value")
        .agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    )
    counted = write_table(counted, "counted")
    running = running_totals(counted, ["j"], ["value"], ["a", "b"])
    totals = counted.groupBy("j").agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        F.count_if(F.col("a") > 0).alias("d1"),
        F.count_if(F.col("b") > 0).alias("d2"),
    )
    gap = F.abs(
        F.try_divide(F.col("cum_a").cast("double"), F.col("n1")) - F.try_divide(F.col("cum_b").cast("double"), F.col("n2"))
    )
    distance = running.join(F.broadcast(totals), "j").groupBy("j").agg(
        F.max(gap).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"),
        ((F.first("d1") < 2) | (F.first("d2") < 2)).alias("constant"),
    )
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return distance.select(
        label.alias("feature"),
        F.when(F.col("constant"), 0.0).otherwise(F.col("d")).alias("ks_statistic"),
        "n1", "n2", "constant",
    )


def ks_series_p(d: Column, n1: Column, n2: Column) -> Column:
    """Large-sample p-value: 2 sum (-1)^(k-1) exp(-2 k^2 z^2), z = d sqrt(n1 n2 / (n1 + n2))."""
    z2 = d * d * n1 * n2 / (n1 + n2)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * z2),
    )
    total = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    # the series needs many terms near 0, where the value is 1
    return F.when(z2 < 0.01, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _log_factorial(n: int) -> Decimal:
    """Logarithm of n! to some 28 digits, as a difference of such logarithms must keep those behind the point."""
    if n < 256:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = sum(Decimal(top) / Decimal(bottom) / x**power for top, bottom, power in STIRLING)
    return (x + Decimal("0.5")) * x.ln() - x + (2 * PI).ln() / 2 + series


def _ks_exact_p(d: float, n1: int, n2: int) -> float:
    """Share of lattice paths from (0,0) to (n1,n2) that reach the distance d.

    Paths are counted from one diagonal i + j = s to the next, only at the places nearer than d, so time is (rows of both sides) x (places
    on a diagonal, at most 2 d n1) and memory the latter. A step in j counts n2 / n1 times, which keeps all counts of a diagonal in the
    range of doubles. Where the distance is so large that the share is proven to be below the rounding of these sums (by the bound of
    Dvoretzky, Kiefer, Wolfowitz and Massart for each side) it is 0 without them; so a diagonal has at most some ten times sqrt(n1) places.
    """
    n1, n2 = sorted((n1, n2))
    g = math.gcd(n1, n2)
    a, b = n2 // g, n1 // g
    h = round(d * a * n1)
    if h == 0:
        return 1.0
    if 4 * math.exp(-2 * d * d * n1 * n2 / (math.sqrt(n1) + math.sqrt(n2)) ** 2) < (n1 + n2) * 2.0**-53:
        return 0.0
    ratio = n2 / n1
    steps = max(1, int(500 / math.log2(1 + ratio)))  # diagonals without a change of the unit
    size = 2 * min(n1 + 1, 2 * h // (a + b) + 2) + steps + 2
    here, there = np.zeros(size), np.zeros(size)  # here[i - start]: counts at (i, s - i) in units of 2**bits, with a zero on either side
    here[1] = 1.0
    start, bits = -1, 0
    for first in range(1, n1 + n2 + 1, steps):
        s = np.arange(first, min(first + steps, n1 + n2 + 1))
        low = np.maximum(np.maximum(0, s - n2), (s * b - h) // (a + b) + 1)
        high = np.minimum(np.minimum(n1, s), (s * b + h - 1) // (a + b))
        if (low > high).any():
            return 1.0
        shift = int(low[0]) - 2 - start
        if int(high[-1]) + 1 - start >= size:  # what is left goes to the front
            here[: size - shift] = here[shift:].copy()
            here[size - shift :] = 0.0
            start += shift
        for lower, upper in zip((low - start).tolist(), (high - start + 1).tolist()):
            new = there[lower:upper]
            np.multiply(here[lower:upper], ratio, out=new)
            new += here[lower - 1 : upper - 1]
            there[lower - 1] = there[upper] = 0.0
            here, there = there, here
        top = here[lower:upper].max()
        if top <= 0.0:
            return 1.0
        unit = math.frexp(top)[1]
        here[lower:upper] *= 2.0**-unit
        bits += unit
    with localcontext(prec=50):
        total = _log_factorial(n1 + n2) - _log_factorial(n1) - _log_factorial(n2)
        inside = float(Decimal(float(here[n1 - start])).ln() + bits * Decimal(2).ln() - n2 * Decimal(ratio).ln() - total)
    return min(1.0, max(0.0, -math.expm1(inside)))


@F.pandas_udf(T.DoubleType())
def ks_exact_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact p-value, one row per feature."""
    return pd.Series([_ks_exact_p(float(x), int(m), int(n)) for x, m, n in zip(d, n1, n2)], dtype="float64")


def ks_drift(df: DataFrame, names: list[str], current: Column, alpha: float = 0.05, features: str = "features",
             method: str = "asymptotic") -> DataFrame:
    """Distance, p-value and drift flag per feature.

    ``method`` names how p-values are found, at every size: ``asymptotic``, or ``exact`` (lattice paths), whose time for a feature grows
    with the rows of a side to the power 1.5; every feature is a task of its own.
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method {method!r}")
    stats = ks_statistics(df, names, current, features)
    if method == "exact":  # a row a feature, written for the sampling of the ranges
        stats = write_table(stats, "distances").repartitionByRange(max(1, len(names)), "feature")
    d, n1, n2 = F.col("ks_statistic"), F.col("n1").cast("double"), F.col("n2").cast("double")
    p = ks_exact_p(d, F.col("n1"), F.col("n2")) if method == "exact" else ks_series_p(d, n1, n2)
    p = F.when(F.col("constant"), 1.0).otherwise(p)
    return stats.withColumn("p_value", p).select(
        "feature", "ks_statistic", "p_value", (F.col("p_value") < alpha).alias("drift_flag")
    )


def overfit_flags(metrics: DataFrame, threshold: float = 0.98) -> DataFrame:
    """A message for each suspiciously good metric, and one summary message if there is any."""
    hits = metrics.filter(
        F.col("metric").isin("accuracy", "f1", "roc_auc") & ~F.isnan("value") & (F.col("value") > threshold)
    )
    each = hits.select(F.format_string(OVERFIT_MESSAGE, F.col("metric"), F.col("value"), F.lit(threshold)).alias("message"))
    summary = hits.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(OVERFIT_SUMMARY).alias("message"))
    return each.unionByName(summary)


def realism_summary(metrics: DataFrame, noise_fraction: float, flips: int, feature_noise: bool, threshold: float = 0.98) -> DataFrame:
    """One row: the noise that was applied and the overfit messages."""
    return overfit_flags(metrics, threshold).agg(F.collect_list("message").alias("overfitting_warnings")).select(
        F.lit(float(noise_fraction)).alias("label_noise_fraction"),
        F.lit(int(flips)).alias("labels_randomly_flipped_after_load"),
        F.lit(bool(feature_noise)).alias("gaussian_feature_noise_applied"),
        "overfitting_warnings",
    )


def top_features(attribution: DataFrame, k: int = 12) -> DataFrame:
    """The k features with the largest mean absolute attribution, ties by name."""
    return attribution.orderBy(F.desc("mean_abs"), "feature").limit(k)
