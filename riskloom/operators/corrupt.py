"""Controlled label and feature corruption for robustness studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import normal, uniform, uniform_scalar
from ..functions.scalars import named
from .quantile import exact_percentiles
from .selection import random_k


def label_noise(df: DataFrame, fraction: float = 0.08, seed=42) -> DataFrame:
    """Flip exactly max(1, round(n fraction)) labels of any class; adds ``label_flipped``."""
    if fraction <= 0:
        return df.withColumn("label_flipped", F.lit(False))
    hit = random_k(df, lambda n: min(n, max(1, round(n * fraction))), seed, "label_noise")
    return df.withColumn("label_flipped", hit).withColumn(
        "y", F.when(F.col("label_flipped"), 1 - F.col("y")).otherwise(F.col("y")).cast("int")
    )


def feature_noise(df: DataFrame, columns: list[str], seed=0, volume_std: float = 50.0) -> DataFrame:
    """Add noise to every numeric feature.

    Volumes get N(0, volume_std); failed attempts a step of -1, 0 or 1 and a floor at 0; all
    others N(0, max(0.03 (median|x| + 1), 0.08)), with all medians found in shared passes.
    """
    key = "row_id"
    others = [c for c in columns if c not in ("data_volume_mb", "failed_attempts")]
    medians = exact_percentiles(df, {c: (F.abs(named(c).cast("double")), 0.5) for c in others}) if others else {}
    changed = {}
    for c in columns:
        x = named(c).cast("double")
        if c == "data_volume_mb":
            changed[c] = x + F.lit(float(volume_std)) * normal(seed, f"noise/{c}", key)
        elif c == "failed_attempts":
            step = F.floor(F.lit(3.0) * uniform(seed, f"noise/{c}", key)) - 1
            changed[c] = F.greatest(F.lit(0.0), x + step)
        else:
            scale = max(0.03 * ((medians[c] or 0.0) + 1.0), 0.08)
            changed[c] = x + F.lit(scale) * normal(seed, f"noise/{c}", key)
    return df.withColumns(changed) if changed else df


def label_poison(df: DataFrame, fraction: float = 0.12, benign_only: bool = True, seed=0) -> DataFrame:
    """Flip exactly max(1, int(fraction m)) labels of the m eligible rows; adds ``poisoned``."""

    def k_of_n(n: int) -> int:
        if n == 0:
            raise ValueError("no eligible rows to poison")
        return min(n, max(1, int(n * fraction)))

    eligible = (F.col("y") == 0) if benign_only else None
    hit = random_k(df, k_of_n, seed, "label_poison", eligible=eligible)
    return df.withColumn("poisoned", hit).withColumn(
        "y", F.when(F.col("poisoned"), 1 - F.col("y")).otherwise(F.col("y")).cast("int")
    )


def damped_columns(d: int, seed=1) -> list[int]:
    """The max(1, d // 2) feature positions whose values are pulled towards 0."""
    order = sorted(range(d), key=lambda i: uniform_scalar(seed, "damped", i))
    return sorted(order[: max(1, d // 2)])


def feature_poison(df: DataFrame, d: int, scale: float = 0.35, fraction: float = 0.6, seed=1, label: str = "y") -> DataFrame:
    """Make max(1, int(fraction m)) of the m malicious rows look more benign.

    On the damped positions the value is multiplied by 0.3, then N(0, scale) is added to all
    features of the row. ``label`` names the true label. Adds ``tampered``.
    """
    hit = random_k(df, lambda n: max(1, int(n * fraction)) if n else 0, seed, "feature_poison", eligible=F.col(label) == 1)
    damped = set(damped_columns(d, seed))
    changed = F.array(
        *[
            F.col("features")[i] * F.lit(0.3 if i in damped else 1.0)
            + F.lit(float(scale)) * normal(seed, f"tamper/{i}", "row_id")
            for i in range(d)
        ]
    )
    return df.withColumn("tampered", hit).withColumn(
        "features", F.when(F.col("tampered"), changed).otherwise(F.col("features"))
    )
