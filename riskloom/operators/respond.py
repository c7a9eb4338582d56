"""Risk score, threat level and recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.vocabulary import DEFAULT_TRUST, THREAT_LEVELS
from ..session import write_table
from .joins import lookup_join
from .ordering import as_of_join


def trust_lookup(df: DataFrame, trust: DataFrame, default: float = DEFAULT_TRUST, small: bool | None = None) -> DataFrame:
    """Add the user's trust; users without one get the default."""
    table = trust.select("user_id", "trust") if small else write_table(trust.select("user_id", "trust"), "trust_lookup")
    joined = lookup_join(df, table, "user_id", "left", small)
    return joined.withColumn("trust", F.coalesce(F.col("trust"), F.lit(default)))


def trust_at(rows: DataFrame, versions: DataFrame, time: str = "ts", default: float = DEFAULT_TRUST) -> DataFrame:
    """Add the trust that a row's user had at the time of the row; before the first version it is the default.

    ``versions`` are rows (user_id, window_end, trust, n_windows), as the running trust of a stream writes them. Where a late
    window corrected an end, the row with most windows counts.
    """
    newest = versions.groupBy("user_id", "window_end").agg(F.max_by("trust", "n_windows").alias("trust"))
    found = as_of_join(rows, newest, "user_id", time, "trust", version_time="window_end")
    return found.withColumn("trust", F.coalesce("trust", F.lit(default)))


def risk_score(p: Column, err: Column, trust: Column, threshold: float) -> Column:
    """0.42 p + 0.38 relative error + 0.20 distrust, kept within 0 and 1; null if one of them is missing."""
    relative = F.when(err.isNotNull(), F.least(F.lit(1.0), err / F.lit(max(float(threshold), 1e-6))))
    return clip(F.lit(0.42) * p + F.lit(0.38) * relative + F.lit(0.20) * (F.lit(1.0) - trust), 0.0, 1.0)


def threat_columns(risk: Column) -> dict[str, Column]:
    """Level, actions and note of a risk score."""

    def chain(values: list[Column]) -> Column:
        out = values[-1]
        for (bound, *_), value in reversed(list(zip(THREAT_LEVELS, values[:-1]))):
            out = F.when(risk >= bound, value).otherwise(out)
        return out

    return {
        "threat_level": chain([F.lit(level) for _, level, _, _ in THREAT_LEVELS]),
        "actions": chain([F.array(*[F.lit(a) for a in actions]) for _, _, actions, _ in THREAT_LEVELS]),
        "notes": chain([F.lit(note) for _, _, _, note in THREAT_LEVELS]),
    }


def decide(df: DataFrame, threshold: float) -> DataFrame:
    """Add risk_score, threat_level, actions and notes to rows with p, err and trust."""
    scored = df.withColumn("risk_score", risk_score(F.col("p"), F.col("err"), F.col("trust"), threshold))
    return scored.withColumns(threat_columns(F.col("risk_score")))


def score_rows(prepared: DataFrame, scorer, classifier, trust: DataFrame, threshold: float, limit: int | None = None,
               small: bool | None = None) -> DataFrame:
    """Decisions for prepared rows, batch or stream; ``limit`` keeps the first rows by row_id."""
    if limit is not None:
        prepared = prepared.orderBy("row_id").limit(limit)
    rows = trust_lookup(classifier.score(scorer.with_error(prepared)), trust, small=small)
    return decide(rows, threshold).select(
        "row_id", "user_id", "threat_level", "risk_score",
        F.col("p").alias("classifier_proba"), F.col("err").alias("reconstruction_mse"),
        "trust", "actions", "notes",
    )


def threat_level_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("threat_level").agg(F.count(F.lit(1)).alias("n"))
