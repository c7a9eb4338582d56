"""Clean, poisoned and trust-weighted models compared on the same held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import LABEL_MESSAGES
from ..operators.anomaly import MIN_BENIGN, anomaly_threshold, benign_subset, fit_scorer, with_anomaly_flag
from ..operators.corrupt import feature_noise, feature_poison, label_noise, label_poison
from ..operators.learn import Classifier, confusion_metrics, evaluate, fit_classifier
from ..operators.monitor import overfit_flags, realism_summary
from ..operators.prep import Preparation, prepare
from ..operators.schema import numeric_feature_columns
from ..operators.trust import trust_summary, trust_training
from ..session import write_table
from ..sources.csv_files import preview, resolve_source


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    label_flip: float = 0.14
    tamper_scale: float = 0.4
    tamper_fraction: float = 0.55
    rounds: int = 4
    power: float = 1.6
    realism: bool = True
    noise_fraction: float = 0.08
    scorer: str = "linear"
    scorer_rounds: int = 45
    classifier: str = "trees"
    trees: int = 200
    depth: int = 5
    split_by: str = "row"  # row, or user: no user on both sides
    score_on: str = "clean"  # rows the anomaly scores of the trust updates come from: clean or poisoned

    def fit_options(self) -> dict:
        return {"kind": self.classifier, "trees": self.trees, "depth": self.depth}


@dataclass(frozen=True)
class Experiment:
    rows: DataFrame  # row_id, user_id, y, split, features, err
    trained: DataFrame  # poisoned training rows with trust
    preparation: Preparation
    scorer: object
    threshold: float
    model: Classifier  # the trust-weighted one
    metrics: DataFrame  # model, metric, value
    trust: DataFrame  # mean trust of flipped and other rows
    warnings: DataFrame  # message
    meta: DataFrame
    preview: DataFrame
    realism: DataFrame  # the noise that was applied and what looks too good


def with_noise(frame: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """The rows with the evaluation noise of the settings, written once, and the number of flipped labels."""
    if not s.realism:
        return frame, 0
    frame = feature_noise(frame, numeric_feature_columns(frame), s.seed + 11)
    # written once: the draws are costly and later passes read a few columns each
    frame = write_table(label_noise(frame, s.noise_fraction, s.seed + 13), "noisy")
    return frame.drop("label_flipped"), frame.filter("label_flipped").count()


def dataset_facts(frame: DataFrame, meta: dict, settings: Settings = Settings()) -> DataFrame:
    """One row of facts about the data set as a run would see it; no model is needed for them."""
    noisy, flips = with_noise(frame, settings)
    prepared, preparation = prepare(noisy, meta.get("categorical", []), settings.seed, split_by=settings.split_by)
    return _meta(prepared, meta, preparation, settings, flips)


def run_experiment(frame: DataFrame, meta: dict, settings: Settings = Settings()) -> Experiment:
    """The whole comparison for labelled rows (row_id, user_id, features, y).

    The model rows, the scored rows and the poisoned rows are written once each; every fit and
    every percentile reads such a table instead of repeating what led to it.
    """
    s = settings
    frame, n_flips = with_noise(frame, s)
    prepared, preparation = prepare(frame, meta.get("categorical", []), s.seed, split_by=s.split_by)
    d = len(preparation.names)

    benign = benign_subset(prepared.filter(F.col("split") == "train"))
    scorer = fit_scorer(benign, d, s.scorer, seed=s.seed, rounds=s.scorer_rounds)
    rows = write_table(scorer.with_error(prepared), "scored")
    train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
    threshold = anomaly_threshold(benign_subset(train))

    clean = fit_classifier(train, seed=s.seed, **s.fit_options())
    clean_metrics = write_table(evaluate(clean.score(test), "clean"), "metrics")

    tampered = feature_poison(train, d, s.tamper_scale, s.tamper_fraction, s.seed + 7)
    poisoned = label_poison(tampered, s.label_flip, True, s.seed)
    if s.score_on == "poisoned":
        poisoned = scorer.with_error(poisoned.drop("err"))
    poisoned = write_table(poisoned, "poisoned")
    plain = fit_classifier(poisoned, seed=s.seed, **s.fit_options())
    model, trained = trust_training(poisoned, threshold, s.rounds, s.power, s.seed, **s.fit_options())

    flagged = with_anomaly_flag(test, threshold)
    counts = (
        rows.agg(
            F.count_if(F.col("split") == "train").cast("double").alias("n_train"),
            F.count_if(F.col("split") == "test").cast("double").alias("n_test"),
            F.count_if((F.col("split") == "train") & (F.col("y") == 0)).cast("double").alias("n_benign"),
        )
        .withColumn("scorer_saw_all_rows", (F.col("n_benign") < MIN_BENIGN).cast("double"))
        .select(
            "*", F.lit(float(d)).alias("n_features"), F.lit(float(threshold)).alias("threshold"),
            F.lit(float(getattr(scorer, "updates", 0))).alias("scorer_updates"),
        )
    )
    facts = counts.select(
        "*", trained.agg(F.count_if("poisoned").cast("double")).scalar().alias("label_poisoned_rows")
    )
    metrics = (
        clean_metrics
        .unionByName(evaluate(plain.score(test), "poisoned"))
        .unionByName(evaluate(model.score(test), "trust_weighted"))
        .unionByName(_as_metrics(confusion_metrics(flagged, F.col("anomalous"), F.col("y")).select("f1"), "anomaly"))
        .unionByName(_as_metrics(facts, "run"))
    )
    return Experiment(
        rows=rows, trained=trained, preparation=preparation, scorer=scorer, threshold=threshold, model=model,
        metrics=metrics, trust=trust_summary(trained), warnings=overfit_flags(clean_metrics),
        meta=_meta(rows, meta, preparation, s, n_flips), preview=preview(frame),
        realism=realism_summary(clean_metrics, s.noise_fraction if s.realism else 0.0, n_flips, s.realism),
    )


def _as_metrics(row: DataFrame, model: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])
    return row.select(F.lit(model).alias("model"), F.explode(cells).alias("c")).select("model", "c.metric", "c.value")


def _meta(rows: DataFrame, meta: dict, preparation: Preparation, s: Settings, n_flips: int) -> DataFrame:
    """One row of facts about the data set."""
    source = meta.get("label_source", "n/a")
    return rows.agg(F.count(F.lit(1)).alias("n_rows_input")).select(
        "n_rows_input",
        F.lit(source).alias("label_source"),
        F.lit(LABEL_MESSAGES.get(source, "The caller supplied the labels.")).alias("label_message"),
        F.lit(len(preparation.names)).alias("n_features_used"),
        F.array(*[F.lit(n) for n in preparation.names]).alias("feature_names"),
        F.lit(s.noise_fraction if s.realism else 0.0).alias("evaluation_label_noise_fraction"),
        F.lit(int(n_flips)).cast("bigint").alias("evaluation_label_flips"),
        F.lit(bool(s.realism)).alias("gaussian_feature_noise_applied"),
    )


def run_folder(spark: SparkSession, folder: str, settings: Settings = Settings()) -> tuple[Experiment, list[str]]:
    """The comparison for a folder of CSV files, and the warnings of the loader."""
    frame, meta, warnings = resolve_source(spark, folder, settings.seed)
    return run_experiment(write_table(frame, "source"), meta, settings), warnings
