"""Weighted classifiers and their metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fit_trees

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


@dataclass(frozen=True)
class Classifier:
    """A fitted model over ``features``; :meth:`score` adds the probability ``p`` of class 1."""

    kind: str
    model: object

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        if self.kind == "constant":
            return df.withColumn("p", F.lit(float(self.model)))
        if self.kind == "trees":
            return df.withColumn("p", self.model.probability(F.col(features)))
        ready = df.withColumn("_vector", array_to_vector(F.col(features)))
        out = self.model.transform(ready).withColumn("p", vector_to_array("_probability")[1])
        return out.drop("_vector", "_raw", "_probability", "_prediction")


def fit_classifier(df: DataFrame, kind: str = "trees", label: str = "y", weight: str | None = None, seed=42,
                   trees: int = 200, depth: int = 5, rate: float = 0.08, share: float = 0.85, iterations: int = 50, cuts: list | None = None) -> Classifier:
    """Fit boosted trees or, as the fast option, a logistic regression.

    One class only gives a constant classifier. ``cuts`` are the thresholds of the trees where they are known already.
    """
    size = F.max(F.size("features")).alias("d")
    span = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), size).first()
    if span["lo"] == span["hi"]:
        return Classifier("constant", float(span["lo"] or 0))
    if kind == "trees":
        return Classifier(kind, fit_trees(df, span["d"], label, weight, seed=seed, trees=trees, depth=depth, rate=rate, share=share, cuts=cuts))
    if kind != "logistic":
        raise ValueError(f"unknown classifier {kind!r}")
    columns = [array_to_vector("features").alias("_vector"), F.col(label).cast("double").alias("_label")]
    learner = LogisticRegression(maxIter=iterations, regParam=1e-3, featuresCol="_vector", labelCol="_label", predictionCol="_prediction")
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    if weight:
        columns.append(F.col(weight).alias("_weight"))
        learner = learner.setWeightCol("_weight")
    return Classifier(kind, learner.fit(df.select(*columns)))


def confusion(predicted: Column, label: Column) -> list[Column]:
    return [
        F.count_if((predicted == 1) & (label == 1)).alias("tp"),
        F.count_if((predicted == 1) & (label == 0)).alias("fp"),
        F.count_if((predicted == 0) & (label == 1)).alias("fn"),
        F.count_if((predicted == 0) & (label == 0)).alias("tn"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_metrics(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    """One row with accuracy, precision, recall and F1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.agg(*confusion(predicted, label)).select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, p: str = "p", label: str = "y") -> float:
    """Area under the ROC curve with tied scores sharing their rank; NaN with one class."""
    span = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if span["lo"] == span["hi"]:
        return math.nan
    ready = df.select(F.col(p).alias("_score"), F.col(label).cast("double").alias("_label"))
    return BinaryClassificationEvaluator(rawPredictionCol="_score", labelCol="_label", numBins=0).evaluate(ready)


def evaluate(df: DataFrame, model: str, p: str = "p", label: str = "y") -> DataFrame:
    """Metrics of one model as rows (model, metric, value); a probability above 0.5 predicts 1."""
    predicted = (F.col(p) > 0.5).cast("int")
    row = confusion_metrics(df, predicted, F.col(label)).withColumn("roc_auc", F.lit(roc_auc(df, p, label)))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return row.select(F.lit(model).alias("model"), F.explode(cells).alias("c")).select("model", "c.metric", "c.value")
