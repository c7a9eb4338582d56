"""Model queries: what they return depends on the fitted model, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.anomaly import anomaly_threshold, fit_linear, fit_network
from ...operators.attribution import feature_attribution, with_shapley
from ...operators.learn import evaluate, fit_classifier
from ...operators.monitor import top_features
from ...operators.prep import prepare
from ...operators.respond import score_rows
from ...operators.trust import trust_map, trust_training
from ...sources.csv_files import table_manifest
from ...sources.provenance import table_provenance
from ...session import write_table
from ..adapters import labelled_events, planted_signal, table
from ..experiment import Settings, dataset_facts, run_experiment
from ..monitored import run_monitored
from .registry import query, rounded

SETTINGS = Settings()


def _planted(spark, folder):
    frame, _ = planted_signal(spark, folder)
    rows, preparation = prepare(frame)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'"), preparation


@query("fit_reconstruction_linear")
def linear_errors(spark, folder):
    train, test, preparation = _planted(spark, folder)
    scorer = fit_linear(train.filter("y = 0"), len(preparation.names))
    return rounded(scorer.with_error(train.unionByName(test)).select("row_id", "y", "split", "err"))


@query("fit_reconstruction_network")
def network_errors(spark, folder):
    train, test, preparation = _planted(spark, folder)
    scorer = fit_network(train.filter("y = 0"), len(preparation.names))
    return rounded(scorer.with_error(train.unionByName(test)).select("row_id", "y", "split", "err"))


@query("fit_weighted_trees")
def tree_metrics(spark, folder):
    train, test, _ = _planted(spark, folder)
    weighted = train.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    return rounded(evaluate(fit_classifier(weighted, weight="w").score(test), "trees"))


@query("fit_weighted_logistic")
def logistic_metrics(spark, folder):
    train, test, _ = _planted(spark, folder)
    weighted = train.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    return rounded(evaluate(fit_classifier(weighted, "logistic", weight="w").score(test), "logistic"))


@query("trust_training")
def trained_trust(spark, folder):
    train, _, preparation = _planted(spark, folder)
    scored = fit_linear(train.filter("y = 0"), len(preparation.names)).with_error(train)
    threshold = anomaly_threshold(scored.filter("y = 0"))
    _, state = trust_training(scored, threshold, rounds=SETTINGS.rounds, power=SETTINGS.power)
    return rounded(state.select("row_id", "user_id", "y", "trust"))


@query("feature_attribution")
def attribution(spark, folder):
    train, test, preparation = _planted(spark, folder)
    model = fit_classifier(train)
    explained = with_shapley(test, model, train, len(preparation.names))
    return rounded(top_features(feature_attribution(explained, preparation.names)))


@query("score_rows")
def scored_rows(spark, folder):
    train, test, preparation = _planted(spark, folder)
    scorer = fit_linear(train.filter("y = 0"), len(preparation.names))
    scored = scorer.with_error(train)
    threshold = anomaly_threshold(scored.filter("y = 0"))
    model, state = trust_training(scored, threshold, rounds=SETTINGS.rounds, power=SETTINGS.power)
    return rounded(score_rows(test, scorer, model, trust_map(state), threshold))


@query("model_comparison")
def comparison(spark, folder):
    frame, meta = planted_signal(spark, folder)
    return rounded(run_experiment(frame, meta).metrics)


@query("dataset_facts")
def facts(spark, folder):
    frame, meta = planted_signal(spark, folder)
    return dataset_facts(frame, meta)


@query("realism_summary")
def realism(spark, folder):
    frame, meta = planted_signal(spark, folder)
    return run_experiment(frame, meta).realism


@query("monitored_run")
def monitored(spark, folder):
    """The monitored comparison over all events; the result is the threat level of every test event."""
    frame, meta = labelled_events(spark, folder)
    frame = write_table(frame, "source")
    events = table(spark, folder, "events")
    run = run_monitored(frame, meta, table_provenance(events, "events"), table_manifest(events))
    return rounded(run.decisions.select("row_id", "user_id", "threat_level", "risk_score", "trust"))


@query("monitored_audit")
def monitored_audit(spark, folder):
    frame, meta = planted_signal(spark, folder)
    source = table(spark, folder, "embeddings").select("vec_id", "label")
    run = run_monitored(frame, meta, table_provenance(source, "embeddings"), table_manifest(source))
    return run.audit.tail(40).select("seq", "stage", "payload")
