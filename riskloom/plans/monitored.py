"""The comparison with provenance, audit trail, attribution, drift and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attribution import feature_attribution, with_shapley
from ..operators.monitor import ks_drift, top_features
from ..operators.respond import score_rows, threat_level_counts
from ..operators.trust import trust_map
from ..session import scratch_path, write_table
from ..sources.audit import AuditTrail, write_report
from ..sources.csv_files import ingestion_manifest, resolve_source
from ..sources.provenance import provenance_record
from .experiment import Experiment, Settings, run_experiment


@dataclass(frozen=True)
class MonitoredRun:
    experiment: Experiment
    provenance: DataFrame
    manifest: DataFrame
    attribution: DataFrame
    drift: DataFrame
    decisions: DataFrame
    audit: AuditTrail


def run_monitored(frame: DataFrame, meta: dict, provenance: DataFrame, manifest: DataFrame, settings: Settings = Settings(),
                  audit_folder: str | None = None, limit: int | None = None, report_folder: str | None = None,
                  warnings: list[str] = ()) -> MonitoredRun:
    """Run and monitor the comparison for labelled rows.

    All test rows are attributed and scored unless ``limit`` asks for the first ones only. The data source, the loader's
    warnings and the manifest go to the audit; with ``report_folder`` the run's report is written there as JSON.
    """
    spark = frame.sparkSession
    audit = AuditTrail(spark, audit_folder or scratch_path(spark, "audit"))
    provenance, manifest = write_table(provenance, "provenance"), write_table(manifest, "manifest")
    audit.append("provenance", provenance)
    audit.note("ingestion", event="batch_scan_start")
    audit.append("ingestion_manifest", manifest)
    audit.note("feature_engineering", event="start")
    run = run_experiment(frame, meta, settings)
    audit.append("feature_engineering", run.meta.select("n_rows_input", "n_features_used"))
    for text in warnings:
        audit.note("loader_warning", message=text)
    audit.append("realism", run.realism)
    audit.append("trust_weighted_learning", run.trust)

    train, test = run.rows.filter(F.col("split") == "train"), run.rows.filter(F.col("split") == "test")
    names = run.preparation.names
    explained = with_shapley(test, run.model, train, len(names))
    attribution = write_table(feature_attribution(explained, names), "attribution")
    audit.append("attribution", top_features(attribution))

    drift = write_table(ks_drift(run.rows, names, F.col("split") == "test"), "drift")
    audit.append("drift_detection", drift.agg(F.count_if("drift_flag").alias("n_features_drifted")))

    decisions = score_rows(test.drop("err"), run.scorer, run.model, trust_map(run.trained), run.threshold, limit)
    decisions = write_table(decisions, "decisions")
    audit.append("realtime_inference_response", threat_level_counts(decisions))
    audit.append("audit", provenance.select(F.lit("run_complete").alias("event"), "dataset_id"))
    if report_folder:
        source = F.lit(meta.get("source", "table")).alias("data_source")
        notes = F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("loader_warnings")
        write_report(run.meta.select("*", source, notes), f"{report_folder}/run")
        write_report(run.realism, f"{report_folder}/realism")
        write_report(manifest, f"{report_folder}/manifest")
        write_report(run.metrics, f"{report_folder}/metrics")
        write_report(top_features(attribution), f"{report_folder}/attribution")
        write_report(drift, f"{report_folder}/drift")
        write_report(decisions, f"{report_folder}/decisions")
    return MonitoredRun(run, provenance, manifest, attribution, drift, decisions, audit)


def run_monitored_folder(spark: SparkSession, folder: str, settings: Settings = Settings(), **options) -> tuple[MonitoredRun, list[str]]:
    """The same for a folder of CSV files, and the warnings of the loader."""
    frame, meta, warnings = resolve_source(spark, folder, settings.seed)
    return (
        run_monitored(
            write_table(frame, "source"), meta, provenance_record(spark, folder), ingestion_manifest(spark, folder),
            settings, warnings=warnings, **options,
        ),
        warnings,
    )
