"""End to end on a planted signal, and every query against its SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from riskloom.plans.adapters import event_table, planted_signal
from riskloom.plans.experiment import Settings, run_experiment
from riskloom.plans.monitored import run_monitored_folder
from riskloom.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.threat_level for r in rows} <= {"critical", "elevated", "watch", "normal"} and sum(r.n for r in rows) == 1000


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, name, FOLDER, con).startswith("ok")


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("score_on", ["clean", "poisoned"])
def test_flipped_rows_lose_trust(spark, score_on):
    frame, meta = planted_signal(spark, FOLDER)
    run = run_experiment(frame, meta, Settings(classifier="logistic", rounds=3, realism=False, score_on=score_on))
    trust = run.trust.first()
    assert trust.mean_trust_flipped < trust.mean_trust_other - 0.2
    metrics = {(r.model, r.metric): r.value for r in run.metrics.collect()}
    assert metrics["clean", "roc_auc"] > 0.9
    assert metrics["trust_weighted", "roc_auc"] >= metrics["poisoned", "roc_auc"] - 0.02
    assert metrics["run", "n_train"] == 375 and metrics["run", "n_test"] == 125
    assert run.trained.count() == 375


def test_monitored_run_of_a_folder(spark):
    base = scratch_path(spark, "folder")
    events = event_table(spark, FOLDER).drop("row_id").toPandas()
    os.makedirs(base.removeprefix("file:"), exist_ok=True)
    events.to_csv(f"{base.removeprefix('file:')}/events.csv", index=False)
    run, warnings = run_monitored_folder(spark, base, Settings(classifier="logistic", rounds=2), limit=20)
    assert warnings == [] and run.decisions.count() == 20
    assert run.attribution.count() == 12 and run.drift.count() == 12
    assert run.manifest.first().total_csv_rows == 1000
    stages = [r.stage for r in run.audit.tail(40).collect()]
    assert stages[0] == "audit" and stages[-1] == "provenance"
    assert run.experiment.meta.first().label_source == "probabilistic_rules"
    assert run.experiment.preview.count() == 15
    assert run.experiment.rows.filter(F.col("err") < 0).count() == 0
