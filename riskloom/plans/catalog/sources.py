"""File queries: the tables are written as CSV into the scratch folder and read by the loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import scratch_path
from ...sources.audit import AuditTrail, audit_tail, write_report
from ...sources.csv_files import (
    csv_inventory,
    ingestion_manifest,
    load_logs,
    read_answer_users,
    read_csv_tolerant,
    resolve_source,
    scan_csv_union,
)
from ...sources.provenance import content_fingerprint, provenance_record
from ..adapters import answer_set, event_table, given_scores, log_tables, order_table, table
from .registry import EVENT_CTE, USER_LOG_CTE, query, r6


PARTS = 8


def _write_csv(df, base: str, name: str) -> None:
    """A table as a folder ``name`` of eight part files, each with a header."""
    df.repartition(PARTS).write.option("header", "true").option("escape", '"').csv(f"{base}/{name}")


def _log_folder(spark, folder: str, answers: bool = True) -> str:
    """Log tables as ``<kind>.csv`` folders of part files."""
    base = scratch_path(spark, "logs")
    for kind, df in log_tables(spark, folder).items():
        _write_csv(df, base, f"{kind}.csv")
    if answers:
        _write_csv(answer_set(spark, folder).distinct(), base, "insiders.csv")
    return base


@query("read_csv_log_features", f"WITH {USER_LOG_CTE} SELECT * FROM users")
def csv_logs(spark, folder):
    return load_logs(spark, _log_folder(spark, folder, False))


@query(
    "resolve_log_source",
    f"WITH {USER_LOG_CTE} SELECT *, (CASE WHEN user_id::BIGINT % 10 = 0 THEN 1 ELSE 0 END)::INT AS y, user_id AS row_id FROM users",
)
def csv_log_source(spark, folder):
    return resolve_source(spark, _log_folder(spark, folder))[0]


@query(
    "resolve_event_source",
    f"""WITH {EVENT_CTE} SELECT user_id, count(*) AS n, round(sum(data_volume_mb), 4) AS volume, sum(failed_attempts) AS failed,
      sum(privilege_level) AS privileged, sum(hour(ts))::DOUBLE AS hours, count(*)::DOUBLE AS frequency FROM ev GROUP BY user_id""",
)
def csv_event_source(spark, folder):
    base = scratch_path(spark, "eventcsv")
    events = event_table(spark, folder)
    early = F.col("row_id") % 3 == 0
    _write_csv(events.filter(~early).drop("row_id"), base, "activity.csv")
    renamed = {"user_id": "userid", "timestamp": "datetime", "data_volume_mb": "volume_mb"}  # other names of the same roles
    _write_csv(events.filter(early).drop("row_id").withColumnsRenamed(renamed), base, "activity_early.csv")
    frame, _, _ = resolve_source(spark, base)
    return frame.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("data_volume_mb"), 4).alias("volume"), F.sum("failed_attempts").alias("failed"),
        F.sum("privilege_level").alias("privileged"), F.sum("hour").alias("hours"), F.max("login_frequency").alias("frequency"),
    )


@query(
    "resolve_tabular_source",
    """SELECT o_custkey::VARCHAR AS user_id, round(avg(o_totalprice), 6) AS price,
      max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::INT AS y FROM orders GROUP BY o_custkey""",
)
def csv_tabular_source(spark, folder):
    base = scratch_path(spark, "tabular")
    orders = order_table(spark, folder).select(
        "user_id", "price", "priority", F.when(F.col("status") == "F", "yes").otherwise("no").alias("label")
    )
    half = F.col("price") % 2 < 1
    _write_csv(orders.filter(half), base, "wide_a.csv")
    _write_csv(orders.filter(~half), base, "wide_b.csv")
    _write_csv(orders.select("user_id", "price"), base, "narrow.csv")
    frame, _, _ = resolve_source(spark, base)
    return frame.select("user_id", r6("price").alias("price"), "y")


@query("read_answer_users", "SELECT DISTINCT user_id::VARCHAR AS user_id FROM events WHERE user_id % 10 = 0")
def csv_answers(spark, folder):
    return read_answer_users(spark, _log_folder(spark, folder))


@query(
    "scan_csv_union",
    """SELECT c_nationkey AS nation, count(*) AS n, count(c_mktsegment) AS n_segment FROM
      (SELECT c_nationkey, c_mktsegment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY 1""",
)
def csv_union(spark, folder):
    base = scratch_path(spark, "union")
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    _write_csv(customers, base, "a.csv")
    _write_csv(table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name"), base, "b.csv")
    rows = scan_csv_union(spark, f"{base}/*.csv")
    return rows.groupBy(F.col("nation").cast("int").alias("nation")).agg(
        F.count(F.lit(1)).alias("n"), F.count("segment").alias("n_segment")
    )


@query("csv_inventory", "SELECT count(*) AS total_csv_rows, 32::BIGINT AS files_seen FROM events")
def inventory(spark, folder):
    return csv_inventory(spark, _log_folder(spark, folder, False))


@query(
    "csv_manifest",
    """SELECT 'batch_csv_files' AS transport, greatest(1, ceil(count(*) / 1000e0))::BIGINT AS micro_batches,
      count(*) AS total_csv_rows, 32::BIGINT AS files_seen FROM events""",
)
def manifest(spark, folder):
    return ingestion_manifest(spark, _log_folder(spark, folder, False), 1000)


@query("content_fingerprint")
def fingerprint(spark, folder):
    return content_fingerprint(spark, _log_folder(spark, folder)).select("content_sha256")


@query("provenance_record")
def provenance(spark, folder):
    return provenance_record(spark, _log_folder(spark, folder)).select("dataset_id", "content_sha256", "pipeline_version")


@query(
    "audit_tail",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id AS seq, event_type AS stage, props AS payload
    FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 30""",
)
def last_entries(spark, folder):
    entries = table(spark, folder, "events").select(
        "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("props").alias("payload")
    )
    return audit_tail(entries, 30).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("audit_append", "SELECT 0::BIGINT AS seq, 'scan' AS stage, count(*) AS n FROM events UNION ALL SELECT 1, 'users', count(DISTINCT user_id) FROM events")
def audit_trail(spark, folder):
    trail = AuditTrail(spark, scratch_path(spark, "audit"))
    events = table(spark, folder, "events")
    trail.append("scan", events.agg(F.count(F.lit(1)).alias("n")))
    trail.append("users", events.agg(F.count_distinct("user_id").alias("n")))
    return trail.tail().select("seq", "stage", F.get_json_object("payload", "$.n").cast("bigint").alias("n"))


@query("report_sink", "SELECT event_id AS row_id, user_id::VARCHAR AS user_id FROM events")
def report(spark, folder):
    path = scratch_path(spark, "report")
    write_report(given_scores(spark, folder).select("row_id", "user_id", F.col("p").alias("_internal")), path)
    return spark.read.schema("row_id long, user_id string").json(path)
