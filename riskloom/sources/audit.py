"""Append-only audit trail and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "ts timestamp, seq long, stage string, payload string"


class AuditTrail:
    """Audit entries as JSON files in one folder; entries are only ever added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seq = 0

    def append(self, stage: str, payload: DataFrame, batch: int | None = None) -> None:
        """One entry per payload row; the row is stored as JSON text.

        Entries of a numbered ``batch`` have a folder of their own, so a repeated batch replaces its entries.
        """
        seq = self._seq if batch is None else batch
        entries = payload.select(
            F.current_timestamp().alias("ts"), F.lit(seq).cast("bigint").alias("seq"),
            F.lit(stage).alias("stage"), F.to_json(F.struct("*")).alias("payload"),
        )
        if batch is None:
            self._seq += 1
            entries.write.mode("append").json(f"{self.folder}/notes")
        else:
            entries.write.mode("overwrite").json(f"{self.folder}/{stage}-{batch}")

    def note(self, stage: str, **values) -> None:
        """An entry with plain values."""
        cells = [F.lit(v).alias(k) for k, v in values.items()]
        self.append(stage, self.spark.range(1).select(*cells))

    def entries(self) -> DataFrame:
        return self.spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", "true").json(self.folder)

    def tail(self, n: int = 30) -> DataFrame:
        return audit_tail(self.entries(), n)


def audit_tail(entries: DataFrame, n: int = 30) -> DataFrame:
    """The last n entries, newest first."""
    return entries.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON lines; columns whose name starts with ``_`` are internal and left out."""
    report.select(*[c for c in report.columns if not c.startswith("_")]).write.mode("append").json(path)
