"""CSV files: tolerant reading, inventory, answer lists and choice of the input file."""

from __future__ import annotations

import csv
import logging
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hour_or_null, is_number, named, to_number
from ..functions.vocabulary import (
    CATEGORICAL_COLUMNS,
    EVENT_ALIASES,
    MICRO_BATCH_ROWS,
    MIN_EVENT_ROWS,
    MIN_TABULAR_ROWS,
    MISSING_WORDS,
    PREVIEW_ROWS,
)
from ..operators.events import event_features
from ..operators.joins import label_from_answers
from ..operators.logs import numeric_columns, percentile_label, tabular_user_features, user_log_features
from ..operators.schema import coerce_mostly_numeric, event_roles, has_event_columns, tabular_roles
from ..session import write_table

LOG_KINDS = ("logon", "device", "email", "file")
WHOLE_NUMBER = r"^\s*[+-]?\d{1,18}\s*$"
#: A quoted cell that begins in this line and is not closed in it; a quote inside a plain cell is no such thing.
OPEN_CELL = r'(^|,)\s*"([^"]|"")*$'

log = logging.getLogger(__name__)


def list_entries(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a glob: files, and folders of part files; read from the listing only."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    return list_entries(spark, f"{folder.rstrip('/')}/*.csv")


def files_below(spark: SparkSession, folder: str, glob: str = "*.csv") -> list[str]:
    """Paths of all matching files at any depth, empty ones too, from Spark's file listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return sorted(plain_path(unquote(p)) for p in reader.load(folder).inputFiles())


def plain_path(path: str) -> str:
    """Local files are written with one or with three slashes; keep one."""
    return path.replace("file:///", "file:/", 1)


def files_of(spark: SparkSession, entries: list[str]) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Header and line-break flag of every file that is not empty: one pass over all lines of all entries.

    The flag is set where a quoted cell goes on in the next line.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(entries).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"),
    )
    seen = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"), F.max(F.col("value").rlike(OPEN_CELL)).alias("open"))
    return {r["path"]: (tuple(next(csv.reader([r["header"]]), [])), r["open"]) for r in seen.collect() if (r["header"] or "").strip()}


def read_groups(spark: SparkSession, entries: list[str]) -> list[tuple[list[str], DataFrame]]:
    """CSV entries as text tables, one for each header: (its entries, rows).

    Files with the same header are read together, so the plan has a branch for each header, whatever the number of
    files. Only files with line breaks inside cells are read in multi-line mode, because Spark cannot split those.
    Folders keep the columns that their ``key=value`` folders stand for.
    """
    if not entries:
        return []
    groups: dict[tuple, dict] = {}
    for path, (header, broken) in sorted(files_of(spark, entries).items()):
        plain = plain_path(unquote(path))
        entry = max((e for e in entries if plain == plain_path(e) or plain.startswith(plain_path(e).rstrip("/") + "/")), key=len)
        base = entry if plain != plain_path(entry) and "=" in plain[len(plain_path(entry)) :] else None
        part = groups.setdefault(header, {"entries": [], "reads": {}})
        if entry not in part["entries"]:
            part["entries"].append(entry)
        part["reads"].setdefault((base, broken), []).append(path)
    out = []
    for part in groups.values():
        frame = None
        for (base, broken), paths in part["reads"].items():
            reader = spark.read.option("basePath", base) if base else spark.read
            rows = reader.csv([unquote(p) for p in paths], header=True, multiLine=broken, escape='"', mode="PERMISSIVE")
            frame = rows if frame is None else frame.unionByName(rows, allowMissingColumns=True)
        cells = [F.when(~named(c).cast("string").isin(*MISSING_WORDS), named(c).cast("string")).alias(c) for c in frame.columns]
        out.append((part["entries"], frame.select(*cells)))
    return out


def union_groups(groups: list[DataFrame]) -> DataFrame | None:
    out = None
    for frame in groups:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame | None:
    """All cells of a CSV file or folder of part files as text; None when it is missing or empty.

    Anything else that goes wrong (access, storage) rises.
    """
    return union_groups([frame for _, frame in read_groups(spark, list_entries(spark, path))])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose every present cell is a whole number, number or true/false."""
    aggregates = []
    for i, c in enumerate(df.columns):
        x = named(c)
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.count_if(x.rlike(WHOLE_NUMBER)).alias(f"w{i}"),
            F.count(to_number(x, T.StringType())).alias(f"d{i}"),
            F.count_if(x.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"b{i}"),
        ]
    seen = df.agg(*aggregates).first()
    columns = []
    for i, c in enumerate(df.columns):
        x, n = named(c), seen[f"n{i}"]
        if n and seen[f"w{i}"] == n:
            x = F.trim(x).try_cast("bigint")
        elif seen[f"d{i}"] == n:
            x = to_number(x, T.StringType())
        elif seen[f"b{i}"] == n:
            x = x.try_cast("boolean")
        columns.append(x.alias(c))
    return df.select(*columns)


def read_csv_tolerant(spark: SparkSession, path: str) -> DataFrame | None:
    """Full CSV with inferred types; None when the file is missing or unreadable."""
    df = read_texts(spark, path)
    return None if df is None else infer_types(df)


def scan_csv_union(spark: SparkSession, pattern: str) -> DataFrame | None:
    """All matching files as one bag of rows, columns matched by name; None without a match."""
    out = read_texts(spark, pattern)
    return None if out is None else infer_types(out)


def csv_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row: text lines minus one header per file (at least 0), and the number of files."""
    files = F.lit(len(files_below(spark, folder))).cast("bigint")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(folder)
    return lines.agg(
        F.greatest(F.lit(0).cast("bigint"), F.count(F.lit(1)) - files).alias("total_csv_rows"), files.alias("files_seen")
    )


def manifest_columns(rows, batch_rows: int = MICRO_BATCH_ROWS):
    """Number of micro-batches for a row count, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(rows / F.lit(batch_rows)))


def ingestion_manifest(spark: SparkSession, folder: str | None, batch_rows: int = MICRO_BATCH_ROWS) -> DataFrame:
    """One row that describes the files to be ingested."""
    if folder is None:
        return spark.range(1).select(
            F.lit("in_memory_synthetic").alias("transport"), F.lit(1).cast("bigint").alias("micro_batches"),
            F.lit(0).cast("bigint").alias("total_csv_rows"), F.lit(0).cast("bigint").alias("files_seen"),
        )
    return csv_inventory(spark, folder).select(
        F.lit("batch_csv_files").alias("transport"),
        manifest_columns(F.col("total_csv_rows"), batch_rows).alias("micro_batches"),
        "total_csv_rows", "files_seen",
    )


def table_manifest(df: DataFrame, batch_rows: int = MICRO_BATCH_ROWS) -> DataFrame:
    """The same facts for any table."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", manifest_columns(F.col("total_rows"), batch_rows).alias("micro_batches")
    )


def looks_like_feature_matrix(typed: DataFrame) -> bool:
    """At least three columns, at least two of them numeric, judged by the types of all rows."""
    if len(typed.columns) < 3:
        return False
    return sum(is_number(f.dataType) or isinstance(f.dataType, T.BooleanType) for f in typed.schema) >= 2


def answer_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files at any depth that are named, or lie in a folder named, insider*.csv or malicious*.csv."""
    start = plain_path(list_entries(spark, folder.rstrip("/"))[0])
    names = re.compile(r"/(insider|malicious)[^/]*\.csv(/|$)")
    return [p for p in files_below(spark, folder) if names.search(p[len(start) :])]


def read_answer_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct user ids of all answer files; feature tables with such a name are passed over and logged."""
    out = spark.createDataFrame([], "user_id string")
    for entries, texts in read_groups(spark, answer_files(spark, folder)):
        typed = infer_types(texts)
        column = next((c for c in texts.columns if any(w in c.lower() for w in ("user", "insider", "employee"))), None)
        if looks_like_feature_matrix(typed) or column is None:
            log.warning("not an answer list: %s", ", ".join(entries))
            continue
        out = out.unionByName(typed.select(named(column).cast("string").alias("user_id")))
    return out.na.drop().distinct()


def with_row_id(df: DataFrame) -> DataFrame:
    """Add a ``row_id`` that depends on content only: MD5 of the row as JSON and the occurrence number.

    Equal rows are counted before the shuffle (written once) and numbered while they are expanded again, in
    blocks that spread over tasks, so many copies of one row do not meet in one task.
    """
    names = [named(c) for c in df.columns]
    cells = F.md5(F.to_json(F.struct(*[named(c).cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    counted = write_table(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "distinct")
    block = 100_000
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))))
    if not counted.filter(F.col("_n") > block).isEmpty():
        blocks = blocks.repartition("_block", *names)
    first = F.col("_block") * block
    number = F.explode(F.sequence(first, F.least(first + block, F.col("_n")) - 1))
    return blocks.withColumn("_occurrence", number).select(
        F.concat(cells, F.lit("-"), F.col("_occurrence").cast("string")).alias("row_id"), *names
    )


def event_tables(spark: SparkSession, folder: str, pick: str = "all") -> tuple[list[str], DataFrame, list[str]] | None:
    """All rows of the folder's event-schema files under the roles' first names: (entries, rows, entries left out).

    ``pick="largest"`` keeps the file with most rows only (the first one of a tie).
    """
    canonical = {role: aliases[0] for role, aliases in EVENT_ALIASES.items()}

    def under_roles(texts: DataFrame) -> DataFrame:
        return texts.select(*[named(c).alias(canonical[role]) for role, c in event_roles(texts.columns).items() if c])

    groups = [(e, under_roles(t)) for e, t in read_groups(spark, list_csv(spark, folder)) if has_event_columns(t.columns)]
    left: list[str] = []
    if pick == "largest":
        single = [(e, under_roles(read_texts(spark, e)).count()) for e in sorted(e for es, _ in groups for e in es)]
        best = max(single, key=lambda x: x[1], default=None)
        left = [e for e, _ in single if e != best[0]] if best else []
        groups = [([best[0]], under_roles(read_texts(spark, best[0])))] if best else []
    rows = union_groups([t for _, t in groups])
    return None if rows is None else (sorted(e for es, _ in groups for e in es), rows, left)


def load_events(spark: SparkSession, folder: str, seed=42, pick: str = "all", min_rows: int = MIN_EVENT_ROWS) -> tuple[DataFrame, dict, list[str]] | None:
    """Labelled event features of all event files, their facts and warnings; None without such rows."""
    found = event_tables(spark, folder, pick)
    if found is None:
        return None
    entries, texts, left = found
    typed = write_table(with_row_id(infer_types(texts)), "events")
    rows = typed.count()
    if not rows:
        return None
    warnings = [f"Left out by choice of the largest file: {e}." for e in left]
    if rows < min_rows:
        warnings.append(f"The event files have only {rows} rows; {min_rows} or more make training meaningful.")
    time = event_roles(typed.columns)["time"]
    unread = typed.filter(named(time).isNotNull() & hour_or_null(named(time), typed.schema[time].dataType).isNull()).count()
    if unread:
        warnings.append(f"{unread} time cells could not be read and count as hour 12.")
    features, meta = event_features(typed, seed)
    return features, {**meta, "n_rows": rows, "source_files": entries, "n_unread_times": unread}, warnings


def load_logs(spark: SparkSession, folder: str) -> DataFrame | None:
    """User features of the log tables that are there; None without any.

    A log of a kind is ``<kind>.csv`` (a file, or a folder of part files), ``<kind>-*.csv``, or a folder ``<kind>``; all are read.
    """
    logs = {}
    for kind in LOG_KINDS:
        entries = sorted({e for name in (f"{kind}.csv", f"{kind}-*.csv", kind) for e in list_entries(spark, f"{folder.rstrip('/')}/{name}")})
        frames = [infer_types(texts) for _, texts in read_groups(spark, entries)]
        if frames:
            logs[kind] = frames
    users = user_log_features(logs) if logs else None
    return None if users is None or users.isEmpty() else users


def load_tabular(spark: SparkSession, folder: str, min_rows: int = MIN_TABULAR_ROWS) -> tuple[DataFrame, dict, list[str]] | None:
    """Labelled user rows of the best wide table: most features, then most rows, then first path.

    Files with the same columns are one table. Tables are judged first, and only the best one is built; the files left
    out are named in the warnings.
    """
    best, passed, answers = None, [], None
    for entries, texts in read_groups(spark, list_csv(spark, folder)):
        df = infer_types(texts)
        df = df.toDF(*[c.strip() for c in df.columns])
        role = tabular_roles(df.columns)
        if role["user"] is None:
            passed.append(entries)
            continue
        _, features, n = coerce_mostly_numeric(df, tuple(c for c in (role["user"], role["label"], "row_id") if c))
        score = (1000 * len(features) + n, [-ord(c) for c in entries[0]])
        if n < min_rows or not features or (best is not None and score <= best[0]):
            passed.append(entries)
            continue
        if best is not None:
            passed.append(best[1])
        best = (score, entries, df)
    if best is None:
        return None
    answers = read_answer_users(spark, folder)
    users, meta = tabular_user_features(best[2], answers, min_rows)
    warnings = _tabular_warnings(best[1][0].rsplit("/", 1)[-1], meta)
    warnings += [f"Not used as the wide table: {e}." for es in passed for e in es]
    return users, {**meta, "source_files": best[1]}, warnings


def _tabular_warnings(name: str, meta: dict) -> list[str]:
    warnings = []
    if meta["label_source"] == "percentile":
        warnings.append(
            f"{name} has no label column and there is no answer file: labels follow the feature percentile."
        )
    if meta["n_rows"] < MIN_EVENT_ROWS:
        warnings.append(f"{name} has fewer than {MIN_EVENT_ROWS} rows, so metrics say little.")
    if meta["label_column"]:
        warnings.append(f"{name} was read with '{meta['label_column']}' as the label.")
    else:
        warnings.append(f"{name} was read without a label column.")
    return warnings


def resolve_source(spark: SparkSession, folder: str, seed=42, pick: str = "all") -> tuple[DataFrame, dict, list[str]]:
    """Labelled rows of a folder: event files first, then log tables, then a wide table.

    Every frame has row_id, user_id, features and y. ``meta`` names the source kind and the
    categorical columns.
    """
    events = load_events(spark, folder, seed, pick)
    if events is not None:
        frame, meta, warnings = events
        rest = sorted(set(list_csv(spark, folder)) - set(meta["source_files"]))
        warnings = warnings + [f"Not used, as event files come first: {e}." for e in rest if f"file: {e}." not in " ".join(warnings)]
        return frame, {**meta, "source": "custom_insider_events", "categorical": list(CATEGORICAL_COLUMNS)}, warnings
    users = load_logs(spark, folder)
    if users is not None:
        answers, warnings = read_answer_users(spark, folder), []
        if answers.isEmpty():
            users = percentile_label(users, numeric_columns(users))
            warnings.append("There is no answer file: labels follow the activity percentile.")
        else:
            users = label_from_answers(users, answers)
        known = [e for kind in LOG_KINDS for name in (f"{kind}.csv", f"{kind}-*.csv") for e in list_entries(spark, f"{folder.rstrip('/')}/{name}")]
        rest = sorted(set(list_csv(spark, folder)) - set(known))
        warnings += [f"Not used, as log tables come first: {e}." for e in rest if not re.search(r"/(insider|malicious)[^/]*$", e)]
        return users.withColumn("row_id", F.col("user_id")), {"source": "cert", "label_source": "logs", "categorical": []}, warnings
    tabular = load_tabular(spark, folder)
    if tabular is not None:
        frame, meta, warnings = tabular
        return frame.withColumn("row_id", F.col("user_id")), {**meta, "source": "csv_tabular", "label_source": "tabular", "categorical": []}, warnings
    raise RuntimeError("no usable CSV files in the folder")


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by row key."""
    return df.orderBy("row_id").limit(n)
