"""CSV reading, choice of the input, provenance and audit on small literal files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import hour_or_null

from riskloom.session import scratch_dir, write_table
from riskloom.sources.audit import AuditTrail, write_report
from riskloom.sources.csv_files import (
    csv_inventory,
    infer_types,
    ingestion_manifest,
    load_events,
    load_logs,
    load_tabular,
    looks_like_feature_matrix,
    read_answer_users,
    read_csv_tolerant,
    read_texts,
    resolve_source,
    scan_csv_union,
    with_row_id,
)
from riskloom.sources import provenance
from riskloom.sources.provenance import content_fingerprint, provenance_record, table_fingerprint
from riskloom.sources.streams import dead_letters, kafka_source, message_events


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + ("\n" if lines else ""))
    return str(path)


def test_missing_empty_and_typed_files(spark, tmp_path):
    assert read_csv_tolerant(spark, str(tmp_path / "none.csv")) is None
    assert read_csv_tolerant(spark, write(tmp_path / "empty.csv")) is None
    path = write(tmp_path / "a.csv", "id,price,ok,text,gap", "007,1.5,True,x,", "8,NA,False,None,3")
    df = read_csv_tolerant(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "bigint"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(7, 1.5, True, "x", None), (8, None, False, None, 3)]


def test_line_break_in_a_cell(spark, tmp_path):
    path = write(tmp_path / "a.csv", "user,note", 'u1,"two', 'lines, ""quoted"""', "u2,plain")
    rows = read_csv_tolerant(spark, path).orderBy("user").collect()
    assert [r.user for r in rows] == ["u1", "u2"] and rows[0].note == 'two\nlines, "quoted"'


def test_union_matches_columns_by_name(spark, tmp_path):
    write(tmp_path / "b.csv", "x,y", "1,2")
    write(tmp_path / "a.csv", "y,z", "5,q")
    df = scan_csv_union(spark, f"{tmp_path}/*.csv")
    assert sorted(df.columns) == ["x", "y", "z"] and df.count() == 2 and df.agg(F.sum("y")).first()[0] == 7
    assert scan_csv_union(spark, f"{tmp_path}/*.tsv") is None


def test_inventory_counts_lines_and_empty_files(spark, tmp_path):
    write(tmp_path / "a.csv", "h", "1", "2")
    write(tmp_path / "deep" / "b.csv", "h", "1")
    write(tmp_path / "empty.csv")
    write(tmp_path / "other.txt", "h", "1")
    row = csv_inventory(spark, str(tmp_path)).first()
    assert (row.total_csv_rows, row.files_seen) == (2, 3)
    row = ingestion_manifest(spark, str(tmp_path), 1).first()
    assert (row.transport, row.micro_batches) == ("batch_csv_files", 2)
    row = ingestion_manifest(spark, None).first()
    assert (row.transport, row.micro_batches, row.total_csv_rows) == ("in_memory_synthetic", 1, 0)


def test_answer_files(spark, tmp_path):
    write(tmp_path / "deep" / "insider_list.csv", "day,Employee,user", "1,e1,x", "2,,y")
    write(tmp_path / "malicious.csv", "insider_id", "5", "e1")
    write(tmp_path / "insider_dataset.csv", "user,a,b", "zz,1,2")
    assert {r.user_id for r in read_answer_users(spark, str(tmp_path)).collect()} == {"e1", "5"}
    assert looks_like_feature_matrix(read_csv_tolerant(spark, str(tmp_path / "insider_dataset.csv")))


def test_row_ids_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", None)], "x string, y int")
    ids = [r.row_id for r in with_row_id(df).collect()]
    assert len(set(ids)) == 4 and len({i.split("-")[0] for i in ids}) == 2
    assert sorted(ids) == sorted(r.row_id for r in with_row_id(df.repartition(5)).collect())


def test_all_event_files_are_united(spark, tmp_path):
    header = "user_id,timestamp,location,label"
    write(tmp_path / "a.csv", header, "u1,2024-01-01 01:00:00,Pune,1")
    write(tmp_path / "b.csv", "userid,time,city,y", "u1,2024-01-01 01:00:00,Pune,1", "u1,2024-01-01 01:00:00,Pune,1")
    write(tmp_path / "c.csv" / "part-0.csv", header, "u9,2024-01-01 01:00:00,Pune,1")
    write(tmp_path / "c.csv" / "part-1.csv", header, "u9,not a time,Pune,0")
    frame, meta, warnings = load_events(spark, str(tmp_path))
    assert meta["n_rows"] == frame.count() == 5 and len(meta["source_files"]) == 3 and meta["n_unread_times"] == 1
    assert any("only 5 rows" in w for w in warnings) and any("1 time cells" in w for w in warnings)
    assert frame.filter("user_id = 'u1'").first().login_frequency == 3.0
    frame, meta, warnings = load_events(spark, str(tmp_path), pick="largest")
    assert meta["n_rows"] == 2 and meta["source_files"][0].endswith("b.csv") and sum("Left out" in w for w in warnings) == 2


def test_a_stray_quote_keeps_files_split(spark, tmp_path):
    lines = ["id,size"] + [f'{i},5" disk' for i in range(20_000)]
    path = write(tmp_path / "a.csv", *lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = read_texts(spark, path)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_partitioned_log_folder(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i % 3}", "01/02/2024 22:00:00", "Logon", i % 2) for i in range(12)], "user string, date string, activity string, day int")
    df.write.partitionBy("day").option("header", "true").csv(str(tmp_path / "logon"))
    df.drop("day").repartition(2).write.option("header", "true").csv(str(tmp_path / "logon-late.csv"))
    users = {r.user_id: r for r in load_logs(spark, str(tmp_path)).collect()}
    assert len(users) == 3 and all(r.logon_count == 8 and r.after_hours == 8 for r in users.values())


def test_row_ids_of_cells_with_separators(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)], "x string, y string")
    assert with_row_id(df).select("row_id").distinct().count() == 4


def test_time_layouts(spark):
    cells = ["01/02/2024 3:04:05 PM", "1/2/24 15:04", "2 Jan 2024 15:04", "Jan 2, 2024 3:04 PM", "25/12/2024 15:00", "25.12.2024 15:00", "never"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    hours = [r[0] for r in df.select(hour_or_null(F.col("t"), T.StringType())).collect()]
    assert hours == [15] * 6 + [None]


def test_source_priority(spark, tmp_path):
    wide = tmp_path / "wide"
    write(wide / "t.csv", "emp_id,score,label", *[f"u{i},{i},{i % 2}" for i in range(9)])
    write(wide / "small.csv", "emp_id,a,b,c,label", *[f"u{i},1,2,3,0" for i in range(7)])
    frame, meta, warnings = resolve_source(spark, str(wide))
    assert meta["source"] == "csv_tabular" and frame.agg(F.sum("y")).first()[0] == 4
    assert len(warnings) == 3 and "small.csv" in warnings[2]
    logs = tmp_path / "logs"
    write(logs / "logon.csv", "id,date,user,pc,activity", *[f"{i},01/02/2024 0{i}:00:00,u{i},p,Logon" for i in range(9)])
    frame, meta, warnings = resolve_source(spark, str(logs))
    assert meta["source"] == "cert" and len(warnings) == 1 and frame.agg(F.sum("y")).first()[0] == 7
    write(logs / "insiders.csv", "user", "u3")
    frame, _, warnings = resolve_source(spark, str(logs))
    assert warnings == [] and [r.user_id for r in frame.filter("y = 1").collect()] == ["u3"]
    write(logs / "events.csv", "user,time,city", "u,2024-01-01 00:00:00,Pune")
    assert resolve_source(spark, str(logs))[1]["source"] == "custom_insider_events"
    with pytest.raises(RuntimeError):
        resolve_source(spark, str(tmp_path / "nothing"))


def test_equal_tables_are_united_and_ties_keep_the_first(spark, tmp_path):
    for name in ("b.csv", "a.csv"):
        write(tmp_path / name, "user,f,y", *[f"{name}{i},{i},0" for i in range(8)])
    write(tmp_path / "c.csv", "user,g,y", *[f"c{i},{i},0" for i in range(16)])
    users, meta, warnings = load_tabular(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in meta["source_files"]] == ["a.csv", "b.csv"] and users.count() == 16
    assert any("c.csv" in w for w in warnings)


def test_fingerprint_follows_names_and_contents(spark, tmp_path):
    def digest(folder):
        return content_fingerprint(spark, str(folder)).first()

    for name in ("one", "two"):
        write(tmp_path / name / "a.csv", "h", "1")
        write(tmp_path / name / "sub" / "b c+.csv", "h", "2")
    first = digest(tmp_path / "one")
    assert first.content_sha256 == digest(tmp_path / "two").content_sha256 and len(first.sources) == 2
    write(tmp_path / "two" / "sub" / "b c+.csv", "h", "3")
    assert digest(tmp_path / "two").content_sha256 != first.content_sha256
    found = provenance.file_digests(spark, str(tmp_path / "one")).collect()
    assert len({r.digest for r in found}) == 2 and all(not r.digest.startswith("e3b0c442") for r in found)
    assert len(digest(tmp_path / "one").sources) == 2
    write(tmp_path / "one" / "none.csv")
    assert digest(tmp_path / "one").content_sha256 != first.content_sha256
    record = provenance_record(spark, str(tmp_path / "one")).first()
    assert record.dataset_id.startswith("cert_batch:") and record.metadata["root"] == str(tmp_path / "one")


def plain_digest(lines):
    """The digest of a file as defined, line by line."""
    sums = [0, 0, 0, 0]
    for i, line in enumerate(lines):
        h = hashlib.md5(line.encode()).hexdigest()
        sums = [(s + int(h[8 * k : 8 * k + 8], 16) * pow(b, i, provenance.PRIME)) % provenance.PRIME for k, (s, b) in enumerate(zip(sums, provenance.BASES))]
    return hashlib.sha256(":".join(map(str, [len(lines), *sums])).encode()).hexdigest()


def test_digest_sees_the_order_of_lines_at_any_split(spark, tmp_path):
    lines = [f"{i % 13},value {i * 7919 % 101}" for i in range(3000)] + ["", "ümlaut,1", "", "same", "same"]
    swapped = [*lines[:1500], lines[1501], lines[1500], *lines[1502:]]
    for name, rows in (("a", lines), ("b", swapped), ("c", lines[::-1]), ("d", ["one"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "e.csv").write_text("")
    want = {"a": plain_digest(lines), "b": plain_digest(swapped), "c": plain_digest(lines[::-1]), "d": plain_digest(["one"])}
    want["e"] = hashlib.sha256(b"").hexdigest()
    assert len(set(want.values())) == 5
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (size, "5000", "777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r.path.rsplit("/", 1)[-1][0]: r.digest for r in provenance.file_digests(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert got == want


def test_table_fingerprint_ignores_order(spark):
    df = spark.range(0, 100).withColumn("t", F.concat(F.lit("v"), "id"))
    assert table_fingerprint(df).first() == table_fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert table_fingerprint(df).first() != table_fingerprint(df.filter("id <> 5")).first()
    a, b = (spark.createDataFrame([row], "x string, y string") for row in [("", None), (None, "")])
    assert table_fingerprint(a).first() != table_fingerprint(b).first()


def test_audit_trail_and_report(spark, tmp_path):
    trail = AuditTrail(spark, str(tmp_path / "audit"))
    trail.note("start", event="x")
    trail.append("facts", spark.range(2))
    tail = trail.tail(2).collect()
    assert {r.stage for r in tail} == {"facts"} and json.loads(trail.tail(3).collect()[2].payload) == {"event": "x"}
    write_report(spark.range(1).withColumn("_hidden", F.lit(1)), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).columns == ["id"]


def test_kafka_is_optional(spark, monkeypatch):
    monkeypatch.delenv("KAFKA_BOOTSTRAP_SERVERS", raising=False)
    assert kafka_source(spark, "topic") is None


def test_files_not_used_are_named(spark, tmp_path):
    events = [f"u{i},2024-01-0{1 + i % 9} 10:00:00,{i}" for i in range(12)]
    write(tmp_path / "one" / "events.csv", "user_id,timestamp,data_volume_mb", *events)
    write(tmp_path / "one" / "logon.csv", "date,user,activity", "2024-01-01 08:00:00,u1,Logon")
    write(tmp_path / "two" / "logon.csv", "date,user,activity", *[f"2024-01-01 08:00:00,u{i},Logon" for i in range(9)])
    write(tmp_path / "two" / "wide.csv", "user_id,a,b", "u1,1,2")
    write(tmp_path / "two" / "insiders.csv", "user", "u1")
    named = {n: [w.rsplit("/", 1)[-1] for w in resolve_source(spark, str(tmp_path / n))[2] if w.startswith("Not used")] for n in ("one", "two")}
    assert named == {"one": ["logon.csv."], "two": ["wide.csv."]}


def test_messages_become_events_or_dead_letters(spark):
    values = [
        '{"User-ID": "u1", "Event Time": "2024-03-01 05:10:00", "VOLUME": 700.5, "failures": "3", "extra": {"a": 1}}',
        '{"userid": "second", "user_id": "first", "date": "2024-03-01T23:00:00", "volume": "many"}',
        '{"user": "u", "user": "v", "time": "2024-03-01", "label": 1}',
        '{"user_id": "u1"}', '{"timestamp": "2024-03-01"}', '{"user_id": "u1", "time": "soon"}', "[1]", "{\"user_id\": ", "", None,
    ]
    rows = [(i, i % 2, None if v is None else bytearray(v.encode())) for i, v in enumerate(values)]
    messages = spark.createDataFrame(rows, "offset long, partition int, value binary")
    events = {r.row_id: r for r in message_events(messages).collect()}
    assert sorted(events) == ["0-0", "0-2", "1-1"]
    first = events["0-0"]
    assert (first.user_id, first.timestamp.hour, first.data_volume_mb, first.failed_attempts) == ("u1", 5, 700.5, 3.0)
    assert events["1-1"].user_id == "first" and events["1-1"].data_volume_mb is None
    broken = {r.row_id: r.error for r in dead_letters(messages).collect()}
    object_ = "not a JSON object"
    assert broken == {"1-3": "no time", "0-4": "no user", "1-5": "unreadable time", "0-6": object_, "1-7": object_, "0-8": object_, "1-9": object_}
    assert message_events(messages.limit(0)).isEmpty()


def test_written_tables_live_in_the_scratch_folder(spark):
    df = write_table(spark.range(10), "numbers")
    assert df.count() == 10 and scratch_dir(spark) in df.inputFiles()[0]


def test_infer_types_of_an_empty_column(spark):
    df = infer_types(spark.createDataFrame([(None,), (None,)], "x string"))
    assert df.dtypes == [("x", "double")]


def test_message_keys_are_normalised_once(spark):
    """One lambda over the keys of a message, not one for each accepted name; of equal keys the first counts, of names the first accepted one."""
    import contextlib
    import io

    from riskloom.sources.streams import message_events, read_messages

    texts = ['{"User-ID": "a", "user_id": "b", "TIME": "2024-01-01 10:00:00", "date": "2024-01-02 10:00:00", "Volume": "3.5"}',
             '{"USER ID": null, "user": "c", "event_time": "2024-01-03 10:00:00"}', '{"user": "d"}', "[1]", None]
    messages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "offset long, partition int, value string").withColumn("value", F.col("value").cast("binary"))
    rows = read_messages(messages)
    got = {r.row_id: r for r in rows.collect()}
    assert (got["0-0"].user_id, str(got["0-0"].timestamp), got["0-0"].data_volume_mb) == ("a", "2024-01-02 10:00:00", 3.5)
    assert got["0-1"].user_id == "c" and got["0-1"].error is None and got["0-2"].error == "no time"
    assert got["0-3"].error == got["0-4"].error == "not a JSON object"
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        message_events(messages.withColumn("value", F.upper(F.col("value").cast("string")))).explain()
    assert plan.getvalue().count("lambdafunction(") <= 2 and plan.getvalue().count("from_json(") == 1
