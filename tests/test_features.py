"""Schema resolution, event features, log features and wide tables."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins
from riskloom.operators.prep import ordinal_encode, value_codes
from riskloom.operators.events import event_features, login_frequency
from riskloom.operators.joins import label_from_answers, lookup_join, merge_user_tables
from riskloom.operators.logs import (
    log_features,
    percentile_label,
    tabular_user_features,
    user_log_features,
)
from riskloom.operators.schema import (
    coerce_mostly_numeric,
    event_roles,
    has_event_columns,
    is_event_schema,
    log_roles,
    numeric_feature_columns,
    tabular_roles,
)


def test_aliases_in_order():
    role = event_roles(["Event Time", "TIMESTAMP", "User-ID", "geo", "city", "Bytes MB"])
    assert role["time"] == "TIMESTAMP" and role["user"] == "User-ID"
    assert role["location"] == "geo" and role["volume"] == "Bytes MB" and role["label"] is None
    assert not has_event_columns(["user", "date", "pc", "activity"])
    assert has_event_columns(["user", "date", "site"])


def test_log_and_tabular_fallbacks():
    assert log_roles(["id", "when", "who", "x"], "logon")["user"] == "who"
    assert log_roles(["id", "when"], "logon")["user"] == "id"
    assert log_roles(["date", "From"], "email")["user"] == "From"
    assert log_roles(["date", "From"], "device")["user"] == "date"
    assert tabular_roles(["x", "my_user_key"])["user"] == "my_user_key"
    assert tabular_roles(["x", "badge_id"])["user"] == "badge_id"
    assert tabular_roles(["x", "z"])["user"] is None


def test_empty_frame_is_no_event_table(spark):
    assert not is_event_schema(spark.createDataFrame([], "user string, time string, city string"))


def test_event_features_and_null_rules(spark):
    rows = [
        (1, " u1 ", "2024-01-01 05:59:00", None, "pc1", "Pune", "500", "3", " ADMIN "),
        (2, None, "bad", "read", None, " BANGALORE ", "500.1", "4", "user"),
        (3, "u1", None, "read", "pc2", None, "x", None, None),
    ]
    schema = "row_id long, user string, time string, action string, host string, city string, volume string, failures string, role string"
    features, meta = event_features(spark.createDataFrame(rows, schema))
    a, b, c = features.orderBy("row_id").collect()
    assert (a.user_id, b.user_id, c.user_id) == ("u1", "nan", "u1")
    assert (a.action, b.device, c.location) == ("nan", "nan", "nan")
    assert (a.hour, a.is_night, b.hour, b.is_night, c.hour) == (5.0, 1.0, 12.0, 0.0, 12.0)
    assert (a.high_data_transfer, b.high_data_transfer, c.data_volume_mb, c.failed_attempts) == (0.0, 1.0, 0.0, 0.0)
    assert (a.privilege_level, b.privilege_level) == (1.0, 0.0)
    assert (a.login_frequency, b.login_frequency) == (2.0, 1.0)
    assert 1 <= a.session_duration <= 120 and a.file_sensitivity in (0.0, 1.0, 2.0)
    assert meta["label_source"] == "probabilistic_rules"


def test_absent_columns_get_defaults_and_labels_are_used(spark):
    df = spark.createDataFrame([(1, "u", "2024-01-01", "yes")], "row_id long, user_id string, date string, label string")
    features, meta = event_features(df)
    row = features.first()
    assert (row.action, row.device, row.location, row.y) == ("unknown", "unknown", "Bangalore", 1)
    assert meta["label_source"] == "provided"


def test_mostly_numeric_needs_85_percent(spark):
    rows = [(i, "x" if i < 3 else str(i), "x" if i < 4 else str(i), i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "u long, ok string, bad string, flag boolean")
    converted, features, n = coerce_mostly_numeric(df, ("u",))
    assert features == ["ok", "flag"] and n == 20
    assert converted.agg(F.count("ok")).first()[0] == 17
    assert numeric_feature_columns(df, "u") == []


def test_logs_in_one_pass_equal_outer_merge(spark):
    logon = spark.createDataFrame(
        [("1", "01/02/2024 06:59:00", "a", "Logon"), ("2", "01/02/2024 07:00:00", "a", "LOGOFF"), ("3", "?", "b", "other"), ("4", None, None, "Logon")],
        "id string, date string, user string, activity string",
    )
    device = spark.createDataFrame([("a",), ("c",)], "user string")
    email = spark.createDataFrame([("b", "x"), ("b", "y")], "from string, size string")
    logs = {"logon": logon, "device": device, "email": email}
    one = sorted(user_log_features(logs).collect())
    merged = sorted(merge_user_tables([log_features(df, k) for k, df in logs.items()]).collect())
    assert one == merged
    outer = None
    for kind, df in logs.items():
        part = log_features(df, kind)
        outer = part if outer is None else outer.join(part, "user_id", "full")
    assert sorted(outer.na.fill(0).collect()) == one
    by_user = {r.user_id: r for r in one}
    assert by_user["a"].after_hours == 1 and by_user["a"].logoff_count == 1 and by_user["a"].device_events == 1
    assert by_user["nan"].logon_count == 1 and by_user["c"].logon_count == 0 and by_user["b"].email_events == 2
    with pytest.raises(ValueError):
        merge_user_tables([])


def test_logon_without_activity_and_time(spark):
    row = log_features(spark.createDataFrame([("x", "y", "u")], "a string, b string, c string"), "logon").first()
    assert (row.user_id, row.logon_count, row.logoff_count, row.after_hours) == ("u", 1, 0, 0)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_ways_agree(spark, monkeypatch, how):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 40}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string")
    lookup = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 40, 2)], "k string, v double")

    def result():
        return sorted(map(tuple, lookup_join(df, lookup, "k", how).select("id", "k", "v").collect()), key=str)

    small = result()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert result() == small
    split = lookup_join(df, lookup, "k", how, hot_rows=100).select("id", "k", "v")
    assert sorted(map(tuple, split.collect()), key=str) == small
    salts = F.lit(joins.STREAM_SALTS)
    salted = joins._salted_join(df.withColumn("_salts", salts), lookup.withColumn("_salts", salts), "k", how).select("id", "k", "v").collect()
    assert sorted(map(tuple, salted), key=str) == small


def test_encoding_scans_grow_linearly(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(f"a{i}", f"b{i}", f"c{i}") for i in range(50)], "a string, b string, c string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    codes = value_codes(df, ["a", "b", "c"])
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 100)  # the codes are large, the hot keys few
    plan = ordinal_encode(df, codes, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [a#") == 1
    assert ordinal_encode(df, codes, ["a", "b", "c"]).agg(F.sum("a_enc"), F.sum("c_enc")).first()[:] == (1225.0, 1225.0)


def test_login_frequency_with_large_lookup(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i < 60 else f"u{i}") for i in range(100)], "row_id long, user_id string")
    small = sorted(map(tuple, login_frequency(df).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, login_frequency(df).select("user_id", "row_id", "login_frequency").collect())) == small


def test_label_from_answers_is_exact_text(spark):
    users = spark.createDataFrame([("u1",), ("U1",), ("u2",)], "user_id string")
    answers = spark.createDataFrame([("u1",), ("u1",), (None,)], "user_id string")
    assert {r.user_id: r.y for r in label_from_answers(users, answers).collect()} == {"u1": 1, "U1": 0, "u2": 0}


def test_percentile_label_keeps_ties(spark):
    df = spark.createDataFrame([(f"u{i}", 5 if i >= 80 else 1) for i in range(100)], "user_id string, n long")
    assert percentile_label(df, ["n"]).agg(F.sum("y")).first()[0] == 20


def test_wide_table_rules(spark):
    seven = spark.createDataFrame([(i, i * 1.0) for i in range(7)], "user_id long, f double")
    eight = spark.createDataFrame([(i // 2, i * 1.0, None if i == 0 else 2, "yes" if i == 3 else "no") for i in range(8)], "user_id long, f double, g int, class string")
    assert tabular_user_features(seven) is None
    assert tabular_user_features(eight.select("f", "g")) is None
    users, meta = tabular_user_features(eight)
    by_user = {r.user_id: (r.f, r.g, r.y) for r in users.collect()}
    assert by_user["0"] == (0.5, 2.0, 0) and by_user["1"] == (2.5, 2.0, 1)
    assert meta["label_column"] == "class" and meta["feature_columns"] == ["f", "g"]
    unlabelled = eight.drop("class")
    users, meta = tabular_user_features(unlabelled, spark.createDataFrame([("3",)], "user_id string"))
    assert meta["label_source"] == "answers" and {r.user_id for r in users.filter("y = 1").collect()} == {"3"}
    users, meta = tabular_user_features(unlabelled)
    assert meta["label_source"] == "percentile" and {r.user_id for r in users.filter("y = 1").collect()} == {"3"}
