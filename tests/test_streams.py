"""Streams equal their batch twins on closed windows, also over several files and triggers."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from riskloom.operators.anomaly import anomaly_threshold, fit_linear
from riskloom.operators.prep import prepare
from riskloom.operators.respond import decide, threat_level_counts
from riskloom.operators.trust import trust_map, trust_training
from riskloom.plans.adapters import event_columns, labelled_events
from riskloom.plans.catalog import QUERIES, facts, streams
from riskloom.plans.experiment import Settings
from riskloom.session import scratch_path
from riskloom.sources.audit import AuditTrail
from riskloom.sources.streams import parquet_stream
from riskloom.streaming.activity import (
    batch_sessions,
    deduplicate,
    late_events,
    run_to_folder,
    run_to_table,
    stream_sessions,
    user_activity,
)
from riskloom.operators.trust import log_loss
from riskloom.session import write_table
from riskloom.streaming.scoring import batch_user_trust, loss_profiles, loss_sketches, respond_to_stream, stream_user_trust, trust_changes

START = datetime.datetime(2024, 1, 1)
KINDS = ["logon", "logoff", "device", "email", "file"]


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for i in range(1200):
        user = "hot" if i % 3 == 0 else f"u{i % 7}"
        rows.append((i, START + datetime.timedelta(minutes=i * 7, seconds=i % 50), user, KINDS[i % 5], (i * 37 % 100) / 100 + 0.001, (i * 53 % 100) / 100, i % 2))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id string, activity string, p double, err double, y int").cache()


@pytest.fixture(scope="module")
def folder(spark, events):
    """Four files, written and read in time order."""
    path = scratch_path(spark, "stream-in")
    for part in range(4):
        events.filter(f"event_id div 300 = {part}").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, events, folder):
    return parquet_stream(spark, folder, events.schema, files_per_trigger=1)


def closed(df, events, column="window_end"):
    limit = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    return sorted(map(tuple, df.filter(F.col(column) <= F.lit(limit)).collect()))


@pytest.mark.parametrize("slide", [None, "6 hours"])
def test_window_activity(spark, events, folder, slide):
    got = run_to_table(user_activity(stream(spark, events, folder), "12 hours", slide), "t")
    assert sorted(map(tuple, got.collect())) == closed(user_activity(events, "12 hours", slide), events)


def test_sessions(spark, events, folder):
    got = run_to_table(stream_sessions(stream(spark, events, folder)), "t")
    assert sorted(map(tuple, got.collect())) == closed(batch_sessions(events), events, "session_end")


def test_sessions_at_the_exact_gap(spark):
    times = [0, 30, 60, 91, 120, 151, 181]
    rows = [("u", START + datetime.timedelta(minutes=m)) for m in times]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp")
    built_in = df.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, built_in.select("user_id", "w.start", "w.end", "n").collect()))
    assert sorted(map(tuple, batch_sessions(df).collect())) == want


def test_dedup_keeps_one_copy(spark, events, folder):
    copies = stream(spark, events, folder).withColumn("c", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") == 5, 400).otherwise(2)))).drop("c")
    got = run_to_table(deduplicate(copies), "t")
    assert got.count() == 1200 == got.select("event_id").distinct().count()
    assert deduplicate(events.unionByName(events)).count() == 1200


def test_running_trust(spark, events, folder):
    options = dict(high=2.0, mean=0.3, threshold=0.8, length="12 hours")
    changes = trust_changes(stream(spark, events, folder), **options)
    table = run_to_folder(changes, "changes")
    running = run_to_table(stream_user_trust(parquet_stream(spark, table, changes.schema)), "t")
    newest = running.groupBy("user_id").agg(F.max_by("trust", "n_windows"), F.max("n_windows"))
    limit = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    batch = batch_user_trust(trust_changes(events, **options).filter(F.col("window_end") <= F.lit(limit)))
    got, want = ({r[0]: (round(r[1], 9), r[2]) for r in df.collect()} for df in (newest, batch))
    assert got == want and min(v for v, _ in want.values()) >= 0.15


def test_windows_out_of_order(spark, tmp_path):
    """Two files in the wrong order give the trust of the right order."""
    schema = "user_id string, window_end timestamp, change double, n long"
    days = [START + datetime.timedelta(days=d) for d in range(4)]
    late, early = [("u", days[2], 0.5, 1), ("u", days[3], -0.3, 1)], [("u", days[0], -0.4, 1), ("u", days[1], 0.6, 1)]
    for number, rows in enumerate((late, early)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{number}")
        time.sleep(1.1)
    part = spark.read.schema(schema).parquet(f"{tmp_path}/0", f"{tmp_path}/1")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    running = run_to_table(stream_user_trust(source), "t")
    newest = running.agg(F.max_by("trust", "n_windows"), F.max("n_windows"), F.max_by("window_end", "n_windows")).first()
    assert newest[0] == pytest.approx(batch_user_trust(part).first().trust) and newest[1] == 4 and newest[2] == days[3]


def test_state_of_trust_is_bounded(spark, tmp_path):
    """A thousand windows in fifty files: the state holds the windows of one delay, and the trust is that of the batch."""
    schema = "user_id string, window_end timestamp, change double, n long"
    rng = random.Random(4)
    rows = [(u, START + datetime.timedelta(hours=h), rng.uniform(-0.3, 0.35), 1) for h in range(1000) for u in ("a", "b")]
    for number in range(50):
        part = rows[number * 40 : number * 40 + 40]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    parts = spark.read.schema(schema).parquet(f"{tmp_path}/t")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    got = run_to_table(stream_user_trust(source, "30 hours"), "t").groupBy("user_id").agg(
        F.max_by("trust", "n_windows"), F.max("n_windows"), F.max("n_open"))
    want = {r.user_id: (pytest.approx(r.trust), r.n_windows) for r in batch_user_trust(parts).collect()}
    found = {r[0]: r[1:] for r in got.collect()}
    assert {u: f[:2] for u, f in found.items()} == want and all(f[1] == 1000 for f in found.values())
    assert max(f[2] for f in found.values()) <= 30 + 2 * 20 + 2


def test_trust_changes_without_values(spark, tmp_path):
    """Rows without end or change are passed over; a window given twice counts twice; null users share one state."""
    schema = "user_id string, window_end timestamp, change double, n long"
    rows = [("a", START, 0.2, 1), ("a", START, 0.2, 1), ("a", START, None, 1), ("b", None, 0.3, 1), (None, START, 0.5, 1), (None, START, 0.1, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/t")
    running = run_to_table(stream_user_trust(parquet_stream(spark, f"{tmp_path}/t", spark.read.parquet(f"{tmp_path}/t").schema)), "t")
    newest = {r[0]: (round(r[1], 6), r[2]) for r in running.groupBy("user_id").agg(F.max_by("trust", "n_windows"), F.max("n_windows")).collect()}
    assert newest == {"a": (0.6, 2), None: (0.4, 2)}


def test_late_events(spark):
    minutes = [(0, 0), (0, 200), (1, 130), (1, 150), (2, 210), (2, 139)]
    df = spark.createDataFrame([(b, START + datetime.timedelta(minutes=m)) for b, m in minutes], "batch long, ts timestamp")
    got = {r.batch: (r.n_events, r.n_late) for r in late_events(df).collect()}
    assert got == {0: (2, 0), 1: (2, 1), 2: (2, 1)}


def test_decisions_reach_the_sink_and_the_audit(spark, events, folder, tmp_path):
    decided = decide(stream(spark, events, folder).withColumn("trust", F.lit(0.85)), 0.8).drop("notes")
    trail = AuditTrail(spark, f"{tmp_path}/audit")
    respond_to_stream(decided, f"{tmp_path}/out", f"{tmp_path}/progress", trail).awaitTermination()
    written = spark.read.json(f"{tmp_path}/out")
    want = {r.threat_level: r.n for r in threat_level_counts(decide(events.withColumn("trust", F.lit(0.85)), 0.8)).collect()}
    assert {r.threat_level: r.n for r in threat_level_counts(written).collect()} == want
    counted = trail.entries().agg(F.sum(F.get_json_object("payload", "$.n").cast("long"))).first()[0]
    assert counted == 1200 and written.select("batch").distinct().count() == 4


def test_stream_scoring_takes_trust_of_all_rounds(spark, monkeypatch):
    """The query and its facts give the stream the trust that training rows have after the last round, not the first value."""
    seen = []
    for module in (streams, facts):
        def scored(events, counts, preparation, scorer, model, trust, threshold, score=module.stream_risk_scoring):
            seen.append({r.user_id: r.trust for r in trust.collect()})
            return score(events, counts, preparation, scorer, model, trust, threshold)

        monkeypatch.setattr(module, "stream_risk_scoring", scored)
    folder = "/root/testdata/sf0.001"
    risks = {r.row_id: r.risk_score for r in QUERIES["stream_risk_scoring"](spark, folder).collect()}
    assert len(risks) == 1000
    QUERIES["stream_scoring_facts"](spark, folder)
    frame, meta = labelled_events(spark, folder)
    rows, preparation = prepare(frame, meta["categorical"], 42)
    train = rows.filter("split = 'train'")
    scored = fit_linear(train.filter("y = 0"), len(preparation.names)).with_error(train)
    settings = Settings()
    _, state = trust_training(scored, anomaly_threshold(scored.filter("y = 0")), settings.rounds, settings.power, kind="logistic")
    want = {r.user_id: pytest.approx(r.trust, abs=1e-6) for r in trust_map(state).collect()}
    assert len(seen) == 3 and all(trust == want for trust in seen)
    assert min(seen[0].values()) < 1


def test_loss_profiles_follow_the_windows_ahead(spark, events):
    """Percentile and mean of the two windows ahead, against the losses themselves; no row counts in its own window."""
    length = datetime.timedelta(hours=12)
    profiles = {r.window_end: r for r in loss_profiles(loss_sketches(events, "12 hours"), "12 hours", before=2).collect()}
    rows = [(r.e, r.loss) for r in events.select(F.window("ts", "12 hours")["end"].alias("e"), log_loss(F.col("p"), F.col("y")).alias("loss")).collect()]
    ends = sorted({e for e, _ in rows})
    assert set(profiles) == {*ends[1:], ends[-1] + length}
    for end, found in profiles.items():
        ahead = sorted(x for e, x in rows if end - 2 * length <= e < end)
        assert found.n_earlier == len(ahead)
        assert abs(sum(x <= found.high for x in ahead) / len(ahead) - 0.9) < 0.02
        assert abs(sum(min(1, x / found.high) for x in ahead) / len(ahead) - found.mean) < 0.01


def test_trust_changes_take_the_profile_of_their_window(spark, events, folder):
    """The stream agrees with a plain sum; windows without a profile take the numbers given."""
    profiles = write_table(loss_profiles(loss_sketches(events, "12 hours"), "12 hours"), "profiles")
    options = dict(high=2.0, mean=0.3, threshold=0.8, length="12 hours", profiles=profiles)
    got = {(r.user_id, r.window_end): (r.change, r.n) for r in run_to_table(trust_changes(stream(spark, events, folder), **options), "c").collect()}
    known = {r.window_end: (r.high, r.mean) for r in profiles.collect()}
    want = {}
    for r in events.select("*", F.window("ts", "12 hours")["end"].alias("e"), log_loss(F.col("p"), F.col("y")).alias("loss")).collect():
        high, mean = known.get(r.e, (2.0, 0.3))
        step = 0.06 if r.y == 0 and r.err > 0.8 else 0.03 if r.y == 1 and r.err <= 0.8 else 0.0
        change, n = want.get((r.user_id, r.e), (0.0, 0))
        want[r.user_id, r.e] = (change + 0.12 * (min(1, max(0, r.loss / high)) - mean) + step, n + 1)
    limit = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    want = {k: v for k, v in want.items() if k[1] <= limit}
    assert set(got) == set(want)
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


def test_profiles_without_losses(spark):
    """Rows without a loss do not count; a table without any gives no profile."""
    schema = "ts timestamp, p double, y int"
    none = spark.createDataFrame([(START, None, 1), (START, 0.5, None)], schema)
    assert loss_profiles(loss_sketches(none)).count() == 0
    assert loss_profiles(loss_sketches(none.limit(0))).count() == 0
    some = none.unionByName(spark.createDataFrame([(START, 0.5, 1)] * 3, schema))
    found = loss_profiles(loss_sketches(some)).collect()
    assert len(found) == 1 and found[0].n_earlier == 3 and found[0].high == pytest.approx(0.693147, abs=1e-5)
    assert found[0].mean == pytest.approx(1.0)


def test_running_trust_reads_and_writes_its_state_once_a_call():
    """However many windows come: state calls of a user do not grow with them, and late windows change the later ones."""
    from types import SimpleNamespace

    import pandas as pd

    from riskloom.streaming.scoring import _RunningTrust

    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    timers = []
    handle = SimpleNamespace(getValueState=lambda name, schema: Value(), registerTimer=timers.append)
    trust = _RunningTrust()
    trust.init(handle)
    day = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)
    given = [(k, 0.02 * (k % 5 - 1)) for k in range(60) if k != 7]
    first = pd.concat(trust.handleInputRows(("u",), iter([pd.DataFrame({"window_end": [day(k) for k, _ in given], "change": [c for _, c in given]})]), None))
    assert len(first) == 59 and len(calls) <= 4 and len(timers) == 1 and first["n_open"].tolist() == list(range(1, 60))
    late = pd.concat(trust.handleInputRows(("u",), iter([pd.DataFrame({"window_end": [day(7), day(9)], "change": [0.3, 0.1]})]), None))
    expected = 1.0
    for _, change in sorted([*given, (7, 0.3), (9, 0.1)]):
        expected = min(1.0, max(0.15, expected - change))
    assert late["trust"].tolist()[-1] == expected and late["n_windows"].tolist() == [60, 61] and late["n_open"].tolist() == [60, 60]
    mark = day(30).value // 1_000_000
    assert list(trust.handleExpiredTimer(("u",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), SimpleNamespace(getExpiryTimeInMs=lambda: timers[0]))) == []
    assert len(trust.open.held[0]) == 29 and trust.closed.held[1] == 32 and timers[-1] == day(31).value // 1_000_000
    last = pd.concat(trust.handleInputRows(("u",), iter([pd.DataFrame({"window_end": [day(60)], "change": [0.0]})]), None))
    assert last["trust"].tolist() == [expected] and last["n_windows"].tolist() == [62] and last["n_open"].tolist() == [30]


def test_users_of_a_bucket_share_their_state_calls():
    """State calls do not grow with the users of a bucket, and each user gets the trust of a state of their own, closed windows and late ones included."""
    from types import SimpleNamespace

    import pandas as pd

    from riskloom.streaming.scoring import _BucketTrust, _RunningTrust

    calls, timers = [], []

    class Value:
        held = None

        def __init__(self, counted):
            self.counted = counted

        def exists(self):
            return self.held is not None

        def get(self):
            self.counted.append("get")
            return self.held

        def update(self, value):
            self.counted.append("update")
            self.held = value

        def clear(self):
            self.held = None

    def started(processor, counted, waits):
        processor.init(SimpleNamespace(getValueState=lambda name, schema: Value(counted), registerTimer=waits.append))
        return processor

    day = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)
    users = [f"u{k}" for k in range(200)] + [None]
    bucket, alone, own_timers = started(_BucketTrust(), calls, timers), {}, {u: [] for u in users}
    for u in users:
        alone[u] = started(_RunningTrust(), [], own_timers[u])
    parts = [
        [(u, day(k + i % 3), 0.02 * ((k + i) % 7 - 2)) for i, u in enumerate(users) for k in range(12)],
        [(u, day(5), 0.1) for u in users[:50]] + [(users[3], None, 0.1), (users[4], day(6), float("nan"))],
        [(u, day(15), -0.05) for u in users[20:]],
    ]
    marks = [day(4).value // 1_000_000, day(8).value // 1_000_000, day(20).value // 1_000_000]
    columns = ["user_id", "newest_micros", "trust", "n_windows", "n_open"]
    for part, mark in zip(parts, marks):
        frame = pd.DataFrame(part, columns=["user_id", "window_end", "change"])
        frame["end_micros"] = [None if pd.isna(e) else e.value // 1000 for e in frame["window_end"]]
        frames = [frame[:700], frame[700:]] if len(frame) > 700 else [frame]
        got = pd.concat(bucket.handleInputRows((7,), iter(frames), None))[columns]
        want = []
        for u in users:
            mine = frame[frame["user_id"].isna()] if u is None else frame[frame["user_id"] == u]
            for out in alone[u].handleInputRows((u,), iter([mine]), None):
                want += [(u, r.window_end.value // 1000, r.trust, r.n_windows, r.n_open) for r in out.itertuples()]
        assert sorted(got.itertuples(index=False, name=None), key=repr) == sorted(want, key=repr)
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)  # noqa: B023
        while timers and timers[-1] <= mark:
            at = timers.pop()
            assert list(bucket.handleExpiredTimer((7,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at))) == []  # noqa: B023
        for u in users:
            while own_timers[u] and own_timers[u][-1] <= mark:
                at = own_timers[u].pop()
                list(alone[u].handleExpiredTimer((u,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at)))  # noqa: B023
    assert len(calls) <= 15 and not timers


def test_running_trust_is_the_same_in_buckets_and_alone(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(f"u{u}" if u else None, start + timedelta(days=d), 0.05 * ((u + d) % 5 - 1), 1) for u in range(12) for d in range(1, 25) if (u * d) % 7 != 3]
    frame = spark.createDataFrame(rows, "user_id string, window_end timestamp, change double, n long")
    for k, (low, high) in enumerate([(10, 25), (1, 10)]):  # the first days come last and are dropped in part
        part = frame.filter((F.dayofmonth("window_end") >= low) & (F.dayofmonth("window_end") < high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    found = []
    for buckets in (None, 1, 5):
        source = parquet_stream(spark, f"{tmp_path}/t", frame.schema, files_per_trigger=1)
        found.append(sorted(run_to_table(stream_user_trust(source, buckets=buckets), "t").collect(), key=repr))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_event_columns_parse_the_text_once(spark):
    plan = event_columns(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1
