"""Streaming queries: the event table as a file stream, compared on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.hashing import uniform
from ...functions.vocabulary import DEFAULT_TRUST
from ...operators.anomaly import anomaly_threshold, fit_linear
from ...operators.events import login_counts
from ...operators.prep import prepare
from ...operators.respond import decide, trust_at
from ...operators.trust import log_loss, trust_map, trust_training
from ...session import write_table
from ...sources.streams import dead_letters, message_events, parquet_stream
from ...streaming.activity import (
    batch_sessions,
    deduplicate,
    late_events,
    run_to_folder,
    run_to_table,
    stream_event_features,
    stream_sessions,
    user_activity,
)
from ...streaming.scoring import batch_user_trust, loss_profiles, loss_sketches, stream_risk_scoring, stream_user_trust, trust_changes
from ..adapters import SEED, activity_stream_columns, event_columns, labelled_events, scored_activity, table
from .learning import SETTINGS
from .registry import EVENT_CTE, h, query, r6, rounded

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
HIGH, MEAN = 2.0, 0.4


def _stream(spark, folder):
    return parquet_stream(spark, folder, table(spark, folder, "events").schema, "events.parquet")


def _stamped(df, *columns):
    return df.withColumns({c: F.date_format(c, STAMP) for c in columns})


def _activity_sql(starts: str, length: str, closed: bool) -> str:
    return f"""WITH e AS (SELECT user_id::VARCHAR AS user_id, ts, event_type, {starts} AS w FROM events)
    SELECT strftime(w, {SQL_STAMP}) AS window_start, strftime(w + INTERVAL {length}, {SQL_STAMP}) AS window_end, user_id,
      count(*) FILTER (event_type = 'signup') AS logon_count, count(*) FILTER (event_type = 'click') AS logoff_count,
      sum(CASE WHEN event_type IN ('signup', 'click') AND (hour(ts) < 7 OR hour(ts) > 19) THEN 1 ELSE 0 END)::BIGINT AS after_hours,
      count(*) FILTER (event_type = 'view') AS device_events, count(*) FILTER (event_type = 'purchase') AS email_events,
      count(*) FILTER (event_type = 'error') AS file_events
    FROM e {"WHERE w + INTERVAL " + length + " <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)" if closed else ""} GROUP BY w, user_id"""


@query("stream_user_activity", _activity_sql("date_trunc('day', ts)", "1 DAY", True))
def tumbling_stream(spark, folder):
    counts = user_activity(activity_stream_columns(_stream(spark, folder)), "1 day")
    return _stamped(run_to_table(counts, "activity"), "window_start", "window_end")


@query(
    "stream_user_activity_sliding",
    _activity_sql("unnest([date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) < 12 THEN -1 ELSE 1 END)])", "1 DAY", True),
)
def sliding_stream(spark, folder):
    counts = user_activity(activity_stream_columns(_stream(spark, folder)), "1 day", "12 hours")
    return _stamped(run_to_table(counts, "activity"), "window_start", "window_end")


@query("batch_user_activity", _activity_sql("date_trunc('day', ts)", "1 DAY", False))
def tumbling_batch(spark, folder):
    return _stamped(user_activity(activity_stream_columns(table(spark, folder, "events")), "1 day"), "window_start", "window_end")


def _session_sql(closed: bool) -> str:
    return f"""WITH o AS (SELECT user_id::VARCHAR AS user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
      g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o),
      r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM g GROUP BY user_id, s)
    SELECT user_id, strftime(a, {SQL_STAMP}) AS session_start, strftime(b, {SQL_STAMP}) AS session_end, n AS n_events FROM r
    {"WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)" if closed else ""}"""


@query("stream_sessions", _session_sql(True))
def sessions_stream(spark, folder):
    sessions = stream_sessions(activity_stream_columns(_stream(spark, folder)))
    return _stamped(run_to_table(sessions, "sessions"), "session_start", "session_end")


@query("batch_sessions", _session_sql(False))
def sessions_batch(spark, folder):
    return _stamped(batch_sessions(activity_stream_columns(table(spark, folder, "events"))), "session_start", "session_end")


@query("stream_dedup", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def dedup_stream(spark, folder):
    """Every event comes twice; one of each stays."""
    events = _stream(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = run_to_table(deduplicate(twice), "dedup")
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "stream_event_features",
    f"""WITH {EVENT_CTE} SELECT row_id, user_id, hour(ts)::DOUBLE AS hour, CASE WHEN hour(ts) < 6 THEN 1e0 ELSE 0e0 END AS is_night,
      CASE WHEN data_volume_mb > 500 THEN 1e0 ELSE 0e0 END AS high_data_transfer,
      1e0 + floor(120e0 * {h('session_duration', 'row_id')}) AS session_duration FROM ev""",
)
def features_stream(spark, folder):
    rows = stream_event_features(event_columns(_stream(spark, folder)), SEED)
    return run_to_table(rows.select("row_id", "user_id", "hour", "is_night", "high_data_transfer", "session_duration"), "features")


def _messages(events):
    """Events as JSON messages in four partitions; every 50th is cut off, every 51st has no user."""
    k = F.col("row_id")
    user = F.when(k % 51 != 0, F.col("user_id")).alias("User-ID")
    text = F.to_json(F.struct(user, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "action", "device",
                              F.col("data_volume_mb").alias("volume"), F.col("failed_attempts").alias("failures")))
    value = F.when(k % 50 == 0, F.substring(text, 1, 20)).otherwise(text).cast("binary")
    return event_columns(events).select(k.alias("offset"), (k % 4).cast("int").alias("partition"), value.alias("value"))


@query(
    "stream_message_events",
    f"""WITH {EVENT_CTE}, m AS (SELECT row_id % 4 || '-' || row_id AS row_id, CASE WHEN row_id % 50 = 0 THEN 'not a JSON object'
        WHEN row_id % 51 = 0 THEN 'no user' END AS error, user_id, hour(ts)::DOUBLE AS hour,
        CASE WHEN data_volume_mb > 500 THEN 1e0 ELSE 0e0 END AS high_data_transfer FROM ev)
    SELECT row_id, error, CASE WHEN error IS NULL THEN user_id END AS user_id, CASE WHEN error IS NULL THEN hour END AS hour,
      CASE WHEN error IS NULL THEN high_data_transfer END AS high_data_transfer FROM m""",
)
def message_stream(spark, folder):
    """Messages become events with features; what is none goes to the dead letters."""
    features = run_to_table(stream_event_features(message_events(_messages(_stream(spark, folder))), SEED), "features")
    broken = run_to_table(dead_letters(_messages(_stream(spark, folder))), "dead")
    rows = features.select("row_id", "user_id", "hour", "high_data_transfer")
    return rows.unionByName(broken.select("row_id", "error"), allowMissingColumns=True)


def labelled_source(spark, folder):
    """Labelled events, written once as all passes of the preparation read them, the counts of users, and the facts about the rows."""
    frame, meta = labelled_events(spark, folder)
    frame = write_table(frame, "source")
    return frame, write_table(login_counts(frame), "counts"), meta


def trusted_scoring(frame, meta):
    """What decisions on events need, fitted on the training rows: encoder and scaler, scorer, classifier and trust after all rounds, threshold."""
    rows, preparation = prepare(frame, meta["categorical"], SEED)
    train = rows.filter("split = 'train'")
    scorer = fit_linear(train.filter("y = 0"), len(preparation.names))
    scored = write_table(scorer.with_error(train), "scored")
    threshold = anomaly_threshold(scored.filter("y = 0"))
    model, state = trust_training(scored, threshold, rounds=SETTINGS.rounds, power=SETTINGS.power)
    return preparation, scorer, model, trust_map(state), threshold


@query("stream_risk_scoring")
def scoring_stream(spark, folder):
    frame, counts, meta = labelled_source(spark, folder)
    decisions = stream_risk_scoring(event_columns(_stream(spark, folder)), counts, *trusted_scoring(frame, meta))
    return rounded(run_to_table(decisions, "decisions").select("row_id", "user_id", "threat_level", "risk_score"))


LOSS = "CASE WHEN y = 1 THEN -ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE -ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END"
TRUST_CTE = f"""e AS (SELECT user_id::VARCHAR AS user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS w, {h('p', 'event_id')} AS p,
        {h('err', 'event_id')} AS err, CASE WHEN {h('y', 'event_id')} < 0.2e0 THEN 1 ELSE 0 END AS y FROM events),
      c AS (SELECT user_id, w, sum(0.12e0 * (greatest(0e0, least(1e0, ({LOSS}) / 2e0)) - 0.4e0)
        + CASE WHEN y = 0 AND err > 0.8e0 THEN 0.06e0 WHEN y = 1 AND err <= 0.8e0 THEN 0.03e0 ELSE 0e0 END) AS change FROM e GROUP BY user_id, w)"""
FOLD_MOVES = "list_reduce(list_prepend(1e0, moves), lambda t, d: greatest(0.15e0, least(1e0, t - d)))"
FOLD = "list_reduce(list_prepend(1e0, list(change ORDER BY w)), lambda t, d: greatest(0.15e0, least(1e0, t - d)))"


@query(
    "stream_user_trust",
    f"""WITH {TRUST_CTE}, d AS (SELECT * FROM c WHERE w <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))
    SELECT user_id, count(*) AS n_windows, round({FOLD}, 6) AS trust FROM d GROUP BY user_id""",
)
def trust_stream(spark, folder):
    """The newest running trust of every user."""
    changes = trust_changes(scored_activity(_stream(spark, folder)), HIGH, MEAN, 0.8)
    closed = parquet_stream(spark, run_to_folder(changes, "changes"), changes.schema)
    running = run_to_table(stream_user_trust(closed), "trust")
    newest = F.max_by("trust", "n_windows")
    return running.groupBy("user_id").agg(F.max("n_windows").alias("n_windows"), r6(newest).alias("trust"))


@query(
    "decisions_at_event_time",
    f"""WITH {TRUST_CTE}, d AS (SELECT * FROM c WHERE w <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
      l AS (SELECT user_id, w, list(change) OVER (PARTITION BY user_id ORDER BY w ROWS UNBOUNDED PRECEDING) AS moves FROM d),
      v AS (SELECT user_id, w, {FOLD_MOVES} AS trust FROM l),
      e2 AS (SELECT event_id, user_id::VARCHAR AS user_id, ts, {h('p', 'event_id')} AS p, {h('err', 'event_id')} AS err FROM events),
      a AS (SELECT event_id, e2.user_id, p, err, coalesce(trust, {DEFAULT_TRUST}e0) AS trust FROM e2 ASOF LEFT JOIN v ON e2.user_id = v.user_id AND e2.ts >= v.w)
    SELECT event_id AS row_id, user_id, round(trust, 6) AS trust,
      round(greatest(0e0, least(1e0, 0.42e0 * p + 0.38e0 * least(1e0, err / 0.8e0) + 0.2e0 * (1e0 - trust))), 6) AS risk_score FROM a""",
)
def timed_decisions(spark, folder):
    """Decisions on all events with the trust that the stream had given their user by then."""
    changes = trust_changes(scored_activity(_stream(spark, folder)), HIGH, MEAN, 0.8)
    closed = parquet_stream(spark, run_to_folder(changes, "changes"), changes.schema)
    versions = run_to_table(stream_user_trust(closed), "trust")
    rows = scored_activity(table(spark, folder, "events"), "event_id").withColumnRenamed("event_id", "row_id")
    return rounded(decide(trust_at(rows, versions), 0.8).select("row_id", "user_id", "trust", "risk_score"))


PROFILE_SLACK = 0.015


@query(
    "stream_loss_profiles",
    f"""WITH d AS (SELECT date_trunc('day', ts) + INTERVAL 1 DAY AS w FROM events),
      c AS (SELECT w, count(*) AS n FROM d WHERE w <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w),
      t AS (SELECT DISTINCT unnest([w, w + INTERVAL 1 DAY]) AS t FROM c)
    SELECT strftime(t, {SQL_STAMP}) AS window_end, sum(n)::BIGINT AS n_earlier, 0 AS n_wrong
    FROM t JOIN c ON w < t AND w >= t - INTERVAL 7 DAY GROUP BY t""",
)
def profiles_stream(spark, folder):
    """Percentile and mean loss ahead of every window, from the sketches that the stream left for the windows it closed.

    ``n_wrong`` counts which of the two is off by more than 0.015 (of the rank, of the mean) against all losses themselves.
    """
    sketches = run_to_table(loss_sketches(scored_activity(_stream(spark, folder))), "sketches")
    profiles = write_table(loss_profiles(sketches), "profiles")
    events = scored_activity(table(spark, folder, "events")).select(F.window("ts", "1 day")["end"].alias("of"), log_loss(F.col("p"), F.col("y")).alias("loss"))
    closed = events.join(F.broadcast(sketches.select(F.col("window_end").alias("of"))), "of", "left_semi")
    later = closed.withColumn("window_end", F.explode(F.expr("sequence(of + interval 1 day, of + interval 7 days, interval 1 day)")))
    exact = later.join(F.broadcast(profiles), "window_end").groupBy("window_end").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("loss") <= F.col("high")).alias("below"),
        F.avg(F.least(F.lit(1.0), F.col("loss") / F.col("high"))).alias("exact_mean"),
    )
    off = [F.abs(F.col("below") / F.col("n") - 0.9) > PROFILE_SLACK, F.abs(F.col("mean") - F.col("exact_mean")) > PROFILE_SLACK, F.col("n") != F.col("n_earlier")]
    rows = profiles.join(F.broadcast(exact), "window_end", "left").withColumn("n_wrong", sum(F.coalesce(o, F.lit(True)).cast("int") for o in off))
    return _stamped(rows.select("window_end", "n_earlier", "n_wrong"), "window_end")


@query("batch_user_trust", f"WITH {TRUST_CTE} SELECT user_id, count(*) AS n_windows, round({FOLD}, 6) AS trust FROM c GROUP BY user_id")
def trust_batch(spark, folder):
    return rounded(batch_user_trust(trust_changes(scored_activity(table(spark, folder, "events")), HIGH, MEAN, 0.8)))


@query(
    "late_event_count",
    f"""WITH a AS (SELECT ts, (event_id + floor(3000e0 * {h('delay', 'event_id')})::BIGINT) // 500 AS batch FROM events),
      m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark
        FROM a GROUP BY batch)
    SELECT a.batch, count(*) AS n_events, count(*) FILTER (a.ts < m.mark) AS n_late FROM a JOIN m USING (batch) GROUP BY a.batch""",
)
def late_count(spark, folder):
    delay = F.floor(F.lit(3000.0) * uniform(SEED, "delay", "event_id"))
    arrivals = table(spark, folder, "events").select("ts", F.floor((F.col("event_id") + delay) / 500).alias("batch"))
    return late_events(arrivals)
