"""Risk scores and running trust on event streams."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.scalars import clip
from ..functions.vocabulary import TRUST_CEILING, TRUST_FLOOR
from ..operators.events import login_frequency
from ..operators.joins import lookup_join
from ..operators.prep import Preparation
from ..operators.respond import score_rows, threat_level_counts
from ..operators.trust import EPSILON, anomaly_penalty, log_loss, relative_loss
from ..sources.audit import AuditTrail
from .activity import stream_event_features

SKETCH_K = 400  # ranks are within 0.8 percent in 99 of 100 cases, also after merging
PROFILE_POINTS = 500

TRUST_BUCKETS = 4096
_NEW = (1.0, 0, -(1 << 62))  # trust, number and newest end before any window
_CLOSED = np.dtype([("size", "<i8"), ("trust", "<f8"), ("n", "<i8"), ("newest", "<i8")])
_OPEN = np.dtype([("end", "<i8"), ("change", "<f8")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_risk_scoring(events: DataFrame, login_counts: DataFrame, preparation: Preparation, scorer, classifier,
                        trust: DataFrame, threshold: float, seed=42) -> DataFrame:
    """Decisions for every event of a stream with fitted encoder, scaler, scorer and classifier.

    Counts and trust of users are static tables joined to the stream.
    """
    rows = login_frequency(stream_event_features(events, seed), login_counts)
    rows = rows.withColumn("login_frequency", F.coalesce(F.col("login_frequency"), F.lit(1.0)))
    prepared = preparation.transform(rows, ["row_id", "user_id"])
    return score_rows(prepared, scorer, classifier, trust, threshold)


def respond_to_stream(decisions: DataFrame, folder: str, progress: str, trail: AuditTrail | None = None) -> StreamingQuery:
    """Write the decisions of each micro-batch as JSON and audit its level counts.

    A batch and its audit entries have folders of their own, named by its number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        target = f"{folder}/batch={number}"
        batch.write.mode("overwrite").json(target)
        if trail is not None:
            written = batch.sparkSession.read.schema(batch.schema).json(target)
            trail.append("realtime_inference_response", threat_level_counts(written), batch=number)

    return (
        decisions.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def loss_sketches(events: DataFrame, length: str = "1 day", delay: str = "1 hour", k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of the losses of each time window, batch or stream: window_end, sketch, n.

    Sketches are made in the tasks and merged after the shuffle, so a window with most of the rows costs a few kilobytes a task.
    Rows without probability or label have no loss and do not count; a window without any loss gives no row in :func:`loss_profiles`.
    """
    loss = log_loss(F.col("p"), F.col("y"))
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", length))
        .agg(F.kll_sketch_agg_double(loss, k).alias("sketch"), F.count(loss).alias("n"))
        .select(F.col("window.end").alias("window_end"), "sketch", "n")
    )


def loss_profiles(sketches: DataFrame, length: str = "1 day", before: int = 7, percentile: float = 0.90, k: int = SKETCH_K) -> DataFrame:
    """What the ``before`` windows ahead of each window tell of its losses: window_end, high, mean, n_earlier.

    ``high`` is the percentile of the losses of these windows together, ``mean`` their mean relative loss. ``sketches`` is a table as
    :func:`loss_sketches` gives it; several rows of one window are merged. Every sketch goes to the windows after it, so a
    profile merges ``before`` sketches in a shuffle by window, and no task sees all windows. The window after the newest one has a
    profile too, ready for the events to come; a window without losses ahead of it has none.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(before))).alias("_step")
    ahead = (
        sketches.filter("n > 0").select("window_end", "sketch", "n", steps)
        .withColumn("window_end", F.expr(f"window_end + _step * interval {length}"))
        .groupBy("window_end")
        .agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n_earlier"))
    )
    wanted = sketches.select("window_end", F.explode(F.array(F.lit(0), F.lit(1))).alias("_step")).select(
        F.expr(f"window_end + _step * interval {length}").alias("window_end")
    ).distinct()
    ranks = F.array(*[F.lit((i + 0.5) / PROFILE_POINTS) for i in range(PROFILE_POINTS)])
    high = F.kll_sketch_get_quantile_double("sketch", F.lit(percentile)) + F.lit(EPSILON)
    total = F.aggregate("_losses", F.lit(0.0), lambda a, x: a + F.least(F.lit(1.0), x / F.col("high")))
    return (
        ahead.join(wanted, "window_end", "left_semi")
        .select("window_end", high.alias("high"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("_losses"), "n_earlier")
        .select("window_end", "high", (total / PROFILE_POINTS).alias("mean"), "n_earlier")
    )


def trust_changes(events: DataFrame, high: float, mean: float, threshold: float, rate: float = 0.12, step: float = 0.06,
                  length: str = "1 day", delay: str = "1 hour", profiles: DataFrame | None = None) -> DataFrame:
    """Summed trust change per user and time window; partly summed before the shuffle.

    ``high`` and ``mean`` are the 90th percentile and the mean relative loss of an earlier
    batch: a stream has no global percentile. With ``profiles``, a written table of :func:`loss_profiles` (at most one row a window), they are
    those of the windows ahead of the event's own, and the numbers given hold where a window has no profile.
    """
    events, window = events.withWatermark("ts", delay), F.window("ts", length)
    if profiles is not None:
        ahead = profiles.select(F.col("window_end").alias("_end"), F.col("high").alias("_high"), F.col("mean").alias("_mean"))
        events = lookup_join(events.withColumn("_end", F.window("ts", length)["end"]), ahead, "_end")
        high, mean = F.coalesce("_high", F.lit(high)), F.coalesce("_mean", F.lit(mean))
    change = F.lit(rate) * (relative_loss(log_loss(F.col("p"), F.col("y")), high) - F.lit(mean)) + anomaly_penalty(
        F.col("y"), F.col("err"), threshold, step
    )
    return (
        events.groupBy(window, "user_id")
        .agg(F.sum(change).alias("change"), F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("window.end").alias("window_end"), "change", "n")
    )


class _RunningTrust(StatefulProcessor):
    """A user's open windows, and what all closed ones came to.

    ``open`` holds the ends of windows that others may still precede, in order, with their changes; ``closed`` is trust, number and newest
    end of the windows behind the watermark. One timer a user, at the end of the first open window, folds into ``closed`` all that the
    watermark has passed. Each of the two is read and written once a call, however many windows come.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ends array<long>, changes array<double>")
        self.closed = handle.getValueState("closed", "trust double, n long, window_end long")

    def _state(self) -> tuple[list[tuple[int, float]], tuple[float, int, int]]:
        open_ = list(zip(*self.open.get())) if self.open.exists() else []
        return open_, self.closed.get() if self.closed.exists() else _NEW

    def _wait(self, end: int) -> None:
        self.handle.registerTimer(-(-end // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(
            (_micros(end), float(change)) for frame in rows for end, change in zip(frame["window_end"], frame["change"]) if end == end and change == change
        )
        if not arrived:
            return
        windows, start = self._state()
        first = windows[0][0] if windows else None
        out = [(key[0], pd.Timestamp(newest, unit="us"), *counts) for newest, *counts in _placed(windows, start, arrived)]
        self.open.update(tuple(map(list, zip(*windows))))
        if first is None or windows[0][0] < first:
            self._wait(windows[0][0])
        yield pd.DataFrame(out, columns=["user_id", "window_end", "trust", "n_windows", "n_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, state = self._state()
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        taken = bisect_right(windows, upto, key=lambda w: w[0])
        if taken:
            for window in windows[:taken]:
                state = _after(state, window)
            self.closed.update(state)
            if taken == len(windows):
                self.open.clear()
            else:
                self.open.update(tuple(map(list, zip(*windows[taken:]))))
                self._wait(windows[taken][0])
        yield from ()

    def close(self) -> None:
        pass


class _BucketTrust(StatefulProcessor):
    """The same for a bucket of users: their open windows, and what the closed ones of each came to, are one value.

    A call between Spark and Python costs far more than the few windows of a user, so the state is read and written once a bucket and call.
    Users stand in the value one after another, with ``size`` open windows each; numbers are packed as in :data:`_CLOSED` and :data:`_OPEN`.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.users = handle.getValueState("users", "users array<string>, closed binary, open binary")

    def _state(self) -> dict[str | None, tuple[list[tuple[int, float]], tuple[float, int, int]]]:
        held = self.users.get()
        if not held:
            return {}
        closed, open_ = np.frombuffer(bytes(held[1]), _CLOSED).tolist(), np.frombuffer(bytes(held[2]), _OPEN).tolist()
        users, at = {}, 0
        for user, (size, *state) in zip(held[0], closed):
            users[user] = (open_[at : at + size], tuple(state))
            at += size
        return users

    def _keep(self, users: dict, waiting: int | None) -> None:
        """Write the state; a timer waits at the first open window unless one does already."""
        closed = [(len(windows), *state) for windows, state in users.values()]
        open_ = [window for windows, _ in users.values() for window in windows]
        self.users.update((list(users), np.array(closed, _CLOSED).tobytes(), np.array(open_, _OPEN).tobytes()))
        first = min((windows[0][0] for windows, _ in users.values() if windows), default=None)
        if first is not None and (waiting is None or first < waiting):
            self.handle.registerTimer(-(-first // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = {}
        for frame in rows:
            for user, end, change in zip(frame["user_id"].tolist(), frame["end_micros"].tolist(), frame["change"].tolist()):
                if end == end and change == change and end is not None and change is not None:
                    arrived.setdefault(user, []).append((int(end), float(change)))
        if not arrived:
            return
        users = self._state()
        waiting = min((windows[0][0] for windows, _ in users.values() if windows), default=None)
        out = []
        for user, windows in arrived.items():
            held, state = users.setdefault(user, ([], _NEW))
            out.extend((user, *version) for version in _placed(held, state, sorted(windows)))
        self._keep(users, waiting)
        yield pd.DataFrame(out, columns=["user_id", "newest_micros", "trust", "n_windows", "n_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        users = self._state()
        for user, (windows, state) in users.items():
            taken = bisect_right(windows, upto, key=lambda w: w[0])
            for window in windows[:taken]:
                state = _after(state, window)
            users[user] = (windows[taken:], state)
        self._keep(users, None)
        yield from ()

    def close(self) -> None:
        pass


def _placed(windows: list[tuple[int, float]], start: tuple[float, int, int], arrived: list[tuple[int, float]]) -> Iterator[tuple[int, float, int, int]]:
    """Put windows, in order, among the open ones; newest end, trust, number of windows and of open ones after each."""
    states = [start]  # states[i]: trust, number and newest end after i open windows
    for window in windows:
        states.append(_after(states[-1], window))
    n_open = len({end for end, _ in windows})
    for window in arrived:
        at = bisect_right(windows, window)
        n_open += all(windows[i][0] != window[0] for i in (at - 1, at) if 0 <= i < len(windows))
        windows.insert(at, window)
        del states[at + 1 :]
        for later in windows[at:]:
            states.append(_after(states[-1], later))
        trust, n, newest = states[-1]
        yield newest, trust, n, n_open


def _after(state: tuple[float, int, int], window: tuple[int, float]) -> tuple[float, int, int]:
    """Trust, number and newest end after one more window."""
    trust, n, newest = state
    return min(TRUST_CEILING, max(TRUST_FLOOR, trust - window[1])), n + 1, max(newest, window[0])


def _micros(end) -> int:
    return pd.Timestamp(end).value // 1000


def stream_user_trust(changes: DataFrame, delay: str = "7 days", buckets: int | None = TRUST_BUCKETS) -> DataFrame:
    """Running trust per user: one row for each closed window, in the order in which windows end.

    ``changes`` is the stream of a table that :func:`trust_changes` is written to, because state
    of one's own cannot follow a streaming aggregate in the same query. Every window is one update, clipped like the
    batch update, so order matters: a window that arrives up to ``delay`` (of event time) late is put in its place and the later
    ones are computed again. It then gives one row with the newest end. Windows behind the watermark are folded into one number,
    so a user's state holds the windows of one ``delay``, however long the stream runs; later ones are dropped by the watermark
    and counted in the query's progress. Rows without an end or a change are passed over.

    Users share a state by a hash of their id, in so many ``buckets``, as a call costs far more than a user's few windows. A call reads and
    writes the whole bucket, so their number should grow with that of users (hundreds to a few thousand a bucket) and stay the same for a
    stream's life. With None every user has a state of its own, for streams whose batches touch few users.

    The row with the largest ``n_windows`` is the newest of a user; ``n_open`` is the number of windows its state holds. Timers need
    the RocksDB state store; the function selects it in the session where another one is set.
    """
    spark = changes.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    options = {"outputMode": "Append", "timeMode": "EventTime"}
    marked = changes.withWatermark("window_end", delay)
    if buckets is None:
        return marked.groupBy("user_id").transformWithStateInPandas(
            _RunningTrust(), outputStructType="user_id string, window_end timestamp, trust double, n_windows long, n_open long", **options
        )
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")
    arriving = marked.select(bucket, "user_id", "window_end", F.unix_micros("window_end").alias("end_micros"), "change")
    versions = arriving.groupBy("bucket").transformWithStateInPandas(
        _BucketTrust(), outputStructType="user_id string, newest_micros long, trust double, n_windows long, n_open long", **options
    )
    return versions.select("user_id", F.timestamp_micros("newest_micros").alias("window_end"), "trust", "n_windows", "n_open")


def batch_user_trust(changes: DataFrame) -> DataFrame:
    """Final trust per user of a batch; the list per user is bounded by the number of windows."""
    ordered = F.array_sort(F.collect_list(F.struct("window_end", "change")))
    folded = F.aggregate(
        ordered, F.lit(1.0), lambda trust, w: clip(trust - w["change"], TRUST_FLOOR, TRUST_CEILING)
    )
    return changes.groupBy("user_id").agg(folded.alias("trust"), F.count(F.lit(1)).alias("n_windows"))
