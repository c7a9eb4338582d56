"""The registry and the SQL pieces shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` and, where SQL can say it, its check."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded to six digits."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def h32(salt: str, key: str, seed=42) -> str:
    return f"('0x' || substr(md5('{seed}:{salt}:' || ({key})), 1, 8))::BIGINT"


def h(salt: str, key: str, seed=42) -> str:
    return f"(({h32(salt, key, seed)} + 0.5e0) / 4294967296e0)"


def normal_sql(salt: str, key: str, seed=42) -> str:
    return f"(sqrt(-2e0 * ln({h(salt + '/a', key, seed)})) * cos(2e0 * pi() * {h(salt + '/b', key, seed)}))"


K = "(props->>'$.k')::INT"

# events with the roles of an event schema
EVENT_CTE = f"""ev AS (
  SELECT event_id AS row_id, user_id::VARCHAR AS user_id, ts, event_type AS action,
         'pc' || ({K} % 7)::VARCHAR AS device,
         CASE {K} % 4 WHEN 0 THEN 'Bangalore' WHEN 1 THEN ' bangalore ' WHEN 2 THEN 'Pune' ELSE 'Delhi' END AS location,
         value * 5e0 AS data_volume_mb, ({K} % 6)::DOUBLE AS failed_attempts,
         CASE WHEN user_id % 10 = 0 THEN 1e0 ELSE 0e0 END AS privilege_level
  FROM events)"""

# features and label of these events
FEATURE_CTE = EVENT_CTE + f""", feat AS (
  SELECT row_id, user_id, action, device, location, data_volume_mb, failed_attempts, privilege_level,
         hour(ts)::DOUBLE AS hour,
         CASE WHEN hour(ts) < 6 THEN 1e0 ELSE 0e0 END AS is_night,
         CASE WHEN data_volume_mb > 500 THEN 1e0 ELSE 0e0 END AS high_data_transfer,
         1e0 + floor(120e0 * {h('session_duration', 'row_id')}) AS session_duration,
         (count(*) OVER (PARTITION BY user_id))::DOUBLE AS login_frequency,
         floor(3e0 * {h('file_sensitivity', 'row_id')}) AS file_sensitivity,
         CASE WHEN (CASE WHEN failed_attempts > 3 THEN 0.4e0 ELSE 0e0 END)
                 + (CASE WHEN data_volume_mb > 500 THEN 0.3e0 ELSE 0e0 END)
                 + (CASE WHEN lower(trim(location)) <> 'bangalore' THEN 0.2e0 ELSE 0e0 END)
                 + (CASE WHEN privilege_level = 1 THEN 0.1e0 ELSE 0e0 END)
                 + (0.4e0 * {h('rule_noise', 'row_id')} - 0.2e0) > 0.5e0 THEN 1 ELSE 0 END AS y
  FROM ev)"""

# rows with given probability, error, trust and label
SCORE_CTE = f"""sc AS (
  SELECT event_id AS row_id, user_id::VARCHAR AS user_id, {h('p', 'event_id')} AS p, {h('err', 'event_id')} AS err,
         greatest(0.15e0, {h('trust', 'user_id')}) AS trust,
         CASE WHEN {h('y', 'event_id')} < 0.2e0 THEN 1 ELSE 0 END AS y
  FROM events)"""

RISK = "least(1e0, greatest(0e0, 0.42e0 * p + 0.38e0 * least(1e0, err / 0.8e0) + 0.20e0 * (1e0 - trust)))"

LOG_CTE = """log AS (
  SELECT user_id::VARCHAR AS user_id,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS logon, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS logoff,
         CASE WHEN event_type IN ('signup', 'click') AND (hour(ts) < 7 OR hour(ts) > 19) THEN 1 ELSE 0 END AS late,
         event_type
  FROM events)"""

USER_LOG_CTE = LOG_CTE + """, users AS (
  SELECT user_id, sum(logon)::BIGINT AS logon_count, sum(logoff)::BIGINT AS logoff_count, sum(late)::BIGINT AS after_hours,
         count(*) FILTER (event_type = 'view') AS device_events, count(*) FILTER (event_type = 'purchase') AS email_events,
         count(*) FILTER (event_type = 'error') AS file_events
  FROM log GROUP BY user_id)"""
