"""Schema, filter, join, aggregate, window and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.hashing import uniform
from ...functions.scalars import binarize_label, clip, hour_or_noon, named, row_sum, to_number
from ...functions.vocabulary import EVENT_NUMERIC_COLUMNS
from ...operators.anomaly import anomalies, benign_subset
from ...operators.events import (
    event_features,
    login_frequency,
    resolve_events,
    row_features,
    rule_label,
    rule_score,
    seeded_columns,
)
from ...operators.joins import label_from_answers, merge_user_tables
from ...operators.logs import (
    is_usable_table,
    log_features,
    log_rows,
    numeric_columns,
    percentile_label,
    tabular_user_features,
    user_log_features,
    user_means,
)
from ...operators.monitor import ks_statistics, top_features
from ...operators.quantile import exact_percentiles
from ...operators.respond import trust_lookup
from ...operators.schema import coerce_mostly_numeric, numeric_feature_columns
from ...operators.selection import random_k
from ...sources.csv_files import preview, table_manifest
from ...sources.provenance import table_fingerprint
from ..adapters import (
    SEED,
    answer_set,
    drift_table,
    event_table,
    given_scores,
    labelled_events,
    log_tables,
    order_table,
    table,
)
from .registry import EVENT_CTE, FEATURE_CTE, K, LOG_CTE, SCORE_CTE, USER_LOG_CTE, h, query, r6, rounded

FEATURES = ("action", "device", "location", *EVENT_NUMERIC_COLUMNS)


@query(
    "activity_risk_levels",
    f"""WITH {FEATURE_CTE}, risk AS (
      SELECT least(1e0, greatest(0e0, 0.42e0 * ({' + '.join([
          '(CASE WHEN failed_attempts > 3 THEN 0.4e0 ELSE 0e0 END)',
          '(CASE WHEN data_volume_mb > 500 THEN 0.3e0 ELSE 0e0 END)',
          "(CASE WHEN lower(trim(location)) <> 'bangalore' THEN 0.2e0 ELSE 0e0 END)",
          '(CASE WHEN privilege_level = 1 THEN 0.1e0 ELSE 0e0 END)'])})
        + 0.38e0 * least(1e0, (data_volume_mb / login_frequency) / 2e0) + 0.20e0 * (1e0 - 0.85e0))) AS r, y FROM feat)
    SELECT CASE WHEN r >= 0.78e0 THEN 'critical' WHEN r >= 0.55e0 THEN 'elevated' WHEN r >= 0.35e0 THEN 'watch' ELSE 'normal' END
             AS threat_level, count(*) AS n, sum(y)::BIGINT AS n_labelled
    FROM risk GROUP BY 1""",
)
def activity_risk_levels(spark, folder):
    """Events to features, rule score, risk and threat level counts: scan, lookup, aggregate."""
    from ...operators.respond import decide

    frame, _ = labelled_events(spark, folder)
    scored = frame.withColumns(
        {"p": rule_score(), "err": F.col("data_volume_mb") / F.col("login_frequency"), "trust": F.lit(0.85)}
    )
    return decide(scored, 2.0).groupBy("threat_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_labelled")
    )


@query(
    "ingestion_manifest",
    "SELECT count(*) AS total_rows, greatest(1, ceil(count(*) / 50000e0))::BIGINT AS micro_batches FROM lineitem",
)
def ingestion_manifest(spark, folder):
    return table_manifest(table(spark, folder, "lineitem"))


@query(
    "table_fingerprint",
    """WITH d AS (SELECT md5('{"c0":"' || o_orderkey || '","c1":"' || o_custkey || '","c2":"' || o_orderstatus || '","c3":"' || o_orderpriority || '"}') AS m FROM orders)
    SELECT count(*) AS n_rows, sum(('0x' || substr(m, 1, 8))::BIGINT)::VARCHAR AS hash_a,
           sum(('0x' || substr(m, 9, 8))::BIGINT)::VARCHAR AS hash_b FROM d""",
)
def fingerprint(spark, folder):
    columns = [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return table_fingerprint(table(spark, folder, "orders"), columns)


@query(
    "preview",
    f"WITH {FEATURE_CTE} SELECT row_id, user_id, {', '.join(FEATURES)}, y FROM feat ORDER BY row_id LIMIT 15",
)
def first_rows(spark, folder):
    return preview(labelled_events(spark, folder)[0])


@query(
    "resolve_columns",
    f"""WITH {EVENT_CTE} SELECT row_id, user_id, hour(ts)::INT AS hour, action, device, location, data_volume_mb,
      failed_attempts, privilege_level FROM ev""",
)
def resolve_columns(spark, folder):
    odd = event_table(spark, folder).withColumnsRenamed(
        {"user_id": " UserID ", "timestamp": "Event-Time", "action": "Event Type", "device": "PC", "location": "City",
         "data_volume_mb": "Data Volume", "failed_attempts": "Failed-Logins", "privilege_level": "ROLE"}
    )
    return resolve_events(odd)


@query(
    "column_or_default",
    """SELECT event_id AS row_id, user_id::VARCHAR AS user_id, hour(ts)::INT AS hour, event_type AS action, 'unknown' AS device,
      'Bangalore' AS location, 0e0 AS data_volume_mb, 0e0 AS failed_attempts, 0e0 AS privilege_level FROM events""",
)
def column_or_default(spark, folder):
    few = table(spark, folder, "events").select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("time"), "event_type")
    return resolve_events(few)


@query(
    "numeric_feature_columns",
    """SELECT feature, round(total, 2) AS total FROM (
      UNPIVOT (SELECT sum(l_partkey)::DOUBLE AS l_partkey, sum(l_suppkey)::DOUBLE AS l_suppkey, sum(l_linenumber)::DOUBLE AS l_linenumber,
        sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice, sum(l_discount) AS l_discount FROM lineitem)
      ON COLUMNS(*) INTO NAME feature VALUE total)""",
)
def numeric_features(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_tax", "Is Insider").withColumn("late", F.col("l_shipdate").isNull())
    names = numeric_feature_columns(lines, "l_orderkey")
    sums = lines.agg(*[F.sum(named(c).cast("double")).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 2).alias("total")) for c in names])
    return sums.select(F.explode(cells).alias("c")).select("c.feature", "c.total")


@query(
    "coerce_mostly_numeric",
    """SELECT 'price' AS feature, count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    UNION ALL SELECT 'priority', count(*), round(sum(substr(o_orderpriority, 1, 1)::DOUBLE), 2) FROM orders
    UNION ALL SELECT 'mostly', count(*) FILTER (o_orderkey % 10 <> 0),
      round(sum(o_totalprice) FILTER (o_orderkey % 10 <> 0), 2) FROM orders""",
)
def mostly_numeric(spark, folder):
    converted, features, _ = coerce_mostly_numeric(order_table(spark, folder), ("user_id",))
    facts = [F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("total")).alias(c) for c in features]
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c)["n"].alias("n"), F.round(F.col(c)["total"], 2).alias("total")) for c in features]
    )
    return converted.agg(*facts).select(F.explode(cells).alias("c")).select("c.feature", "c.n", "c.total")


@query(
    "binarize_label",
    """SELECT c_mktsegment, sum(CASE WHEN c_acctbal / 2000e0 >= 1 THEN 1 ELSE 0 END)::BIGINT AS from_number,
      sum(CASE WHEN c_nationkey % 5 IN (0, 1, 2) THEN 1 ELSE 0 END)::BIGINT AS from_text FROM customer GROUP BY c_mktsegment""",
)
def labels_of_columns(spark, folder):
    key = F.col("c_nationkey") % 5
    text = F.when(key == 0, " YES ").when(key == 1, "Attack").when(key == 2, "1").when(key == 3, "no")
    customers = table(spark, folder, "customer").select("c_mktsegment", (F.col("c_acctbal") / 2000).alias("number"), text.alias("text"))
    kinds = {f.name: f.dataType for f in customers.schema}
    return customers.groupBy("c_mktsegment").agg(
        F.sum(binarize_label(F.col("number"), kinds["number"])).alias("from_number"),
        F.sum(binarize_label(F.col("text"), kinds["text"])).alias("from_text"),
    )


@query("event_features", f"WITH {FEATURE_CTE} SELECT row_id, user_id, {', '.join(FEATURES)}, y FROM feat")
def features_of_events(spark, folder):
    return event_features(event_table(spark, folder), SEED)[0]


@query(
    "seeded_uniform_columns",
    f"""SELECT event_id, 1e0 + floor(120e0 * {h('session_duration', 'event_id')}) AS session_duration,
      floor(3e0 * {h('file_sensitivity', 'event_id')}) AS file_sensitivity FROM events""",
)
def noise_columns(spark, folder):
    return table(spark, folder, "events").select("event_id").withColumns(seeded_columns(SEED, "event_id"))


@query(
    "risk_rule_label",
    f"WITH {FEATURE_CTE} SELECT action, location, count(*) AS n, sum(y)::BIGINT AS positive FROM feat GROUP BY action, location",
)
def labels_by_rule(spark, folder):
    rows = resolve_events(event_table(spark, folder)).withColumn("y", rule_label(SEED))
    return rows.groupBy("action", "location").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))


@query(
    "logon_flags",
    f"""WITH {LOG_CTE} SELECT user_id, logon::BIGINT AS logon_count, logoff::BIGINT AS logoff_count, late::BIGINT AS after_hours,
      count(*) AS n FROM log WHERE event_type IN ('signup', 'click') GROUP BY ALL""",
)
def logon_flags(spark, folder):
    rows = log_rows(log_tables(spark, folder)["logon"], "logon")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_numeric_sum",
    """SELECT o_orderkey, round(o_totalprice + o_custkey + CASE WHEN o_orderkey % 7 <> 0 THEN 1e0 ELSE 0e0 END, 6) AS total FROM orders""",
)
def row_numeric_sum(spark, folder):
    gap = F.when(F.col("o_orderkey") % 7 != 0, 1.0)
    rows = table(spark, folder, "orders").withColumn("gap", gap)
    return rows.select("o_orderkey", r6(row_sum(["o_totalprice", "o_custkey", "gap"])).alias("total"))


@query(
    "scalar_functions",
    f"""SELECT event_type, count(*) AS n, sum(hour(ts))::BIGINT AS hours,
      round(sum(round_even(value / 5e0, 0)), 6) AS half_even, round(sum(least(100e0, greatest(5e0, value))), 6) AS clipped,
      sum({K})::BIGINT AS numbers,
      round(sum(CASE WHEN value > 1 THEN -log10(greatest(1e0 / value, 1e-8)) ELSE 0e0 END), 6) AS minus_log
    FROM events GROUP BY event_type""",
)
def scalar_functions(spark, folder):
    events = table(spark, folder, "events")
    text = F.regexp_extract("props", r"(\d+)", 1)
    kinds = {f.name: f.dataType for f in events.schema}
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hour_or_noon(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), kinds["event_type"])).alias("hours"),
        r6(F.sum(F.bround(F.col("value") / 5.0, 0))).alias("half_even"),
        r6(F.sum(clip(F.col("value"), 5.0, 100.0))).alias("clipped"),
        F.sum(to_number(text, kinds["props"]).cast("bigint")).alias("numbers"),
        r6(F.sum(F.when(F.col("value") > 1, -F.log10(F.greatest(1.0 / F.col("value"), F.lit(1e-8)))).otherwise(0.0))).alias("minus_log"),
    )


@query("benign_subset", f"WITH {FEATURE_CTE} SELECT row_id, user_id, y FROM feat WHERE y = 0")
def benign(spark, folder):
    rows = row_features(resolve_events(event_table(spark, folder)), SEED).withColumn("y", rule_label(SEED))
    return benign_subset(rows.select("row_id", "user_id", "y"))


@query(
    "set_membership",
    f"WITH {EVENT_CTE} SELECT row_id, lower(trim(location)) <> 'bangalore' AS risky_place FROM ev",
)
def set_membership(spark, folder):
    from ...functions.vocabulary import ALLOWED_LOCATIONS

    rows = event_table(spark, folder)
    return rows.select("row_id", (~F.lower(F.trim("location")).isin(*ALLOWED_LOCATIONS)).alias("risky_place"))


@query("usable_table", "SELECT count(*) AS n, (count(*) >= 8) AS usable FROM orders")
def usable_table(spark, folder):
    orders = order_table(spark, folder)
    return orders.agg(F.count(F.lit(1)).alias("n")).withColumn("usable", F.lit(is_usable_table(orders)))


@query(
    "anomaly_filter",
    f"WITH {SCORE_CTE} SELECT row_id, user_id, round(err, 6) AS err FROM sc WHERE err > 0.8e0",
)
def anomaly_filter(spark, folder):
    return rounded(anomalies(given_scores(spark, folder), 0.8).select("row_id", "user_id", "err"))


@query(
    "drop_null_ids",
    "SELECT DISTINCT user_id::VARCHAR AS user_id FROM events WHERE user_id % 10 = 0 AND event_type <> 'view'",
)
def drop_null_ids(spark, folder):
    ids = table(spark, folder, "events").filter("user_id % 10 = 0").select(
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("user_id")
    )
    return ids.na.drop().distinct()


@query("merge_user_tables", f"WITH {USER_LOG_CTE} SELECT * FROM users")
def merge_tables(spark, folder):
    return merge_user_tables([log_features(df, kind) for kind, df in log_tables(spark, folder).items()])


@query("user_log_features", f"WITH {USER_LOG_CTE} SELECT * FROM users")
def one_pass_log_features(spark, folder):
    return user_log_features(log_tables(spark, folder))


@query(
    "features_with_labels",
    """SELECT o_custkey::VARCHAR AS user_id, round(avg(o_totalprice), 6) AS price,
      max(CASE WHEN o_totalprice / 300000e0 >= 1 THEN 1 ELSE 0 END)::INT AS y FROM orders GROUP BY o_custkey""",
)
def features_with_labels(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 300000).alias("label")
    )
    return rounded(user_means(orders, "user_id", ["price"], "label"))


@query(
    "label_from_answers",
    f"""WITH {USER_LOG_CTE} SELECT *, (CASE WHEN user_id::BIGINT % 10 = 0 THEN 1 ELSE 0 END)::INT AS y FROM users""",
)
def answers_label(spark, folder):
    return label_from_answers(user_log_features(log_tables(spark, folder)), answer_set(spark, folder))


@query(
    "trust_lookup",
    f"""SELECT event_id AS row_id, user_id::VARCHAR AS user_id,
      round(CASE WHEN user_id % 3 = 0 THEN greatest(0.15e0, {h('trust', 'user_id')}) ELSE 0.85e0 END, 6) AS trust FROM events""",
)
def lookup_trust(spark, folder):
    rows = event_table(spark, folder).select("row_id", "user_id")
    users = rows.select("user_id").distinct().filter("cast(user_id as bigint) % 3 = 0")
    known = users.withColumn("trust", F.greatest(F.lit(0.15), uniform(SEED, "trust", "user_id")))
    return rounded(trust_lookup(rows, known))


@query(
    "score_alignment",
    f"""WITH {SCORE_CTE} SELECT y, count(*) AS n, round(sum(p * err), 4) AS product, round(sum(trust), 4) AS trust FROM sc GROUP BY y""",
)
def score_alignment(spark, folder):
    """Scores kept in separate tables meet again by row key."""
    scores = given_scores(spark, folder)
    left, right = scores.select("row_id", "p", "y"), scores.select("row_id", "err", "trust")
    joined = left.join(right, "row_id")
    return joined.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p") * F.col("err")), 4).alias("product"),
        F.round(F.sum("trust"), 4).alias("trust"),
    )


@query(
    "logon_features",
    f"""WITH {LOG_CTE} SELECT user_id, sum(logon)::BIGINT AS logon_count, sum(logoff)::BIGINT AS logoff_count,
      sum(late)::BIGINT AS after_hours FROM log WHERE event_type IN ('signup', 'click') GROUP BY user_id""",
)
def logon_features(spark, folder):
    return log_features(log_tables(spark, folder)["logon"], "logon")


def _count_query(kind: str, event_type: str) -> None:
    sql = f"SELECT user_id::VARCHAR AS user_id, count(*) AS {kind}_events FROM events WHERE event_type = '{event_type}' GROUP BY user_id"

    @query(f"{kind}_features", sql)
    def count_features(spark, folder):
        return log_features(log_tables(spark, folder)[kind], kind)


for _kind, _type in (("device", "view"), ("email", "purchase"), ("file", "error")):
    _count_query(_kind, _type)


TABULAR_CTE = """u AS (
      SELECT o_custkey::VARCHAR AS user_id, avg(o_totalprice) AS price, avg(substr(o_orderpriority, 1, 1)::DOUBLE) AS priority,
             avg(CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END) AS mostly FROM orders GROUP BY o_custkey),
    s AS (SELECT *, coalesce(price, 0) + coalesce(priority, 0) + coalesce(mostly, 0) AS score FROM u)"""


@query(
    "tabular_user_features",
    f"""WITH {TABULAR_CTE}
    SELECT user_id, round(price, 6) AS price, round(priority, 6) AS priority, round(mostly, 6) AS mostly,
      (CASE WHEN score >= (SELECT quantile_cont(score, 0.92) FROM s) THEN 1 ELSE 0 END)::INT AS y FROM s""",
)
def wide_user_features(spark, folder):
    return rounded(tabular_user_features(order_table(spark, folder))[0])


@query(
    "percentile_label",
    f"""WITH {USER_LOG_CTE}, s AS (SELECT *, logon_count + logoff_count + after_hours + device_events + email_events + file_events AS score
      FROM users)
    SELECT user_id, (CASE WHEN score >= (SELECT quantile_cont(score::DOUBLE, 0.92) FROM s) THEN 1 ELSE 0 END)::INT AS y FROM s""",
)
def label_by_percentile(spark, folder):
    users = user_log_features(log_tables(spark, folder))
    return percentile_label(users, numeric_columns(users)).select("user_id", "y")


@query(
    "exact_percentile",
    """SELECT 'l_extendedprice' AS name, round(quantile_cont(l_extendedprice, 0.90), 6) AS value FROM lineitem
    UNION ALL SELECT 'l_quantity', round(quantile_cont(l_quantity, 0.95), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', round(quantile_cont(l_discount, 0.5), 6) FROM lineitem""",
)
def percentiles(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = exact_percentiles(
        lines,
        {"l_extendedprice": (F.col("l_extendedprice"), 0.90), "l_quantity": (F.col("l_quantity"), 0.95), "l_discount": (F.col("l_discount"), 0.5)},
    )
    return spark.createDataFrame([(n, round(v, 6)) for n, v in found.items()], "name string, value double")


@query("median_abs", "SELECT round(median(abs(c_acctbal)), 6) AS median_abs FROM customer")
def median_abs(spark, folder):
    value = exact_percentiles(table(spark, folder, "customer"), {"m": (F.abs("c_acctbal"), 0.5)})["m"]
    return spark.createDataFrame([(round(value, 6),)], "median_abs double")


@query(
    "distinct_test",
    """SELECT event_type, (count(DISTINCT value) >= 2) AS varied, (count(DISTINCT event_type) >= 2) AS mixed FROM events GROUP BY event_type""",
)
def distinct_test(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(
        (F.min("value") != F.max("value")).alias("varied"), (F.min("event_type") != F.max("event_type")).alias("mixed")
    )


@query("unique_users", "SELECT DISTINCT user_id FROM events")
def unique_users(spark, folder):
    return table(spark, folder, "events").select("user_id").distinct()


@query(
    "login_frequency",
    "SELECT event_id AS row_id, user_id::VARCHAR AS user_id, (count(*) OVER (PARTITION BY user_id))::DOUBLE AS login_frequency FROM events",
)
def frequency(spark, folder):
    return login_frequency(event_table(spark, folder).select("row_id", "user_id"))


KS_CTE = """long AS (
      SELECT 'value' AS feature, (ts >= TIMESTAMP '2024-01-16')::INT AS side, value AS v FROM events
      UNION ALL SELECT 'shifted', (ts >= TIMESTAMP '2024-01-16')::INT, value + CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 20e0 ELSE 0e0 END FROM events
      UNION ALL SELECT 'constant', (ts >= TIMESTAMP '2024-01-16')::INT, 1e0 FROM events),
    agg AS (SELECT feature, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM long GROUP BY feature, v),
    cum AS (SELECT feature, a, b, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS n1,
      sum(b) OVER (PARTITION BY feature) AS n2 FROM agg WINDOW w AS (PARTITION BY feature ORDER BY v)),
    ks AS (SELECT feature, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2,
      (count(*) FILTER (a > 0) < 2 OR count(*) FILTER (b > 0) < 2) AS constant, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d
      FROM cum GROUP BY feature)"""


@query(
    "ks_distance",
    f"WITH {KS_CTE} SELECT feature, round(CASE WHEN constant THEN 0e0 ELSE d END, 6) AS ks_statistic, n1, n2, constant FROM ks",
)
def ks_distance(spark, folder):
    return rounded(ks_statistics(drift_table(spark, folder), ["value", "shifted", "constant"], F.col("side")))


@query(
    "top_features",
    "SELECT event_type AS feature, round(avg(abs(value - 50)), 6) AS mean_abs FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def best_features(spark, folder):
    attribution = table(spark, folder, "events").groupBy(F.col("event_type").alias("feature")).agg(
        F.avg(F.abs(F.col("value") - 50)).alias("mean_abs")
    )
    return rounded(top_features(attribution, 3))


@query("head_n", "SELECT event_id AS row_id, user_id::VARCHAR AS user_id FROM events ORDER BY event_id LIMIT 25")
def head_n(spark, folder):
    return preview(event_table(spark, folder).select("row_id", "user_id"), 25)


@query(
    "random_k_without_replacement",
    f"SELECT event_id FROM events ORDER BY {h('pick', 'event_id')}, event_id LIMIT (SELECT count(*) // 3 FROM events)",
)
def random_rows(spark, folder):
    events = table(spark, folder, "events")
    return events.filter(random_k(events, lambda n: n // 3, SEED, "pick", "event_id")).select("event_id")


@query(
    "union_by_name",
    """SELECT 'c' AS kind, c_nationkey AS nation, count(*) AS n, count(c_mktsegment) AS n_segment FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 's', s_nationkey, count(*), 0 FROM supplier GROUP BY s_nationkey""",
)
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return both.groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("c_mktsegment").alias("n_segment"))


@query(
    "distinct_union",
    "SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0",
)
def distinct_union(spark, folder):
    a = table(spark, folder, "events").filter("event_type = 'error'").select("user_id")
    b = table(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return a.union(b).distinct()
