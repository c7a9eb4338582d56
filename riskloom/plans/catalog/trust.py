"""Split, encode, scale, corruption, trust, metric, drift and risk queries on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.hashing import uniform
from ...functions.scalars import flag
from ...operators.anomaly import anomaly_threshold, reconstruction_error, with_anomaly_flag
from ...operators.corrupt import feature_noise, feature_poison, label_noise, label_poison
from ...operators.events import resolve_events, row_features, rule_label
from ...operators.learn import confusion_metrics, evaluate
from ...operators.monitor import ks_drift, overfit_flags
from ...operators.prep import Scaler, ordinal_encode, value_codes
from ...operators.respond import decide, threat_level_counts
from ...operators.selection import split_by_group, stratified_split
from ...operators.trust import (
    init_trust,
    log_loss,
    refine_round,
    trust_after_anomaly,
    trust_after_loss,
    trust_map,
    trust_summary,
    trust_weights,
)
from ...session import write_table
from ..adapters import SEED, drift_table, event_table, given_scores, planted_signal
from .features import KS_CTE
from .registry import EVENT_CTE, FEATURE_CTE, RISK, SCORE_CTE, h, h32, normal_sql, query, r6, rounded

LOSS = """(CASE WHEN y = 1 THEN -ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE -ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END)"""

SPLIT_CTE = f"""cnt AS (SELECT y, count(*) AS c FROM feat GROUP BY y),
    tot AS (SELECT sum(c)::BIGINT AS n, ceil(0.25e0 * sum(c))::BIGINT AS n_test FROM cnt),
    share AS (SELECT y, c, (n - n_test) * c / n::DOUBLE AS s, n - n_test AS n_train FROM cnt, tot),
    quota AS (SELECT y, c - floor(s)::BIGINT - (CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, y)
        <= n_train - (SELECT sum(floor(s)) FROM share) THEN 1 ELSE 0 END) AS q FROM share),
    split AS (SELECT feat.*, CASE WHEN row_number() OVER (PARTITION BY feat.y ORDER BY {h('split', 'row_id')}, row_id) <= q
        THEN 'test' ELSE 'train' END AS split FROM feat JOIN quota USING (y))"""


def _labelled(spark, folder):
    """Labelled rows as a written table: splits and selections pass over them several times."""
    return write_table(row_features(resolve_events(event_table(spark, folder)), SEED).withColumn("y", rule_label(SEED)), "labelled")


@query("stratified_split", f"WITH {FEATURE_CTE}, {SPLIT_CTE} SELECT row_id, y, split FROM split")
def split_rows(spark, folder):
    return stratified_split(_labelled(spark, folder).select("row_id", "y"), SEED)


@query(
    "standard_scale",
    f"""WITH {FEATURE_CTE}, {SPLIT_CTE}, m AS (SELECT avg(data_volume_mb) AS m1, stddev_pop(data_volume_mb) AS s1,
      avg(failed_attempts) AS m2, stddev_pop(failed_attempts) AS s2, avg(hour) AS m3, stddev_pop(hour) AS s3 FROM split WHERE split = 'train')
    SELECT row_id, split, round((data_volume_mb - m1) / s1, 6) AS data_volume_mb, round((failed_attempts - m2) / s2, 6) AS failed_attempts,
      round((hour - m3) / s3, 6) AS hour, 0e0 AS constant FROM split, m""",
)
def scale_columns(spark, folder):
    columns = ["data_volume_mb", "failed_attempts", "hour", "constant"]
    rows = stratified_split(_labelled(spark, folder).withColumn("constant", F.lit(3.7)), SEED)
    scaler = Scaler.fit(rows.filter("split = 'train'"), columns)
    scaled = rows.select("row_id", "split", scaler.features().alias("x"))
    return scaled.select("row_id", "split", *[r6(F.col("x")[i]).alias(c) for i, c in enumerate(columns)])


@query(
    "ordinal_encode",
    f"""WITH {FEATURE_CTE}, {SPLIT_CTE}, t AS (SELECT *, (round(data_volume_mb)::BIGINT)::VARCHAR AS mb FROM split),
      ca AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT action AS v FROM t WHERE split = 'train')),
      cl AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT location AS v FROM t WHERE split = 'train')),
      cm AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT mb AS v FROM t WHERE split = 'train'))
    SELECT row_id, coalesce(ca.c, -1)::DOUBLE AS action_enc, coalesce(cl.c, -1)::DOUBLE AS location_enc, coalesce(cm.c, -1)::DOUBLE AS mb_enc
    FROM t LEFT JOIN ca ON t.action = ca.v LEFT JOIN cl ON t.location = cl.v LEFT JOIN cm ON t.mb = cm.v""",
)
def encode_columns(spark, folder):
    rows = stratified_split(_labelled(spark, folder), SEED)
    rows = rows.withColumn("mb", F.round("data_volume_mb").cast("bigint").cast("string"))
    columns = ["action", "location", "mb"]
    codes = value_codes(rows.filter("split = 'train'"), columns)
    return ordinal_encode(rows, codes, columns).select("row_id", "action_enc", "location_enc", "mb_enc")


@query(
    "label_noise",
    f"""WITH {FEATURE_CTE}, k AS (SELECT least(count(*), greatest(1, round_even(count(*) * 0.08e0, 0)))::BIGINT AS k FROM feat),
      o AS (SELECT row_id, y, row_number() OVER (ORDER BY {h('label_noise', 'row_id')}, row_id) AS rn FROM feat)
    SELECT row_id, (CASE WHEN rn <= k THEN 1 - y ELSE y END)::INT AS y, rn <= k AS label_flipped FROM o, k""",
)
def noisy_labels(spark, folder):
    return label_noise(_labelled(spark, folder).select("row_id", "y"), 0.08, SEED)


@query(
    "label_poison",
    f"""WITH {FEATURE_CTE}, k AS (SELECT greatest(1, floor(count(*) * 0.14e0))::BIGINT AS k FROM feat WHERE y = 0),
      o AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {h('label_poison', 'row_id')}, row_id) AS rn FROM feat)
    SELECT row_id, (CASE WHEN y = 0 AND rn <= k THEN 1 ELSE y END)::INT AS y, (y = 0 AND rn <= k) AS poisoned FROM o, k""",
)
def poisoned_labels(spark, folder):
    return label_poison(_labelled(spark, folder).select("row_id", "y"), 0.14, True, SEED)


@query(
    "feature_noise",
    f"""WITH {FEATURE_CTE}, m AS (SELECT greatest(0.03e0 * (median(abs(hour)) + 1), 0.08e0) AS sh,
      greatest(0.03e0 * (median(abs(privilege_level)) + 1), 0.08e0) AS sp FROM feat)
    SELECT row_id, round(data_volume_mb + 50e0 * {normal_sql('noise/data_volume_mb', 'row_id', 53)}, 6) AS data_volume_mb,
      greatest(0e0, failed_attempts + floor(3e0 * {h('noise/failed_attempts', 'row_id', 53)}) - 1) AS failed_attempts,
      round(hour + sh * {normal_sql('noise/hour', 'row_id', 53)}, 6) AS hour,
      round(privilege_level + sp * {normal_sql('noise/privilege_level', 'row_id', 53)}, 6) AS privilege_level FROM feat, m""",
)
def noisy_features(spark, folder):
    columns = ["data_volume_mb", "failed_attempts", "hour", "privilege_level"]
    return rounded(feature_noise(_labelled(spark, folder).select("row_id", *columns), columns, 53, 50.0))


@query(
    "feature_poison",
    f"""WITH base AS (SELECT vec_id AS row_id, CASE WHEN {h('y', 'vec_id')} < 0.12e0 THEN 1 ELSE 0 END AS y, embedding FROM embeddings),
      k AS (SELECT CASE WHEN count(*) > 0 THEN greatest(1, floor(count(*) * 0.55e0))::BIGINT ELSE 0 END AS k FROM base WHERE y = 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {h('feature_poison', 'row_id', 49)}, row_id) AS rn FROM base),
      d AS (SELECT i AS j, row_number() OVER (ORDER BY {h('damped', 'i', 49)}) <= 6 AS damped FROM range(12) t(i))
    SELECT row_id, j::INT AS j, (y = 1 AND rn <= k) AS tampered,
      round(CASE WHEN y = 1 AND rn <= k
        THEN (embedding[j + 1]::DOUBLE * 8e0 + y) * (CASE WHEN damped THEN 0.3e0 ELSE 1e0 END)
          + 0.4e0 * (sqrt(-2e0 * ln((('0x' || substr(md5('49:tamper/' || j || '/a:' || row_id), 1, 8))::BIGINT + 0.5e0) / 4294967296e0))
            * cos(2e0 * pi() * ((('0x' || substr(md5('49:tamper/' || j || '/b:' || row_id), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)))
        ELSE embedding[j + 1]::DOUBLE * 8e0 + y END, 6) AS value
    FROM o, k, d""",
)
def tampered_features(spark, folder):
    frame, _ = planted_signal(spark, folder)
    rows = frame.select("row_id", "y", F.array(*[F.col(f"f{i}") for i in range(12)]).alias("features"))
    tampered = feature_poison(rows, 12, 0.4, 0.55, 49)
    return rounded(tampered.select("row_id", "tampered", F.posexplode("features").alias("j", "value")))


@query(
    "reconstruction_error",
    """SELECT vec_id, round((SELECT avg(pow(x - round(x * 10) / 10, 2)) FROM (SELECT unnest(embedding)::DOUBLE AS x)), 6) AS err FROM embeddings""",
)
def given_reconstruction(spark, folder):
    from ..adapters import table

    features = F.transform("embedding", lambda x: x.cast("double"))
    rebuilt = F.transform("features", lambda x: F.round(x * 10) / 10)
    rows = table(spark, folder, "embeddings").select("vec_id", features.alias("features"))
    return rows.select("vec_id", r6(reconstruction_error(F.col("features"), rebuilt)).alias("err"))


@query(
    "anomaly_threshold",
    f"""WITH {SCORE_CTE}, t AS (SELECT quantile_cont(err, 0.95) AS threshold FROM sc WHERE y = 0)
    SELECT y, count(*) AS n, sum(CASE WHEN err > threshold THEN 1 ELSE 0 END)::BIGINT AS n_anomalous FROM sc, t GROUP BY y""",
)
def threshold_of_errors(spark, folder):
    scores = given_scores(spark, folder)
    threshold = anomaly_threshold(scores.filter("y = 0"))
    return with_anomaly_flag(scores, threshold).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("anomalous").alias("n_anomalous")
    )


COUNTS = """count(*) FILTER (p > 0.5e0 AND y = 1) AS tp, count(*) FILTER (p > 0.5e0 AND y = 0) AS fp,
      count(*) FILTER (p <= 0.5e0 AND y = 1) AS fn, count(*) FILTER (p <= 0.5e0 AND y = 0) AS tn"""
AUC_CTE = """a1 AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM cut GROUP BY p),
      a2 AS (SELECT pos * ((sum(neg) OVER (ORDER BY p)) - neg + neg / 2e0) AS part, pos, neg FROM a1),
      auc AS (SELECT sum(part) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM a2)"""
METRIC_ROWS = """SELECT 'accuracy' AS metric, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS value FROM c
      UNION ALL SELECT 'precision', coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) FROM c
      UNION ALL SELECT 'recall', coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) FROM c
      UNION ALL SELECT 'f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) FROM c
      UNION ALL SELECT 'roc_auc', auc FROM auc"""


@query(
    "confusion_metrics",
    f"""WITH {SCORE_CTE}, cut AS (SELECT * FROM sc), c AS (SELECT {COUNTS} FROM cut)
    SELECT round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
      round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""",
)
def confusion_of_scores(spark, folder):
    scores = given_scores(spark, folder)
    return rounded(confusion_metrics(scores, (F.col("p") > 0.5).cast("int"), F.col("y")))


@query(
    "evaluate_classifier",
    f"""WITH {SCORE_CTE}, cut AS (SELECT y, round((p + y) / 2, 3) AS p FROM sc), c AS (SELECT {COUNTS} FROM cut), {AUC_CTE},
      m AS ({METRIC_ROWS}) SELECT 'given' AS model, metric, round(value, 6) AS value FROM m""",
)
def evaluate_given(spark, folder):
    """Scores are cut to three digits, so many of them tie."""
    scores = given_scores(spark, folder).withColumn("p", F.round((F.col("p") + F.col("y")) / 2, 3))
    return rounded(evaluate(scores, "given"))


@query(
    "overfit_flags",
    f"""WITH {SCORE_CTE}, cut AS (SELECT y, (p + 19 * y) / 20 AS p FROM sc), c AS (SELECT {COUNTS} FROM cut), {AUC_CTE},
      m AS (SELECT * FROM ({METRIC_ROWS}) WHERE metric IN ('accuracy', 'f1', 'roc_auc') AND NOT isnan(value) AND value > 0.98e0)
    SELECT format('The clean model''s {{}} of {{:.3f}} is above 0.98, which real data seldom allow.', metric, value) AS message FROM m
    UNION ALL SELECT 'Look for leaked labels or classes that are too easy to tell apart.' FROM m HAVING count(*) > 0""",
)
def overfit(spark, folder):
    scores = given_scores(spark, folder).withColumn("p", (F.col("p") + 19 * F.col("y")) / 20)
    return overfit_flags(evaluate(scores, "given"))


@query("log_loss", f"WITH {SCORE_CTE} SELECT row_id, round({LOSS}, 6) AS loss FROM sc")
def loss_of_scores(spark, folder):
    return given_scores(spark, folder).select("row_id", r6(log_loss(F.col("p"), F.col("y"))).alias("loss"))


@query(
    "trust_weights",
    f"""WITH {SCORE_CTE}, w AS (SELECT row_id, pow(greatest(1e-3, least(1e0, trust)), 1.6e0) AS w FROM sc)
    SELECT row_id, round(w / ((SELECT avg(w) FROM w) + 1e-8), 6) AS weight FROM w""",
)
def weights_of_trust(spark, folder):
    return rounded(trust_weights(given_scores(spark, folder), 1.6).select("row_id", "weight"))


@query(
    "trust_after_loss",
    f"""WITH {SCORE_CTE}, l AS (SELECT *, {LOSS} AS loss FROM sc), q AS (SELECT quantile_cont(loss, 0.90) + 1e-8 AS hi FROM l),
      n AS (SELECT row_id, trust, greatest(0e0, least(1e0, loss / hi)) AS rel FROM l, q)
    SELECT row_id, round(greatest(0.15e0, least(1e0, trust - 0.15e0 * (rel - (SELECT avg(rel) FROM n)))), 6) AS trust FROM n""",
)
def trust_by_loss(spark, folder):
    rows = given_scores(spark, folder).withColumn("loss", log_loss(F.col("p"), F.col("y")))
    return rounded(trust_after_loss(rows).select("row_id", "trust"))


ANOMALY_STEP = """greatest(0.15e0, least(1e0, t - CASE WHEN y = 0 AND err > 0.8e0 THEN {step} WHEN y = 1 AND err <= 0.8e0 THEN {step} / 2 ELSE 0e0 END))"""


@query(
    "trust_after_anomaly",
    f"WITH {SCORE_CTE} SELECT row_id, round({ANOMALY_STEP.format(step='0.08e0').replace('(0.15e0, least(1e0, t -', '(0.15e0, least(1e0, trust -')}, 6) AS trust FROM sc",
)
def trust_by_anomaly(spark, folder):
    return rounded(trust_after_anomaly(given_scores(spark, folder), 0.8).select("row_id", "trust"))


def _round_sql(r: int, rate: str, source: str) -> str:
    """One trust round in SQL: from column t of ``source`` to column t of ``s{r + 1}``."""
    loss = LOSS.replace("p))", f"p{r}))")
    return f"""l{r} AS (SELECT *, {loss} AS loss FROM {source}),
      q{r} AS (SELECT quantile_cont(loss, 0.90) + 1e-8 AS hi FROM l{r}),
      n{r} AS (SELECT * EXCLUDE (loss, hi), greatest(0e0, least(1e0, loss / hi)) AS rel FROM l{r}, q{r}),
      u{r} AS (SELECT * REPLACE (greatest(0.15e0, least(1e0, t - {rate} * (rel - (SELECT avg(rel) FROM n{r})))) AS t) FROM n{r}),
      s{r + 1} AS (SELECT * EXCLUDE (rel) REPLACE ({ANOMALY_STEP.format(step='0.06e0')} AS t) FROM u{r})"""


@query(
    "refine_round",
    f"""WITH {SCORE_CTE}, s0 AS (SELECT row_id, y, err, p AS p0, trust AS t FROM sc), {_round_sql(0, '0.12e0', 's0')}
    SELECT row_id, round(t, 6) AS trust FROM s1""",
)
def one_round(spark, folder):
    return rounded(refine_round(given_scores(spark, folder), 0.8).select("row_id", "trust"))


@query(
    "trust_rounds",
    f"""WITH s0 AS (SELECT event_id AS row_id, {h('err', 'event_id')} AS err, {h('p0', 'event_id')} AS p0, {h('p1', 'event_id')} AS p1,
        {h('p2', 'event_id')} AS p2, CASE WHEN {h('y', 'event_id')} < 0.2e0 THEN 1 ELSE 0 END AS y, 1e0 AS t FROM events),
      {_round_sql(0, '0.12e0', 's0')}, {_round_sql(1, '0.15e0', 's1')}, {_round_sql(2, '0.18e0', 's2')}
    SELECT row_id, round(t, 6) AS trust FROM s3""",
)
def several_rounds(spark, folder):
    """Three rounds of the training loop with given probabilities in the place of fitted models."""
    state = init_trust(given_scores(spark, folder).drop("trust", "p"))
    for r in range(3):
        state = refine_round(state.withColumn("p", uniform(SEED, f"p{r}", "row_id")), 0.8, 0.12 + 0.03 * r, 0.06)
    return rounded(state.select("row_id", "trust"))


@query(
    "trust_summary",
    f"""WITH {SCORE_CTE} SELECT round(avg(trust) FILTER (y = 1), 6) AS mean_trust_flipped, round(avg(trust) FILTER (y = 0), 6) AS mean_trust_other FROM sc""",
)
def summary_of_trust(spark, folder):
    return rounded(trust_summary(given_scores(spark, folder).withColumn("poisoned", F.col("y") == 1)))


@query(
    "trust_map",
    f"""SELECT user_id::VARCHAR AS user_id, round(max_by({h('t', 'event_id')}, event_id), 6) AS trust, round(avg({h('t', 'event_id')}), 6) AS mean_trust
    FROM events GROUP BY user_id""",
)
def trust_per_user(spark, folder):
    rows = event_table(spark, folder).select("row_id", "user_id", uniform(SEED, "t", "row_id").alias("trust"))
    mean = trust_map(rows, "mean").withColumnRenamed("trust", "mean_trust")
    return rounded(trust_map(rows).join(mean, "user_id"))


@query(
    "ks_drift",
    f"""WITH {KS_CTE}, z AS (SELECT feature, CASE WHEN constant THEN 0e0 ELSE d END AS d, constant,
        d * d * n1::DOUBLE * n2::DOUBLE / (n1::DOUBLE + n2::DOUBLE) AS z2 FROM ks),
      p AS (SELECT feature, d, CASE WHEN constant OR z2 < 0.01e0 THEN 1e0 ELSE greatest(0e0, least(1e0,
        2e0 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * z2))))) END AS p FROM z)
    SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, p < 0.05e0 AS drift_flag FROM p""",
)
def drift_large_sample(spark, folder):
    rows = drift_table(spark, folder)
    return rounded(ks_drift(rows, ["value", "shifted", "constant"], F.col("side")))


@query("ks_drift_exact")
def drift_exact(spark, folder):
    return rounded(ks_drift(drift_table(spark, folder), ["value", "shifted", "constant"], F.col("side"), method="exact"))


@query("risk_score", f"WITH {SCORE_CTE} SELECT row_id, round({RISK}, 6) AS risk_score FROM sc")
def risk_of_scores(spark, folder):
    return rounded(decide(given_scores(spark, folder), 0.8).select("row_id", "risk_score"))


LEVEL = "CASE WHEN r >= 0.78e0 THEN {0} WHEN r >= 0.55e0 THEN {1} WHEN r >= 0.35e0 THEN {2} ELSE {3} END"
ACTIONS = LEVEL.format(
    "'block_high_risk_session,alert_soc_priority,forensic_snapshot'",
    "'alert_analyst,step_up_auth,enhanced_monitoring_24h'",
    "'log_for_trending,optional_manager_notification'",
    "'allow'",
)
NOTES = LEVEL.format(
    "'Combined model and low trust exceed critical threshold.'",
    "'Elevated insider-risk score; manual review recommended.'",
    "'Borderline signals; continue passive monitoring.'",
    "'Within expected behavior envelope.'",
)
NAMES = LEVEL.format("'critical'", "'elevated'", "'watch'", "'normal'")


@query(
    "threat_decision",
    f"""WITH {SCORE_CTE}, k AS (SELECT row_id, user_id, {RISK} AS r FROM sc)
    SELECT row_id, user_id, {NAMES} AS threat_level, round(r, 6) AS risk_score, {ACTIONS} AS actions, {NOTES} AS notes FROM k""",
)
def decisions(spark, folder):
    """The action list is joined to one text, so that both engines print it alike."""
    rows = decide(given_scores(spark, folder), 0.8).withColumn("actions", F.array_join("actions", ","))
    return rounded(rows.select("row_id", "user_id", "threat_level", "risk_score", "actions", "notes"))


@query(
    "threat_level_counts",
    f"WITH {SCORE_CTE}, k AS (SELECT {RISK} AS r FROM sc) SELECT {NAMES} AS threat_level, count(*) AS n FROM k GROUP BY 1",
)
def level_counts(spark, folder):
    return threat_level_counts(decide(given_scores(spark, folder), 0.8))


@query(
    "split_by_user",
    f"""WITH g AS (SELECT user_id::VARCHAR AS user_id, count(*) AS n, max(CASE WHEN {h('y', 'user_id')} < 0.2e0 THEN 1 ELSE 0 END) AS s,
        any_value({h32('split', 'user_id')}) AS k FROM events GROUP BY user_id),
      r AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY k) AS upto FROM g),
      a AS (SELECT 0.25e0 * coalesce(sum(n) FILTER (s = 1), 0) AS want1, 0.25e0 * coalesce(sum(n) FILTER (s = 0), 0) AS want0 FROM g),
      t AS (SELECT coalesce(sum(n), 0) AS taken FROM r, a WHERE s = 1 AND upto - n / 2e0 <= want1)
    SELECT user_id, s AS y, n, CASE WHEN upto - n / 2e0 <= CASE WHEN s = 1 THEN want1 ELSE want0 + want1 - taken END THEN 'test' ELSE 'train' END AS split
    FROM r, a, t""",
)
def user_split(spark, folder):
    """All events of a user on one side; users with and without a seeded label apart."""
    rows = event_table(spark, folder).select("row_id", "user_id").withColumn("y", flag(uniform(SEED, "y", "user_id") < 0.2))
    return split_by_group(rows, "user_id", SEED).groupBy("user_id", "split").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n"))
