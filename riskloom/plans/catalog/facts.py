"""What must hold for results that depend on a fitted model or a digest, as rows that SQL can state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ...operators.anomaly import anomaly_threshold, fit_linear, reconstruction_error
from ...operators.attribution import tree_leaves, with_shapley
from ...operators.boosting import fit_trees
from ...operators.learn import fit_classifier
from ...operators.respond import threat_columns
from ...operators.trust import trust_training
from ...session import scratch_path
from ...sources.csv_files import files_below, table_manifest
from ...sources.provenance import content_fingerprint, provenance_record, table_provenance
from ...streaming.activity import run_to_table
from ...streaming.scoring import stream_risk_scoring
from ..adapters import event_columns, planted_signal, table
from ..experiment import dataset_facts
from ..monitored import run_monitored
from .learning import SETTINGS, _planted
from .registry import h, query
from .sources import _log_folder, _write_csv
from .streams import _stream, labelled_source, trusted_scoring


@query(
    "dataset_facts_row",
    """SELECT count(*) AS n_rows_input, 12::INT AS n_features_used, round_even(count(*) * 0.08, 0)::BIGINT AS evaluation_label_flips,
      'f0,f1,f2,f3,f4,f5,f6,f7,f8,f9,f10,f11' AS names FROM embeddings""",
)
def facts_row(spark, folder):
    facts = dataset_facts(*planted_signal(spark, folder))
    return facts.select("n_rows_input", "n_features_used", "evaluation_label_flips", F.array_join("feature_names", ",").alias("names"))


@query("linear_scorer_facts", "SELECT count(*) AS n_rows, 0::BIGINT AS n_wrong, 0e0 AS skew FROM embeddings")
def linear_facts(spark, folder):
    """The short form of the error equals the long one on every row, and the components are orthonormal."""
    train, test, preparation = _planted(spark, folder)
    scorer = fit_linear(train.filter("y = 0"), len(preparation.names))
    w, mean = scorer.model.pc.toArray(), np.asarray(scorer.mean)
    project = w @ w.T
    rebuilt = F.array(*[
        F.lit(float(mean[i])) + sum((F.col("features")[j] - F.lit(float(mean[j]))) * F.lit(float(project[i, j])) for j in range(len(mean)))
        for i in range(len(mean))
    ])
    rows = scorer.with_error(train.unionByName(test)).withColumn("long", reconstruction_error(F.col("features"), rebuilt))
    skew = abs(float(np.abs(w.T @ w - np.eye(w.shape[1])).max()))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("err") - F.col("long")) > 1e-8).alias("n_wrong"), F.lit(round(skew, 6)).alias("skew")
    )


@query("attribution_facts", "SELECT 'logistic' AS kind, 0::BIGINT AS n_wrong UNION ALL SELECT 'trees', 0")
def attribution_facts(spark, folder):
    """A row's values sum to its score minus the mean score of the background, in log-odds."""
    train, test, preparation = _planted(spark, folder)
    odds, out = F.log(F.col("p") / (1 - F.col("p"))), None
    for kind in ("logistic", "trees"):
        model = fit_classifier(train, kind)
        mean = model.score(train).agg(F.avg(odds)).first()[0]
        explained = with_shapley(model.score(test), model, train, len(preparation.names))
        total = F.aggregate("shapley", F.lit(0.0), lambda a, b: a + b)
        one = explained.agg(F.lit(kind).alias("kind"), F.count_if(F.abs(total - (odds - F.lit(mean))) > 1e-6).alias("n_wrong"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "path_attribution_facts",
    """SELECT 5::INT AS depth, 0::BIGINT AS n_wrong, count(*) AS n_rows FROM embeddings
    UNION ALL SELECT 12, 0, count(*) FROM embeddings""",
)
def path_facts(spark, folder):
    """Values by path shares sum to a row's score minus the mean score of the background, for shallow and deep trees."""
    train, test, preparation = _planted(spark, folder)
    out = None
    for depth, trees in ((5, 200), (12, 40)):
        model = fit_classifier(train, trees=trees, depth=depth)
        odds = F.log(F.col("p") / (1 - F.col("p")))
        mean = model.score(train).agg(F.avg(odds)).first()[0]
        explained = with_shapley(model.score(train.unionByName(test)), model, train, len(preparation.names), "path")
        total = F.aggregate("shapley", F.lit(0.0), lambda a, b: a + b)
        one = explained.agg(
            F.lit(depth).alias("depth"), F.count_if(F.abs(total - (odds - F.lit(mean))) > 1e-6).alias("n_wrong"), F.count(F.lit(1)).alias("n_rows")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "boosting_facts",
    f"""WITH r AS (SELECT vec_id, CASE WHEN {h('y', 'vec_id')} < 0.12e0 THEN 1 ELSE 0 END AS y, vec_id % 5 + 1 AS w FROM embeddings),
      m AS (SELECT sum(w * y)::DOUBLE / sum(w) AS p FROM r)
      SELECT 'gradient of the root' AS fact, round(sum(w * (p - y)), 4) AS value FROM r, m
      UNION ALL SELECT 'hessian of the root', round(sum(w * p * (1 - p)), 4) FROM r, m
      UNION ALL SELECT 'base', round(ln(p / (1 - p)), 6) FROM m
      UNION ALL SELECT 'leaves with another value', 0 UNION ALL SELECT 'leaves with other sums', 0 UNION ALL SELECT 'trees with a higher loss', 0""",
)
def boosting_facts(spark, folder):
    """The first tree over all rows starts from the weighted share of label 1; its leaves hold the sums of their rows, and the loss falls."""
    frame, _ = planted_signal(spark, folder)
    names = [f"f{i}" for i in range(12)]
    rows = frame.select("row_id", "y", F.array(*names).alias("features"), (F.col("row_id") % 5 + 1).cast("double").alias("w"))
    model = fit_trees(rows, len(names), weight="w", trees=60, share=1.0)
    feature, threshold = model.feature[0], model.threshold[0]
    p, at = 1 / (1 + F.exp(F.lit(-model.base))), F.lit(None).cast("int")
    for _, path, node in tree_leaves(feature, threshold, model.value[0]):
        met = F.lit(True)
        for f, (low, high) in path.items():
            met = met & (F.col("features")[f] > F.lit(low)) & (F.col("features")[f] <= F.lit(high))
        at = F.when(met, F.lit(node)).otherwise(at)
    sums = rows.groupBy(at.alias("node")).agg(F.sum(F.col("w") * (p - F.col("y"))).alias("g"), F.sum(F.col("w") * p * (1 - p)).alias("h"))
    leaves = np.flatnonzero((feature < 0) & (model.h[0] > 0))
    table = spark.createDataFrame([(int(i), float(model.g[0][i]), float(model.h[0][i]), float(model.value[0][i])) for i in leaves], "node int, leaf_g double, leaf_h double, value double")
    both = sums.join(F.broadcast(table), "node", "full")  # at most 32 leaves
    other = F.coalesce((F.abs(F.col("g") - F.col("leaf_g")) < 1e-4) & (F.abs(F.col("h") - F.col("leaf_h")) < 1e-4), F.lit(False))
    wrong = F.coalesce(F.abs(F.col("value") + 0.08 * F.col("g") / (F.col("h") + 1)) < 1e-6, F.lit(False))
    found = both.agg(F.count_if(~wrong).cast("double").alias("value"), F.count_if(~other).cast("double").alias("sums"))
    facts = {
        "gradient of the root": F.lit(round(float(model.g[0][0]), 4) + 0.0), "hessian of the root": F.lit(round(float(model.h[0][0]), 4)), "base": F.lit(round(model.base, 6)),
        "leaves with another value": F.col("value"), "leaves with other sums": F.col("sums"), "trees with a higher loss": F.lit(float((np.diff(model.losses) > 0).sum())),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("fact"), v.cast("double").alias("value")) for k, v in facts.items()])
    return found.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "logistic_facts",
    "SELECT unnest(range(13))::INT AS coordinate, 0e0 AS gradient FROM (SELECT 1 FROM embeddings LIMIT 1)",
)
def logistic_facts(spark, folder):
    """At the fitted weights the gradient of the weighted mean loss with its penalty is near 0 in every coordinate (the last: intercept)."""
    train, _, preparation = _planted(spark, folder)
    d = len(preparation.names)
    weighted = train.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    model = fit_classifier(weighted, "logistic", weight="w", iterations=300)
    scored = model.score(weighted).withColumn("r", F.col("w") * (F.col("p") - F.col("y")))
    # the penalty is on standardised weights: each is multiplied by its feature's deviation
    spread = [F.var_samp(F.col("features")[j]) for j in range(d)]
    sums = scored.agg(*[(F.sum(F.col("r") * F.col("features")[j]) / F.sum("w")).alias(f"g{j}") for j in range(d)], (F.sum("r") / F.sum("w")).alias(f"g{d}"),
                      *[v.alias(f"v{j}") for j, v in enumerate(spread)])
    weights = model.model.coefficients.toArray()
    cells = [F.col(f"g{j}") + (1e-3 * float(weights[j]) * F.col(f"v{j}") if j < d else 0) for j in range(d + 1)]
    return sums.select(F.posexplode(F.array(*[F.round(c, 3) + 0.0 for c in cells])).alias("coordinate", "gradient"))


@query("trust_training_facts", "SELECT 0::BIGINT AS n_outside, true AS poisoned_lower")
def trust_facts(spark, folder):
    """Trust stays within its bounds, and rows with a turned label end lower on average."""
    train, _, preparation = _planted(spark, folder)
    turned = train.withColumn("poisoned", F.col("row_id") % 7 == 0).withColumn("y", F.when(F.col("poisoned"), 1 - F.col("y")).otherwise(F.col("y")))
    scored = fit_linear(train.filter("y = 0"), len(preparation.names)).with_error(turned)
    threshold = anomaly_threshold(scored.filter("y = 0"))
    _, state = trust_training(scored, threshold, rounds=SETTINGS.rounds, power=SETTINGS.power)
    return state.agg(
        F.count_if(~F.col("trust").between(0.15, 1.0)).alias("n_outside"),
        (F.avg(F.when(F.col("poisoned"), F.col("trust"))) < F.avg(F.when(~F.col("poisoned"), F.col("trust")))).alias("poisoned_lower"),
    )


@query("stream_scoring_facts", "SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM events")
def scoring_facts(spark, folder):
    """The stream gives every event the decision that the batch gives it."""
    frame, counts, meta = labelled_source(spark, folder)
    fitted = trusted_scoring(frame, meta)
    batch, stream = (
        stream_risk_scoring(event_columns(source), counts, *fitted).select("row_id", "threat_level", "risk_score")
        for source in (table(spark, folder, "events"), _stream(spark, folder))
    )
    both = batch.join(run_to_table(stream, "decisions").toDF("row_id", "level", "risk"), "row_id", "full")
    same = F.col("threat_level").eqNullSafe(F.col("level")) & (F.abs(F.col("risk_score") - F.col("risk")) < 1e-9)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different"))


@query("fingerprint_facts", "SELECT true AS same_when_repeated, true AS other_for_other_files, true AS all_listed, true AS id_follows")
def fingerprint_facts(spark, folder):
    first, second = _log_folder(spark, folder), _log_folder(spark, folder)
    digest = lambda path: content_fingerprint(spark, path).first()
    # a second write of the same rows has part files of other names, so its digest differs
    names = scratch_path(spark, "other")
    _write_csv(spark.range(3), names, "extra.csv")
    one, again, record = digest(first), digest(first), provenance_record(spark, first).first()
    return spark.range(1).select(
        F.lit(one.content_sha256 == again.content_sha256).alias("same_when_repeated"),
        F.lit(len({one.content_sha256, digest(second).content_sha256, digest(names).content_sha256}) == 3).alias("other_for_other_files"),
        F.lit(one.n_sources == len(record.sources) == len(files_below(spark, first))).alias("all_listed"),
        F.lit(record.dataset_id == "cert_batch:" + one.content_sha256[:16]).alias("id_follows"),
    )


@query(
    "monitored_run_facts",
    """SELECT 'levels' AS fact, 0::BIGINT AS n UNION ALL SELECT 'unscored', 0 UNION ALL SELECT 'drifted', 0
      UNION ALL SELECT 'models', 5""",
)
def monitored_facts(spark, folder):
    """Threat levels follow from the returned risk, all test rows are scored, and the five parts of the metrics are there."""
    frame, meta = planted_signal(spark, folder)
    source = table(spark, folder, "embeddings").select("vec_id", "label")
    run = run_monitored(frame, meta, table_provenance(source, "embeddings"), table_manifest(source))
    level = threat_columns(F.col("risk_score"))["threat_level"]
    tests = run.experiment.rows.filter("split = 'test'")
    facts = {
        "levels": run.decisions.filter(~F.col("threat_level").eqNullSafe(level)).count(),
        "unscored": tests.join(run.decisions, "row_id", "left_anti").count(),
        "drifted": run.drift.filter("p_value < 0.05 and not drift_flag").count(),
        "models": run.experiment.metrics.select("model").distinct().count(),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("fact"), F.lit(v).cast("bigint").alias("n")) for k, v in facts.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
