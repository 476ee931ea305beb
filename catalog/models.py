"""Preparation, training, metrics and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import ANCHOR, cents, raw, shop
from catalog.features import Pick
from catalog.labels import CHURN
from relpredict.operators import explain as E
from relpredict.operators import metrics as M
from relpredict.operators import prep
from relpredict.operators.labels import build_labels
from relpredict.operators.models import BOOSTING
from relpredict.plans import pipeline
from relpredict.task import churn, demand

# Boosting rounds of the registered calibration, explanation, ablation and given-cutoff runs, a stated argument of
# each. The predictions are the whole job, with the library's 300. Features are the full default search.
ROUNDS = 20


def _result(spark, sf, kind: str, rounds: int = BOOSTING["maxIter"]) -> pipeline.PredictionResult:
    """A training run of its own: default depth, features and parameters, unless fewer rounds are asked for."""
    db = shop(spark, sf)
    task = demand("part", "lineitem", "l_quantity", months=3) if kind == "demand" else churn("customer", "orders", days=180)
    return pipeline.fit_predict(db, task, calibrate=kind == "calibrated", params={"maxIter": rounds})


def _predictions(kind, rounds=BOOSTING["maxIter"]):
    return lambda spark, sf, rounds=rounds: _result(spark, sf, kind, rounds).predictions


def _importance(spark, sf, rounds=ROUNDS):
    return _result(spark, sf, "churn", rounds).model.importance(spark)


def _drivers(spark, sf, rounds=ROUNDS):
    result = _result(spark, sf, "churn", rounds)
    return E.global_drivers(result.model, result.lineage, 10)


def _contributions(spark, sf, rounds=ROUNDS):
    result = _result(spark, sf, "churn", rounds)
    return E.with_provenance(E.local_contributions(result.model, result.scored, 5), result.lineage)


def _cards(spark, sf, rounds=ROUNDS):
    result = _result(spark, sf, "churn", rounds)
    found = E.local_contributions(result.model, result.scored, 5)
    return E.explanation_cards(found, result.predictions, result.lineage, classification=True)


def _fallback(spark, sf, rounds=ROUNDS):
    result = _result(spark, sf, "churn", rounds)
    return E.fallback_contributions(result.model, result.scored, 5)


def _ablation(spark, sf, rounds=ROUNDS):
    return pipeline.ablation(shop(spark, sf), churn("customer", "orders", days=180), params={"maxIter": rounds})


def _given_cutoffs(spark, sf, rounds=ROUNDS):
    """Training rows with a cutoff each: an order's moment, labelled by its own status."""
    db = shop(spark, sf)
    pick = Pick(db)
    rows = db.rows("orders").groupBy(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("cutoff")
    ).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("label"))
    split = F.col("cutoff") <= F.lit(ANCHOR).cast("timestamp_ntz")
    features = [pick.own("customer", "c_cents"), pick.over_orders("COUNT", None), pick.over_orders("MEAN")]
    return pipeline.score_given(
        db, "customer", rows.where(split), rows.where(~split), True, features, params={"maxIter": rounds}
    )


# -- checkable without a model -----------------------------------------------------------------


def _stand_in(spark, sf):
    """A deterministic stand-in score per customer next to the real churn label."""
    db = shop(spark, sf)
    scores = db.rows("customer").select(
        F.col("c_custkey").alias("entity_id"), ((F.col("c_cents") + 100000) / 1100000.0).cast("double").alias("score")
    )
    return M.attach_labels(scores, build_labels(db, CHURN, ANCHOR).drop("cutoff"))


def _stand_in_value(spark, sf):
    """A stand-in forecast per part next to the real demand."""
    db = shop(spark, sf)
    scores = db.rows("part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_size").cast("double").alias("score")
    )
    labels = build_labels(db, demand("part", "lineitem", "l_quantity", months=3), ANCHOR)
    return M.attach_labels(scores, labels.drop("cutoff"))


def _rounded(frame, digits=9):
    return frame.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
    )


def _metric(measure, rows=_stand_in):
    return lambda spark, sf: _rounded(measure(rows(spark, sf)))


def _top(spark, sf):
    return _rounded(M.top(_stand_in(spark, sf), 25))


def _dirty(spark, sf):
    """Ratios whose denominators are often zero, and a column without any value."""
    lines = raw(spark, sf, ["lineitem"])["lineitem"]
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount") / F.col("l_tax"))
    odd = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    frame = lines.select(
        "l_orderkey", "l_linenumber", ratio.alias("ratio"), odd.alias("odd"), F.lit(None).cast("double").alias("empty")
    )
    columns = ["ratio", "odd", "empty"]
    cleaned = prep.clean(frame, columns)
    known = prep.known_columns(cleaned, columns)
    return cleaned.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), *[F.round(c, 9).alias(c) for c in known]
    )


def _codes(spark, sf):
    db = shop(spark, sf)
    columns = ["o_orderstatus", "o_orderpriority"]
    return prep.category_codes(db.rows("orders"), columns).withColumn("code", F.col("code").cast("bigint"))


def _split(spark, sf):
    return prep.stratified_split(build_labels(shop(spark, sf), CHURN, ANCHOR).drop("cutoff"))


def _many_codes(spark, sf):
    """Codes of vocabularies with a value per row, and of small ones, in one encoding."""
    codes = prep.category_codes(raw(spark, sf, ["customer"])["customer"], ["c_name", "c_mktsegment"])
    return codes.withColumn("code", F.col("code").cast("bigint"))


def _effects(spark, sf):
    """What each market segment and each name does to churn, over all customers and without each fold."""
    labels = build_labels(shop(spark, sf), CHURN, ANCHOR).drop("cutoff")
    named = raw(spark, sf, ["customer"])["customer"].select(F.col("c_custkey").alias("entity_id"), "c_mktsegment", "c_name")
    rows = labels.join(named, "entity_id")
    prior = rows.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    effects = prep.label_effects(rows, ["c_mktsegment", "c_name"], prior)
    return effects.select("feature", "value", F.col("fold").cast("bigint").alias("fold"), F.round("effect", 9).alias("effect"))


QUERIES = {
    "clean_features": _dirty,
    "category_effects": _effects,
    "category_codes": _codes,
    "category_codes_large": _many_codes,
    "stratified_split": _split,
    "churn_predictions": _predictions("churn"),
    "demand_predictions": _predictions("demand"),
    "calibrated_scores": _predictions("calibrated", ROUNDS),
    "predictions_cutoff_per_row": _given_cutoffs,
    "feature_importance": _importance,
    "metric_roc_auc": _metric(M.roc_auc),
    "metric_accuracy": _metric(M.accuracy),
    "metric_brier": _metric(M.brier),
    "metric_regression": _metric(M.regression_errors, _stand_in_value),
    "reliability_bins": lambda spark, sf: _rounded(
        M.reliability_bins(_stand_in(spark, sf)).withColumn("bin", F.col("bin").cast("bigint"))
    ),
    "metric_ece": _metric(M.expected_calibration_error),
    "top_predictions": _top,
    "ablation_report": _ablation,
    "global_drivers": _drivers,
    "local_contributions": _contributions,
    "fallback_contributions": _fallback,
    "explanation_cards": _cards,
}

SCORED = f"""
ev AS (SELECT o_custkey AS id, COUNT(*) AS v FROM orders
       WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2000-01-01' + INTERVAL 90 DAY GROUP BY 1),
scored AS (SELECT c_custkey AS entity_id, ({cents('c_acctbal')} + 100000) / 1100000.0::DOUBLE AS score,
                  CAST(COALESCE(v, 0) = 0 AS INT) AS label
           FROM customer LEFT JOIN ev ON id = c_custkey)"""
VALUES = """
ev AS (SELECT l_partkey AS id, SUM(l_quantity) AS v FROM lineitem
       WHERE l_shipdate > TIMESTAMP '2000-01-01' AND l_shipdate <= TIMESTAMP '2000-04-01' GROUP BY 1),
scored AS (SELECT p_partkey AS entity_id, CAST(p_size AS DOUBLE) AS score, COALESCE(v, 0) AS label
           FROM part LEFT JOIN ev ON id = p_partkey)"""
EDGES = " + ".join(f"CAST(score >= {i * (1.0 / 10)!r}::DOUBLE AS BIGINT)" for i in range(1, 10))
BINS = f"""binned AS (SELECT {EDGES} AS bin, COUNT(*) AS n, AVG(score) AS mean_score,
                             AVG(CAST(label AS DOUBLE)) AS mean_label FROM scored GROUP BY 1)"""

ORACLES = {
    "clean_features": """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN l_tax <> 0 THEN ROUND(l_discount / l_tax, 9) END AS ratio,
       CASE WHEN l_discount <> 0 THEN l_quantity END AS odd FROM lineitem""",
    "category_codes": """
WITH v AS (SELECT 'o_orderstatus' AS feature, o_orderstatus AS value FROM orders GROUP BY ALL
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY ALL)
SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM v""",
    "category_codes_large": """
WITH v AS (SELECT 'c_name' AS feature, c_name AS value FROM customer GROUP BY ALL
           UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer GROUP BY ALL)
SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM v WHERE value IS NOT NULL""",
    "category_effects": f"""
WITH {SCORED},
rows AS (SELECT 'c_mktsegment' AS feature, c_mktsegment AS value, entity_id, label FROM scored JOIN customer ON c_custkey = entity_id
         UNION ALL SELECT 'c_name', c_name, entity_id, label FROM scored JOIN customer ON c_custkey = entity_id),
dealt AS (SELECT *, CAST('0x' || substr(md5(CAST(entity_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold FROM rows),
prior AS (SELECT AVG(CAST(label AS DOUBLE)) AS p FROM scored),
whole AS (SELECT feature, value, COUNT(*) AS n, SUM(label) AS s FROM dealt GROUP BY ALL),
own AS (SELECT feature, value, fold, COUNT(*) AS n, SUM(label) AS s FROM dealt GROUP BY ALL),
kept AS (SELECT feature, value, CAST(-1 AS BIGINT) AS fold, n, s FROM whole
         UNION ALL SELECT o.feature, o.value, o.fold, w.n - o.n, w.s - o.s
         FROM own AS o JOIN whole AS w ON o.feature = w.feature AND o.value IS NOT DISTINCT FROM w.value)
SELECT feature, value, fold, ROUND((s + 10.0::DOUBLE * p) / (n + 10.0::DOUBLE), 9) AS effect FROM kept, prior""",
    "stratified_split": f"""
WITH {SCORED},
labelled AS (SELECT c_custkey AS entity_id, COALESCE(v, 0) AS target_value, CAST(COALESCE(v, 0) = 0 AS INT) AS label
             FROM customer LEFT JOIN ev ON id = c_custkey),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(entity_id || '|42'), entity_id) AS place,
                  COUNT(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT entity_id, target_value, label, CAST(place <= floor(n * 0.25 + 0.5) AS INT) AS held_out FROM placed""",
    "metric_roc_auc": f"""
WITH {SCORED},
ranked AS (SELECT label, (rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0) AS r FROM scored),
t AS (SELECT SUM(CASE WHEN label = 1 THEN r END)::DOUBLE AS rs, COUNT(*) FILTER (WHERE label = 1) AS p,
             COUNT(*) FILTER (WHERE label = 0) AS n FROM ranked)
SELECT ROUND((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 9) AS roc_auc, p AS n_pos, n AS n_neg FROM t""",
    "metric_accuracy": f"""WITH {SCORED}
SELECT ROUND(AVG(CAST(CAST(score >= 0.5 AS INT) = label AS DOUBLE)), 9) AS accuracy FROM scored""",
    "metric_brier": f"WITH {SCORED} SELECT ROUND(AVG((score - label) * (score - label)), 9) AS brier FROM scored",
    "metric_regression": f"""WITH {VALUES} SELECT ROUND(AVG(ABS(label - score)), 9) AS mae,
       ROUND(SQRT(AVG((label - score) * (label - score))), 9) AS rmse FROM scored""",
    "reliability_bins": f"""WITH {SCORED}, {BINS}
SELECT bin, n, ROUND(mean_score, 9) AS mean_score, ROUND(mean_label, 9) AS mean_label FROM binned""",
    "metric_ece": f"""WITH {SCORED}, {BINS}
SELECT ROUND(SUM(n * ABS(mean_score - mean_label)) / SUM(n), 9) AS ece FROM binned""",
    "top_predictions": f"""WITH {SCORED} SELECT entity_id, ROUND(score, 9) AS score, label FROM scored
ORDER BY scored.score DESC, entity_id LIMIT 25""",
}
