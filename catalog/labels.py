"""Anchors, windows and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import ANCHOR, ANCHORS, CUT, CUTS, cents, shop
from relpredict.operators import labels as L
from relpredict.task import FutureWindow, PredictiveTask, churn, demand, event_risk

CHURN = churn("customer", "orders", days=90)
SPEND = FutureWindow(0, 6, "months")


def _spend(func: str, column: str | None = "o_cents", **options) -> PredictiveTask:
    return PredictiveTask("customer", func, "orders", SPEND, column=column, **options)


def _label(task: PredictiveTask, anchor=ANCHOR):
    return lambda spark, sf: L.build_labels(shop(spark, sf), task, anchor)


def _default_test_labels(spark, sf):
    """Churn labels at the test anchor that the data itself implies."""
    db = shop(spark, sf)
    return L.build_labels(db, CHURN, L.default_anchors(db, CHURN)[1])


def _bounds(spark, sf):
    """Month windows from every order date, so month ends and leap years occur."""
    anchors = shop(spark, sf).rows("orders").select(F.col("o_orderdate").alias("anchor")).distinct()
    return L.window_bounds(anchors, PredictiveTask("customer", "COUNT", "orders", FutureWindow(1, 3, "months")))


def _label_sql(value: str, label: str, entity="customer", key="c_custkey", events="", universe="") -> str:
    return f"""
WITH ev AS ({events})
SELECT {key} AS entity_id, {CUT} AS cutoff, {value} AS target_value, {label} AS label
FROM {entity} LEFT JOIN ev ON id = {key} {universe}"""


def _spend_sql(aggregate: str, cast: str, extra: str = "", universe: str = "") -> str:
    events = f"""SELECT o_custkey AS id, {aggregate} AS v FROM orders
      WHERE o_orderdate > {CUT} AND o_orderdate <= TIMESTAMP '2000-07-01' {extra} GROUP BY 1"""
    value = f"CAST(COALESCE(v, 0) AS {cast})"
    return _label_sql(value, "CAST(COALESCE(v, 0) AS DOUBLE)", events=events, universe=universe)


CENTS = cents("o_totalprice")

# name -> (query, check)
ENTRIES = {
    "time_range": (
        lambda spark, sf: L.time_range(shop(spark, sf), CHURN),
        "SELECT MIN(o_orderdate) AS min_time, MAX(o_orderdate) AS max_time FROM orders",
    ),
    "default_anchors": (
        lambda spark, sf: L.anchors_frame(shop(spark, sf), CHURN),
        """SELECT date_trunc('day', max(o_orderdate) - INTERVAL 180 DAY)::TIMESTAMP AS train_anchor,
                  date_trunc('day', max(o_orderdate) - INTERVAL 90 DAY)::TIMESTAMP AS test_anchor FROM orders""",
    ),
    "window_bounds": (
        _bounds,
        """SELECT DISTINCT o_orderdate AS anchor, o_orderdate + INTERVAL 1 MONTH AS lo,
                  o_orderdate + INTERVAL 3 MONTH AS hi FROM orders""",
    ),
    "entity_universe": (
        lambda spark, sf: L.entity_universe(
            shop(spark, sf),
            churn("orders", "lineitem", assuming="o_orderstatus = 'F' OR NOT o_orderpriority LIKE '1%'"),
            ANCHOR,
        ),
        f"""SELECT o_orderkey AS entity_id FROM orders WHERE o_orderdate <= {CUT}
            AND (o_orderstatus = 'F' OR NOT o_orderpriority LIKE '1%')""",
    ),
    "join_path_two_hop": (
        lambda spark, sf: L.join_chain(shop(spark, sf), "customer", "lineitem").select(
            "c_custkey", "o_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("line")
        ),
        """SELECT c_custkey, o_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line
           FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""",
    ),
    "future_window_events": (
        lambda spark, sf: L.window_events(shop(spark, sf), CHURN, ANCHOR).select("o_orderkey", "o_custkey", "o_orderdate"),
        f"""SELECT o_orderkey, o_custkey, o_orderdate FROM orders
            WHERE o_orderdate > {CUT} AND o_orderdate <= {CUT} + INTERVAL 90 DAY""",
    ),
    "label_count": (_label(_spend("COUNT", None)), _spend_sql("COUNT(*)", "BIGINT")),
    "label_count_col": (_label(_spend("COUNT", "o_orderstatus")), _spend_sql("COUNT(o_orderstatus)", "BIGINT")),
    "label_sum": (_label(_spend("SUM")), _spend_sql(f"SUM({CENTS})", "BIGINT")),
    "label_avg": (
        _label(_spend("MEAN")),
        _spend_sql(f"CAST(SUM({CENTS}) AS DOUBLE) / COUNT(*)", "DOUBLE"),
    ),
    "label_min": (_label(_spend("MIN")), _spend_sql(f"MIN({CENTS})", "BIGINT")),
    "label_max": (_label(_spend("MAX")), _spend_sql(f"MAX({CENTS})", "BIGINT")),
    "label_with_where": (
        _label(_spend("SUM", where="o_orderstatus IN ('F', 'O') AND NOT (o_orderpriority LIKE '5%' OR o_cents < 100000)")),
        _spend_sql(
            f"SUM({CENTS})", "BIGINT",
            f"AND o_orderstatus IN ('F', 'O') AND NOT (o_orderpriority LIKE '5%' OR {CENTS} < 100000)",
        ),
    ),
    "label_with_assuming": (
        _label(_spend("SUM", assuming="c_cents < -10000 OR c_mktsegment = 'MACHINERY'")),
        _spend_sql(
            f"SUM({CENTS})", "BIGINT",
            universe=f"WHERE {cents('c_acctbal')} < -10000 OR c_mktsegment = 'MACHINERY'",
        ),
    ),
    "label_churn": (
        _default_test_labels,
        """
WITH a AS (SELECT date_trunc('day', max(o_orderdate) - INTERVAL 90 DAY)::TIMESTAMP AS cutoff FROM orders),
ev AS (SELECT o_custkey AS id, COUNT(*) AS v FROM orders, a
       WHERE o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 90 DAY GROUP BY 1)
SELECT c_custkey AS entity_id, cutoff, COALESCE(v, 0) AS target_value,
       CAST(COALESCE(v, 0) = 0 AS INT) AS label
FROM customer CROSS JOIN a LEFT JOIN ev ON id = c_custkey""",
    ),
    "label_demand": (
        _label(demand("part", "lineitem", "l_quantity", months=3)),
        _label_sql(
            "COALESCE(v, 0)", "CAST(COALESCE(v, 0) AS DOUBLE)", "part", "p_partkey",
            f"""SELECT l_partkey AS id, SUM(l_quantity) AS v FROM lineitem
                WHERE l_shipdate > {CUT} AND l_shipdate <= TIMESTAMP '2000-04-01' GROUP BY 1""",
        ),
    ),
    "label_risk_two_hop": (
        _label(
            event_risk("customer", "lineitem", days=60, where={"lineitem": "l_returnflag = 'R'", "orders": "o_cents > 10000000"})
        ),
        _label_sql(
            "COALESCE(v, 0)", "CAST(COALESCE(v, 0) > 0 AS INT)",
            events=f"""SELECT o_custkey AS id, COUNT(*) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey
                WHERE l_shipdate > {CUT} AND l_shipdate <= {CUT} + INTERVAL 60 DAY
                  AND l_returnflag = 'R' AND {CENTS} > 10000000 GROUP BY 1""",
        ),
    ),
    "label_through_parent": (
        _label(PredictiveTask("part", "SUM", "orders", FutureWindow(0, 2, "weeks"), column="o_cents")),
        _label_sql(
            "CAST(COALESCE(v, 0) AS BIGINT)", "CAST(COALESCE(v, 0) AS DOUBLE)", "part", "p_partkey",
            f"""SELECT l_partkey AS id, SUM({CENTS}) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey
                WHERE o_orderdate > {CUT} AND o_orderdate <= {CUT} + INTERVAL 14 DAY GROUP BY 1""",
        ),
    ),
    "label_multi_anchor": (
        lambda spark, sf: L.build_labels_many(
            shop(spark, sf), PredictiveTask("customer", "AVG", "orders", FutureWindow(0, 12, "months"), column="o_cents"), ANCHORS
        ),
        f"""
WITH ev AS (SELECT o_custkey AS id, cutoff, CAST(SUM({CENTS}) AS DOUBLE) / COUNT(*) AS v FROM orders, {CUTS}
            WHERE o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 12 MONTH GROUP BY ALL)
SELECT c_custkey AS entity_id, a.cutoff, COALESCE(v, 0) AS target_value, COALESCE(v, 0) AS label
FROM customer CROSS JOIN {CUTS} LEFT JOIN ev ON id = c_custkey AND ev.cutoff = a.cutoff""",
    ),
}

QUERIES = {name: query for name, (query, _) in ENTRIES.items()}
ORACLES = {name: sql for name, (_, sql) in ENTRIES.items()}

