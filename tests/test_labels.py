import pytest
from conftest import assert_same, at, rows_of
from pyspark.sql import functions as F

from relpredict.operators import labels as L
from relpredict.operators.features import union_all
from relpredict.task import FutureWindow, PredictiveTask, TaskError, churn, event_risk

ANCHOR = at("2024-03-01")
MONTH = FutureWindow(0, 30, "days")


def values(db, task, anchor=ANCHOR, **options):
    return {r.entity_id: r.target_value for r in L.build_labels(db, task, anchor, **options).collect()}


def spend(func, column="amount", **options):
    return PredictiveTask("customers", func, "purchases", MONTH, column=column, **options)


def test_window_is_open_below_and_closed_above(small):
    # 10 is exactly at the anchor (out), 12 exactly at the end (in), 13 just after it (out)
    assert values(small, churn("customers", "purchases", 30)) == {1: 2, 2: 0, 5: 0}


def test_universe_drops_unborn_and_undated_entities(small):
    assert rows_of(L.entity_universe(small, churn("customers", "purchases"), ANCHOR), "entity_id") == [(1,), (2,), (5,)]
    no_time = churn("regions", "purchases")
    assert len(L.entity_universe(small, no_time, ANCHOR).collect()) == 3


def test_aggregates_and_fill(small):
    assert values(small, spend("SUM")) == {1: 4.0, 2: 0.0, 5: 0.0}
    assert values(small, spend("AVG")) == {1: 2.0, 2: 0.0, 5: 0.0}
    assert values(small, spend("MIN"))[1] == -3.0 and values(small, spend("MAX"))[1] == 7.0
    assert values(small, spend("MIN"), fill=None) == {1: -3.0, 2: None, 5: None}
    assert values(small, spend("COUNT", None)) == {1: 2, 2: 0, 5: 0}


def test_count_of_a_column_skips_nulls(small):
    task = PredictiveTask("customers", "COUNT", "purchases", FutureWindow(0, 60), column="kind")
    assert values(small, task, at("2024-01-15"))[2] == 1


def test_comparison_makes_the_label(small):
    rows = L.build_labels(small, churn("customers", "purchases", 30), ANCHOR).collect()
    assert {r.entity_id: r.label for r in rows} == {1: 0, 2: 1, 5: 1}
    assert {r.cutoff for r in rows} == {ANCHOR}
    assert L.build_labels(small, spend("COUNT", None), ANCHOR).schema["label"].dataType.typeName() == "double"


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("kind = 'a' OR amount > 6", 2),
        ("NOT kind = 'a'", 1),
        ("kind IN ('a', 'c')", 1),
        ("amount < -2.5", 1),
        ("amount BETWEEN -3 AND 0 OR kind IS NULL", 1),
        ("5 < amount", 1),
        (lambda: F.col("amount") == -3.0, 1),
    ],
)
def test_filters_keep_their_boolean_meaning(small, where, expected):
    where = where() if callable(where) else where
    assert values(small, spend("COUNT", None, where=where))[1] == expected


def test_quotes_in_strings(small):
    task = churn("customers", "purchases", assuming=F.col("colour") == "it's")
    assert values(small, task, at("2024-07-01")) == {4: 0}


def test_two_hops_and_filter_on_the_middle(small):
    risk = event_risk("customers", "returns", 30)
    assert values(small, risk) == {1: 1, 2: 1, 5: 0}
    middle = event_risk("customers", "returns", 30, where={"purchases": "kind = 'b'"})
    assert values(small, middle) == {1: 1, 2: 0, 5: 0}
    on_entity = event_risk("customers", "returns", 30, where={"customers": "balance < 0"})
    assert values(small, on_entity) == {1: 0, 2: 1, 5: 0}


def test_paths_through_a_parent_count_join_rows(small):
    # every return of a region counts for each customer of that region
    task = PredictiveTask("customers", "COUNT", "customers", FutureWindow(0, 12, "months"))
    assert values(small, task) == {1: 0, 2: 0, 5: 0}
    by_region = PredictiveTask("regions", "COUNT", "returns", MONTH)
    assert values(small, by_region) == {1: 2, 2: 0, 3: 0}
    down_up = PredictiveTask("returns", "COUNT", "purchases", FutureWindow(0, 12, "months"))
    assert values(small, down_up, at("2024-02-25")) == {100: 1, 101: 0}


def test_many_anchors_equal_one_by_one(small, db):
    anchors = [at("2024-02-01"), at("2024-02-20"), at("2024-03-01"), at("2024-03-15")]
    for task in (churn("customers", "purchases", 30), spend("AVG"), spend("MAX"), event_risk("customers", "returns", 45)):
        assert_same(
            L.build_labels_many(small, task, anchors),
            union_all([L.build_labels(small, task, a) for a in anchors]),
        )
    task = PredictiveTask("customer", "SUM", "lineitem", FutureWindow(1, 7, "months"), column="l_quantity")
    anchors = [at("1999-01-01"), at("1999-03-15"), at("2000-01-01")]
    assert_same(
        L.build_labels_many(db, task, anchors), union_all([L.build_labels(db, task, a) for a in anchors])
    )


def test_default_anchors(small, frame):
    assert L.default_anchors(small, churn("customers", "purchases", 10)) == (at("2024-03-11"), at("2024-03-21"))
    # 2024-02-01 .. 2024-03-31: two horizons of 90 days do not fit, so thirds of the range
    first, second = L.default_anchors(small, churn("customers", "purchases", 90))
    assert (first, second) == (at("2024-02-20"), at("2024-03-11"))


def test_empty_target_is_refused(small):
    empty = small.with_tables({"purchases": small.rows("purchases").where("false")})
    with pytest.raises(TaskError):
        L.default_anchors(empty, churn("customers", "purchases"))


def test_window_bounds_on_columns(small, frame):
    anchors = frame("anchor timestamp_ntz", (at("2024-01-31 10:00"),))
    row = L.window_bounds(anchors, PredictiveTask("customers", "COUNT", "purchases", FutureWindow(0, 1, "months"))).first()
    assert (row.lo, row.hi) == (at("2024-01-31 10:00"), at("2024-02-29 10:00"))


def test_time_bounds_reach_the_scan(db):
    task = churn("customer", "orders", 90)
    plan = L.build_labels(db, task, at("2000-01-01"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate,2000-01-01" in plan
    scan = next(line for line in plan.splitlines() if "o_orderdate" in line and "ReadSchema" in line)
    assert "o_totalprice" not in scan
