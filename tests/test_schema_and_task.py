import pytest
from conftest import at

from relpredict.functions.times import shift
from relpredict.schema import Link, SchemaError, TableGraph, TableSpec, declare
from relpredict.task import (
    FutureWindow,
    PredictiveTask,
    TaskError,
    churn,
    demand,
    event_risk,
)


def graph(*links):
    names = {t for child, parent in links for t in (child, parent)} | {"island"}
    return TableGraph(
        {n: TableSpec(n, (), f"{n}_id") for n in names},
        tuple(Link(child, f"{parent}_id", parent, f"{parent}_id") for child, parent in links),
    )


def test_shortest_path_wins_in_either_direction():
    g = graph(("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"))
    assert [h.table for h in g.join_path("a", "d")] == ["d"]
    assert [(h.table, h.down) for h in g.join_path("c", "d")] == [("d", True)]
    assert [(h.table, h.down) for h in g.join_path("d", "b")] in ([("c", False), ("b", False)], [("a", False), ("b", True)])


def test_ties_go_to_the_first_link():
    g = graph(("m1", "a"), ("m2", "a"), ("z", "m2"), ("z", "m1"))
    assert [h.table for h in g.join_path("a", "z")] == ["m1", "z"]


def test_same_table_needs_no_step_and_islands_fail():
    g = graph(("b", "a"))
    assert g.join_path("a", "a") == []
    with pytest.raises(SchemaError):
        g.join_path("a", "island")
    with pytest.raises(SchemaError):
        g.join_path("a", "nowhere")


def test_declared_roles(small):
    spec = small.spec("customers")
    assert spec.time_index == "joined" and spec.primary_key == "customer_id"
    assert spec.column("region_id").role == "fk"
    assert small.spec("purchases").with_role("categorical") == ["kind"]
    assert "returns.purchase_id -> purchases.purchase_id" in small.graph.describe()


def test_bad_declarations(small):
    with pytest.raises(SchemaError):
        declare(small.tables, {"customers": "nope"}, [])
    with pytest.raises(SchemaError):
        declare(small.tables, {}, [("purchases", "customer_id", "customers")])


def test_month_shift_clamps_to_month_end():
    assert shift(at("2024-01-31 10:00"), 1, "months") == at("2024-02-29 10:00")
    assert shift(at("2023-11-30"), 3, "months") == at("2024-02-29")
    assert shift(at("2024-01-31"), -2, "months") == at("2023-11-30")
    assert shift(at("2024-01-31"), 2, "weeks") == at("2024-02-14")


def test_window_bounds_and_horizon():
    assert FutureWindow(0, 2, "months").horizon.days == 60
    assert FutureWindow(1, 3, "weeks").bounds(at("2024-01-01")) == (at("2024-01-08"), at("2024-01-22"))
    for start, end, unit in ((-1, 5, "days"), (5, 5, "days"), (0, 5, "years")):
        with pytest.raises(TaskError):
            FutureWindow(start, end, unit)


def test_presets():
    assert churn("c", "e", 30).compare == ("==", 0) and churn("c", "e").is_classification
    assert demand("p", "e", "q", 3).window == FutureWindow(0, 3, "months")
    assert not demand("p", "e", "q").is_classification
    risk = event_risk("t", "r", 60, assuming="amount > 100")
    assert risk.compare == (">", 0) and risk.assuming == "amount > 100"
    assert PredictiveTask("a", "mean", "b", FutureWindow(0, 1), column="x").func == "AVG"
    assert "COUNT(e.*, 0, 30, days) == 0 per c" == churn("c", "e").describe()


def test_rejected_tasks(small):
    window = FutureWindow(0, 30)
    with pytest.raises(TaskError):
        PredictiveTask("customers", "MEDIAN", "purchases", window, column="amount")
    with pytest.raises(TaskError):
        PredictiveTask("customers", "SUM", "purchases", window)
    with pytest.raises(TaskError):
        PredictiveTask("customers", "COUNT", "purchases", window, compare=("~", 1))
    for entity, table, column in (
        ("nowhere", "purchases", None),
        ("customers", "nowhere", None),
        ("customers", "regions", None),  # no time column
        ("customers", "purchases", "nope"),
    ):
        with pytest.raises(TaskError):
            PredictiveTask(entity, "COUNT", table, window, column=column).check(small)
    with pytest.raises(TaskError):
        churn("customers", "purchases", where={"returns": "true"}).check(small)
