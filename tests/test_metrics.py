import random

import pytest
from conftest import rows_of

from relpredict.operators import metrics as M


def brute_auc(rows):
    wins = [(p > n) + 0.5 * (p == n) for p, y in rows if y == 1 for n, z in rows if z == 0]
    return sum(wins) / len(wins)


@pytest.fixture(scope="module")
def scored(frame):
    return lambda rows: frame("entity_id int, score double, label int", *[(i, s, y) for i, (s, y) in enumerate(rows)])


def test_auc_with_ties_equals_brute_force(scored):
    random.seed(3)
    rows = [(random.choice([0.1, 0.2, 0.5, 0.9, random.random()]), random.randint(0, 1)) for _ in range(400)]
    for slices in (2, 16, 1024):
        assert M.roc_auc(scored(rows), slices=slices).first().roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_auc_needs_two_classes(scored):
    row = M.roc_auc(scored([(0.1, 1), (0.9, 1)])).first()
    assert row.roc_auc is None and (row.n_pos, row.n_neg) == (2, 0)
    assert "roc_auc" not in M.evaluate(scored([(0.1, 1), (0.9, 1)]), True)
    assert M.roc_auc(scored([])).first().roc_auc is None


def test_unknown_labels_are_left_out(scored):
    rows = [(0.2, 0), (0.8, 1), (0.9, None), (0.1, None)]
    assert M.roc_auc(scored(rows)).first().roc_auc == 1.0
    assert M.accuracy(scored(rows)).first().accuracy == 1.0
    assert sum(r.n for r in M.reliability_bins(scored(rows)).collect()) == 2


def test_accuracy_counts_a_half_as_positive(scored):
    assert M.accuracy(scored([(0.5, 1), (0.4999, 1), (0.1, 0)])).first().accuracy == pytest.approx(2 / 3)


def test_regression_errors(frame):
    row = M.regression_errors(frame("score double, label double", (1.0, 2.0), (5.0, 2.0))).first()
    assert (row.mae, row.rmse) == (2.0, pytest.approx(5**0.5))


def test_brier(scored):
    assert M.brier(scored([(0.0, 0), (1.0, 1)])).first().brier == 0.0
    assert M.brier(scored([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)])).first().brier == pytest.approx(0.025)


def test_bins_are_closed_on_the_left_and_at_the_end(scored):
    rows = [(0.0, 0), (0.1, 0), (0.3, 1), (0.30000000000000004, 1), (0.9999, 1), (1.0, 1)]
    bins = {r.bin: r.n for r in M.reliability_bins(scored(rows)).collect()}
    # the edge is 3 * 0.1 = 0.30000000000000004, so 0.3 itself lies below it
    assert bins == {0: 1, 1: 1, 2: 1, 3: 1, 9: 2}


def test_expected_calibration_error(scored):
    rows = [(0.05, 0), (0.05, 1), (0.95, 1), (0.95, 1)]
    assert M.expected_calibration_error(scored(rows)).first().ece == pytest.approx(0.5 * 0.45 + 0.5 * 0.05)


def test_top_breaks_ties_by_entity(scored):
    rows = scored([(0.5, 0), (0.9, 1), (0.9, 0), (0.1, 0)])
    assert [r.entity_id for r in M.top(rows, 3).collect()] == [1, 2, 0]
    assert [r.entity_id for r in M.top(rows, 1, ascending=True).collect()] == [3]
    assert len(M.head(rows, 2).collect()) == 2


def test_attach_labels(frame, scored):
    labels = frame("entity_id int, label int", (1, 1))
    predictions = scored([(0.2, 0), (0.4, 0)]).drop("label")
    assert rows_of(M.attach_labels(predictions, labels), "entity_id", "label") == [(0, None), (1, 1)]
