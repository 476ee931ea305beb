import datetime as dt

import pytest
from conftest import assert_same, at, rows_of
from pyspark.sql import functions as F

from catalog.features import Pick
from relpredict.functions.states import State, moments_of, running_merge
from relpredict.functions.times import moments_before, ntz
from relpredict.operators import cutoffs
from relpredict.operators import features as X
from relpredict.operators import labels as L
from relpredict.operators.cutoffs import ancestors, cover, synthesize_many
from relpredict.plans import feature_plan as plan
from relpredict.schema import declare
from relpredict.task import FutureWindow, PredictiveTask

ANCHOR = at("2024-03-01")


def only(db, entity, *names, depth=2):
    found = {f.name: f for f in plan.enumerate_features(db.graph, entity, depth)}
    return [found[n] for n in names]


def single(db, entity, name, cutoff=ANCHOR):
    frame = X.synthesize_at(db, entity, cutoff, only(db, entity, name))
    return {r.entity_id: r[name] for r in frame.collect()}


def test_names_are_unique_and_plain(db):
    features = plan.enumerate_features(db.graph, "customer", 2)
    names = [f.name for f in features]
    assert len(set(names)) == len(names) > 200
    assert all(n.replace("_", "").isalnum() for n in names)
    assert max(f.depth for f in features) == 2
    assert not {"c_custkey", "c_name", "c_nationkey"} & set(names)


def test_enumeration_rules(small):
    names = {f.name for f in plan.enumerate_features(small.graph, "customers", 2)}
    assert {"month__joined", "weekday__joined", "regions__region", "count__purchases_returns"} <= names
    assert "num_unique__purchases__month__bought" in names
    assert "mean__purchases__count__returns" in names
    assert "sum__purchases__count__returns" not in names  # the two-hop count says the same
    assert not any("customers__" in n and n.startswith("mean__purchases") for n in names)  # no way back
    assert "regions__mean__customers__balance" in names
    assert {f.name for f in plan.enumerate_features(small.graph, "customers", 0)} == {"colour", "balance"}
    few = plan.enumerate_features(small.graph, "customers", 1, aggregations=["COUNT"], transforms=[])
    assert {f.name for f in few} == {"colour", "balance", "regions__region", "count__purchases", "count__purchases_returns"}


def test_role_playing_links_stay_apart(frame):
    tables = {
        "city": frame("city_id int, size double", (1, 1.0), (2, 2.0)),
        "trip": frame("trip_id int, origin int, target int, price double", (1, 1, 2, 5.0), (2, 1, 1, 7.0)),
    }
    db = declare(tables, {"city": "city_id", "trip": "trip_id"}, [("trip", "origin", "city"), ("trip", "target", "city")])
    features = plan.enumerate_features(db.graph, "city", 1)
    names = [f.name for f in features]
    assert len(set(names)) == len(names)
    rows = {r.entity_id: r for r in X.synthesize_at(db, "city", ANCHOR, features).collect()}
    assert rows[1].count__trip_origin == 2 and rows[1].count__trip_target == 1
    assert rows[2].count__trip_origin == 0 and rows[2].sum__trip_target__price == 5.0


def test_cutoff_is_inclusive_and_future_is_invisible(small):
    assert single(small, "customers", "count__purchases") == {1: 1, 2: 2, 5: 0}
    assert single(small, "customers", "sum__purchases__amount") == {1: 5.0, 2: 6.0, 5: 0.0}


def test_values_of_absent_children(small):
    assert single(small, "customers", "mean__purchases__amount") == {1: 5.0, 2: 3.0, 5: None}
    assert single(small, "customers", "std__purchases__amount")[1] is None
    assert single(small, "customers", "std__purchases__amount")[2] == pytest.approx(2**0.5)
    assert single(small, "customers", "num_unique__purchases__kind") == {1: 1, 2: 1, 5: 0}


def test_own_columns_transforms_and_lookup(small):
    assert single(small, "customers", "weekday__joined") == {1: 0, 2: 2, 5: 1}  # 2024-01-01 was a Monday
    assert single(small, "customers", "month__joined") == {1: 1, 2: 1, 5: 1}
    assert single(small, "customers", "regions__region") == {1: "north", 2: "north", 5: None}
    assert single(small, "customers", "colour") == {1: "red", 2: "blue", 5: None}


def test_two_hop_rows_need_every_step_visible(small):
    # return 100 is dated before its purchase 10, which becomes visible at the anchor
    assert single(small, "customers", "count__purchases_returns") == {1: 1, 2: 1, 5: 0}
    assert single(small, "customers", "count__purchases_returns", at("2024-02-25")) == {1: 0, 2: 1, 5: 0}


def test_stacked(small):
    assert single(small, "customers", "mean__purchases__count__returns") == {1: 1.0, 2: 0.5, 5: None}
    assert single(small, "customers", "max__purchases__count__returns") == {1: 1.0, 2: 1.0, 5: None}


def truncated(db, anchor):
    """The database without any row after the anchor."""
    kept = {}
    for name, rows in db.tables.items():
        time = db.spec(name).time_index
        kept[name] = rows if time is None else rows.where(F.col(time) <= ntz(anchor))
    return db.with_tables(kept)


def test_no_future_row_reaches_a_feature(db, small):
    anchor = at("2000-01-01")
    for entity, depth in (("customer", 1), ("supplier", 1)):
        features = [f for f in plan.enumerate_features(db.graph, entity, depth) if not f.name.startswith("nation__")]
        assert_same(
            X.synthesize_at(db, entity, anchor, features), X.synthesize_at(truncated(db, anchor), entity, anchor, features)
        )
    assert_same(X.synthesize_at(small, "customers", ANCHOR), X.synthesize_at(truncated(small, ANCHOR), "customers", ANCHOR))
    features = only(db, "customer", "std__orders__o_cents", "num_unique__orders__o_orderstatus", "max__orders__count__lineitem")
    assert_same(
        synthesize_many(db, "customer", [anchor], features), synthesize_many(truncated(db, anchor), "customer", [anchor], features)
    )


CUTS = [at("2024-02-20"), ANCHOR, at("2024-03-31")]


def test_strategies_agree_on_edge_rows(small):
    features = plan.enumerate_features(small.graph, "customers", 2, aggregations=["COUNT", "SUM", "STD", "NUM_UNIQUE"])
    expected = X.union_all([X.synthesize_at(small, "customers", c, features) for c in CUTS]).cache()
    assert_same(synthesize_many(small, "customers", CUTS, features), expected)
    asked = X.union_all(
        [small.rows("customers").select(F.col("customer_id").alias("entity_id"), ntz(c).alias("cutoff")) for c in CUTS]
    )
    assert_same(synthesize_many(small, "customers", asked, features), expected)


def test_strategies_agree_on_provided_tables(db):
    cuts = [at("1998-03-01"), at("2000-01-01"), at("2001-02-02")]
    keep = ("nation__n_name", "nation__mean__customer__c_cents", "nation__std__customer_orders__o_cents")
    features = [
        f
        for f in plan.enumerate_features(db.graph, "customer", 2)
        if f.name in keep or ("o_cents" in f.name and not f.name.startswith("nation__")) or "l_quantity" in f.name and "nation" not in f.name
        or "part__p_brand" in f.name and "nation" not in f.name
    ]
    assert len(features) > 20
    expected = X.union_all([X.synthesize_at(db, "customer", c, features) for c in cuts]).cache()
    assert_same(synthesize_many(db, "customer", cuts, features), expected)
    asked = expected.select("entity_id", "cutoff")
    assert_same(synthesize_many(db, "customer", asked, features), expected)


def test_uneven_cutoffs_per_row(db):
    asked = db.rows("orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("cutoff"))
    features = only(db, "customer", "count__orders", "max__orders__o_cents", "std__orders__o_cents", "min__orders__sum__lineitem__l_quantity")
    found = synthesize_many(db, "customer", asked, features)
    brute = (
        asked.distinct()
        .join(db.rows("orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", "o_orderdate", "o_cents"), "entity_id")
        .where("o_orderdate <= cutoff")
    )
    lines = db.rows("lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    per_order = (
        brute.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") <= F.col("cutoff")), "left")
        .groupBy("entity_id", "cutoff", "o_orderkey", "o_cents")
        .agg(F.coalesce(F.sum("l_quantity"), F.lit(0)).alias("q"))
    )
    expected = per_order.groupBy("entity_id", "cutoff").agg(
        F.count(F.lit(1)).alias("count__orders"),
        F.max("o_cents").alias("max__orders__o_cents"),
        F.stddev_samp("o_cents").alias("std__orders__o_cents"),
        F.min("q").alias("min__orders__sum__lineitem__l_quantity"),
    )
    assert_same(found, expected)


def test_large_mean_keeps_its_spread(frame):
    times = [at(f"2024-01-{d:02d}") for d in range(1, 11)]
    db = declare(
        {
            "box": frame("box_id int", (1,)),
            "item": frame("item_id int, box_id int, seen timestamp_ntz, weight double", *[(i, 1, t, 1e9 + i % 3) for i, t in enumerate(times)]),
        },
        {"box": "box_id", "item": "item_id"},
        [("item", "box_id", "box")],
    )
    features = only(db, "box", "std__item__weight")
    expected = X.union_all([X.synthesize_at(db, "box", c, features) for c in times])
    asked = frame("entity_id int, cutoff timestamp_ntz", *[(1, t) for t in times])
    assert_same(synthesize_many(db, "box", asked, features), expected)


@pytest.mark.parametrize("n", [1, 2, 256, 257, 5000])
def test_any_number_of_anchors(frame, n):
    start = at("2024-01-01")
    anchors = [start + dt.timedelta(hours=7 * i) for i in range(n)]
    times = [start + dt.timedelta(hours=h) for h in (-3, 0, 0, 1, 7 * (n // 2), 7 * (n - 1), 7 * n)]
    db = declare(
        {"box": frame("box_id int", (1,), (2,)), "item": frame("item_id int, box_id int, seen timestamp_ntz, weight int", *[(i, 1, t, 1 << i) for i, t in enumerate(times)], (99, 1, None, 1 << 20))},
        {"box": "box_id", "item": "item_id"},
        [("item", "box_id", "box")],
    )
    found = {(r.entity_id, r.cutoff): (r[2], r[3]) for r in synthesize_many(db, "box", anchors, only(db, "box", "count__item", "sum__item__weight")).collect()}
    assert len(found) == 2 * n
    for a in anchors:
        seen = [1 << i for i, t in enumerate(times) if t <= a]
        assert found[1, a] == (len(seen), sum(seen)) and found[2, a] == (0, 0)
    task = PredictiveTask("box", "SUM", "item", FutureWindow(0, 10, "days"), "weight")
    labels = {(r.entity_id, r.cutoff): r.target_value for r in L.build_labels_many(db, task, anchors).collect()}
    for a in anchors:
        assert labels[1, a] == sum(1 << i for i, t in enumerate(times) if a < t <= a + dt.timedelta(days=10))


def test_no_size_is_probed_before_a_scan(db, spark):
    """Building the plan of flat features with a cutoff per row runs no job but the one for the last cutoff."""
    asked = db.rows("orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("cutoff"))
    features = only(db, "customer", "count__orders", "std__orders__o_cents", "sum__orders_lineitem__l_quantity")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        synthesize_many(db, "customer", asked, features)
        assert len(tracker.getJobIdsForGroup("planning")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_interval_cover(frame, spark):
    levels, end = 4, 16
    spans = [(a, b) for a in range(end) for b in range(a + 1, end + 1)]
    frame = spark.createDataFrame(spans, "a int, b int")
    covers = {(r.a, r.b): r.nodes for r in frame.selectExpr("a", "b", f"{cover('a', 'b', levels)} AS nodes").collect()}
    above = {r.id: set(r.nodes) for r in spark.range(end).selectExpr("id", f"{ancestors('CAST(id AS INT)', levels)} AS nodes").collect()}
    for (a, b), nodes in covers.items():
        assert len(nodes) <= 2 * levels + 1
        for slot in range(end):
            assert len(above[slot] & set(nodes)) == (1 if a <= slot < b else 0)


def deep(db, entity, depth, *endings):
    """Features of stacked or looked-up aggregates whose names end like one of ``endings``."""
    return [f for f in plan.enumerate_features(db.graph, entity, depth) if f.name in endings]


def same_in_all_forms(db, entity, features, anchors):
    expected = X.union_all([X.synthesize_at(db, entity, a, features) for a in anchors]).cache()
    assert_same(synthesize_many(db, entity, anchors, features), expected)
    assert_same(synthesize_many(db, entity, expected.select("entity_id", "cutoff"), features), expected)


THREE = (
    "mean__customer__max__orders__count__lineitem",
    "std__customer__sum__orders__mean__lineitem__l_quantity",
    "min__customer__mean__orders__num_unique__lineitem__l_returnflag",
    "max__customer_orders__mean__lineitem__l_quantity",
)


def test_three_levels_in_all_forms(db):
    features = deep(db, "nation", 3, *THREE)
    assert len(features) == 4
    same_in_all_forms(db, "nation", features, [at("1998-06-01"), at("1999-01-01"), at("2000-01-01")])


def test_aggregates_of_looked_up_aggregates_in_all_forms(db):
    names = ("mean__orders_lineitem__part__count__lineitem", "max__orders__mean__lineitem__part__count__lineitem", "sum__orders__max__lineitem__supplier__std__lineitem__l_quantity")
    features = deep(db, "customer", 4, *names)
    assert len(features) == 3
    same_in_all_forms(db, "customer", features, [at("1998-06-01"), at("2000-01-01")])


def test_three_levels_on_edge_rows(frame, small):
    checks = frame(
        "check_id int, return_id int, checked timestamp_ntz, points double",
        (1, 100, at("2024-02-21"), 3.0), (2, 100, at("2024-03-01"), 5.0), (3, 101, None, 9.0),
        (4, 102, at("2024-03-02"), 4.0), (5, 103, at("2024-03-12"), 1.0), (6, 101, at("2024-01-01"), 2.0), (7, None, at("2024-01-01"), 7.0),
    )
    db = declare(
        {**small.tables, "checks": checks},
        {"customers": "customer_id", "purchases": "purchase_id", "returns": "return_id", "regions": "region_id", "checks": "check_id"},
        [("customers", "region_id", "regions"), ("purchases", "customer_id", "customers"), ("returns", "purchase_id", "purchases"), ("checks", "return_id", "returns")],
    )
    wanted = deep(db, "customers", 3, "std__purchases__mean__returns__count__checks", "mean__purchases__count__returns")
    assert len(wanted) == 2
    same_in_all_forms(db, "customers", wanted, [at("2024-02-22"), at("2024-03-02"), at("2024-04-01")])


def test_uneven_cutoffs_three_levels_deep_see_no_future(db):
    features = deep(db, "nation", 3, *THREE[:2])
    asked = db.rows("customer").join(db.rows("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_nationkey").agg(F.min("o_orderdate").alias("cutoff"))
    asked = asked.select(F.col("c_nationkey").alias("entity_id"), "cutoff").distinct()
    found = synthesize_many(db, "nation", asked, features).cache()
    assert found.count() == asked.count()
    last = asked.orderBy("cutoff", "entity_id").limit(6)
    edge = last.agg(F.max("cutoff")).first()[0]
    early = found.join(last, ["entity_id", "cutoff"], "left_semi")
    assert_same(synthesize_many(truncated(db, edge), "nation", last, features), early)
    for row in last.collect():
        single = X.synthesize_at(db, "nation", row["cutoff"], features).where(F.col("entity_id") == row["entity_id"])
        assert_same(single, early.where((F.col("entity_id") == row["entity_id"]) & (F.col("cutoff") == ntz(row["cutoff"]))))


def test_one_scan_a_table_and_states_below_the_join(spark, tmp_path, db):
    names = ("customer", "orders", "lineitem")
    for name in names:
        db.rows(name).write.parquet(f"{tmp_path}/{name}")
    stored = db.with_tables({n: spark.read.parquet(f"{tmp_path}/{n}") for n in names})
    lines = ("count__orders_lineitem", "std__orders_lineitem__l_quantity", "num_unique__orders_lineitem__l_returnflag", "max__orders__sum__lineitem__l_quantity", "sum__orders__num_unique__lineitem__l_returnflag")
    features = only(stored, "customer", *lines)
    opened = []
    original = X.visible
    spy = lambda d, table, cutoff: opened.append(table) or original(d, table, cutoff)
    X.visible, before = spy, X.visible
    try:
        found = X.synthesize_at(stored, "customer", at("2000-01-01"), features)
    finally:
        X.visible = before
    assert opened.count("lineitem") == 1
    plan = X.synthesize_at(stored, "customer", at("2000-01-01"), only(stored, "customer", "sum__orders_lineitem__l_quantity"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    lines_at = text.index("l_quantity", text.rindex("Aggregate ["))
    assert text.count("Aggregate [") == 2 and text.rindex("Aggregate [") > text.rindex("Join Inner") and lines_at > 0
    slow = X.union_all([found.select("entity_id", "cutoff", *lines)])
    raw = db.rows("lineitem").join(db.rows("orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderdate <= TIMESTAMP_NTZ'2000-01-01' AND l_shipdate <= TIMESTAMP_NTZ'2000-01-01'")
    brute = raw.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count(F.lit(1)).alias(lines[0]), F.stddev_samp("l_quantity").alias(lines[1]), F.count_distinct("l_returnflag").alias(lines[2]))
    met = slow.join(brute.select("entity_id"), "entity_id", "left_semi").select("entity_id", *lines[:3])
    assert_same(met, brute, keys=["entity_id"])


def test_deviation_over_a_path_keeps_its_digits(frame):
    """A mean of a billion with a spread of one, merged over two joins."""
    rows = [(i, i % 7, 1e9 + (i * 5) % 4) for i in range(70)]
    db = declare(
        {"box": frame("box_id int", (1,), (2,)), "tray": frame("tray_id int, box_id int", *[(t, 1 + t % 2) for t in range(7)]), "item": frame("item_id int, tray_id int, weight double", *rows)},
        {"box": "box_id", "tray": "tray_id", "item": "item_id"},
        [("tray", "box_id", "box"), ("item", "tray_id", "tray")],
    )
    found = {r.entity_id: r[2] for r in X.synthesize_at(db, "box", at("2024-01-01"), only(db, "box", "std__tray_item__weight")).collect()}
    for box in (1, 2):
        values = [w - 1e9 for _, t, w in rows if 1 + t % 2 == box]
        mean = sum(values) / len(values)
        assert found[box] == pytest.approx((sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5, rel=1e-6)


def test_lineage(small, spark):
    features = plan.enumerate_features(small.graph, "customers", 2)
    rows = {r.feature: r for r in plan.lineage(spark, features).collect()}
    deep = rows["mean__purchases__count__returns"]
    assert deep.path == ["customers", "purchases", "returns"] and deep.agg == "MEAN" and deep.depth == 2
    assert deep.definition == "MEAN(purchases.COUNT(returns))"
    assert rows["regions__region"].definition == "regions.region" and not rows["regions__region"].entity_only
    assert rows["balance"].entity_only and rows["sum__purchases__amount"].column == "amount"
    assert rows["sum__purchases__amount"].readable.startswith("SUM over purchases")


def test_align_and_conform(frame):
    features = frame("entity_id int, cutoff timestamp_ntz, a double", (1, ANCHOR, 1.0), (2, ANCHOR, 2.0))
    labels = frame("entity_id int, cutoff timestamp_ntz, label int", (2, ANCHOR, 1), (3, ANCHOR, 0))
    assert rows_of(X.align(features, labels), "entity_id", "a", "label") == [(2, 2.0, 1)]
    shaped = X.conform(features, ["b", "a"])
    assert shaped.columns == ["entity_id", "cutoff", "b", "a"]
    assert rows_of(shaped, "b", "a") == [(None, 1.0), (None, 2.0)]


def test_surrogate_key_tells_equal_rows_apart(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 6).selectExpr("id % 3 AS a", "IF(id % 2 = 0, NULL, 'x|1:') AS b", "X'ff' AS c")
    keyed = X.surrogate_key(rows)
    assert keyed.columns == ["a", "b", "c", "row_key"]
    found = sorted((r.row_key, r.a, r.b) for r in keyed.collect())
    assert len({k for k, *_ in found}) == 300
    monkeypatch.setattr(X, "NUMBERED", 7)  # numbers dealt out in blocks, rows in any order and split
    for again in (rows.repartition(2), rows.orderBy("b", "a"), rows.repartition(11, "a")):
        assert sorted((r.row_key, r.a, r.b) for r in X.surrogate_key(again).collect()) == found
    assert X.surrogate_key(rows.limit(0)).count() == 0


def test_running_merge_shuffles_its_rows_once(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS g", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS at", "id AS n", "id % 2 AS ask")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = running_merge(rows, [State("add", "n")], "g", ["at", "ask"], "at")
        plan_text = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan_text
    found = {(r.g, r.at): r.n for r in merged.collect()}
    assert found == {
        (i % 7, at("2024-01-01") + dt.timedelta(hours=i)): sum(range(i % 7, i + 1, 7)) for i in range(1000)
    }


def test_chains_over_the_same_lookup_ask_the_parent_once(db, monkeypatch):
    pick = Pick(db)
    sold = pick.lookup(pick.part, pick.agg("COUNT", [pick.part]))
    features = [pick.agg("SUM", [pick.orders, pick.lines], sold), pick.agg("MAX", [pick.orders], pick.agg("SUM", [pick.lines], sold))]
    asked = db.rows("orders").selectExpr("o_custkey AS entity_id", "o_orderdate AS cutoff")
    names, real = [], cutoffs.written
    monkeypatch.setattr(cutoffs, "written", lambda frame, name: names.append(name) or real(frame, name))
    both = synthesize_many(db, "customer", asked, features)
    assert names.count("asked-parents") == 1
    for f in features:
        assert_same(synthesize_many(db, "customer", asked, [f]), both.select("entity_id", "cutoff", f.name))


def test_surrogate_key_regroups_only_rows_with_an_equal(spark, monkeypatch):
    rows = spark.range(0, 200, 1, 4).selectExpr("IF(id < 190, id, 7) AS a")
    counted, real = [], X.written
    monkeypatch.setattr(X, "written", lambda frame, name: counted.append((name, real(frame, name))) or counted[-1][1])
    keys = [r.row_key for r in X.surrogate_key(rows).collect()]
    assert len(set(keys)) == 200 and sum(k.endswith("-1") for k in keys) == 190
    assert [(n, f.count()) for n, f in counted] == [("shared-hashes", 1), ("row-counts", 1)]


def test_categories_are_no_wide_entries(db):
    """The entry of a category carries no numbers, also behind a join and below a stack."""
    anchors = [at("1999-01-01"), at("2000-01-01")]
    names = ("num_unique__orders_lineitem__l_returnflag", "sum__orders_lineitem__l_quantity", "std__orders__num_unique__lineitem__l_returnflag", "max__orders__sum__lineitem__l_quantity")
    features = deep(db, "customer", 2, *names)
    assert len(features) == 4
    made = synthesize_many(db, "customer", anchors, features)
    generated = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in line and "which" in line]
    assert generated and not any("-1" in line for line in generated)  # no entry for the numbers
    same_in_all_forms(db, "customer", features, anchors)


def test_deviations_share_the_sum_and_count_of_other_functions(frame):
    rows = frame("k int, v double", (1, 1e9), (1, 1e9 + 2), (2, None))
    made = rows.groupBy("k").agg(*[F.expr(s) for s in ("sum(v) AS s", "count(v) AS n", *moments_of("v", "m"))])
    plan_text = made._jdf.queryExecution().executedPlan().toString()
    assert "avg(" not in plan_text and plan_text.count("partial_sum(") == plan_text.count("partial_count(") == 1
    assert {tuple(r) for r in made.select("k", "m_n", "m_mu", "m_m2").collect()} == {(1, 2, 1e9 + 1, 2.0), (2, 0, None, None)}


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_moments_before_few_and_many(frame, n):
    moments = [at(f"2024-01-{d:02d}") for d in range(1, n + 1)]
    times = [None, dt.datetime(2023, 12, 31), *moments, at("2024-01-01") + dt.timedelta(hours=5), at("2024-02-01")]
    sql = moments_before("t", moments)
    assert ("aggregate(" in sql) == (n > 8)  # a lambda for each row only where the list is long
    found = frame("i int, t timestamp_ntz", *enumerate(times)).selectExpr("i", f"{sql} AS n").collect()
    assert {r.i: r.n for r in found} == {i: None if t is None else sum(m < t for m in moments) for i, t in enumerate(times)}


def test_features_at_cutoffs_leave_no_scratch_but_their_values(small, spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    asked = small.rows("customers").selectExpr("customer_id AS entity_id", "timestamp_ntz'2024-03-01' AS cutoff")
    found = synthesize_many(small, "customers", asked, max_depth=3)
    made = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before if p.is_dir())
    assert found.count() > 0 and set(made) == {"values"}


def test_written_tables_give_their_shuffles_back(spark):
    import time

    from relpredict.functions.storage import cleared, keep, release, written

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with cleared(spark) as kept:
        inner = written(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count(), "inner")
        kept.append(written(inner.groupBy(F.col("count").alias("size")).count(), "outer"))
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and kept[0].count() == 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    from pathlib import Path

    assert not Path(inner._written_to).exists()
    again = keep(kept[0])
    release(again)
    assert not Path(again._written_to).exists()
