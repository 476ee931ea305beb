import pytest
from conftest import at, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from relpredict.operators import graph as G


def test_nodes_and_edges(small):
    nodes = {r.node_type: r["count"] for r in G.graph_nodes(small).groupBy("node_type").count().collect()}
    assert nodes == {"customers": 5, "purchases": 9, "returns": 4, "regions": 3}
    edges = {r.edge_type: r["count"] for r in G.graph_edges(small).groupBy("edge_type").count().collect()}
    assert edges["customers.region_id"] == edges["rev_customers.region_id"] == 4  # one is unknown
    assert edges["purchases.customer_id"] == 9


def test_edges_of_keyless_tables_meet_their_nodes(db):
    nodes = G.graph_nodes(db).where("node_type = 'lineitem'").select("node_id")
    ends = G.graph_edges(db).where("edge_type = 'lineitem.l_orderkey'").select(F.col("from_id").alias("node_id"))
    assert nodes.distinct().count() == nodes.count() == ends.count()
    assert nodes.exceptAll(ends).count() == 0


def test_text_columns_stay_out(db):
    assert G.node_features(db, "customer").columns == ["node_id", "time", "c_cents", "c_mktsegment"]


def seeds(db):
    return db.rows("orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("seed_time"))


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """With few ranges, and with as many as the shuffle has partitions, some of them cut inside a node."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_recent_children_equal_brute_force(db, ranges):
    found = G.temporal_neighbors(db, "customer", seeds(db), (3,))
    found = found.where("edge_type = 'rev_orders.o_custkey'").select("seed_id", "seed_time", "node_id", "time")
    order = Window.partitionBy("entity_id", "seed_time").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    pairs = seeds(db).distinct().join(db.rows("orders"), F.col("entity_id") == F.col("o_custkey"))
    brute = (
        pairs.where("o_orderdate <= seed_time")
        .withColumn("place", F.row_number().over(order))
        .where("place <= 3")
        .select(F.col("entity_id").cast("string").alias("seed_id"), "seed_time", F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_orderdate").alias("time"))
    )
    assert rows_of(found, *brute.columns) == rows_of(brute, *brute.columns)


def test_two_hops_never_look_ahead(small, frame):
    start = frame("entity_id bigint, seed_time timestamp_ntz", (1, at("2024-03-10")), (2, at("2024-02-04")))
    found = G.temporal_neighbors(small, "customers", start, (10, 10))
    assert found.where("time > seed_time").count() == 0
    seen = set(rows_of(found, "seed_id", "hop", "node_type", "node_id"))
    assert {("1", 1, "purchases", "10"), ("1", 1, "purchases", "11"), ("1", 2, "returns", "100"), ("1", 2, "returns", "103")} <= seen
    assert ("2", 1, "purchases", "14") in seen and ("2", 2, "returns", "101") not in seen
    assert ("1", 1, "regions", "1") in seen
    ages = {(r.seed_id, r.node_id): r.age_seconds for r in found.where("hop = 1 AND node_type = 'purchases'").collect()}
    assert ages["1", "10"] == 9 * 86400 and ages["2", "14"] == 3 * 86400


def test_truncation_changes_nothing(db):
    moment = at("1999-06-01")
    start = db.rows("customer").select(F.col("c_custkey").alias("entity_id"), F.lit(moment).cast("timestamp_ntz").alias("seed_time"))
    cut = db.with_tables({"orders": db.rows("orders").where(F.col("o_orderdate") <= F.lit(moment).cast("timestamp_ntz"))})
    a, b = (G.temporal_neighbors(d, "customer", start, (5,)) for d in (db, cut))
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_uniform_draws_are_distinct_visible_and_repeatable(db):
    a = G.temporal_neighbors(db, "customer", seeds(db), (4,), mode="uniform", random_seed=3)
    a = a.where("edge_type = 'rev_orders.o_custkey'")
    assert a.where("time > seed_time").count() == 0
    per = a.groupBy("seed_id", "seed_time").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("d"))
    visible = (
        seeds(db).distinct().join(db.rows("orders"), F.col("entity_id") == F.col("o_custkey")).where("o_orderdate <= seed_time")
        .groupBy(F.col("entity_id").cast("string").alias("seed_id"), "seed_time").agg(F.count(F.lit(1)).alias("all"))
    )
    assert per.join(visible, ["seed_id", "seed_time"]).where("n <> d OR n <> least(all, 4)").count() == 0
    b = G.temporal_neighbors(db, "customer", seeds(db), (4,), mode="uniform", random_seed=3)
    assert rows_of(a, "seed_id", "seed_time", "node_id") == rows_of(b.where("edge_type = 'rev_orders.o_custkey'"), "seed_id", "seed_time", "node_id")
    recent = G.temporal_neighbors(db, "customer", seeds(db), (4,)).where("edge_type = 'rev_orders.o_custkey'")
    assert rows_of(a, "seed_id", "seed_time", "node_id") != rows_of(recent, "seed_id", "seed_time", "node_id")
    with pytest.raises(ValueError):
        G.temporal_neighbors(db, "customer", seeds(db), (4,), mode="best")


def test_crowded_moment(frame, spark, ranges):
    """Many children of one node at one moment: the recent ones are still the largest keys, and draws reach all."""
    from relpredict.schema import declare

    kids = spark.range(500).selectExpr("id AS kid_id", "1 AS hub_id", "TIMESTAMP_NTZ'2024-01-01' AS born")
    db = declare({"hub": frame("hub_id int", (1,)), "kid": kids}, {"hub": "hub_id", "kid": "kid_id"}, [("kid", "hub_id", "hub")])
    start = frame("entity_id int, seed_time timestamp_ntz", (1, at("2024-01-01")))
    found = G.temporal_neighbors(db, "hub", start, (3,))
    assert sorted(r.node_id for r in found.collect()) == ["497", "498", "499"]
    drawn = sorted(int(r.node_id) for r in G.temporal_neighbors(db, "hub", start, (5,), mode="uniform").collect())
    assert [d // 100 for d in drawn] == [0, 1, 2, 3, 4]


def test_scans_grow_with_hops_not_with_paths(db):
    start = seeds(db)
    scans = []
    for hops in (1, 2, 3):
        plan = G.temporal_neighbors(db, "customer", start, (2,) * hops)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation ["))
    assert scans == [1, 2, 3]


def test_all_tables_are_in_the_graph_and_checked():
    from catalog import graph
    from catalog.common import SHOP

    assert set(graph.QUERIES) == set(graph.ORACLES)
    assert all(f"'{t}' AS node_type" in graph.ORACLES["graph_nodes"] for t in SHOP)


def test_packed_ids_are_short_and_sort_as_keys_do(db, frame):
    ids = G.PackedIds(db, "recent")
    numbers = frame("id bigint", *[(n,) for n in (-(1 << 63), -5, -1, 0, 7, 10, 1 << 40, (1 << 63) - 1)])
    packed = numbers.selectExpr("id", f"{ids.packed('orders', 'CAST(id AS STRING)', 0)} AS b", "'orders' AS t")
    found = packed.orderBy("b").selectExpr("id", f"{ids.text('t', 'b')} AS text", "length(b) AS n").collect()
    assert [r.id for r in found] == sorted(r.id for r in found) and all(r.text == str(r.id) and r.n == 8 for r in found)
    links = [k for k in db.graph.links if k.child_column == "l_orderkey"]
    for mode in ("recent", "uniform"):
        adjacent = G._adjacent(db, links, mode, 3)
        assert adjacent.columns == ["link", "parent_type", "parent_id", "child_type", "child", "at"]
        assert adjacent.agg(F.max(F.length("child"))).first()[0] <= 32 + len("-10") + 16
        keyed, key = G._keyed(db, "lineitem")
        text = G.PackedIds(db, mode).text("child_type", "child")
        assert rows_of(adjacent.selectExpr(f"{text} AS id"), "id") == rows_of(keyed.select(key), key)


def test_registered_neighbors_are_not_cut(monkeypatch, spark, frame):
    """Six orders of a customer and five lines of the last one: all are there, hop by hop."""
    from catalog import graph as queries
    from relpredict.schema import declare

    tables = {
        "customer": frame("c_custkey long", (1,), (2,)),
        "orders": frame("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", *[(i, 1 + i // 7, at(f"2024-01-0{i}")) for i in range(1, 8)]),
        "lineitem": frame("row_key long, l_orderkey long, l_shipdate timestamp_ntz", *[(i, 6, at("2024-01-02")) for i in range(5)]),
    }
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "row_key"}
    own = declare(tables, keys, [("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders")])
    monkeypatch.setattr(queries, "shop", lambda spark, sf: own)
    found = queries.QUERIES["temporal_neighbors"](spark, "").where("seed_id = '1'").groupBy("hop", "edge_type").count().collect()
    found = {(r["hop"], r["edge_type"]): r["count"] for r in found}
    assert found == {(1, "rev_orders.o_custkey"): 6, (2, "rev_lineitem.l_orderkey"): 5, (2, "orders.o_custkey"): 6}
