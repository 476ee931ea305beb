import pytest
from conftest import at, rows_of

from relpredict.operators import profile as P


@pytest.fixture(scope="module")
def profiled(tables, spark):
    return spark.createDataFrame(P.profile(tables).collect(), P.PROFILE_SCHEMA)


@pytest.fixture(scope="module")
def tables(frame):
    ntz = "timestamp_ntz"
    return {
        "categories": frame("category_id int, id int, title string", (1, 7, "x"), (2, 8, "y")),
        "orders": frame(
            f"ref_id int, orders_id int, category_id int, placed {ntz}, shipped {ntz}, note string, paid boolean",
            (5, 1, 1, at("2024-01-01"), None, "aa", True),
            (6, 2, 1, at("2024-01-02"), None, "bb", False),
            (7, 3, None, at("2024-01-03"), None, "aa", None),
            (8, 4, 2, at("2024-01-04"), None, "aa", True),
        ),
        "buses": frame("buse_id int, bus_id int, wheels int", (1, 1, 4), (2, 2, 6)),
        "lost": frame("owner_id int, tags array<string>, category_id int", (1, ["a"], 1), (1, None, 2)),
        "nothing": frame("id int, word string"),
    }


def test_counts(profiled):
    found = {(r.table_name, r.column_name): (r.n_rows, r.n_values, r.n_distinct) for r in profiled.collect()}
    assert found["orders", "category_id"] == (4, 3, 2)
    assert found["orders", "shipped"] == (4, 0, 0)
    assert found["orders", "paid"] == (4, 3, 2)
    assert found["lost", "tags"] == (2, 1, None)
    assert found["nothing", "word"] == (0, 0, 0)


def test_long_strings_differ_beyond_their_prefix(frame):
    same = "x" * 300
    table = {"t": frame("s string", (same + "a",), (same + "b",), (same + "a",))}
    assert P.profile(table).first().n_distinct == 2


def test_values_of_every_type_are_told_apart(spark):
    rows = spark.sql("""SELECT * FROM VALUES
      (0.0D, '', TIMESTAMP '2024-11-03 05:30:00Z', 1.10BD, true, X'00'), (-0.0D, 'a', TIMESTAMP '2024-11-03 06:30:00Z', 1.1BD, false, X'01'),
      (double('NaN'), repeat('x', 33), NULL, 1.2BD, NULL, X'01'), (double('NaN'), '#' || md5(repeat('x', 33)), NULL, 1.2BD, NULL, NULL) AS t(d, s, t, n, b, x)""")
    found = {r.column_name: (r.n_rows, r.n_values, r.n_distinct) for r in P.profile({"t": rows}).collect()}
    assert found == {"d": (4, 4, 2), "s": (4, 4, 4), "t": (4, 2, 2), "n": (4, 4, 2), "b": (4, 2, 2), "x": (4, 3, None)}


def test_one_scan_a_table_and_one_shuffle_of_values(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS a", "CAST(id AS STRING) AS b").write.parquet(f"{tmp_path}/t")
    spark.range(10).selectExpr("id", "id % 2 AS c").write.parquet(f"{tmp_path}/u")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in "tu"}
    plan = P.profile(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Aggregate [_id#") == 2


def test_primary_keys(profiled):
    keys = dict(rows_of(P.primary_keys(profiled), "table_name", "primary_key"))
    # named after the table (singular or plural, or plain id) first, otherwise the first candidate
    assert keys == {"categories": "category_id", "orders": "orders_id", "buses": "bus_id", "lost": "category_id"}


def test_foreign_keys_go_to_the_first_owner(profiled):
    links = rows_of(P.foreign_keys(profiled), "child_table", "child_column", "parent_table", "parent_column")
    assert links == [("orders", "category_id", "categories", "category_id")]


def test_prefixes_can_be_stripped(db):
    profiled = P.profile({n: db.rows(n) for n in ("customer", "orders", "nation")})
    links = rows_of(P.foreign_keys(profiled, "(key|_id)$", "^[a-z]_"), "child_column", "parent_table")
    assert links == [("c_nationkey", "nation"), ("o_custkey", "customer")]


def test_roles(profiled):
    roles = {(r.table_name, r.column_name): (r.role, r.is_time_index) for r in P.column_roles(profiled).collect()}
    assert roles["orders", "placed"] == ("time", 1) and roles["orders", "shipped"] == ("time", 0)
    assert roles["orders", "note"] == ("categorical", 0)  # 2 of 4 distinct
    assert roles["orders", "ref_id"] == ("text", 0)  # an id that leads nowhere
    assert roles["orders", "category_id"] == ("fk", 0)
    assert roles["categories", "title"] == ("text", 0)
    assert roles["buses", "wheels"] == ("numeric", 0)
    assert roles["lost", "tags"] == ("text", 0)
    assert roles["nothing", "word"] == ("text", 0)


def test_shortlist_decides_like_the_exact_profile(tables, db, spark):
    for some, pattern in ((tables, P.ID_PATTERN), (db.tables, "(key|_id)$")):
        exact = spark.createDataFrame(P.profile(some).collect(), P.PROFILE_SCHEMA)
        short = P.shortlist_profile(some, pattern)
        for job in (P.primary_keys, P.foreign_keys, P.column_roles):
            columns = job(exact, pattern).columns
            assert rows_of(job(exact, pattern), *columns) == rows_of(job(short, pattern), *columns)


def test_discover(tables):
    for exact in (True, False):
        db = P.discover(tables, exact=exact)
        assert db.spec("orders").primary_key == "orders_id" and db.spec("orders").time_index == "placed"
        assert [str(link) for link in db.graph.links] == ["orders.category_id -> categories.category_id"]
        assert db.spec("lost").column("owner_id").role == "text"
    assert P.discover(tables, times={"orders": "shipped"}).spec("orders").time_index == "shipped"



def test_inclusion(small):
    found = {r.child_column: (r.child_table, r.n_values, r.n_orphans) for r in P.link_inclusion(small).collect()}
    assert found["customer_id"] == ("purchases", 9, 1)
    assert found["region_id"] == ("customers", 4, 0)
