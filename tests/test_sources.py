import pytest
from conftest import TESTDATA, rows_of
from pyspark.sql import functions as F

from relpredict.sources import tables as S


def test_postgres_options():
    source = S.JdbcSource(
        "jdbc:postgresql://host:5432/shop", "orders", user="reader", password="secret",
        partition_column="id", lower=0, upper=1000, partitions=16,
    )
    opts = source.options()
    assert opts["dbtable"] == "public.orders" and opts["driver"] == "org.postgresql.Driver"
    assert (opts["partitionColumn"], opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("id", "0", "1000", "16")
    assert "secret" not in repr(source)
    copy = S.copy_options(source)
    assert "partitionColumn" not in copy and copy["numPartitions"] == "16" and copy["batchsize"] == "10000"


def test_mysql_options():
    opts = S.JdbcSource("jdbc:mysql://host/shop", "orders").options()
    assert opts["dbtable"] == "orders" and "ANSI_QUOTES" in opts["sessionInitStatement"]
    assert "numPartitions" not in opts


def test_unreadable_sources(spark):
    with pytest.raises(S.SourceError):
        S.JdbcSource("jdbc:oracle://host", "t").options()
    with pytest.raises(S.SourceError):
        S.JdbcSource("jdbc:mysql://host/shop", "t", partition_column="id").options()
    with pytest.raises(S.SourceError):
        S.read_table(spark, "ftp://host/file")


def test_mixed_sources(spark, tmp_path, frame):
    frame("a int, b string", (1, "x"), (2, None)).write.option("header", True).csv(str(tmp_path / "t.csv"))
    frame("v int", (5,)).createOrReplaceTempView("known_view")
    found = S.load_tables(
        spark,
        {"b_view": "known_view", "a_csv": str(tmp_path / "t.csv"), "c_parquet": f"{TESTDATA}/nation.parquet", "d_frame": frame("x int", (1,))},
    )
    assert list(found) == ["a_csv", "b_view", "c_parquet", "d_frame"]
    assert rows_of(found["a_csv"], "a", "b") == [("1", "x"), ("2", None)]
    assert S.list_columns(found)[2] == ("b_view", "v", "int")
    counts = {r.table_name: r.n_rows for r in S.row_counts(found).collect()}
    assert counts == {"a_csv": 2, "b_view": 1, "c_parquet": 25, "d_frame": 1}


def test_normalise(spark):
    frame = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t, date'2024-01-02' AS d, true AS b, 1 AS n, timestamp_ntz'2024-01-03' AS z")
    out = S.normalise(frame)
    assert dict(out.dtypes) == {"t": "timestamp_ntz", "d": "timestamp_ntz", "b": "string", "n": "int", "z": "timestamp_ntz"}
    assert out.first().t.hour == 10


def test_parameterised_query(spark, frame):
    tables = {"things": frame("a int, b string", (1, "it's"), (2, "other"))}
    by_name = S.run_query(spark, tables, "SELECT a FROM {things} WHERE b = :word", {"word": "it's"})
    assert [r.a for r in by_name.collect()] == [1]
    assert [r.a for r in S.run_query(spark, tables, "SELECT a FROM {things} WHERE a > ? AND b <> '?'", [1]).collect()] == [2]


def test_prediction_sink(spark, tmp_path, frame):
    scores = frame("entity_id int, score double", (1, 0.25), (2, 0.5))
    S.write_predictions(scores, str(tmp_path / "p"))
    assert rows_of(spark.read.parquet(str(tmp_path / "p")), "entity_id", "score") == [(1, 0.25), (2, 0.5)]
    S.write_predictions(scores, str(tmp_path / "c"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).select(F.col("score").cast("double"))
    assert sorted(r.score for r in back.collect()) == [0.25, 0.5]


def test_a_folder_and_a_database_are_listed_and_loaded(spark, tmp_path, frame):
    frame("b int, a string", (1, "x"), (2, None)).write.parquet(str(tmp_path / "zoo.parquet"))
    frame("v int", (5,)).write.option("header", True).csv(str(tmp_path / "ape.csv"))
    (tmp_path / "notes.txt").write_text("no table")
    found = S.load_source(spark, str(tmp_path))
    assert list(found) == ["ape", "zoo"]
    listed = [(r.table_name, r.position, r.column_name, r.type, r.n_rows) for r in S.describe_source(found).orderBy("table_name", "position").collect()]
    assert listed == [("ape", 0, "v", "string", 1), ("zoo", 0, "b", "int", 2), ("zoo", 1, "a", "string", 2)]
    spark.sql("CREATE DATABASE listed_here")
    try:
        frame("k int", (1,)).write.saveAsTable("listed_here.two")
        frame("k int", (1,)).write.saveAsTable("listed_here.one")
        assert list(S.load_source(spark, "listed_here")) == ["one", "two"]
    finally:
        spark.sql("DROP DATABASE listed_here CASCADE")


@pytest.mark.parametrize(("url", "schema"), [("jdbc:postgresql://h/s", "'public'"), ("jdbc:mysql://h/s", "DATABASE()")])
def test_listing_and_slices_of_a_database(url, schema):
    source = S.JdbcSource(url, "", partition_column="id", lower=0, upper=1)
    listing = source.listing_options()
    assert listing["query"].endswith(f"table_schema = {schema}") and "ordinal_position" in listing["query"]
    assert "dbtable" not in listing and "partitionColumn" not in listing
    cut = S.sliced(S.JdbcSource(url, "t", partition_column="id"), -5, 10_000_004, 9_500_000)
    opts = cut.options()
    assert (opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("-5", "10000005", "10")
    assert S.sliced(cut, 7, 7, 0).options()["numPartitions"] == "1"
