import datetime as dt
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from catalog.common import shop as provided_shop  # noqa: E402
from relpredict.schema import declare  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.session.timeZone", "America/New_York")  # results must not depend on it
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame with an explicit schema."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


@pytest.fixture(scope="session")
def db(spark):
    """The provided tables at the smallest size."""
    return provided_shop(spark, TESTDATA)


@pytest.fixture(scope="session")
def small(spark):
    """Customers with a sign-up time, purchases on the edges of windows, returns, and a region."""
    ntz = "timestamp_ntz"
    customers = spark.createDataFrame(
        [
            (1, at("2024-01-01"), "red", 10.0, 1),
            (2, at("2024-01-10"), "blue", -5.0, 1),
            (3, None, "red", 7.5, 2),
            (4, at("2024-06-01"), "it's", 1.0, 2),
            (5, at("2024-01-02"), None, None, None),
        ],
        f"customer_id bigint, joined {ntz}, colour string, balance double, region_id int",
    )
    purchases = spark.createDataFrame(
        [
            (10, 1, at("2024-03-01 00:00:00"), 5.0, "a"),  # exactly at the anchor
            (11, 1, at("2024-03-01 00:00:01"), 7.0, "b"),
            (12, 1, at("2024-03-31 00:00:00"), -3.0, "a"),  # exactly 30 days later
            (13, 1, at("2024-03-31 00:00:01"), 100.0, "c"),
            (14, 2, at("2024-02-01"), 2.0, "a"),
            (15, 2, at("2024-02-02"), 4.0, None),
            (16, 3, at("2024-03-05"), 9.0, "b"),
            (17, 2, None, 50.0, "z"),
            (18, 99, at("2024-02-03"), 1.0, "a"),  # orphan
        ],
        f"purchase_id bigint, customer_id bigint, bought {ntz}, amount double, kind string",
    )
    returns = spark.createDataFrame(
        [
            (100, 10, at("2024-02-20")),  # before its purchase
            (101, 14, at("2024-02-05")),
            (102, 14, at("2024-03-20")),
            (103, 11, at("2024-03-10")),
        ],
        f"return_id bigint, purchase_id bigint, returned {ntz}",
    )
    regions = spark.createDataFrame([(1, "north"), (2, "south"), (3, "east")], "region_id int, region string")
    return declare(
        {"customers": customers, "purchases": purchases, "returns": returns, "regions": regions},
        {"customers": "customer_id", "purchases": "purchase_id", "returns": "return_id", "regions": "region_id"},
        [
            ("customers", "region_id", "regions"),
            ("purchases", "customer_id", "customers"),
            ("returns", "purchase_id", "purchases"),
        ],
    )


def rows_of(frame, *columns):
    """Sorted tuples, nulls as None."""
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def assert_same(left, right, keys=("entity_id", "cutoff"), tolerance=1e-7):
    """Equal frames up to float noise, null equal to null."""
    keys = list(keys)
    a = left.toPandas().sort_values(keys).reset_index(drop=True)
    b = right.toPandas().sort_values(keys).reset_index(drop=True)
    assert len(a) == len(b)
    assert sorted(a.columns) == sorted(b.columns)
    different = []
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) or pd.api.types.is_numeric_dtype(b[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            close = ((x - y).abs() <= tolerance * (1 + x.abs())) | (x.isna() & y.isna())
        else:
            x, y = a[c].astype(object), b[c].astype(object)
            close = (x == y) | (x.isna() & y.isna())
        if not close.all():
            different.append((c, a[~close].head(3), b[~close].head(3)))
    assert not different, different
