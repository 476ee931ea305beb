"""The provided tables as a declared database, and SQL pieces shared by the checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpredict.schema import Database, declare
from relpredict.sources.tables import load_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
SHOP = "region nation customer supplier part orders lineitem events".split()

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
}
LINKS = [
    ("nation", "n_regionkey", "region"),
    ("customer", "c_nationkey", "nation"),
    ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"),
    ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"),
    ("events", "user_id", "customer"),
]
TEXT = ["customer.c_name", "supplier.s_name", "part.p_name", "events.props"]

# Amounts with two decimals enter as whole hundredths. Integer sums are exact in any order, so
# sums and means do not depend on how the rows were partitioned.
HUNDREDTHS = {
    "customer": {"c_acctbal": "c_cents"},
    "supplier": {"s_acctbal": "s_cents"},
    "part": {"p_retailprice": "p_cents"},
    "orders": {"o_totalprice": "o_cents"},
    "lineitem": {"l_extendedprice": "l_cents", "l_discount": "l_discount_pct", "l_tax": "l_tax_pct"},
    "events": {"value": "value_cents"},
}

ANCHOR = dt.datetime(2000, 1, 1)
ANCHORS = [dt.datetime(1999, 1, 1), dt.datetime(2000, 1, 1), dt.datetime(2000, 7, 1)]
CUT = "TIMESTAMP '2000-01-01'"
CUTS = "(VALUES (TIMESTAMP '1999-01-01'), (TIMESTAMP '2000-01-01'), (TIMESTAMP '2000-07-01')) AS a(cutoff)"


_OPENED: dict[tuple[str, str, str], DataFrame] = {}
_SHOPS: dict[tuple[str, str], Database] = {}


def raw(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables as they are. Opening one reads its file footer, so that happens once per session."""
    app = spark.sparkContext.applicationId
    missing = [n for n in names if (app, sf_dir, n) not in _OPENED]
    _OPENED.update({(app, sf_dir, n): frame for n, frame in load_folder(spark, sf_dir, missing).items()})
    return {n: _OPENED[app, sf_dir, n] for n in names}


def shop(spark: SparkSession, sf_dir: str) -> Database:
    """The eight related tables with amounts in hundredths; only file footers are read here, once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHOPS:
        _SHOPS[key] = _declared_shop(spark, sf_dir)
    return _SHOPS[key]


def _declared_shop(spark: SparkSession, sf_dir: str) -> Database:
    tables = {}
    for name, frame in raw(spark, sf_dir, SHOP).items():
        exact = HUNDREDTHS.get(name, {})
        tables[name] = frame.select(
            *[
                F.round(F.col(c) * 100).cast("bigint").alias(exact[c]) if c in exact else F.col(c)
                for c in frame.columns
            ]
        )
    return declare(tables, KEYS, LINKS, text=TEXT)


def cents(column: str) -> str:
    return f"CAST(ROUND({column} * 100) AS BIGINT)"


def past(table: str, time: str, cut: str = CUT) -> str:
    return f"(SELECT * FROM {table} WHERE {time} <= {cut})"
