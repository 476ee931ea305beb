"""Point-in-time features at one cutoff, at several anchors and at a cutoff per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import ANCHOR, ANCHORS, CUT, CUTS, cents, past, raw, shop
from catalog.labels import CHURN
from relpredict.operators import features as X
from relpredict.operators.cutoffs import synthesize_many
from relpredict.plans import feature_plan as plan
from relpredict.plans.pipeline import training_set
from relpredict.schema import Database

O_CENTS, L_CENTS = cents("o_totalprice"), cents("l_extendedprice")


class Pick:
    """Short names for features of the customer table."""

    def __init__(self, db: Database):
        graph = db.graph
        self.graph = graph
        link = {(k.child, k.child_column): k for k in graph.links}
        self.nation, self.region = link["customer", "c_nationkey"], link["nation", "n_regionkey"]
        self.orders, self.lines = link["orders", "o_custkey"], link["lineitem", "l_orderkey"]
        self.part, self.events = link["lineitem", "l_partkey"], link["events", "user_id"]

    def own(self, table: str, column: str, numeric: bool = True) -> plan.Feature:
        return plan.own_feature(table, column, numeric)

    def agg(self, function: str, links, base=None) -> plan.Feature:
        return plan.aggregate_feature(self.graph, function, links, base)

    def over_orders(self, function: str, column: str | None = "o_cents", numeric: bool = True) -> plan.Feature:
        return self.agg(function, [self.orders], column and self.own("orders", column, numeric))

    def lookup(self, link, base) -> plan.Feature:
        return plan.lookup_feature(self.graph, link, base)


def _choose(pick: Pick) -> dict[str, list[plan.Feature]]:
    month = plan.transform_feature("orders", "MONTH", "o_orderdate")
    lines = [pick.orders, pick.lines]
    quantity = pick.own("lineitem", "l_quantity")
    per_order = [
        pick.agg("COUNT", [pick.lines]),
        pick.agg("SUM", [pick.lines], quantity),
        pick.agg("MEAN", [pick.lines], quantity),
        pick.agg("NUM_UNIQUE", [pick.lines], pick.own("lineitem", "l_returnflag", False)),
    ]
    retail = pick.lookup(pick.part, pick.own("part", "p_cents"))
    brand = pick.lookup(pick.part, pick.own("part", "p_brand", False))
    return {
        "pit_count": [pick.over_orders("COUNT", None)],
        "pit_sum": [pick.over_orders("SUM")],
        "pit_mean": [pick.over_orders("MEAN")],
        "pit_max": [pick.over_orders("MAX")],
        "pit_min": [pick.over_orders("MIN")],
        "pit_std": [pick.over_orders("STD")],
        "pit_num_unique": [
            pick.over_orders("NUM_UNIQUE", "o_orderpriority", False),
            pick.over_orders("NUM_UNIQUE", "o_orderstatus", False),
        ],
        "entity_direct_features": [pick.own("customer", "c_cents"), pick.own("customer", "c_mktsegment", False)],
        "parent_lookup": [
            pick.lookup(pick.nation, pick.own("nation", "n_name", False)),
            pick.lookup(pick.nation, pick.lookup(pick.region, pick.own("region", "r_name", False))),
        ],
        "pit_agg_over_lookup": [
            pick.agg("MEAN", lines, retail),
            pick.agg("MAX", lines, retail),
            pick.agg("NUM_UNIQUE", lines, brand),
        ],
        "pit_stacked": [
            pick.agg("SUM", [pick.orders], per_order[0]),
            pick.agg("MAX", [pick.orders], per_order[0]),
            pick.agg("MIN", [pick.orders], per_order[1]),
            pick.agg("MEAN", [pick.orders], per_order[1]),
            pick.agg("MAX", [pick.orders], per_order[2]),
            pick.agg("SUM", [pick.orders], per_order[3]),
            pick.agg("STD", [pick.orders], per_order[1]),
        ],
        "pit_two_hop": [
            pick.agg("COUNT", lines),
            pick.agg("SUM", lines, pick.own("lineitem", "l_cents")),
            pick.agg("MEAN", lines, quantity),
            pick.agg("NUM_UNIQUE", lines, pick.own("lineitem", "l_returnflag", False)),
        ],
        "pit_num_unique_month": [
            pick.agg("NUM_UNIQUE", [pick.orders], month),
            pick.agg("NUM_UNIQUE", [pick.orders], plan.transform_feature("orders", "WEEKDAY", "o_orderdate")),
        ],
    }


def _comparable(frame: DataFrame) -> DataFrame:
    """One type per kind of value: counts as bigint, deviations rounded to a hundredth."""
    out = []
    for name, kind in frame.dtypes:
        if name.startswith("std__"):
            out.append(F.round(name, 2).alias(name))
        elif kind == "int":
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return frame.select(*out)


def _single(name: str):
    def query(spark, sf):
        db = shop(spark, sf)
        return _comparable(X.synthesize_at(db, "customer", ANCHOR, _choose(Pick(db))[name]))

    return query


MANY = ("pit_count", "pit_sum", "pit_mean", "pit_max", "pit_min", "pit_std", "pit_num_unique", "pit_two_hop")


def _three_hop(spark, sf):
    """A region's orders and their amounts, over three links."""
    db = shop(spark, sf)
    pick = Pick(db)
    links = [pick.region, pick.nation, pick.orders]
    features = [pick.agg("COUNT", links), pick.agg("SUM", links, pick.own("orders", "o_cents"))]
    assert {f.name for f in features} <= {f.name for f in plan.enumerate_features(db.graph, "region", 1)}
    return _comparable(X.synthesize_at(db, "region", ANCHOR, features))


def _many(names, cutoffs):
    def query(spark, sf):
        db = shop(spark, sf)
        chosen = _choose(Pick(db))
        features = [f for n in names for f in chosen[n]]
        asked = ANCHORS if cutoffs is None else cutoffs(db)
        return _comparable(synthesize_many(db, "customer", asked, features))

    return query


def _own_order_times(db: Database) -> DataFrame:
    """A cutoff per row: the moment of every order of every customer."""
    return db.rows("orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("cutoff"))


def _first_order_times(db: Database) -> DataFrame:
    """A cutoff per row: for every nation the first order of each of its customers."""
    owners = db.rows("customer").select("c_custkey", F.col("c_nationkey").alias("entity_id"))
    first = db.rows("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("cutoff"))
    return first.join(owners, F.col("o_custkey") == F.col("c_custkey")).select("entity_id", "cutoff").distinct()


def _three_levels(spark, sf):
    """Aggregates of aggregates of aggregates, each nation at the first orders of its customers."""
    db = shop(spark, sf)
    pick = Pick(db)
    quantity = pick.own("lineitem", "l_quantity")
    per_order = [pick.agg("COUNT", [pick.lines]), pick.agg("SUM", [pick.lines], quantity), pick.agg("MEAN", [pick.lines], quantity)]
    per_customer = [
        pick.agg("MAX", [pick.orders], per_order[0]), pick.agg("MEAN", [pick.orders], per_order[1]),
        pick.agg("MIN", [pick.orders], per_order[2]),
    ]
    features = [
        pick.agg("SUM", [pick.nation], per_customer[0]), pick.agg("MAX", [pick.nation], per_customer[1]),
        pick.agg("STD", [pick.nation], per_customer[1]), pick.agg("MAX", [pick.nation], per_customer[2]),
        pick.agg("MAX", [pick.nation, pick.orders], per_order[1]),
    ]
    assert {f.name for f in features} <= {f.name for f in plan.enumerate_features(db.graph, "nation", 3)}
    return _comparable(synthesize_many(db, "nation", _first_order_times(db), features))


def _of_looked_up(spark, sf):
    """Aggregates over what is known of each line's part, every customer at the moments of all own orders."""
    db = shop(spark, sf)
    pick = Pick(db)
    sold = [pick.lookup(pick.part, pick.agg("COUNT", [pick.part])), pick.lookup(pick.part, pick.agg("MAX", [pick.part], pick.own("lineitem", "l_quantity")))]
    features = [
        pick.agg("SUM", [pick.orders, pick.lines], sold[0]), pick.agg("MIN", [pick.orders, pick.lines], sold[1]),
        pick.agg("MAX", [pick.orders], pick.agg("SUM", [pick.lines], sold[0])),
    ]
    return _comparable(synthesize_many(db, "customer", _own_order_times(db), features))


def _transforms(spark, sf):
    db = shop(spark, sf)
    features = [
        plan.transform_feature("orders", function, "o_orderdate") for function in plan.TRANSFORMS
    ]
    return _comparable(X.synthesize_at(db, "orders", ANCHOR, features))


def _training(spark, sf):
    db = shop(spark, sf)
    chosen = _choose(Pick(db))
    features = chosen["pit_count"] + chosen["pit_sum"] + chosen["entity_direct_features"]
    return _comparable(training_set(db, CHURN, [ANCHOR], features))


def _lineage(spark, sf):
    db = shop(spark, sf)
    table = plan.lineage(spark, plan.enumerate_features(db.graph, "customer", 2))
    sizes = [
        rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("source_rows"))
        for name, rows in db.tables.items()
    ]
    return table.withColumn("source", F.element_at("path", -1)).join(X.union_all(sizes), "source")


def _surrogate(spark, sf):
    return X.surrogate_key(raw(spark, sf, ["lineitem"])["lineitem"])


# -- checks ----------------------------------------------------------------------------------

ORDERS = past("orders", "o_orderdate")
LINES = past("lineitem", "l_shipdate")


def _customer_sql(events: str, *values: str) -> str:
    columns = ", ".join(values)
    return f"""WITH ev AS ({events})
SELECT c_custkey AS entity_id, {CUT} AS cutoff, {columns} FROM customer LEFT JOIN ev ON id = c_custkey"""


def _orders_sql(*aggregates: tuple[str, str, bool]) -> str:
    listed = ", ".join(f"{sql} AS {name}" for name, sql, _ in aggregates)
    values = [f"COALESCE({n}, 0) AS {n}" if zero else n for n, _, zero in aggregates]
    return _customer_sql(f"SELECT o_custkey AS id, {listed} FROM {ORDERS} GROUP BY 1", *values)


AGGREGATES = {
    "pit_count": [("count__orders", "COUNT(*)", True)],
    "pit_sum": [("sum__orders__o_cents", f"CAST(SUM({O_CENTS}) AS DOUBLE)", True)],
    "pit_mean": [("mean__orders__o_cents", f"CAST(SUM({O_CENTS}) AS DOUBLE) / COUNT(*)", False)],
    "pit_max": [("max__orders__o_cents", f"CAST(MAX({O_CENTS}) AS DOUBLE)", False)],
    "pit_min": [("min__orders__o_cents", f"CAST(MIN({O_CENTS}) AS DOUBLE)", False)],
    "pit_std": [("std__orders__o_cents", f"ROUND(STDDEV_SAMP({O_CENTS}), 2)", False)],
    "pit_num_unique": [
        ("num_unique__orders__o_orderpriority", "COUNT(DISTINCT o_orderpriority)", True),
        ("num_unique__orders__o_orderstatus", "COUNT(DISTINCT o_orderstatus)", True),
    ],
    "pit_num_unique_month": [
        ("num_unique__orders__month__o_orderdate", "COUNT(DISTINCT month(o_orderdate))", True),
        ("num_unique__orders__weekday__o_orderdate", "COUNT(DISTINCT isodow(o_orderdate))", True),
    ],
}
TWO_HOP = [
    ("count__orders_lineitem", "COUNT(*)", True),
    ("sum__orders_lineitem__l_cents", f"CAST(SUM({L_CENTS}) AS DOUBLE)", True),
    ("mean__orders_lineitem__l_quantity", "SUM(l_quantity) / COUNT(*)", False),
    ("num_unique__orders_lineitem__l_returnflag", "COUNT(DISTINCT l_returnflag)", True),
]


def _stacked_sql(cuts: str) -> str:
    """Every order's own line aggregates at the cutoff, then aggregates of those."""
    return f"""
WITH per AS (
  SELECT o_custkey AS id, o_orderkey, a.cutoff, COUNT(l_orderkey) AS n, COALESCE(SUM(l_quantity), 0) AS s,
         SUM(l_quantity) / NULLIF(COUNT(l_orderkey), 0) AS m, COUNT(DISTINCT l_returnflag) AS u
  FROM {cuts} JOIN orders ON o_orderdate <= a.cutoff
  LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= a.cutoff GROUP BY ALL),
ev AS (
  SELECT id, cutoff, SUM(n) AS sn, MAX(n) AS xn, MIN(s) AS ns, SUM(s) / COUNT(*) AS ms, MAX(m) AS xm,
         SUM(u) AS su, ROUND(STDDEV_SAMP(s), 2) AS ds FROM per GROUP BY ALL)
SELECT c_custkey AS entity_id, a.cutoff, CAST(COALESCE(sn, 0) AS DOUBLE) AS sum__orders__count__lineitem,
       CAST(xn AS DOUBLE) AS max__orders__count__lineitem, ns AS min__orders__sum__lineitem__l_quantity,
       ms AS mean__orders__sum__lineitem__l_quantity, xm AS max__orders__mean__lineitem__l_quantity,
       CAST(COALESCE(su, 0) AS DOUBLE) AS sum__orders__num_unique__lineitem__l_returnflag,
       ds AS std__orders__sum__lineitem__l_quantity
FROM customer CROSS JOIN {cuts} LEFT JOIN ev ON id = c_custkey AND ev.cutoff = a.cutoff"""


def _many_sql(cuts_cte: str, join: str) -> str:
    """All one-path functions by brute force: each cutoff row joined with its whole past."""
    flat = [a for n in MANY[:-1] for a in AGGREGATES[n]]
    one = ", ".join(f"{sql} AS {name}" for name, sql, _ in flat)
    two = ", ".join(f"{sql} AS {name}" for name, sql, _ in TWO_HOP)
    values = ", ".join(f"COALESCE({n}, 0) AS {n}" if zero else n for n, _, zero in [*flat, *TWO_HOP])
    return f"""
WITH asked AS ({cuts_cte}),
one AS (SELECT entity_id, cutoff, {one} FROM asked JOIN orders ON o_custkey = entity_id AND o_orderdate <= cutoff
        GROUP BY ALL),
two AS (SELECT entity_id, cutoff, {two} FROM asked JOIN orders ON o_custkey = entity_id AND o_orderdate <= cutoff
        JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= cutoff GROUP BY ALL)
SELECT entity_id, cutoff, {values} FROM asked LEFT JOIN one USING (entity_id, cutoff)
LEFT JOIN two USING (entity_id, cutoff) {join}"""


ONE_CUT = f"(VALUES ({CUT})) AS a(cutoff)"
EVERY_CUSTOMER = f"SELECT c_custkey AS entity_id, a.cutoff FROM customer CROSS JOIN {CUTS}"
EVERY_ORDER = "SELECT DISTINCT o_custkey AS entity_id, o_orderdate AS cutoff FROM orders"

SINGLE = [
    "pit_count", "pit_sum", "pit_mean", "pit_max", "pit_min", "pit_std", "pit_num_unique",
    "entity_direct_features", "parent_lookup", "pit_agg_over_lookup", "pit_stacked", "pit_two_hop",
    "pit_num_unique_month",
]

QUERIES = {name: _single(name) for name in SINGLE} | {
    "pit_transforms": _transforms,
    "pit_three_hop": _three_hop,
    "pit_features_multi_cutoff": _many(MANY, None),
    "pit_features_cutoff_per_row": _many(MANY, _own_order_times),
    "pit_stacked_multi_cutoff": _many(("pit_stacked",), None),
    "pit_stacked_depth3_cutoff_per_row": _three_levels,
    "pit_lookup_of_aggregates_cutoff_per_row": _of_looked_up,
    "pit_lookup_multi_cutoff": _many(("parent_lookup", "pit_agg_over_lookup", "entity_direct_features"), None),
    "feature_lineage": _lineage,
    "training_set": _training,
    "surrogate_key": _surrogate,
}

LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
    " l_returnflag l_linestatus l_shipdate"
).split()
LINE_TEXT = " || '|' || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in LINE_COLUMNS
)

_LOOKUP = f"""SELECT o_custkey AS id, CAST(SUM({cents('p_retailprice')}) AS DOUBLE) / COUNT(*) AS mean_p,
  CAST(MAX({cents('p_retailprice')}) AS DOUBLE) AS max_p, COUNT(DISTINCT p_brand) AS brands"""

ORACLES = {name: _orders_sql(*parts) for name, parts in AGGREGATES.items()} | {
    "pit_two_hop": _customer_sql(
        f"SELECT o_custkey AS id, {', '.join(f'{s} AS {n}' for n, s, _ in TWO_HOP)}"
        f" FROM {ORDERS} JOIN {LINES} ON l_orderkey = o_orderkey GROUP BY 1",
        *[f"COALESCE({n}, 0) AS {n}" if zero else n for n, _, zero in TWO_HOP],
    ),
    "pit_three_hop": f"""SELECT r_regionkey AS entity_id, {CUT} AS cutoff, COUNT(o_orderkey) AS count__nation_customer_orders,
        COALESCE(SUM({cents('o_totalprice')}), 0) AS sum__nation_customer_orders__o_cents
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
        LEFT JOIN {ORDERS} ON o_custkey = c_custkey GROUP BY 1, 2""",
    "pit_transforms": f"""SELECT o_orderkey AS entity_id, {CUT} AS cutoff, month(o_orderdate) AS month__o_orderdate,
        isodow(o_orderdate) - 1 AS weekday__o_orderdate FROM {ORDERS}""",
    "entity_direct_features": f"""SELECT c_custkey AS entity_id, {CUT} AS cutoff, {cents('c_acctbal')} AS c_cents,
        c_mktsegment FROM customer""",
    "parent_lookup": f"""SELECT c_custkey AS entity_id, {CUT} AS cutoff, n_name AS nation__n_name,
        r_name AS nation__region__r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "pit_agg_over_lookup": _customer_sql(
        f"{_LOOKUP} FROM {ORDERS} JOIN {LINES} ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1",
        "mean_p AS mean__orders_lineitem__part__p_cents",
        "max_p AS max__orders_lineitem__part__p_cents",
        "COALESCE(brands, 0) AS num_unique__orders_lineitem__part__p_brand",
    ),
    "pit_stacked": _stacked_sql(ONE_CUT),
    "pit_features_multi_cutoff": _many_sql(EVERY_CUSTOMER, ""),
    "pit_features_cutoff_per_row": _many_sql(EVERY_ORDER, ""),
    "pit_stacked_multi_cutoff": _stacked_sql(CUTS),
    "pit_stacked_depth3_cutoff_per_row": f"""
WITH asked AS (SELECT DISTINCT c_nationkey AS entity_id, cutoff FROM customer
  JOIN (SELECT o_custkey, MIN(o_orderdate) AS cutoff FROM orders GROUP BY 1) ON o_custkey = c_custkey),
per_order AS (
  SELECT entity_id, cutoff, c_custkey, o_orderkey, COUNT(l_orderkey) AS n, COALESCE(SUM(l_quantity), 0) AS s,
         SUM(l_quantity) / NULLIF(COUNT(l_orderkey), 0) AS m
  FROM asked JOIN customer ON c_nationkey = entity_id LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= cutoff
  LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= cutoff GROUP BY ALL),
per_customer AS (
  SELECT entity_id, cutoff, c_custkey, MAX(IF(o_orderkey IS NULL, NULL, n)) AS xn,
         SUM(IF(o_orderkey IS NULL, NULL, s)) / NULLIF(COUNT(o_orderkey), 0) AS ms, MIN(m) AS nm,
         MAX(IF(o_orderkey IS NULL, NULL, s)) AS xs
  FROM per_order GROUP BY ALL)
SELECT entity_id, cutoff, CAST(COALESCE(SUM(xn), 0) AS DOUBLE) AS sum__customer__max__orders__count__lineitem,
  MAX(ms) AS max__customer__mean__orders__sum__lineitem__l_quantity,
  ROUND(STDDEV_SAMP(ms), 2) AS std__customer__mean__orders__sum__lineitem__l_quantity,
  MAX(nm) AS max__customer__min__orders__mean__lineitem__l_quantity,
  MAX(xs) AS max__customer_orders__sum__lineitem__l_quantity
FROM per_customer GROUP BY ALL""",
    "pit_lookup_of_aggregates_cutoff_per_row": f"""
WITH asked AS ({EVERY_ORDER}),
seen AS (SELECT entity_id, cutoff, o_orderkey, l_partkey FROM asked
  JOIN orders ON o_custkey = entity_id AND o_orderdate <= cutoff JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= cutoff),
parts AS (SELECT p.l_partkey, p.cutoff, COUNT(*) AS n, MAX(l.l_quantity) AS x
  FROM (SELECT DISTINCT l_partkey, cutoff FROM seen) AS p JOIN lineitem AS l ON l.l_partkey = p.l_partkey AND l.l_shipdate <= p.cutoff GROUP BY ALL),
per_order AS (SELECT entity_id, cutoff, o_orderkey, SUM(n) AS sn, MIN(x) AS nx FROM seen JOIN parts USING (l_partkey, cutoff) GROUP BY ALL),
orders_at AS (SELECT entity_id, cutoff, o_orderkey, COALESCE(sn, 0) AS sn, nx FROM asked
  JOIN orders ON o_custkey = entity_id AND o_orderdate <= cutoff LEFT JOIN per_order USING (entity_id, cutoff, o_orderkey))
SELECT entity_id, cutoff, CAST(SUM(sn) AS DOUBLE) AS sum__orders_lineitem__part__count__lineitem,
  MIN(nx) AS min__orders_lineitem__part__max__lineitem__l_quantity,
  CAST(MAX(sn) AS DOUBLE) AS max__orders__sum__lineitem__part__count__lineitem
FROM orders_at GROUP BY ALL""",
    "pit_lookup_multi_cutoff": f"""
WITH ev AS ({_LOOKUP}, a.cutoff FROM {CUTS} JOIN orders ON o_orderdate <= a.cutoff
  JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate <= a.cutoff JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT c_custkey AS entity_id, a.cutoff, n_name AS nation__n_name, r_name AS nation__region__r_name,
  mean_p AS mean__orders_lineitem__part__p_cents, max_p AS max__orders_lineitem__part__p_cents,
  COALESCE(brands, 0) AS num_unique__orders_lineitem__part__p_brand, {cents('c_acctbal')} AS c_cents, c_mktsegment
FROM customer CROSS JOIN {CUTS} LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN ev ON id = c_custkey AND ev.cutoff = a.cutoff""",
    "surrogate_key": f"""
WITH hashed AS (SELECT *, sha256({LINE_TEXT}) AS h FROM lineitem)
SELECT * EXCLUDE (h), h || '-' || row_number() OVER (PARTITION BY h) AS row_key FROM hashed""",
    "training_set": f"""
WITH ev AS (SELECT o_custkey AS id, COUNT(*) AS n, CAST(SUM({O_CENTS}) AS DOUBLE) AS s FROM {ORDERS} GROUP BY 1),
fu AS (SELECT o_custkey AS id, COUNT(*) AS v FROM orders
       WHERE o_orderdate > {CUT} AND o_orderdate <= {CUT} + INTERVAL 90 DAY GROUP BY 1)
SELECT c_custkey AS entity_id, {CUT} AS cutoff, COALESCE(n, 0) AS count__orders,
       COALESCE(s, 0) AS sum__orders__o_cents, {cents('c_acctbal')} AS c_cents, c_mktsegment,
       COALESCE(v, 0) AS target_value, CAST(COALESCE(v, 0) = 0 AS BIGINT) AS label
FROM customer LEFT JOIN ev ON ev.id = c_custkey LEFT JOIN fu ON fu.id = c_custkey""",
}
