"""Graph export and temporal neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import KEYS, LINKS, SHOP, cents, shop
from relpredict.operators import graph as G
from relpredict.schema import Database

FANOUT = (4, 3)
# What the sampler takes by default, and so all that it is for: 64 neighbours of each link, two hops.
WHOLE_FANOUT = (64, 64)
DRAW_SEED = 7


def _last_orders(db: Database):
    """Seeds: every customer at the moment of the last order."""
    return db.rows("orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max("o_orderdate").alias("seed_time"))


def _neighbors(mode: str, random_seed: int = 0, fanout: tuple[int, ...] = FANOUT):
    def query(spark, sf):
        db = shop(spark, sf)
        found = G.temporal_neighbors(db, "customer", _last_orders(db), fanout, mode=mode, random_seed=random_seed)
        return found.withColumn("hop", F.col("hop").cast("bigint"))

    return query


QUERIES = {
    "graph_nodes": lambda spark, sf: G.graph_nodes(shop(spark, sf)),
    "graph_edges": lambda spark, sf: G.graph_edges(shop(spark, sf)),
    "graph_node_features": lambda spark, sf: G.node_features(shop(spark, sf), "orders"),
    "graph_node_features_keyless": lambda spark, sf: G.node_features(shop(spark, sf), "lineitem"),
    "temporal_neighbors": _neighbors("recent", fanout=WHOLE_FANOUT),
    "temporal_neighbors_keyless": _neighbors("recent"),
    "temporal_neighbors_uniform": _neighbors("uniform", DRAW_SEED),
}

TIMES = {"orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate"}

# ``lineitem`` with its content key: the digest of the row as ``shop`` has it, and a number among equal rows.
_LINE = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
    "l_quantity": "l_quantity", "l_cents": cents("l_extendedprice"), "l_discount_pct": cents("l_discount"),
    "l_tax_pct": cents("l_tax"), "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": "l_shipdate",
}
_LINE_TEXT = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _LINE)
KEYED_LINES = f"""keyed_lines AS (
  SELECT * EXCLUDE (h), h || '-' || row_number() OVER (PARTITION BY h) AS row_key
  FROM (SELECT *, sha256({_LINE_TEXT}) AS h FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _LINE.items())} FROM lineitem))
)"""


def _key(table: str) -> str:
    return KEYS.get(table, "row_key")


def _rows(table: str) -> str:
    return "keyed_lines" if table == "lineitem" else table


def _nodes_sql(tables: list[str] = SHOP) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS node_type, CAST({_key(t)} AS VARCHAR) AS node_id, CAST({TIMES.get(t, 'NULL')} AS TIMESTAMP) AS time FROM {_rows(t)}"
        for t in tables
    )


def _edges_sql(tables: list[str] = SHOP) -> str:
    parts = []
    for child, column, parent in LINKS:
        if child not in tables:
            continue
        own, other = f"CAST({_key(child)} AS VARCHAR)", f"CAST({column} AS VARCHAR)"
        parts.append(
            f"SELECT '{child}.{column}' AS edge_type, '{child}' AS from_type, {own} AS from_id,"
            f" '{parent}' AS to_type, {other} AS to_id FROM {_rows(child)} WHERE {column} IS NOT NULL"
        )
        parts.append(
            f"SELECT 'rev_{child}.{column}', '{parent}', {other}, '{child}', {own} FROM {_rows(child)} WHERE {column} IS NOT NULL"
        )
    return "\nUNION ALL ".join(parts)


def _drawn(hop: int, k: int, child: str, column: str, timeless: bool) -> str:
    """Whether a child is drawn, from its number among the ``seen`` ones: one of each of k equal parts."""
    if timeless:
        return f"number <= {k}"
    # the part of a number: the last one that begins before it
    part = f"list_max([p FOR p IN range(1, {k + 1}) IF (p - 1) * seen // {k} < number])"
    chance = (
        f"CAST('0x' || substr(md5(concat_ws('|', seed_id, CAST(epoch(seed_time) AS BIGINT), from_id, {part}, '{child}.{column}', '{DRAW_SEED + hop}')), 1, 15) AS BIGINT)"
    )
    first, size = f"(({part}) - 1) * seen // {k}", f"(({part}) * seen // {k} - (({part}) - 1) * seen // {k})"
    return f"seen <= {k} OR number = {first} + {chance} % {size} + 1"


def _steps_sql(hop: int, frontier: str, table: str, k: int, uniform: bool) -> list[str]:
    """All edges out of one node type, by ranking every visible neighbour of every seed."""
    steps = []
    for child, column, parent in LINKS:
        if parent == table:
            time, key = TIMES.get(child), f"c.{_key(child)}"
            visible = f"AND c.{time} <= f.seed_time" if time else ""
            stamp = f"c.{time}" if time else "CAST(NULL AS TIMESTAMP)"
            if uniform:
                order = f"c.{time}, {key}" if time else f"md5({key} || '|{DRAW_SEED}'), {key}"
                picked = _drawn(hop, k, child, column, time is None)
            else:
                order = (f"c.{time} DESC, " if time else "") + f"{key} DESC"
                picked = f"number <= {k}"
            steps.append(
                f"SELECT * EXCLUDE (number, seen) FROM (SELECT seed_id, seed_time, {hop} AS hop, 'rev_{child}.{column}' AS edge_type, '{table}' AS from_type,"
                f" node AS from_id, '{child}' AS node_type, {key} AS node_id, {stamp} AS time,"
                f" row_number() OVER (PARTITION BY seed_id, seed_time, node ORDER BY {order}) AS number,"
                f" count(*) OVER (PARTITION BY seed_id, seed_time, node) AS seen"
                f" FROM {frontier} f JOIN {_rows(child)} c ON c.{column} = f.node {visible}) WHERE {picked}"
            )
        if child == table:
            steps.append(
                f"SELECT seed_id, seed_time, {hop} AS hop, '{child}.{column}' AS edge_type, '{table}' AS from_type,"
                f" node AS from_id, '{parent}' AS node_type, p.{KEYS[parent]} AS node_id, CAST(NULL AS TIMESTAMP) AS time"
                f" FROM {frontier} f JOIN {_rows(child)} c ON c.{_key(child)} = f.node JOIN {parent} p ON p.{KEYS[parent]} = c.{column}"
            )
    return [f"({step})" for step in steps]


def _neighbors_sql(uniform: bool = False, fanout: tuple[int, ...] = FANOUT) -> str:
    first = " UNION ALL ".join(_steps_sql(1, "seeds", "customer", fanout[0], uniform))
    second = []
    for table in ("nation", "orders", "events"):
        frontier = (
            f"(SELECT DISTINCT seed_id, seed_time, node_id AS node FROM first_hop WHERE node_type = '{table}')"
        )
        second += _steps_sql(2, frontier, table, fanout[1], uniform)
    return f"""
WITH {KEYED_LINES},
seeds AS (SELECT o_custkey AS seed_id, MAX(o_orderdate) AS seed_time, o_custkey AS node FROM orders GROUP BY ALL),
first_hop AS ({first}),
found AS (SELECT * FROM first_hop UNION ALL {' UNION ALL '.join(second)})
SELECT CAST(seed_id AS VARCHAR) AS seed_id, seed_time, CAST(hop AS BIGINT) AS hop, edge_type, from_type,
       CAST(from_id AS VARCHAR) AS from_id, node_type, CAST(node_id AS VARCHAR) AS node_id, time,
       datediff('second', time, seed_time) AS age_seconds FROM found"""


ORACLES = {
    "graph_nodes": f"WITH {KEYED_LINES}\n{_nodes_sql()}",
    "graph_edges": f"WITH {KEYED_LINES}\n{_edges_sql()}",
    "graph_node_features": """SELECT CAST(o_orderkey AS VARCHAR) AS node_id, o_orderdate AS time, o_orderstatus,
        CAST(ROUND(o_totalprice * 100) AS BIGINT) AS o_cents, o_orderpriority FROM orders""",
    "graph_node_features_keyless": f"""WITH {KEYED_LINES}
SELECT row_key AS node_id, l_shipdate AS time, l_linenumber, l_quantity, l_cents, l_discount_pct, l_tax_pct, l_returnflag, l_linestatus
FROM keyed_lines""",
    "temporal_neighbors": _neighbors_sql(fanout=WHOLE_FANOUT),
    "temporal_neighbors_keyless": _neighbors_sql(),
    "temporal_neighbors_uniform": _neighbors_sql(uniform=True),
}

# Earlier names of the queries over all eight tables. That of the neighbours keeps its few, as the uniform draw does.
for _name in ("graph_nodes", "graph_edges"):
    QUERIES[f"{_name}_keyless"], ORACLES[f"{_name}_keyless"] = QUERIES[_name], ORACLES[_name]
