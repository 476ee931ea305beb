"""Scans, counts, profiling and key discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SHOP, TABLES, raw, shop
from relpredict.operators import profile as P
from relpredict.sources.tables import describe_source, load_source, row_counts, run_query

ID_PATTERN = "(key|_id)$"
PREFIX_PATTERN = "^[a-z]_"

# column -> type as Spark reads it, by position
COLUMNS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}
CLASSES = {"timestamp_ntz": "temporal", "string": "string", "array<float>": "other"}


def _profile_sql() -> str:
    parts = []
    for table, columns in COLUMNS.items():
        for position, column in enumerate(columns.split(", ")):
            name, kind = column.split()
            group = CLASSES.get(kind, "numeric")
            distinct = "CAST(NULL AS BIGINT)" if group == "other" else f"COUNT(DISTINCT {name})"
            parts.append(
                f"SELECT '{table}' AS table_name, {position} AS position, '{name}' AS column_name,"
                f" '{kind}' AS type, '{group}' AS type_class, COUNT(*) AS n_rows,"
                f" COUNT({name}) AS n_values, {distinct} AS n_distinct FROM {table}"
            )
    return "\nUNION ALL ".join(parts)


PROFILE_SQL = _profile_sql()
KEYS_CTE = f"""
profiled AS ({PROFILE_SQL}),
candidates AS (
  SELECT *, CASE WHEN column_name = 'id' OR column_name = table_name || '_id' OR column_name = (
      CASE WHEN table_name LIKE '%ies' THEN left(table_name, length(table_name) - 3) || 'y'
           WHEN table_name LIKE '%ses' THEN left(table_name, length(table_name) - 2)
           WHEN table_name LIKE '%s' THEN left(table_name, length(table_name) - 1)
           ELSE table_name END) || '_id' THEN 0 ELSE 1 END AS preference
  FROM profiled
  WHERE regexp_matches(column_name, '{ID_PATTERN}') AND type_class <> 'temporal'
    AND n_rows > 0 AND n_values = n_rows AND n_distinct = n_rows),
pks AS (
  SELECT table_name, column_name AS primary_key FROM candidates
  QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY preference, position) = 1),
owners AS (
  SELECT regexp_replace(primary_key, '{PREFIX_PATTERN}', '') AS bare, table_name, primary_key FROM pks
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(primary_key, '{PREFIX_PATTERN}', '')
                             ORDER BY table_name) = 1),
fks AS (
  SELECT p.table_name AS child_table, p.column_name AS child_column,
         o.table_name AS parent_table, o.primary_key AS parent_column
  FROM profiled p
  LEFT JOIN pks k ON k.table_name = p.table_name
  JOIN owners o ON o.bare = regexp_replace(p.column_name, '{PREFIX_PATTERN}', '')
  WHERE regexp_matches(p.column_name, '{ID_PATTERN}') AND p.type_class <> 'temporal'
    AND (k.primary_key IS NULL OR k.primary_key <> p.column_name) AND o.table_name <> p.table_name)
"""


def _inclusion_sql() -> str:
    links = [
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("events", "user_id", "customer", "c_custkey"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS child_table, '{k}' AS child_column, '{p}' AS parent_table,"
        f" COUNT({k}) AS n_values, CAST(COUNT(*) FILTER (WHERE {k} IS NOT NULL AND {pk} IS NULL) AS BIGINT) AS n_orphans,"
        f" CAST(COUNT({pk}) AS DOUBLE) / COUNT({k}) AS inclusion"
        f" FROM {c} LEFT JOIN {p} ON {k} = {pk}"
        for c, k, p, pk in links
    )


def _profiled(spark, sf):
    return P.profile(raw(spark, sf, TABLES))


def _profiled_ids(spark, sf):
    """The profile that a search for keys needs: id columns alone."""
    tables = raw(spark, sf, TABLES)
    return P.profile(tables, P.id_columns(tables, ID_PATTERN))


QUERIES = {
    "scan_table": lambda spark, sf: raw(spark, sf, ["orders"])["orders"],
    "table_row_counts": lambda spark, sf: row_counts(raw(spark, sf, TABLES)),
    "parameterised_query": lambda spark, sf: run_query(
        spark,
        raw(spark, sf, SHOP),
        "SELECT c_mktsegment, count(*) AS n FROM {customer} JOIN {orders} ON o_custkey = c_custkey"
        " WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY c_mktsegment",
        {"status": "F", "least": 1000.0},
    ),
    "list_source": lambda spark, sf: describe_source(load_source(spark, sf)).select(
        "table_name", F.col("position").cast("bigint").alias("position"), "column_name", "n_rows"
    ),
    "column_profile": _profiled,
    "primary_keys": lambda spark, sf: P.primary_keys(_profiled_ids(spark, sf), ID_PATTERN),
    "foreign_keys": lambda spark, sf: P.foreign_keys(_profiled_ids(spark, sf), ID_PATTERN, PREFIX_PATTERN),
    "fk_inclusion": lambda spark, sf: P.link_inclusion(shop(spark, sf)),
    "column_roles": lambda spark, sf: P.column_roles(_profiled(spark, sf), ID_PATTERN, PREFIX_PATTERN),
    # shortlist: sketches for all columns, exact counts for every id column without gaps
    "primary_keys_shortlist": lambda spark, sf: P.primary_keys(
        P.shortlist_profile(raw(spark, sf, TABLES), ID_PATTERN), ID_PATTERN
    ),
}

ORACLES = {
    "scan_table": "SELECT * FROM orders",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in sorted(TABLES)
    ),
    "parameterised_query": "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey"
    " WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY c_mktsegment",
    "list_source": "SELECT c.table_name, CAST(c.ordinal_position - 1 AS BIGINT) AS position, c.column_name, n.n_rows"
    " FROM information_schema.columns AS c JOIN ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in sorted(TABLES))
    + ") AS n ON n.table_name = c.table_name",
    "column_profile": PROFILE_SQL,
    "primary_keys": f"WITH {KEYS_CTE} SELECT * FROM pks",
    "primary_keys_shortlist": f"WITH {KEYS_CTE} SELECT * FROM pks",
    "foreign_keys": f"WITH {KEYS_CTE} SELECT * FROM fks",
    "fk_inclusion": _inclusion_sql(),
    "column_roles": f"""WITH {KEYS_CTE}
SELECT p.table_name, p.column_name,
  CASE WHEN type_class = 'temporal' THEN 'time'
       WHEN p.column_name = primary_key THEN 'pk'
       WHEN child_column IS NOT NULL THEN 'fk'
       WHEN regexp_matches(p.column_name, '{ID_PATTERN}') THEN 'text'
       WHEN type_class = 'numeric' THEN 'numeric'
       WHEN type_class = 'string' AND n_values > 0
            AND CAST(n_distinct AS DOUBLE) / n_values <= 0.5 THEN 'categorical'
       ELSE 'text' END AS role,
  CASE WHEN type_class = 'temporal' AND position = min(CASE WHEN type_class = 'temporal' THEN position END)
            OVER (PARTITION BY p.table_name) THEN 1 ELSE 0 END AS is_time_index
FROM profiled p LEFT JOIN pks USING (table_name)
LEFT JOIN fks ON child_table = p.table_name AND child_column = p.column_name""",
}

