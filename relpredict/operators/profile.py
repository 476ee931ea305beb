"""Profiling jobs: distinct counts, keys, foreign keys and roles found from the data itself.

Exact counts come from one reading of each table: every row gives a (column, value) entry for each
of its columns, and entries are grouped on the map side first, so a value that fills a third of a
column is sent once per task. Long strings travel as a digest.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpredict.schema import (
    DEFAULT_ROLE,
    ColumnSpec,
    Database,
    Link,
    SchemaError,
    TableGraph,
    TableSpec,
    type_class,
)

CATEGORICAL_SHARE = 0.5  # distinct / non-null at or below which a string counts as categorical
ID_PATTERN = r"^id$|_id$"
LONG = 32  # bytes from which a string is counted by its digest

PROFILE_SCHEMA = (
    "table_name string, position int, column_name string, type string, type_class string,"
    " n_rows bigint, n_values bigint, n_distinct bigint"
)
PROFILE_COLUMNS = [field.split()[0] for field in PROFILE_SCHEMA.split(", ")]


def _entry(column: str, data_type: T.DataType) -> str:
    """SQL for a short text that tells the column's values apart; other types only tell whether there is one."""
    name = f"`{column}`"
    if type_class(data_type) == "other":
        return f"IF({name} IS NOT NULL, '', NULL)"
    if isinstance(data_type, T.StringType):
        return f"IF(octet_length({name}) > {LONG}, concat('#', md5({name})), concat('=', {name}))"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"CAST({name} + 0D AS STRING)"  # both zeros are one value
    if isinstance(data_type, T.TimestampType):
        return f"CAST(unix_micros({name}) AS STRING)"  # local time repeats an hour a year
    return f"CAST({name} AS STRING)"


Fields = list[tuple[str, int, T.StructField]]


def _fields(tables: Mapping[str, DataFrame], only: set[tuple[str, str]] | None = None) -> Fields:
    return [
        (name, i, f)
        for name in sorted(tables)
        for i, f in enumerate(tables[name].schema.fields)
        if only is None or (name, f.name) in only
    ]


def _facts(tables: Mapping[str, DataFrame], fields: Fields) -> DataFrame:
    """What the schema alone tells: one small local row per column."""
    session = next(iter(tables.values())).sparkSession
    rows = [
        (i, name, at, f.name, f.dataType.simpleString(), type_class(f.dataType))
        for i, (name, at, f) in enumerate(fields)
    ]
    return session.createDataFrame(
        rows,
        "_id int, table_name string, position int, column_name string, type string, type_class string",
    )


def profile(tables: Mapping[str, DataFrame], only: set[tuple[str, str]] | None = None) -> DataFrame:
    """``(table_name, position, column_name, type, type_class, n_rows, n_values, n_distinct)``.

    Each table is scanned once, whatever its number of columns, and one shuffle serves all of them;
    row, value and distinct counts are read off the groups. Nested and binary columns get no distinct
    count. ``only`` restricts the profile to some ``(table, column)`` pairs.
    """
    fields = _fields(tables, only)
    if not fields:
        return _facts(tables, fields).selectExpr(*PROFILE_COLUMNS[:5], "0L AS n_rows", "0L AS n_values", "0L AS n_distinct")
    entries: dict[str, list[str]] = {}
    for i, (name, _, f) in enumerate(fields):
        entries.setdefault(name, []).append(f"named_struct('_id', {i}, 'value', {_entry(f.name, f.dataType)})")
    melted = [tables[name].selectExpr(f"inline(array({', '.join(listed)}))") for name, listed in entries.items()]
    whole = melted[0]
    for part in melted[1:]:
        whole = whole.unionAll(part)
    groups = whole.groupBy("_id", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.groupBy("_id").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_values"), F.count("value").alias("n_distinct")
    )
    zero = F.lit(0).cast("bigint")
    return (
        _facts(tables, fields)
        .join(counts, "_id", "left")
        .select(
            *PROFILE_COLUMNS[:5],
            F.coalesce("n_rows", zero).alias("n_rows"),
            F.coalesce("n_values", zero).alias("n_values"),
            F.when(F.col("type_class") != "other", F.coalesce("n_distinct", zero)).alias("n_distinct"),
        )
    )


def sketch_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The same columns with HyperLogLog distinct counts: one scan per table and no shuffle of values."""
    fields = _fields(tables)
    parts = []
    for name in sorted(tables):
        mine = [(i, f) for i, (owner, _, f) in enumerate(fields) if owner == name]
        columns = {i: F.col(f"`{f.name}`") for i, f in mine}
        aggregates = [F.count(F.lit(1)).alias("n_rows")]
        aggregates += [F.count(c).alias(f"n{i}") for i, c in columns.items()]
        aggregates += [
            (F.approx_count_distinct(columns[i]) if type_class(f.dataType) != "other" else F.max(F.lit(None).cast("bigint")))
            .alias(f"d{i}")
            for i, f in mine
        ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("_id"), "n_rows", F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("n_distinct")
                )
                for i, _ in mine
            ]
        )
        parts.append(tables[name].agg(*aggregates).select(F.explode(rows).alias("fact")).select("fact.*"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionAll(part)
    return _facts(tables, fields).join(counts, "_id").select(*PROFILE_COLUMNS)


def shortlist_profile(tables: Mapping[str, DataFrame], id_pattern: str = ID_PATTERN, error: float = 0.2) -> DataFrame:
    """A profile whose key decisions are exact at the price of a sketch for most columns.

    The first scan sketches every column. Every id column that holds a value in each row is then
    counted exactly, and so are strings close to the categorical limit; other counts are estimates.
    """
    rough = sketch_profile(tables).collect()  # one row per column of the schema
    unsettled = set()
    for r in rough:
        if r.n_distinct is None or not r.n_values:
            continue
        share = r.n_distinct / r.n_values
        is_id = re.search(id_pattern, r.column_name) is not None
        near_unique = is_id and r.n_values == r.n_rows
        near_limit = r.type_class == "string" and abs(share - CATEGORICAL_SHARE) < error
        if near_unique or near_limit:
            unsettled.add((r.table_name, r.column_name))
    exact = {}
    if unsettled:
        exact = {(r.table_name, r.column_name): r for r in profile(tables, unsettled).collect()}
    session = next(iter(tables.values())).sparkSession
    settled = [exact.get((r.table_name, r.column_name), r) for r in rough]
    return session.createDataFrame([tuple(r) for r in settled], PROFILE_SCHEMA)


def id_columns(tables: Mapping[str, DataFrame], id_pattern: str = ID_PATTERN) -> set[tuple[str, str]]:
    """What a search for keys has to count: ``profile(tables, id_columns(tables))`` reads nothing else."""
    return {(name, c) for name, frame in tables.items() for c in frame.columns if re.search(id_pattern, c)}


# -- keys --------------------------------------------------------------------------------------


def is_unique() -> Column:
    return (F.col("n_rows") > 0) & (F.col("n_values") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows"))


def singular_column(name: Column) -> Column:
    return (
        F.when(name.endswith("ies"), F.concat(F.expr("left(table_name, length(table_name) - 3)"), F.lit("y")))
        .when(name.endswith("ses"), F.expr("left(table_name, length(table_name) - 2)"))
        .when(name.endswith("s"), F.expr("left(table_name, length(table_name) - 1)"))
        .otherwise(name)
    )


def with_primary_key(profiled: DataFrame, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Adds the ``primary_key`` of each row's table, null where there is none.

    Candidates are unique, gap-free id columns. One named after the table wins, then the first by
    position. The windows here run over the profile, which has one row per column of the schema.
    """
    table, column = F.col("table_name"), F.col("column_name")
    named = (
        (column == "id")
        | (column == F.concat(table, F.lit("_id")))
        | (column == F.concat(singular_column(table), F.lit("_id")))
    )
    candidate = column.rlike(id_pattern) & (F.col("type_class") != "temporal") & is_unique()
    rank = F.when(candidate, F.struct(F.when(named, 0).otherwise(1).alias("p"), "position", column.alias("c")))
    return profiled.withColumn("primary_key", F.min(rank).over(Window.partitionBy("table_name"))["c"])


def primary_keys(profiled: DataFrame, id_pattern: str = ID_PATTERN) -> DataFrame:
    """``(table_name, primary_key)`` of the tables that have one."""
    keyed = with_primary_key(profiled, id_pattern)
    return keyed.where(F.col("column_name") == F.col("primary_key")).select("table_name", "primary_key")


def with_parent(
    profiled: DataFrame, id_pattern: str = ID_PATTERN, prefix_pattern: str | None = None
) -> DataFrame:
    """Adds ``primary_key``, ``parent_table`` and ``parent_column``, null where a column is no foreign key.

    An id column that is not its table's key points to the table that owns a key of that name; the
    first table by name wins it. ``prefix_pattern`` strips table prefixes before names are compared,
    e.g. ``o_custkey`` and ``c_custkey``.
    """
    table, column = F.col("table_name"), F.col("column_name")
    keyed = with_primary_key(profiled, id_pattern)
    bare = column if prefix_pattern is None else F.regexp_replace(column, prefix_pattern, "")
    is_key = F.coalesce(column == F.col("primary_key"), F.lit(False))
    owner = F.min(F.when(is_key, F.struct(table.alias("t"), column.alias("c")))).over(Window.partitionBy("_bare"))
    owned = keyed.withColumn("_bare", bare).withColumn("_owner", owner)
    points = (
        column.rlike(id_pattern) & (F.col("type_class") != "temporal") & ~is_key & (F.col("_owner.t") != table)
    )
    return owned.withColumns(
        {"parent_table": F.when(points, F.col("_owner.t")), "parent_column": F.when(points, F.col("_owner.c"))}
    ).drop("_bare", "_owner")


def foreign_keys(
    profiled: DataFrame, id_pattern: str = ID_PATTERN, prefix_pattern: str | None = None
) -> DataFrame:
    """``(child_table, child_column, parent_table, parent_column)``."""
    found = with_parent(profiled, id_pattern, prefix_pattern).where(F.col("parent_table").isNotNull())
    return found.select(
        F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"),
        "parent_table", "parent_column",
    )


def column_roles(
    profiled: DataFrame, id_pattern: str = ID_PATTERN, prefix_pattern: str | None = None
) -> DataFrame:
    """``(table_name, column_name, role, is_time_index)`` for every profiled column."""
    temporal = F.col("type_class") == "temporal"
    first_time = F.min(F.when(temporal, F.col("position"))).over(Window.partitionBy("table_name"))
    share = F.try_divide(F.col("n_distinct"), F.col("n_values"))
    role = (
        F.when(temporal, "time")
        .when(F.col("column_name") == F.col("primary_key"), "pk")
        .when(F.col("parent_table").isNotNull(), "fk")
        .when(F.col("column_name").rlike(id_pattern), "text")
        .when(F.col("type_class") == "numeric", "numeric")
        .when((F.col("type_class") == "string") & (share <= CATEGORICAL_SHARE), "categorical")
        .otherwise("text")
    )
    return with_parent(profiled, id_pattern, prefix_pattern).select(
        "table_name",
        "column_name",
        role.alias("role"),
        F.coalesce(F.col("position") == first_time, F.lit(False)).cast("int").alias("is_time_index"),
    )


def link_inclusion(db: Database) -> DataFrame:
    """Per foreign key: child values, how many have no parent, and the share that do.

    Child keys are counted before the join, so a key that fills a third of the child table enters
    the join as one row.
    """
    parts = []
    for link in db.graph.links:
        child = (
            db.rows(link.child)
            .where(F.col(link.child_column).isNotNull())
            .groupBy(F.col(link.child_column).alias("_key"))
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        parent = db.rows(link.parent).select(F.col(link.parent_column).alias("_key"))
        missing = child.join(parent, "_key", "left_anti").select("_rows", F.lit(1).alias("_orphan"))
        counted = child.select("_rows", F.lit(0).alias("_orphan")).unionByName(missing)
        n_values = F.coalesce(F.sum(F.when(F.col("_orphan") == 0, F.col("_rows"))), F.lit(0))
        n_orphans = F.coalesce(F.sum(F.when(F.col("_orphan") == 1, F.col("_rows"))), F.lit(0))
        parts.append(
            counted.agg(n_values.alias("n_values"), n_orphans.alias("n_orphans")).select(
                F.lit(link.child).alias("child_table"),
                F.lit(link.child_column).alias("child_column"),
                F.lit(link.parent).alias("parent_table"),
                "n_values",
                "n_orphans",
                F.try_divide(F.col("n_values") - F.col("n_orphans"), F.col("n_values")).alias("inclusion"),
            )
        )
    if not parts:
        raise SchemaError("no foreign keys to check")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- discovery ---------------------------------------------------------------------------------


def discover(
    tables: Mapping[str, DataFrame],
    id_pattern: str = ID_PATTERN,
    prefix_pattern: str | None = None,
    exact: bool = True,
    times: Mapping[str, str] | None = None,
) -> Database:
    """A database whose metadata is found by the jobs above; ``times`` overrides time indexes.

    ``exact=False`` sketches the columns whose count cannot change a decision. Only the profile, one row per column of the schema, reaches the driver.
    """
    session = next(iter(tables.values())).sparkSession
    counted = profile(tables) if exact else shortlist_profile(tables, id_pattern)
    profiled = session.createDataFrame(counted.collect(), PROFILE_SCHEMA)
    roles = {(r.table_name, r.column_name): r for r in column_roles(profiled, id_pattern, prefix_pattern).collect()}
    keys = {r.table_name: r.primary_key for r in primary_keys(profiled, id_pattern).collect()}
    specs = {}
    for name in sorted(tables):
        columns, stamp = [], None
        for f in tables[name].schema.fields:
            found = roles.get((name, f.name))
            role = found.role if found else DEFAULT_ROLE[type_class(f.dataType)]
            stamp = f.name if found and found.is_time_index else stamp
            columns.append(ColumnSpec(f.name, f.dataType.simpleString(), role))
        specs[name] = TableSpec(name, tuple(columns), keys.get(name), (times or {}).get(name, stamp))
    order = {(n, c.name): i for n, s in specs.items() for i, c in enumerate(s.columns)}
    links = sorted(
        foreign_keys(profiled, id_pattern, prefix_pattern).collect(),
        key=lambda r: (r.child_table, order[r.child_table, r.child_column]),
    )
    return Database(dict(tables), TableGraph(specs, tuple(Link(*r) for r in links)))
