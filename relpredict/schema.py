"""Metadata for a set of related tables: columns with roles, keys and foreign-key links.

Everything here is a handful of driver-side records. No DataFrame is touched apart from reading
its ``schema``; the data itself stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROLES = ("pk", "fk", "time", "numeric", "categorical", "text")


class SchemaError(ValueError):
    """A table, column, key or join path that the task needs does not exist."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    role: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: str | None = None
    time_index: str | None = None

    def column(self, name: str) -> ColumnSpec:
        for spec in self.columns:
            if spec.name == name:
                return spec
        raise SchemaError(f"table {self.name!r} has no column {name!r}")

    def with_role(self, role: str) -> list[str]:
        return [c.name for c in self.columns if c.role == role]


@dataclass(frozen=True)
class Link:
    """A single-column foreign key, child row -> parent row."""

    child: str
    child_column: str
    parent: str
    parent_column: str

    def __str__(self) -> str:
        return f"{self.child}.{self.child_column} -> {self.parent}.{self.parent_column}"


@dataclass(frozen=True)
class Hop:
    """One step along a link: ``down`` goes from the parent to its children."""

    link: Link
    down: bool

    @property
    def table(self) -> str:
        return self.link.child if self.down else self.link.parent

    @property
    def from_column(self) -> str:
        return self.link.parent_column if self.down else self.link.child_column

    @property
    def to_column(self) -> str:
        return self.link.child_column if self.down else self.link.parent_column


@dataclass(frozen=True)
class TableGraph:
    tables: Mapping[str, TableSpec]
    links: tuple[Link, ...] = ()

    def table(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise SchemaError(f"unknown table {name!r}")
        return self.tables[name]

    def children(self, table: str) -> list[Link]:
        return [link for link in self.links if link.parent == table]

    def parents(self, table: str) -> list[Link]:
        return [link for link in self.links if link.child == table]

    def join_path(self, start: str, goal: str) -> list[Hop]:
        """Shortest chain of links between two tables, in either direction per step.

        Ties go to the link declared first; the same table needs no step.
        """
        self.table(start), self.table(goal)
        reached: dict[str, tuple[Hop, str] | None] = {start: None}
        frontier = [start]
        while frontier and goal not in reached:
            following = []
            for here in frontier:
                for link in self.links:
                    if link.child == here:
                        hop = Hop(link, down=False)
                    elif link.parent == here:
                        hop = Hop(link, down=True)
                    else:
                        continue
                    if hop.table not in reached:
                        reached[hop.table] = (hop, here)
                        following.append(hop.table)
            frontier = following
        if goal not in reached:
            raise SchemaError(f"no foreign-key path connects {start!r} and {goal!r}")
        hops: list[Hop] = []
        step = reached[goal]
        while step is not None:
            hops.append(step[0])
            step = reached[step[1]]
        return hops[::-1]

    def describe(self) -> str:
        """Readable report: keys, time index and roles per table, then the links."""
        report = []
        for spec in self.tables.values():
            roles = ", ".join(f"{c.name}={c.role}" for c in spec.columns)
            report.append(f"{spec.name}: key {spec.primary_key}, time {spec.time_index}; {roles}")
        report += [str(link) for link in self.links]
        return "\n".join(report)


@dataclass
class Database:
    """The tables as lazy DataFrames together with their metadata."""

    tables: dict[str, DataFrame]
    graph: TableGraph = field(default_factory=lambda: TableGraph({}))

    def rows(self, name: str) -> DataFrame:
        self.graph.table(name)
        return self.tables[name]

    def spec(self, name: str) -> TableSpec:
        return self.graph.table(name)

    def with_tables(self, tables: Mapping[str, DataFrame]) -> Database:
        """Same metadata over other rows (a truncated copy, a later snapshot)."""
        return Database({**self.tables, **tables}, self.graph)


def type_class(data_type: T.DataType) -> str:
    """temporal | numeric | string | other, from the real Spark type rather than its name."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return "string"
    return "other"


DEFAULT_ROLE = {
    "temporal": "time",
    "numeric": "numeric",
    "string": "categorical",
    "other": "text",
}


def declare(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    links: Iterable[tuple[str, str, str]],
    times: Mapping[str, str] | None = None,
    text: Iterable[str] = (),
) -> Database:
    """Build a database from declared keys.

    ``links`` holds ``(child, child_column, parent)``; the parent's declared key is the other end.
    ``text`` names ``table.column`` strings kept out of the feature search.
    """
    times = dict(times or {})
    text = set(text)
    resolved = []
    for child, column, parent in links:
        if parent not in keys:
            raise SchemaError(f"link target {parent!r} has no declared key")
        resolved.append(Link(child, column, parent, keys[parent]))
    foreign = {(link.child, link.child_column) for link in resolved}

    specs = {}
    for name, frame in tables.items():
        columns = []
        for f in frame.schema.fields:
            role = DEFAULT_ROLE[type_class(f.dataType)]
            if keys.get(name) == f.name:
                role = "pk"
            elif (name, f.name) in foreign:
                role = "fk"
            elif f"{name}.{f.name}" in text:
                role = "text"
            columns.append(ColumnSpec(f.name, f.dataType.simpleString(), role))
        spec = TableSpec(name, tuple(columns), keys.get(name), times.get(name))
        for wanted in (spec.primary_key, spec.time_index):
            if wanted is not None:
                spec.column(wanted)
        if spec.time_index is None and name not in times:
            stamps = spec.with_role("time")
            spec = replace(spec, time_index=stamps[0] if stamps else None)
        specs[name] = spec
    for link in resolved:
        specs[link.child].column(link.child_column)
    return Database(dict(tables), TableGraph(specs, tuple(resolved)))
