"""Which features exist for an entity: a bounded search over roles and links.

The search is the published Deep Feature Synthesis idea (Kanter & Veeramachaneni, DSAA 2015):
own columns, calendar transforms, parent lookups and child aggregates, stacked up to a depth.
The result is a list of small records. A feature's ``name`` is a plain Spark column name and its
``definition`` the readable form, e.g. ``sum__orders__o_totalprice`` / ``SUM(orders.o_totalprice)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from relpredict.schema import Link, TableGraph

# The aggregate and transform functions of the feature search.
AGGREGATIONS = ("COUNT", "SUM", "MEAN", "MAX", "MIN", "STD", "NUM_UNIQUE")
TRANSFORMS = ("MONTH", "WEEKDAY")
NUMERIC_AGGREGATIONS = ("SUM", "MEAN", "MAX", "MIN", "STD")


@dataclass(frozen=True)
class Feature:
    """One feature of ``table``.

    kind ``own``: a column; ``transform``: ``function`` of a time column; ``lookup``: ``base`` of
    the parent behind ``links[0]``; ``aggregate``: ``function`` over ``base`` of the table at the
    end of ``links`` (walked downwards), ``base`` None for COUNT.
    """

    kind: str
    table: str
    name: str
    definition: str
    numeric: bool
    depth: int
    function: str | None = None
    column: str | None = None
    links: tuple[Link, ...] = ()
    base: Feature | None = None

    @property
    def path(self) -> list[str]:
        """Tables from the entity down to where the value comes from."""
        if self.kind == "lookup":
            return [self.table, *self.base.path]
        if self.kind == "aggregate":
            steps = [self.table] + [link.child for link in self.links]
            return steps if self.base is None else steps + self.base.path[1:]
        return [self.table]

    @property
    def source_column(self) -> str | None:
        return self.column if self.base is None else self.base.source_column

    @property
    def is_entity_only(self) -> bool:
        return self.kind in ("own", "transform")


def _path_label(graph: TableGraph, links: Sequence[Link]) -> str:
    """Table names along the links; a role-playing link also shows its column."""
    parts = []
    for link in links:
        twins = [o for o in graph.links if (o.child, o.parent) == (link.child, link.parent)]
        parts.append(link.child if len(twins) == 1 else f"{link.child}[{link.child_column}]")
    return ".".join(parts)


def _slug(text: str) -> str:
    return text.replace("[", "_").replace("]", "").replace(".", "_")


def descending_paths(graph: TableGraph, table: str, max_links: int | None = None) -> list[tuple[Link, ...]]:
    """Every chain of parent-to-child links that leaves ``table`` and visits no table twice."""
    found: list[tuple[Link, ...]] = []
    open_paths: list[tuple[Link, ...]] = [()]
    while open_paths and (max_links is None or len(open_paths[0]) < max_links):
        grown = []
        for path in open_paths:
            here = path[-1].child if path else table
            seen = {table, *(link.child for link in path)}
            grown += [path + (link,) for link in graph.children(here) if link.child not in seen]
        found += grown
        open_paths = grown
    return found


def own_feature(table: str, column: str, numeric: bool) -> Feature:
    return Feature("own", table, column, f"{table}.{column}", numeric, 0, column=column)


def transform_feature(table: str, function: str, column: str) -> Feature:
    name = f"{function.lower()}__{column}"
    return Feature("transform", table, name, f"{function}({table}.{column})", False, 1, function, column)


def lookup_feature(graph: TableGraph, link: Link, base: Feature) -> Feature:
    twins = [o for o in graph.links if (o.child, o.parent) == (link.child, link.parent)]
    label = link.parent if len(twins) == 1 else f"{link.parent}[{link.child_column}]"
    inner = base.definition.removeprefix(f"{link.parent}.")
    return Feature(
        "lookup", link.child, f"{_slug(label)}__{base.name}", f"{label}.{inner}",
        base.numeric, base.depth + 1, links=(link,), base=base,
    )


def aggregate_feature(
    graph: TableGraph, function: str, links: Sequence[Link], base: Feature | None = None
) -> Feature:
    label = _path_label(graph, links)
    name = f"{function.lower()}__{_slug(label)}"
    if base is None:
        inner = label
    else:
        name += f"__{base.name}"
        inner = f"{label}.{base.definition.removeprefix(links[-1].child + '.')}"
    return Feature(
        "aggregate", links[0].parent, name, f"{function}({inner})", True,
        1 if base is None else base.depth + 1, function, links=tuple(links), base=base,
    )


def _redundant(function: str, base: Feature) -> bool:
    """Stacks that add nothing: a function on itself, or a SUM of COUNTs (a longer path's COUNT)."""
    return base.kind == "aggregate" and (
        function == base.function or (function == "SUM" and base.function == "COUNT")
    )


def enumerate_features(
    graph: TableGraph,
    table: str,
    max_depth: int = 2,
    aggregations: Iterable[str] = AGGREGATIONS,
    transforms: Iterable[str] = TRANSFORMS,
    max_links: int | None = None,
    _closed: frozenset[Link] = frozenset(),
) -> list[Feature]:
    """All features of ``table`` up to ``max_depth``, in a stable order.

    Keys and text never enter. A child row does not look up through the link it is grouped by,
    because that would only repeat the entity's own values. ``max_depth`` counts stacked aggregates;
    paths are followed to their end unless ``max_links`` says otherwise.
    """
    aggregations, transforms = tuple(aggregations), tuple(transforms)
    options = {"aggregations": aggregations, "transforms": transforms, "max_links": max_links}
    spec = graph.table(table)
    found = [
        own_feature(table, c.name, c.role == "numeric")
        for c in spec.columns
        if c.role in ("numeric", "categorical")
    ]
    if max_depth < 1:
        return found
    found += [transform_feature(table, f, c) for c in spec.with_role("time") for f in transforms]
    for link in graph.parents(table):
        if link not in _closed:
            for base in enumerate_features(graph, link.parent, max_depth - 1, **options):
                found.append(lookup_feature(graph, link, base))
    for links in descending_paths(graph, table, max_links):
        if "COUNT" in aggregations:
            found.append(aggregate_feature(graph, "COUNT", links))
        bases = enumerate_features(
            graph, links[-1].child, max_depth - 1, **options, _closed=_closed | set(links)
        )
        for base in bases:
            usable = NUMERIC_AGGREGATIONS if base.numeric else ("NUM_UNIQUE",)
            found += [
                aggregate_feature(graph, f, links, base)
                for f in aggregations
                if f in usable and not _redundant(f, base)
            ]
    return found


def lineage(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    """One row per feature: where it comes from, structurally rather than parsed from its name."""
    rows = [
        (f.name, f.definition, f.path, list(dict.fromkeys(f.path)),
         f.function, f.source_column, f.depth, f.is_entity_only, describe(f))
        for f in features
    ]
    return spark.createDataFrame(
        rows,
        "feature string, definition string, path array<string>, tables array<string>, agg string,"
        " `column` string, depth int, entity_only boolean, readable string",
    )


def describe(feature: Feature) -> str:
    """A sentence part for reports: the function, the tables it runs over, the definition."""
    if feature.kind != "aggregate":
        return feature.definition
    over = ", ".join(dict.fromkeys(feature.path[1:]))
    return f"{feature.function} over {over}: {feature.definition}"
