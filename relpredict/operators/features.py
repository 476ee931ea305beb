"""Point-in-time features at one cutoff: nothing later than the cutoff is ever read.

A row is visible when its time index is at or before the cutoff (timeless rows always are), and a
row reached over several links only when every row on its path is visible. The cutoff filter sits
below the first aggregation, so it reaches the Parquet scan. Every table below the entity is read
once: its rows become mergeable states by the key of the next table, and flat, stacked and longer
features all start from these.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpredict.functions.states import moments_of, quoted, stddev_of
from relpredict.functions.storage import written
from relpredict.functions.times import ntz
from relpredict.plans.feature_plan import Feature, enumerate_features
from relpredict.schema import Database, Link, SchemaError

ZERO_WHEN_ABSENT = ("COUNT", "SUM", "NUM_UNIQUE")
NUMBERED = 1 << 16  # equal rows that one task numbers at a time


def synthesize_at(
    db: Database,
    entity: str,
    cutoff: dt.datetime,
    features: Sequence[Feature] | None = None,
    max_depth: int = 2,
    universe: DataFrame | None = None,
) -> DataFrame:
    """``(entity_id, cutoff, feature...)`` for every entity visible at the cutoff.

    ``universe`` restricts the rows to its ``entity_id``s.
    """
    if features is None:
        features = enumerate_features(db.graph, entity, max_depth)
    pk = db.spec(entity).primary_key
    if pk is None:
        raise SchemaError(f"entity table {entity!r} has no primary key")
    frame = feature_frame(db, entity, features, cutoff, [pk])
    frame = frame.withColumnRenamed(key_name(pk), "entity_id")
    if universe is not None:
        frame = frame.join(universe.select("entity_id"), "entity_id", "left_semi")
    return frame.select("entity_id", ntz(cutoff).alias("cutoff"), *[f.name for f in features])


def key_name(column: str) -> str:
    return f"_key_{column}"


def visible(db: Database, table: str, cutoff: dt.datetime | None) -> DataFrame:
    rows, time = db.rows(table), db.spec(table).time_index
    return rows if time is None or cutoff is None else rows.where(F.col(time) <= ntz(cutoff))


def feature_frame(
    db: Database,
    table: str,
    features: Sequence[Feature],
    cutoff: dt.datetime | None,
    keep: Sequence[str],
    paths: PathStates | None = None,
) -> DataFrame:
    """Visible rows of ``table``: the ``keep`` columns as ``_key_*`` plus every feature.

    ``paths`` holds the states that all features of a run share. Wide projections are written as SQL
    strings: one call per projection instead of several per column keeps planning quick with
    hundreds of features.
    """
    paths = paths or PathStates(db, cutoff, features)
    lookups = by_links(f for f in features if f.kind == "lookup")
    aggregates = by_links(f for f in features if f.kind == "aggregate")
    pk = db.spec(table).primary_key
    needed = dict.fromkeys(keep)
    needed |= dict.fromkeys(links[0].child_column for links in lookups)
    if aggregates:
        needed[pk] = None
    frame = visible(db, table, cutoff).selectExpr(
        *[f"`{c}` AS `{key_name(c)}`" for c in needed],
        *[f"{row_value(f)} AS `{f.name}`" for f in features if f.kind in ("own", "transform")],
    )
    for links, members in lookups.items():
        frame = attach_parent(db, frame, links[0], members, cutoff, paths)
    for links, members in aggregates.items():
        key = F.col(key_name(links[0].parent_column))
        for summary in paths.summaries(links, members):
            group = f"_group_{len(frame.columns)}"
            frame = frame.join(summary.withColumnRenamed("_group", group), key == F.col(group), "left")
    return frame.selectExpr(*[f"`{key_name(c)}`" for c in keep], *[settled(f) for f in features])


def settled(feature: Feature) -> str:
    """The feature's column; counts, sums and distinct counts of nothing are zero."""
    if feature.function in ZERO_WHEN_ABSENT:
        return f"coalesce(`{feature.name}`, 0) AS `{feature.name}`"
    return f"`{feature.name}`"


def row_value(feature: Feature) -> str:
    column = f"`{feature.column}`"
    # weekday: Monday = 0
    return column if feature.function is None else f"{feature.function.lower()}({column})"


def by_links(features) -> dict[tuple[Link, ...], list[Feature]]:
    ordered = sorted(features, key=lambda f: [str(link) for link in f.links])
    return {links: list(group) for links, group in groupby(ordered, key=lambda f: f.links)}


def attach_parent(
    db: Database, frame: DataFrame, link: Link, members: Sequence[Feature], cutoff: dt.datetime | None, paths: PathStates
) -> DataFrame:
    parent = feature_frame(db, link.parent, distinct_bases(members), cutoff, [link.parent_column], paths)
    key = f"_parent_{link.child_column}"
    parent = parent.selectExpr(
        f"`{key_name(link.parent_column)}` AS `{key}`", *[f"`{f.base.name}` AS `{f.name}`" for f in members]
    )
    return frame.join(parent, F.col(key_name(link.child_column)) == F.col(key), "left")


def distinct_bases(members: Sequence[Feature]) -> list[Feature]:
    return list({f.base.name: f.base for f in members if f.base is not None}.values())


# -- states of a path, shared by all features that end in it -------------------------------------


def states_of(function: str, base: str | None) -> list[tuple[str, str, str]]:
    """``(column, SQL that starts it, merge)`` of the states that a function needs; moments own three columns."""
    if function == "COUNT":
        return [("_rows", "count(1)", "sum")]
    value = f"CAST(`{base}` AS DOUBLE)"
    total, known = (f"_s_{base}", f"sum({value})", "sum"), (f"_n_{base}", f"count({value})", "sum")
    return {
        "SUM": [total],
        "MEAN": [total, known],
        "MIN": [(f"_lo_{base}", f"min({value})", "min")],
        "MAX": [(f"_hi_{base}", f"max({value})", "max")],
        "STD": [(f"_m_{base}", value, "moments")],
        "NUM_UNIQUE": [],
    }[function]


def finished(f: Feature) -> str:
    """SQL for a feature's value from its states."""
    base = None if f.base is None else f.base.name
    value = {
        "COUNT": "`_rows`",
        "SUM": f"`_s_{base}`",
        "MEAN": f"IF(`_n_{base}` > 0, `_s_{base}` / `_n_{base}`, NULL)",
        "MIN": f"`_lo_{base}`",
        "MAX": f"`_hi_{base}`",
        "STD": stddev_of(f"_m_{base}"),
    }[f.function]
    return f"{value} AS `{f.name}`"


Need = tuple[str, str | None]  # a function and the name of its base


class PathStates:
    """Mergeable states of the tables below an entity, one DAG for all features of a run.

    The rows at the end of a link are read once and grouped by the link's key: that is the partial
    state which every feature ending in this link starts from, whether it stands on the link's
    parent, is stacked, or reaches over a longer path. A longer path joins states, not rows, with the
    table in between and merges them again. Distinct counts travel beside the numbers, as one entry
    for each value and key. A state with several readers is written once.
    """

    def __init__(self, db: Database, cutoff: dt.datetime | None, features: Sequence[Feature]):
        self.db, self.cutoff = db, cutoff
        self.needs: dict[tuple[Link, ...], dict[Need, Feature]] = {}
        self.readers: Counter[tuple[Link, ...]] = Counter()
        self.frames: dict[tuple[Link, ...], DataFrame] = {}
        self._collect(features)
        self._count(features)

    def _collect(self, features: Iterable[Feature | None]) -> None:
        for f in features:
            if f is None:
                continue
            if f.kind == "aggregate":
                for i in range(len(f.links)):
                    need = (f.function, None if f.base is None else f.base.name)
                    self.needs.setdefault(f.links[i:], {})[need] = f
            self._collect([f.base])

    def _count(self, features: Sequence[Feature]) -> None:
        """How often each state is read; the traversal is that of ``feature_frame``."""
        for f in by_links(x for x in features if x.kind == "lookup").values():
            self._count(distinct_bases(f))
        for links, members in by_links(x for x in features if x.kind == "aggregate").items():
            self._read(links, (any(f.function != "NUM_UNIQUE" for f in members)) + any(f.function == "NUM_UNIQUE" for f in members))

    def _read(self, links: tuple[Link, ...], times: int) -> None:
        first = not self.readers[links]
        self.readers[links] += times
        if first and len(links) > 1:
            functions = {function for function, _ in self.needs[links]}
            self._read(links[1:], 1 + ("STD" in functions))
        elif first:
            self._count(distinct_bases(list(self.needs[links].values())))

    def summaries(self, links: tuple[Link, ...], members: Sequence[Feature]) -> list[DataFrame]:
        """The members' values per ``_group``, the key of the path's first parent."""
        unique = [f for f in members if f.function == "NUM_UNIQUE"]
        other = [f for f in members if f.function != "NUM_UNIQUE"]
        entries, found = self._entries(links), []
        if other:
            numbers = entries.where("_which = -1") if self._values(links) else entries
            found.append(numbers.selectExpr("_group", *[finished(f) for f in other]))
        if unique:
            place = self._values(links)
            counts = [F.expr(f"count_if(_which = {place.index(f.base.name)}) AS `{f.name}`") for f in unique]
            found.append(entries.where("_which >= 0").groupBy("_group").agg(*counts))
        return found

    def _values(self, links: tuple[Link, ...]) -> list[str]:
        """The categories whose values the end of a path is asked for, numbered alike at every step."""
        return [b for function, b in self.needs[links[-1:]] if function == "NUM_UNIQUE"]

    def _states(self, links: tuple[Link, ...]) -> list[tuple[str, str, str]]:
        return list(dict.fromkeys(s for need in self.needs[links] for s in states_of(*need)))

    def _entries(self, links: tuple[Link, ...]) -> DataFrame:
        """States by ``_group``; with categories also by ``_which`` and ``_value``, the numbers under -1."""
        if links not in self.frames:
            frame = self._rows(links[0]) if len(links) == 1 else self._merged(links)
            self.frames[links] = written(frame, "states") if self.readers[links] > 1 else frame
        return self.frames[links]

    def _rows(self, link: Link) -> DataFrame:
        needs = self.needs[link,]
        rows = feature_frame(self.db, link.child, distinct_bases(list(needs.values())), self.cutoff, [link.child_column], self)
        rows = rows.withColumnRenamed(key_name(link.child_column), "_group").where("_group IS NOT NULL")
        values, states = self._values((link,)), self._states((link,))
        starts = []
        for name, sql, merge in states:
            starts += moments_of(sql, name) if merge == "moments" else [f"{sql} AS `{name}`"]
        if not values:
            return rows.groupBy("_group").agg(*[F.expr(s) for s in starts])
        entries = [f"named_struct('which', {i}, 'value', CAST(`{v}` AS STRING))" for i, v in enumerate(values)]
        numeric = list(dict.fromkeys(b for function, b in needs if b is not None and function != "NUM_UNIQUE"))
        if states:
            entries.append("named_struct('which', -1, 'value', CAST(NULL AS STRING))")
        melted = rows.selectExpr("_group", *quoted(numeric), f"explode(array({', '.join(entries)})) AS _entry").selectExpr(
            "_group", "_entry.which AS _which", "_entry.value AS _value", *[f"IF(_entry.which = -1, `{c}`, NULL) AS `{c}`" for c in numeric]
        )
        melted = melted.where("_which = -1 OR _value IS NOT NULL")
        return melted.groupBy("_group", "_which", "_value").agg(F.count(F.lit(1)).alias("_met"), *[F.expr(s) for s in starts])

    def _merged(self, links: tuple[Link, ...]) -> DataFrame:
        """States of the rest of a path, taken one table up."""
        upper, lower = links[0], links[1]
        below, values = self._entries(links[1:]), self._values(links)
        if values:
            asked = [i for i, v in enumerate(values) if ("NUM_UNIQUE", v) in self.needs[links]]
            below = below.where(F.col("_which").isin([*asked, *([-1] if self._states(links) else [])]))
        steps = visible(self.db, upper.child, self.cutoff).select(
            F.col(lower.parent_column).alias("_step"), F.col(upper.child_column).alias("_up")
        )
        joined = below.join(steps.where("_up IS NOT NULL"), F.col("_group") == F.col("_step"), "inner").drop("_group", "_step")
        joined = joined.withColumnRenamed("_up", "_group")
        key = ["_group", "_which", "_value"] if values else ["_group"]
        merges, moments = [], []
        for name, _, merge in self._states(links):
            if merge == "moments":
                moments.append(name)
                merges += [f"sum(`{name}_n`) AS `{name}_n`", f"sum(`{name}_n` * `{name}_mu`) / nullif(sum(`{name}_n`), 0) AS `{name}_mu`"]
            else:
                merges.append(f"{merge}(`{name}`) AS `{name}`")
        if values:
            merges.append("sum(_met) AS _met")
        whole = joined.groupBy(*key).agg(*[F.expr(m) for m in merges])
        if not moments:
            return whole
        # deviations from the merged mean, in a second pass over states, so that a large mean cancels nothing
        numbers = joined.where("_which = -1") if values else joined
        means = (whole.where("_which = -1") if values else whole).selectExpr("_group AS _of", *[f"`{m}_mu` AS `{m}_mean`" for m in moments])
        spread = [
            F.expr(f"sum(`{m}_m2` + `{m}_n` * (`{m}_mu` - `{m}_mean`) * (`{m}_mu` - `{m}_mean`)) AS `{m}_m2`") for m in moments
        ]
        around = numbers.join(means, F.col("_group") == F.col("_of")).groupBy(F.col("_of")).agg(*spread)
        same = (F.col("_group") == F.col("_of")) & (F.col("_which") == -1) if values else F.col("_group") == F.col("_of")
        return whole.join(around, same, "left").drop("_of")


def needs_join(links: Sequence[Link], members: Sequence[Feature]) -> bool:
    """Whether the rows of a path come out of a join, so that reading them twice is expensive."""
    return len(links) > 1 or any(f.base is not None and f.base.kind in ("lookup", "aggregate") for f in members)


def melt(child: DataFrame, wanted: Sequence[Feature], *carry: str) -> DataFrame:
    """``(carry..., _which, _value)``: one row per non-null categorical value."""
    pairs = ", ".join(
        f"named_struct('which', {i}, 'value', CAST(`{f.base.name}` AS STRING))" for i, f in enumerate(wanted)
    )
    return (
        child.selectExpr(*carry, f"explode(array({pairs})) AS _pair")
        .where("_pair.value IS NOT NULL")
        .selectExpr(*carry, "_pair.which AS _which", "_pair.value AS _value")
    )


# -- training sets ---------------------------------------------------------------------------


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join of features and labels on ``(entity_id, cutoff)``."""
    return features.join(labels, ["entity_id", "cutoff"], "inner")


def conform(frame: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("entity_id", "cutoff")) -> DataFrame:
    """The training columns in training order; a missing one becomes null, extra ones are dropped."""
    present = set(frame.columns)
    return frame.select(
        *keep, *[F.col(c) if c in present else F.lit(None).cast("double").alias(c) for c in columns]
    )


def surrogate_key(frame: DataFrame, name: str = "row_key") -> DataFrame:
    """A content key for a table without a primary key, without numbering the table globally.

    The key is the digest of the row plus a running number among equal rows. Rows are counted by a short
    hash first, and those that are alone in it, so unlike any other, are number 1 where they lie: only
    rows that share their hash are regrouped. Equal rows are interchangeable, so each is counted, on
    the map side first, and the counts are expanded into numbers again: keys depend on the rows
    alone, not on how they were split or in which order tasks ran. A row that makes up a third of the
    table is one counted row, whose numbers are dealt out to many tasks in blocks.
    """
    pieces = []
    for f in frame.schema.fields:
        text = F.hex(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string")
        pieces.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    text = F.concat_ws("|", *pieces)
    short = F.xxhash64(text)
    shared = written(frame.groupBy(short.alias("_short")).count().where("count > 1").select("_short"), "shared-hashes")
    digest = F.sha2(text, 256)
    alone = frame.join(shared, short == shared["_short"], "left_anti").select("*", F.concat(digest, F.lit("-1")).alias(name))
    rest = frame.join(shared, short == shared["_short"], "left_semi")
    hashed = rest.select(F.unhex(digest).alias("_hash"), F.struct(*[f"`{c}`" for c in frame.columns]).alias("_row"))
    counted = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))
    counted = written(counted, "row-counts")
    blocks = F.explode(F.expr(f"sequence(0L, (_n - 1) div {NUMBERED})"))
    few = counted.where(F.col("_n") <= NUMBERED).withColumn("_block", F.lit(0).cast("bigint"))
    many = counted.where(F.col("_n") > NUMBERED).withColumn("_block", blocks).repartition("_hash", "_block")
    number = F.explode(F.expr(f"sequence(_block * {NUMBERED} + 1, least(_n, (_block + 1) * {NUMBERED}))"))
    numbered = few.unionByName(many).withColumn("_number", number)
    key = F.concat_ws("-", F.lower(F.hex("_hash")), F.col("_number").cast("string"))
    return alone.unionByName(numbered.select("_row.*", key.alias(name)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
