"""Point-in-time features for many cutoffs at once: every ``(entity, cutoff)`` sees its own past.

No row is copied per cutoff. Child rows are aggregated per ``(key, position)``, where the position
is the row's own time or, for a short list of anchors, the first anchor that can see the row.
The cutoffs are then placed among those positions and read a running merge of the states.

Aggregates of aggregates change as grandchildren arrive. Each child's value is kept as a step
function over the entity's cutoffs: an interval is spread over O(log n) nodes of a binary tree,
states are merged per ``(key, node)``, and each slot that is asked for reads the nodes above its own
leaf. Step functions go in and come out, so levels stack to any depth; the last one is asked for
the cutoffs themselves.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpredict.functions.states import (
    State,
    columns_of,
    merge_over,
    moments_of,
    quoted,
    running_merge,
    stddev_of,
)
from relpredict.functions.storage import cleared, written
from relpredict.functions.times import moments_before, moments_sql, ntz, ntz_sql
from relpredict.operators.features import (
    ZERO_WHEN_ABSENT,
    by_links,
    distinct_bases,
    feature_frame,
    key_name,
    melt,
    settled,
    visible,
)
from relpredict.plans.feature_plan import (
    Feature,
    enumerate_features,
    lookup_feature,
    own_feature,
)
from relpredict.schema import Database, Link, SchemaError

ALWAYS = dt.datetime(1, 1, 1)  # position of rows that every cutoff can see


@dataclass(frozen=True)
class Cutoffs:
    """The requested ``(entity_id, cutoff)`` rows, the last cutoff and, if they come from a list, its anchors.

    ``everyone`` says that the rows are all entities at all anchors. Nothing after ``latest`` can
    be seen, so every scan is limited to it.
    """

    rows: DataFrame
    anchors: tuple[dt.datetime, ...] | None
    latest: dt.datetime | None
    everyone: bool = False

    def position(self, time: str) -> str:
        """SQL for the first anchor at or after a time (null if none), or the time itself."""
        return time if self.anchors is None else f"get({moments_sql(self.anchors)}, {self.slot(time)})"

    def slot(self, time: str) -> str:
        """SQL for how many anchors lie before a time."""
        return moments_before(time, self.anchors)

    def scan_time(self, time: str) -> str | None:
        """What a running merge is cut by: a list of anchors bounds each group by itself."""
        return time if self.anchors is None else None


def synthesize_many(
    db: Database,
    entity: str,
    cutoffs: DataFrame | Sequence[dt.datetime],
    features: Sequence[Feature] | None = None,
    max_depth: int = 2,
) -> DataFrame:
    """``(entity_id, cutoff, feature...)`` for each requested cutoff of a visible entity.

    ``cutoffs`` is a list of anchors that apply to every entity, or a DataFrame with the columns
    ``entity_id`` and ``cutoff``. Aggregates may be stacked to any depth in either form.
    """
    if features is None:
        features = enumerate_features(db.graph, entity, max_depth)
    spec = db.spec(entity)
    if spec.primary_key is None:
        raise SchemaError(f"entity table {entity!r} has no primary key")
    if isinstance(cutoffs, DataFrame):
        asked = cutoffs.select("entity_id", F.col("cutoff").cast("timestamp_ntz")).distinct()
        latest = asked.agg(F.max("cutoff")).first()[0]
        request = Cutoffs(asked, None, latest)
    else:
        anchors = tuple(sorted(set(cutoffs)))
        asked = db.rows(entity).select(
            F.col(spec.primary_key).alias("entity_id"),
            F.explode(F.expr(moments_sql(anchors))).alias("cutoff"),
        )
        request = Cutoffs(asked, anchors, anchors[-1], everyone=True)
    return _features_of(db, entity, request, features).select(
        "entity_id", "cutoff", *[f.name for f in features]
    )


def _moves(feature: Feature | None) -> bool:
    """Whether the value of a row changes after the row has appeared."""
    if feature is None or feature.kind in ("own", "transform"):
        return False
    return feature.kind == "aggregate" or _moves(feature.base)


@dataclass(frozen=True)
class Chain:
    """How an aggregate reaches its values: the paths of the stacked aggregates, outermost first.

    Values at the end are those of plain rows, visible once all ``clocks`` are, or, with ``asked``, are
    looked up over that link and move themselves.
    """

    paths: tuple[tuple[Link, ...], ...]
    clocks: tuple[Feature, ...]
    asked: Link | None

    @property
    def links(self) -> tuple[Link, ...]:
        return tuple(link for path in self.paths for link in path)


def _chain(db: Database, f: Feature) -> Chain:
    base = f.base
    if not _moves(base):
        return Chain((f.links,), _clocks(db, base), None)
    if base.kind == "lookup":
        return Chain((f.links,), (), base.links[0])
    inner = _chain(db, base)
    return Chain((f.links, *inner.paths), inner.clocks, inner.asked)


def _features_of(db: Database, entity: str, request: Cutoffs, features: Sequence[Feature]) -> DataFrame:
    fixed = [f for f in features if not _moves(f)]
    moving = [f for f in features if f.kind == "lookup" and _moves(f)]
    chains: dict[Chain, list[Feature]] = {}
    for f in features:
        if f.kind == "aggregate":
            chains.setdefault(_chain(db, f), []).append(f)
    if not fixed and not moving and not request.everyone and len(chains) == 1:
        (chain, members), = chains.items()
        if len(chain.paths) == 1 and not chain.asked and not _timeless(db, chain.links, chain.clocks):
            values = _path_values(db, request, chain.links, chain.clocks, members)  # has every asked row
            return _fixed_values(db, entity, request, [], values).selectExpr("entity_id", "cutoff", *[settled(f) for f in members])
    out = _fixed_values(db, entity, request, fixed)
    for links, members in by_links(moving).items():
        out = _join_back(out, _parent_values(db, request, links[0], members), members)
    spark = out.sparkSession
    found = []
    with cleared(spark) as all_values:
        looked_up = _shared_lookups(db, request, {c: m for c, m in chains.items() if c.asked})
        for chain, members in chains.items():
            # written one by one, so that the shuffles and tables of one are gone before the next begins
            with cleared(spark) as kept:
                kept.append(written(_chain_values(db, request, chain, members, looked_up.get(chain)), "values"))
            all_values += kept
            found.append((kept[0], members))
    for values, members in found:
        out = _join_back(out, values, members)
    return out


def _chain_values(
    db: Database, request: Cutoffs, chain: Chain, members: Sequence[Feature], looked_up: DataFrame | None
) -> DataFrame:
    if len(chain.paths) > 1 or chain.asked:
        return _stacked_values(db, request, chain, members, looked_up)
    return _path_values(db, request, chain.links, chain.clocks, members)


def _join_back(out: DataFrame, values: DataFrame, members: Sequence[Feature]) -> DataFrame:
    joined = out.join(values, ["entity_id", "cutoff"], "left")
    return joined.selectExpr(*quoted(out.columns), *[settled(f) for f in members])


# -- values that do not change, and lookups of values that do ---------------------------------


def _clocks(db: Database, base: Feature | None) -> tuple[Feature, ...]:
    """Lookups of the time columns that a looked-up value has to wait for."""
    if base is None or base.kind != "lookup":
        return ()
    link = base.links[0]
    time = db.spec(link.parent).time_index
    found = [] if time is None else [lookup_feature(db.graph, link, own_feature(link.parent, time, False))]
    found += [lookup_feature(db.graph, link, c) for c in _clocks(db, base.base)]
    return tuple(found)


def _fixed_values(
    db: Database, entity: str, request: Cutoffs, fixed: Sequence[Feature], carried: DataFrame | None = None
) -> DataFrame:
    """The asked rows of visible entities with values that do not change; ``carried`` are the asked rows with more columns."""
    spec = db.spec(entity)
    clocks = {c.name: c for f in fixed for c in _clocks(db, f)}
    keep = [spec.primary_key] + ([spec.time_index] if spec.time_index else [])
    rows = feature_frame(db, entity, [*fixed, *(c for n, c in clocks.items())], None, keep)
    rows = rows.withColumnRenamed(key_name(spec.primary_key), "entity_id")
    if request.everyone:
        out = rows.withColumn("cutoff", F.explode(F.expr(moments_sql(request.anchors))))
    else:
        out = (request.rows if carried is None else carried).join(rows, "entity_id", "inner")
    if spec.time_index:
        out = out.where(F.col(key_name(spec.time_index)) <= F.col("cutoff"))
    values = []
    for f in fixed:
        seen = " AND ".join(f"`{c.name}` <= cutoff" for c in _clocks(db, f))
        values.append(f"IF({seen}, `{f.name}`, NULL) AS `{f.name}`" if seen else f"`{f.name}`")
    more = [] if carried is None else quoted(c for c in carried.columns if c not in ("entity_id", "cutoff"))
    return out.selectExpr("entity_id", "cutoff", *more, *values)


def _parent_values(db: Database, request: Cutoffs, link: Link, members: Sequence[Feature]) -> DataFrame:
    """Aggregates of a parent, computed once per ``(parent, cutoff)`` and handed to its children."""
    pk = db.spec(link.child).primary_key
    child = db.rows(link.child).select(
        F.col(pk).alias("entity_id"), F.col(link.child_column).alias("_parent")
    )
    asked = request.rows.join(child.where(F.col("_parent").isNotNull()), "entity_id", "inner")
    parents = asked.select(F.col("_parent").alias("entity_id"), "cutoff").distinct()
    values = _features_of(
        db, link.parent, Cutoffs(parents, request.anchors, request.latest), distinct_bases(members)
    )
    values = values.selectExpr(
        "entity_id AS _parent", "cutoff", *[f"`{f.base.name}` AS `{f.name}`" for f in members]
    )
    return asked.join(values, ["_parent", "cutoff"], "inner").drop("_parent")


# -- aggregates over a path -------------------------------------------------------------------


def _timed_rows(
    db: Database,
    request: Cutoffs,
    links: Sequence[Link],
    clocks: Sequence[Feature],
    bases: Sequence[Feature],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows at the end of a path: ``_group`` (first parent's key), ``_seen`` (visible from), values.

    ``keys`` are further columns of the last table, kept as ``_key_*``. Rows with an unknown time
    anywhere on the path are never visible and dropped.
    """
    last = links[-1]
    time = db.spec(last.child).time_index
    keep = dict.fromkeys([last.child_column, *keys, *([time] if time else [])])
    rows = feature_frame(db, last.child, [*bases, *clocks], None, list(keep))
    if time and request.latest is not None:
        rows = rows.where(F.col(key_name(time)) <= ntz(request.latest))
    times = ([key_name(time)] if time else []) + [c.name for c in clocks]
    for t in times:
        rows = rows.where(F.col(t).isNotNull())
    latest = f"greatest({', '.join(quoted(times))})" if len(times) > 1 else next(iter(quoted(times)), ntz_sql(ALWAYS))
    rows = rows.selectExpr(
        f"`{key_name(last.child_column)}` AS _group",
        f"{latest} AS _seen",
        *quoted(key_name(k) for k in keys),
        *quoted(b.name for b in bases),
    )
    kept = quoted([*(key_name(k) for k in keys), *(b.name for b in bases)])
    for upper, lower in zip(reversed(links[:-1]), reversed(links[1:]), strict=True):
        time = db.spec(upper.child).time_index
        steps = visible(db, upper.child, request.latest).selectExpr(
            f"`{lower.parent_column}` AS _step",
            f"`{upper.child_column}` AS _up",
            f"{ntz_sql(ALWAYS) if time is None else f'`{time}`'} AS _step_seen",
        )
        rows = rows.join(steps, F.col("_group") == F.col("_step"), "inner").selectExpr(
            "_up AS _group", "greatest(_seen, _step_seen) AS _seen", *kept
        )
    return rows.where("_group IS NOT NULL AND _seen IS NOT NULL")


def _states_for(members: Sequence[Feature]) -> tuple[list[State], list[str]]:
    """The states that the functions of a path need, and the SQL aggregates that start them."""
    states: dict[str, State] = {}
    starts: list[str] = []
    for f in members:
        value = None if f.base is None else f"CAST(`{f.base.name}` AS DOUBLE)"
        for state in _needed(f):
            if state.name in states:
                continue
            states[state.name] = state
            if state.kind == "moments":
                starts += moments_of(value, state.name)
            elif f.function == "COUNT":
                starts.append(f"count(1) AS `{state.name}`")
            elif f.function != "NUM_UNIQUE":
                merge = {"low": "min", "high": "max"}.get(state.kind, "sum")
                merge = "count" if state.name.startswith("_n_") else merge
                starts.append(f"{merge}({value}) AS `{state.name}`")
    return list(states.values()), starts


def _needed(f: Feature) -> list[State]:
    if f.function in ("COUNT", "NUM_UNIQUE"):
        return [State("add", f"_{f.name}")]
    base = f.base.name
    return {
        "SUM": [State("add", f"_s_{base}")],
        "MEAN": [State("add", f"_s_{base}"), State("add", f"_n_{base}")],
        "MIN": [State("low", f"_lo_{base}")],
        "MAX": [State("high", f"_hi_{base}")],
        "STD": [State("moments", f"_m_{base}")],
    }[f.function]


def _finish(f: Feature) -> str:
    """SQL for the feature's value from its states."""
    if f.function in ("COUNT", "NUM_UNIQUE"):
        return f"`_{f.name}`"
    base = f.base.name
    if f.function == "MEAN":
        return f"IF(`_n_{base}` > 0, `_s_{base}` / `_n_{base}`, NULL)"
    if f.function == "STD":
        return stddev_of(f"_m_{base}")
    return f"`{ {'SUM': '_s_', 'MIN': '_lo_', 'MAX': '_hi_'}[f.function]}{base}`"


def _finished(members: Sequence[Feature]) -> list[str]:
    return [f"{_finish(f)} AS `{f.name}`" for f in members]


def _counted(unique: Sequence[Feature]) -> list[Column]:
    return [F.expr(f"count_if(_which = {i}) AS `_{f.name}`") for i, f in enumerate(unique)]


def _first_seen(rows: DataFrame, unique: Sequence[Feature], keys: Sequence[str], at: str) -> DataFrame:
    """How many values each key meets for the first time at each position."""
    return (
        melt(rows, unique, *keys, at)
        .groupBy(*keys, "_which", "_value")
        .agg(F.min(at).alias(at))
        .groupBy(*keys, at)
        .agg(*_counted(unique))
    )


def _partial_states(
    rows: DataFrame, members: Sequence[Feature], keys: Sequence[str], at: str
) -> tuple[DataFrame, list[State]]:
    """States per ``(keys, at)``; map-side aggregation collapses hot keys before the shuffle.

    Numbers and categories are read apart, each with its own columns, and are two rows of a key: together,
    every category of a row would be an entry as wide as all states, and none would meet another on the map side.
    """
    states, starts = _states_for(members)
    unique = [f for f in members if f.function == "NUM_UNIQUE"]
    parts = []
    if starts:
        parts.append(rows.groupBy(*keys, at).agg(*[F.expr(sql) for sql in starts]))
    if unique:
        parts.append(_first_seen(rows, unique, keys, at))
    partial = parts[0]
    for part in parts[1:]:
        partial = partial.unionByName(part, allowMissingColumns=True)
    return partial, states


def _timeless(db: Database, links: Sequence[Link], clocks: Sequence[Feature]) -> bool:
    return not clocks and not any(db.spec(link.child).time_index for link in links)


def _path_values(
    db: Database, request: Cutoffs, links: Sequence[Link], clocks: Sequence[Feature], members: Sequence[Feature]
) -> DataFrame:
    rows = _timed_rows(db, request, links, clocks, distinct_bases(members))
    if _timeless(db, links, clocks):
        partial, _ = _partial_states(rows, members, ["_group"], "_seen")
        states, _ = _states_for(members)
        merged = partial.groupBy("_group").agg(
            # of the parts united for one key only one carries each state, so any merge will do
            *[F.expr(f"max(`{c}`) AS `{c}`") for c in columns_of(states)]
        )
        values = merged.selectExpr("_group AS entity_id", *_finished(members))
        return request.rows.join(values, "entity_id", "inner")
    rows = rows.selectExpr("*", f"{request.position('_seen')} AS _at").where("_at IS NOT NULL")
    partial, states = _partial_states(rows, members, ["_group"], "_at")
    asked = request.rows.selectExpr("entity_id AS _group", "cutoff AS _at", "1 AS _ask")
    events = partial.withColumn("_ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    running = running_merge(events, states, "_group", ["_at", "_ask"], request.scan_time("_at"))
    return running.where("_ask = 1").selectExpr("_group AS entity_id", "_at AS cutoff", *_finished(members))


# -- aggregates of aggregates -----------------------------------------------------------------


def _slots(request: Cutoffs, rows: DataFrame) -> DataFrame:
    """Adds ``_slot``: how many of the group's cutoffs lie before the row's ``_seen``."""
    if request.anchors is not None:
        return rows.selectExpr("*", f"{request.slot('_seen')} AS _slot")
    positions = rows.select("_group", "_seen").distinct().selectExpr("*", "0 AS _ask", "0L AS _slot")
    asked = request.rows.selectExpr("entity_id AS _group", "cutoff AS _seen", "1 AS _ask", "1L AS _slot")
    counted = running_merge(positions.unionByName(asked), [State("add", "_slot")], "_group", ["_seen", "_ask"], "_seen")
    found = counted.where("_ask = 0").selectExpr("_group", "_seen", "CAST(_slot AS INT) AS _slot")
    return rows.join(found, ["_group", "_seen"], "inner")


def _asked_slots(request: Cutoffs) -> tuple[DataFrame, int]:
    """Cutoffs with their slot, and the depth of the binary tree over the slots."""
    if request.anchors is not None:
        slots = request.rows.selectExpr("*", f"{request.slot('cutoff')} AS _slot")
        return slots, len(request.anchors).bit_length()
    asked = request.rows.selectExpr("*", "entity_id AS _group", "1L AS _one")
    most = asked.groupBy("_group").count().agg(F.max("count")).first()[0] or 1
    counted = running_merge(asked, [State("add", "_one")], "_group", ["cutoff"], "cutoff")
    return counted.selectExpr("entity_id", "cutoff", "CAST(_one - 1 AS INT) AS _slot"), int(most).bit_length()


def cover(start: str, stop: str, levels: int) -> str:
    """SQL for the tree nodes that together cover the slots ``[start, stop)``, two per level at most.

    Level ``k`` groups slots by ``slot >> k``; node ids are ``2**(levels - k) + (slot >> k)``.
    """
    nodes = []
    for k in range(levels + 1):
        base = 1 << (levels - k)
        left, right = f"shiftright({start} + {(1 << k) - 1}, {k})", f"shiftright({stop}, {k})"
        nodes.append(f"IF({left} < {right} AND {left} % 2 = 1, {left} + {base}, NULL)")
        nodes.append(f"IF({left} < {right} AND {right} % 2 = 1, {right} - 1 + {base}, NULL)")
    return f"array_compact(array({', '.join(nodes)}))"


def ancestors(slot: str, levels: int) -> str:
    """SQL for the nodes above and including the leaf of a slot."""
    nodes = [f"shiftright({slot}, {k}) + {1 << (levels - k)}" for k in range(levels + 1)]
    return f"array({', '.join(nodes)})"


def _members_below(members: Sequence[Feature], levels: int) -> list[list[Feature]]:
    """The aggregates of every level of a chain, outermost first."""
    found = [list(members)]
    for _ in range(levels - 1):
        found.append(distinct_bases(found[-1]))
    return found


def _owners(db: Database, request: Cutoffs, paths: Sequence[Sequence[Link]]) -> list[DataFrame]:
    """For each path the rows at its end: ``_child``, ``_up`` (their row one path above), ``_group``, ``_seen``.

    ``_group`` is the entity, and ``_seen`` the time from which all rows on the way are visible.
    """
    found: list[DataFrame] = []
    for path in paths:
        key = db.spec(path[-1].child).primary_key
        rows = _timed_rows(db, request, path, (), (), keys=[key])
        rows = rows.selectExpr(f"`{key_name(key)}` AS _child", "_group AS _up", "_seen")
        found.append(_under(rows, found[-1], ["_child"]) if found else rows.selectExpr("_child", "_up", "_up AS _group", "_seen"))
    return found


def _under(rows: DataFrame, owners: DataFrame, kept: Sequence[str]) -> DataFrame:
    """``rows`` (with ``_up`` and ``_seen``) of the given owners, with the owners' group and from when both are visible."""
    above = owners.selectExpr("_child AS _up", "_group", "_seen AS _up_seen")
    return rows.join(above, "_up", "inner").selectExpr(*kept, "_up", "_group", "greatest(_seen, _up_seen) AS _seen")


def _merged_at(
    intervals: DataFrame, members: Sequence[Feature], keys: Sequence[str], asked: DataFrame, levels: int,
    carried: Sequence[str] = (), single: bool = False,
) -> DataFrame:
    """Aggregates of the values that are alive at each asked slot; what no interval covers is left out.

    ``intervals`` hold a value over ``[_slot, _until)``, ``asked`` has the ``keys`` and ``_slot``. ``single``
    says that each interval is one slot, which needs no tree.
    """
    values = quoted(b.name for b in distinct_bases(members))
    if single:
        _, starts = _states_for(members)
        found = intervals.groupBy(*keys, "_slot").agg(*[F.expr(sql) for sql in starts])
        return asked.select(*keys, "_slot", *carried).join(found, [*keys, "_slot"], "inner").selectExpr(*keys, "_slot", *carried, *_finished(members))
    spread = intervals.selectExpr(*keys, f"explode({cover('_slot', '_until', levels)}) AS _node", *values)
    nodes, states = _partial_states(spread, members, keys, "_node")
    reads = asked.selectExpr(*keys, "_slot", *carried, f"explode({ancestors('_slot', levels)}) AS _node")
    read = reads.join(nodes, [*keys, "_node"], "inner")
    everything = f"PARTITION BY {', '.join(keys)}, _slot ORDER BY _node"
    read = read.selectExpr("*", f"lead(_node) OVER ({everything}) IS NULL AS _last")
    return merge_over(read, states, everything).where("_last").selectExpr(*keys, "_slot", *carried, *_finished(members))


def _doubles(members: Sequence[Feature], finished: bool) -> list[str]:
    """Values of aggregates that are about to be aggregated; counts and sums of nothing are zero."""
    out = []
    for f in members:
        value = f"CAST({_finish(f) if finished else f'`{f.name}`'} AS DOUBLE)"
        out.append(f"coalesce({value}, 0D) AS `{f.name}`" if f.function in ZERO_WHEN_ABSENT else f"{value} AS `{f.name}`")
    return out


def _lasting(steps: DataFrame, levels: int) -> DataFrame:
    """Adds ``_until``, the slot of the row's next step."""
    return steps.selectExpr("*", f"coalesce(lead(_slot) OVER (PARTITION BY _child, _group ORDER BY _slot), {1 << levels}) AS _until")


def _steps_of_rows(
    db: Database, request: Cutoffs, chain: Chain, owners: DataFrame, born: DataFrame, members: Sequence[Feature], levels: int
) -> DataFrame:
    """Step functions of the lowest aggregates, from plain rows: ``_child``, ``_up``, ``_group``, ``_slot``, ``_until``, values."""
    grand = _timed_rows(db, request, chain.paths[-1], chain.clocks, distinct_bases(members)).withColumnRenamed("_group", "_up")
    values = quoted(b.name for b in distinct_bases(members))
    grand = _under(grand, owners, values).withColumnRenamed("_up", "_child")
    grand = _slots(request, grand)
    # rows for each (child, slot) in which the child appears or changes, the appearance first; the last has them all
    partial, states = _partial_states(grand, members, ["_child", "_group"], "_slot")
    steps = partial.withColumn("_tie", F.lit(1)).unionByName(born.withColumn("_tie", F.lit(0)), allowMissingColumns=True)
    ordered = "PARTITION BY _child, _group ORDER BY _slot, _tie"
    steps = steps.selectExpr(
        "*", f"coalesce(lead(_slot) OVER ({ordered}), {1 << levels}) AS _until", f"first(_up, true) OVER ({ordered}) AS _owner"
    )
    steps = merge_over(steps, states, ordered).where("_slot < _until")
    return steps.selectExpr("_child", "_owner AS _up", "_group", "_slot", "_until", *_doubles(members, finished=True))


def _shared_lookups(db: Database, request: Cutoffs, chains: dict[Chain, list[Feature]]) -> dict[Chain, DataFrame]:
    """The looked-up values of each chain; a plain path reads those of a stacked one over the same links."""
    together: dict[Chain, list[Chain]] = {}
    for chain in sorted(chains, key=lambda c: -len(c.paths)):
        same = [c for c in together if len(chain.paths) == 1 and (c.links, c.asked) == (chain.links, chain.asked)]
        together.setdefault(same[0] if same else chain, []).append(chain)
    found = {}
    for first, same in together.items():
        lowest = [f for c in same for f in _members_below(chains[c], len(c.paths))[-1]]
        steps = _steps_of_lookups(db, request, first, lowest)
        found |= dict.fromkeys(same, steps if same == [first] and len(first.paths) == 1 else written(steps, "steps"))
    return found


def _steps_of_lookups(db: Database, request: Cutoffs, chain: Chain, members: Sequence[Feature]) -> DataFrame:
    """Values looked up at a parent whose aggregates move, one interval for each cutoff that can see the row.

    The parent's values are asked for once per ``(parent, cutoff)``, however many rows look there.
    """
    link, bases = chain.asked, distinct_bases(members)
    key = link.child_column
    asked, _ = _asked_slots(request)
    rows = _timed_rows(db, request, chain.paths[-1], (), (), keys=[key])
    rows = rows.selectExpr("_group AS _up", f"`{key_name(key)}` AS _parent", "_seen")
    if len(chain.paths) == 1:
        rows = rows.selectExpr("*", "_up AS _group")
    else:
        rows = _under(rows, _owners(db, request, chain.paths[:-1])[-1], ["_parent"])
    rows = rows.where("_parent IS NOT NULL").join(asked.selectExpr("entity_id AS _group", "cutoff", "_slot"), "_group", "inner")
    # read for its parents and again for their values
    rows = written(rows.where("_seen <= cutoff").select("_up", "_group", "_parent", "cutoff", "_slot"), "looking-up")
    parents = written(rows.selectExpr("_parent AS entity_id", "cutoff").distinct(), "asked-parents")
    wanted = Cutoffs(parents, request.anchors, request.latest)
    values = _features_of(db, link.parent, wanted, distinct_bases(bases))
    values = values.selectExpr("entity_id AS _parent", "cutoff", *[f"CAST(`{b.base.name}` AS DOUBLE) AS `{b.name}`" for b in bases])
    found = rows.join(written(values, "looked-up"), ["_parent", "cutoff"], "left")
    return found.selectExpr("_up", "_group", "_slot", "_slot + 1 AS _until", *quoted(b.name for b in bases))


def _steps_of_slots(steps: DataFrame, born: DataFrame, members: Sequence[Feature], levels: int) -> DataFrame:
    """Step functions of aggregates over looked-up values, which are there slot by slot from their first one on.

    Their slots need no tree: each is one group. Before its first one a row holds the values of nothing.
    """
    keys = ["_child", "_group"]
    steps = steps.withColumnRenamed("_up", "_child")
    _, starts = _states_for(members)
    each = steps.groupBy(*keys, "_slot").agg(*[F.expr(sql) for sql in starts])
    each = each.selectExpr(*keys, "_slot", "_slot + 1 AS _until", *_doubles(members, finished=True))
    first = steps.groupBy(*keys).agg(F.min("_slot").alias("_first"))
    nothing = [f"{'0D' if f.function in ZERO_WHEN_ABSENT else 'CAST(NULL AS DOUBLE)'} AS `{f.name}`" for f in members]
    before = born.join(first, keys, "left").selectExpr(*keys, "_slot", f"coalesce(_first, {1 << levels}) AS _until", *nothing)
    return each.unionByName(before.where("_slot < _until"))


def _stacked_values(
    db: Database, request: Cutoffs, chain: Chain, members: Sequence[Feature], looked_up: DataFrame | None = None
) -> DataFrame:
    """Aggregates of values that move: from the lowest level up, each the step functions of the next."""
    below = _members_below(members, len(chain.paths))
    asked, levels = _asked_slots(request)
    owners = _owners(db, request, chain.paths[:-1])
    born = [_slots(request, rows).select("_child", "_up", "_group", "_slot") for rows in owners]
    open_ = len(owners) - 1
    if not chain.asked:
        steps = _steps_of_rows(db, request, chain, owners[-1], born[-1], below[-1], levels)
    elif owners:
        steps = _steps_of_slots(looked_up, born[-1], below[-1], levels)
        if open_:  # to be merged once more, by the row above
            steps = steps.join(born[-1].select("_child", "_group", "_up"), ["_child", "_group"], "inner")
    else:
        steps = looked_up
    for i in range(open_ - 1, -1, -1):  # the step functions of the rows at the end of path i
        keys = ["_child", "_group"]
        steps = written(steps.drop("_child").withColumnRenamed("_up", "_child"), "steps")  # read for its times and its values
        changes = written(steps.select(*keys, "_slot").union(born[i].select(*keys, "_slot")).distinct(), "changes")
        values = written(_merged_at(steps, below[i + 1], keys, changes, levels), "merged")
        changed = _lasting(changes, levels).join(values, [*keys, "_slot"], "left")
        steps = changed.join(born[i].select(*keys, "_up"), keys, "inner")
        steps = steps.selectExpr("_child", "_up", "_group", "_slot", "_until", *_doubles(below[i + 1], finished=False))
    if len(chain.paths) > 1:
        steps = written(steps, "steps")
    ends = asked.selectExpr("entity_id AS _group", "cutoff", "_slot")
    merged = _merged_at(steps, members, ["_group"], ends, levels, ["cutoff"], single=bool(chain.asked) and not owners)
    return merged.selectExpr("_group AS entity_id", "cutoff", *quoted(f.name for f in members))
