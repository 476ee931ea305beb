"""Labels: an aggregate over a future window for every entity that exists at the anchor.

The target rows are reduced to mergeable partial states as early as possible: first per key of the
last hop, then re-merged after each join on the way back to the entity. A hot key is collapsed
before it is shuffled, and no join ever carries raw target rows past the first hop.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpredict.functions.times import moments_before, ntz, ntz_sql, shift_column
from relpredict.schema import Database
from relpredict.task import PredictiveTask, TaskError, as_predicate


# -- anchors ---------------------------------------------------------------------------------


def time_range(db: Database, task: PredictiveTask) -> DataFrame:
    """One row ``(min_time, max_time)`` of the target's time index."""
    task.check(db)
    time = db.spec(task.table).time_index
    return db.rows(task.table).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def anchors_frame(db: Database, task: PredictiveTask) -> DataFrame:
    """One row ``(train_anchor, test_anchor)``.

    The test anchor lies one horizon before the last target row and the train anchor one more
    before that. When the data is too short for that, both are thirds of its range. Both are
    floored to midnight.
    """
    days = task.window.horizon.days
    lo, hi = F.col("min_time"), F.col("max_time")
    test = shift_column(hi, -days, "days")
    train = shift_column(hi, -2 * days, "days")
    third = F.timestamp_diff("MICROSECOND", lo, hi) / 3

    def after(share: int) -> Column:
        return F.timestamp_add("MICROSECOND", F.floor(third * share).cast("bigint"), lo)

    short = train <= lo
    return time_range(db, task).select(
        F.date_trunc("day", F.when(short, after(1)).otherwise(train))
        .cast("timestamp_ntz").alias("train_anchor"),
        F.date_trunc("day", F.when(short, after(2)).otherwise(test))
        .cast("timestamp_ntz").alias("test_anchor"),
    )


def default_anchors(db: Database, task: PredictiveTask) -> tuple[dt.datetime, dt.datetime]:
    """(train, test) on the driver; refuses an empty target."""
    row = anchors_frame(db, task).first()
    if row is None or row.train_anchor is None:
        raise TaskError(f"target table {task.table!r} has no rows with a time")
    return row.train_anchor, row.test_anchor


def window_bounds(anchors: DataFrame, task: PredictiveTask, anchor: str = "anchor") -> DataFrame:
    """Adds the half-open bounds ``(lo, hi]`` of the task window to each anchor."""
    lo, hi = task.window.bound_columns(F.col(anchor))
    return anchors.withColumns({"lo": lo, "hi": hi})


# -- parts -----------------------------------------------------------------------------------


def entity_universe(db: Database, task: PredictiveTask, anchor: dt.datetime | None) -> DataFrame:
    """Keys of the entities that exist at the anchor and satisfy ``assuming``.

    An entity without a time column always exists; one with an unknown time never does.
    """
    task.check(db)
    spec = db.spec(task.entity)
    rows = db.rows(task.entity)
    if spec.time_index is not None and anchor is not None:
        rows = rows.where(F.col(spec.time_index) <= ntz(anchor))
    if task.assuming is not None:
        rows = rows.where(as_predicate(task.assuming))
    return rows.select(F.col(spec.primary_key).alias("entity_id"))


def window_events(db: Database, task: PredictiveTask, anchor: dt.datetime) -> DataFrame:
    """Target rows inside the future window that pass the ``where`` filter, all columns."""
    task.check(db)
    lo, hi = task.window.bounds(anchor)
    return _events(db, task, lo, hi)


def join_chain(db: Database, start: str, goal: str) -> DataFrame:
    """Raw inner joins along the shortest link path, one row per joined tuple, no filters.

    Joins through a parent fan out, and that is kept: callers count join rows.
    """
    out = db.rows(start)
    for hop in db.graph.join_path(start, goal):
        out = out.join(db.rows(hop.table), F.col(hop.from_column) == F.col(hop.to_column), "inner")
    return out


def _events(db: Database, task: PredictiveTask, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    time = F.col(db.spec(task.table).time_index)
    rows = db.rows(task.table).where((time > ntz(lo)) & (time <= ntz(hi)))
    wanted = task.predicates().get(task.table)
    return rows if wanted is None else rows.where(wanted)


# -- partial states --------------------------------------------------------------------------


def _first_states(task: PredictiveTask) -> list[Column]:
    value = None if task.column is None else F.col(task.column)
    n = F.count(F.lit(1)) if value is None else F.count(value)
    return {
        "COUNT": lambda: [n.alias("_n")],
        "SUM": lambda: [F.sum(value).alias("_v")],
        "AVG": lambda: [n.alias("_n"), F.sum(value.cast("double")).alias("_v")],
        "MIN": lambda: [F.min(value).alias("_v")],
        "MAX": lambda: [F.max(value).alias("_v")],
    }[task.func]()


def _merged_states(task: PredictiveTask) -> list[Column]:
    value = {"MIN": F.min, "MAX": F.max}.get(task.func, F.sum)
    return {
        "COUNT": lambda: [F.sum("_n").alias("_n")],
        "AVG": lambda: [F.sum("_n").alias("_n"), F.sum("_v").alias("_v")],
    }.get(task.func, lambda: [value("_v").alias("_v")])()


def _final_value(task: PredictiveTask) -> Column:
    if task.func == "COUNT":
        return F.col("_n")
    if task.func == "AVG":
        return F.when(F.col("_n") > 0, F.col("_v") / F.col("_n"))
    return F.col("_v")


def _entity_states(
    db: Database, task: PredictiveTask, events: DataFrame, extra: Sequence[str] = ()
) -> DataFrame:
    """Reduce events to partial states per entity key (plus ``extra`` grouping columns)."""
    predicates = task.predicates()
    hops = db.graph.join_path(task.entity, task.table)
    pk = db.spec(task.entity).primary_key
    landing = hops[-1].to_column if hops else pk
    states = events.groupBy(F.col(landing).alias("_key"), *extra).agg(*_first_states(task))
    for position in range(len(hops) - 1, -1, -1):
        hop = hops[position]
        source = task.entity if position == 0 else hops[position - 1].table
        group = pk if position == 0 else hops[position - 1].to_column
        if position == 0 and hop.from_column == pk and source not in predicates:
            break  # the states already carry the entity key; the universe join drops orphans
        rows = db.rows(source)
        if source in predicates:
            rows = rows.where(predicates[source])
        link = rows.select(F.col(hop.from_column).alias("_key"), F.col(group).alias("_next"))
        states = (
            link.join(states, "_key", "inner")
            .groupBy(F.col("_next").alias("_key"), *extra)
            .agg(*_merged_states(task))
        )
    return states


def _values(task: PredictiveTask, states: DataFrame, *extra: str) -> DataFrame:
    return states.select(F.col("_key").alias("entity_id"), *extra, _final_value(task).alias("_value"))


def label_column(task: PredictiveTask, value: Column) -> Column:
    """0/1 from the comparison of a classification, the value as a double otherwise."""
    if task.compare is None:
        return value.cast("double")
    sign, number = task.compare
    against = F.lit(number)
    return {
        "==": value == against,
        "!=": value != against,
        ">": value > against,
        ">=": value >= against,
        "<": value < against,
        "<=": value <= against,
    }[sign].cast("int")


def _labelled(task: PredictiveTask, joined: DataFrame, fill: float | None) -> DataFrame:
    value = F.col("_value") if fill is None else F.coalesce(F.col("_value"), F.lit(fill))
    return joined.withColumn("target_value", value).select(
        "entity_id", "cutoff", "target_value", label_column(task, F.col("target_value")).alias("label")
    )


# -- label tables ----------------------------------------------------------------------------


def build_labels(
    db: Database, task: PredictiveTask, anchor: dt.datetime, fill: float | None = 0
) -> DataFrame:
    """``(entity_id, cutoff, target_value, label)`` at one anchor.

    Entities without a matching event get ``fill``, whatever the aggregate; ``fill=None`` keeps
    the null.
    """
    universe = entity_universe(db, task, anchor)
    values = _values(task, _entity_states(db, task, window_events(db, task, anchor)))
    joined = universe.join(values, "entity_id", "left").withColumn("cutoff", ntz(anchor))
    return _labelled(task, joined, fill)


def build_labels_many(
    db: Database, task: PredictiveTask, anchors: Sequence[dt.datetime], fill: float | None = 0
) -> DataFrame:
    """Labels for a list of anchors in one pass over the target.

    The windows cut time into panes. Each event falls into exactly one pane and is aggregated
    there; only the small pane states are then copied to every anchor whose window covers them.
    Overlapping windows therefore cost states, not rows.
    """
    task.check(db)
    anchors = sorted(set(anchors))
    bounds = [task.window.bounds(a) for a in anchors]
    edges = sorted({edge for pair in bounds for edge in pair})
    # pane i = (edges[i], edges[i + 1]]; windows of sorted anchors begin and end in order, so the anchors
    # that cover a pane follow each other, from first[i] up to last[i]
    starts, ends = [lo for lo, _ in bounds], [hi for _, hi in bounds]
    first = [bisect_left(ends, edge) for edge in edges[1:]]
    last = [bisect_right(starts, edge) - 1 for edge in edges[:-1]]
    pane = moments_before(f"`{db.spec(task.table).time_index}`", edges[1:])
    events = _events(db, task, edges[0], edges[-1]).withColumn("_pane", F.expr(pane))
    begin, end = (f"element_at(array({', '.join(map(str, places))}), _pane + 1)" for places in (first, last))
    if any(a > b for a, b in zip(first, last, strict=True)):
        events = events.where(f"{begin} <= {end}")
    panes = _entity_states(db, task, events, ["_pane"])
    copied = panes.withColumn("_anchor", F.expr(f"explode(sequence({begin}, {end}))"))
    states = copied.groupBy("_key", "_anchor").agg(*_merged_states(task))

    listed = ", ".join(f"named_struct('k', {k}, 'at', {ntz_sql(a)})" for k, a in enumerate(anchors))
    universe = _universe_with_time(db, task).withColumn("_a", F.expr(f"explode(array({listed}))"))
    universe = universe.where(F.coalesce(F.col("_born") <= F.col("_a.at"), F.col("_timeless")))
    joined = universe.select("entity_id", F.col("_a.k").alias("_anchor"), F.col("_a.at").alias("cutoff")).join(
        _values(task, states, "_anchor"), ["entity_id", "_anchor"], "left"
    )
    return _labelled(task, joined, fill)


def _universe_with_time(db: Database, task: PredictiveTask) -> DataFrame:
    spec = db.spec(task.entity)
    rows = db.rows(task.entity)
    if task.assuming is not None:
        rows = rows.where(as_predicate(task.assuming))
    born = F.lit(None).cast("timestamp_ntz") if spec.time_index is None else F.col(spec.time_index)
    return rows.select(
        F.col(spec.primary_key).alias("entity_id"),
        born.alias("_born"),
        F.lit(spec.time_index is None).alias("_timeless"),
    )
