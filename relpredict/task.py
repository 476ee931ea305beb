"""A predictive question as a plain object: target aggregate, future window, entity, filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from relpredict.functions.times import UNIT_DAYS, shift, shift_column
from relpredict.schema import Database, SchemaError

Predicate = Column | str

# Aggregate names of a target (MEAN is an alias) and comparison signs of a label.
AGGREGATES = {"COUNT": "COUNT", "SUM": "SUM", "AVG": "AVG", "MEAN": "AVG", "MIN": "MIN", "MAX": "MAX"}
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")


class TaskError(ValueError):
    """The question cannot be asked of this database."""


@dataclass(frozen=True)
class FutureWindow:
    """Half-open window ``(anchor + start, anchor + end]``; it must lie in the future."""

    start: int
    end: int
    unit: str = "days"

    def __post_init__(self) -> None:
        if self.unit not in UNIT_DAYS:
            raise TaskError(f"unknown unit {self.unit!r}, expected one of {sorted(UNIT_DAYS)}")
        if not 0 <= self.start < self.end:
            raise TaskError(f"window ({self.start}, {self.end}] must satisfy 0 <= start < end")

    @property
    def horizon(self) -> dt.timedelta:
        return dt.timedelta(days=self.end * UNIT_DAYS[self.unit])

    def bounds(self, anchor: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        return shift(anchor, self.start, self.unit), shift(anchor, self.end, self.unit)

    def bound_columns(self, anchor: Column) -> tuple[Column, Column]:
        return (
            shift_column(anchor, self.start, self.unit),
            shift_column(anchor, self.end, self.unit),
        )


@dataclass(frozen=True)
class PredictiveTask:
    """``AGG(table.column)`` over a future window, per entity.

    ``where`` restricts the rows that count: one predicate on the target table, or a mapping from
    any table on the join path to its predicate. ``assuming`` restricts the entities. Predicates
    are Spark ``Column``s or SQL strings with full Boolean logic. ``compare`` turns the value into
    a 0/1 label and the task into a classification.
    """

    entity: str
    func: str
    table: str
    window: FutureWindow
    column: str | None = None
    compare: tuple[str, float] | None = None
    where: Predicate | Mapping[str, Predicate] | None = None
    assuming: Predicate | None = None

    def __post_init__(self) -> None:
        if self.func.upper() not in AGGREGATES:
            raise TaskError(f"unknown aggregate {self.func!r}")
        object.__setattr__(self, "func", AGGREGATES[self.func.upper()])
        if self.column is None and self.func != "COUNT":
            raise TaskError(f"{self.func} needs a column, only COUNT accepts all rows")
        if self.compare is not None and self.compare[0] not in COMPARISONS:
            raise TaskError(f"unknown comparison {self.compare[0]!r}")

    @property
    def is_classification(self) -> bool:
        return self.compare is not None

    def predicates(self) -> dict[str, Column]:
        if self.where is None:
            return {}
        given = self.where if isinstance(self.where, Mapping) else {self.table: self.where}
        return {table: as_predicate(p) for table, p in given.items()}

    def describe(self) -> str:
        w = self.window
        text = f"{self.func}({self.table}.{self.column or '*'}, {w.start}, {w.end}, {w.unit})"
        if self.compare:
            text += f" {self.compare[0]} {self.compare[1]:g}"
        return f"{text} per {self.entity}"

    def check(self, db: Database) -> None:
        """Refuse a task early: tables, key, columns, target time and join path must exist."""
        try:
            if db.spec(self.entity).primary_key is None:
                raise TaskError(f"entity table {self.entity!r} has no primary key")
            target = db.spec(self.table)
            if target.time_index is None:
                raise TaskError(f"target table {self.table!r} has no time column")
            if self.column is not None:
                target.column(self.column)
            hops = db.graph.join_path(self.entity, self.table)
        except SchemaError as error:
            raise TaskError(str(error)) from error
        on_path = {self.entity} | {hop.table for hop in hops}
        astray = set(self.predicates()) - on_path
        if astray:
            raise TaskError(f"filter tables {sorted(astray)} are not on the join path")


def as_predicate(predicate: Predicate) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def churn(entity: str, event: str, days: int = 30, **filters) -> PredictiveTask:
    """Which entities will have no event in the window?"""
    return PredictiveTask(
        entity, "COUNT", event, FutureWindow(0, days, "days"), compare=("==", 0), **filters
    )


def demand(entity: str, event: str, column: str, months: int = 3, **filters) -> PredictiveTask:
    """How much of a column will each entity accumulate?"""
    return PredictiveTask(
        entity, "SUM", event, FutureWindow(0, months, "months"), column=column, **filters
    )


def event_risk(entity: str, event: str, days: int = 60, **filters) -> PredictiveTask:
    """Which entities will have at least one event in the window?"""
    return PredictiveTask(
        entity, "COUNT", event, FutureWindow(0, days, "days"), compare=(">", 0), **filters
    )
