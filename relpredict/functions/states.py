"""Mergeable aggregate states and their running merge over an ordered group.

A state set is a list of columns of four kinds: ``add`` (summed), ``low`` / ``high`` (min / max)
and ``moments`` (count, mean and sum of squared deviations, merged without cancellation).
Expressions are SQL strings, so a wide state set costs one call per projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """One mergeable state; ``moments`` owns the columns ``name_n``, ``name_mu``, ``name_m2``."""

    kind: str
    name: str

    @property
    def columns(self) -> list[str]:
        if self.kind == "moments":
            return [f"{self.name}_n", f"{self.name}_mu", f"{self.name}_m2"]
        return [self.name]


def columns_of(states: Iterable[State]) -> list[str]:
    return [c for s in states for c in s.columns]


def quoted(names: Iterable[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def moments_of(value: str, name: str) -> list[str]:
    """Aggregates that start a ``moments`` state from raw values.

    The mean is taken from the sum and the count, which other states of the same value keep as well; ``avg``
    would carry both a second time.
    """
    return [
        f"count({value}) AS `{name}_n`",
        f"sum({value}) / nullif(count({value}), 0) AS `{name}_mu`",
        f"var_pop({value}) * count({value}) AS `{name}_m2`",
    ]


def stddev_of(name: str) -> str:
    """Sample deviation from a ``moments`` state, null below two values."""
    return f"IF(`{name}_n` > 1, sqrt(greatest(`{name}_m2`, 0D) / (`{name}_n` - 1)), NULL)"


def merge_over(frame: DataFrame, states: Sequence[State], ordered: str, last: str = "CURRENT ROW") -> DataFrame:
    """Replace every state by its merge over the rows so far.

    ``ordered`` is the window as SQL (``PARTITION BY … ORDER BY …``); ``last="1 PRECEDING"`` leaves
    the row itself out. Deviations are taken from the first mean of the group rather than from
    zero, so a large mean with a small spread keeps its digits, and nothing after the row is used.
    """
    moments = [s.name for s in states if s.kind == "moments"]
    over = f"OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"
    so_far = f"OVER ({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    names = set(columns_of(states))
    untouched = quoted(c for c in frame.columns if c not in names)
    if moments:
        frame = frame.selectExpr("*", *[f"first(`{m}_mu`, true) {so_far} AS `{m}_from`" for m in moments])
    merged, kept = [], []
    for s in states:
        m = s.name
        if s.kind == "moments":
            off = f"(`{m}_mu` - `{m}_from`)"
            merged.append(f"sum(`{m}_n`) {over} AS `{m}_n`")
            merged.append(f"sum(`{m}_n` * {off}) {over} AS `{m}_a`")
            merged.append(f"sum(`{m}_m2` + `{m}_n` * {off} * {off}) {over} AS `{m}_q`")
            merged.append(f"`{m}_from`")
            kept.append(f"`{m}_n`")
            kept.append(f"IF(`{m}_n` > 0, `{m}_from` + `{m}_a` / `{m}_n`, NULL) AS `{m}_mu`")
            kept.append(f"IF(`{m}_n` > 0, `{m}_q` - `{m}_a` * `{m}_a` / `{m}_n`, NULL) AS `{m}_m2`")
        else:
            merge = {"add": "sum", "low": "min", "high": "max"}[s.kind]
            merged.append(f"{merge}(`{m}`) {over} AS `{m}`")
            kept.append(f"`{m}`")
    frame = frame.selectExpr(*untouched, *merged)
    return frame.selectExpr(*untouched, *kept) if moments else frame


def merge_pair(states: Sequence[State], left: str, right: str) -> list[str]:
    """Merge the states of two joined sides, named ``left + column`` and ``right + column``."""
    out = []
    for s in states:
        a, b = f"`{left}{s.name}`", f"`{right}{s.name}`"
        if s.kind == "add":
            out.append(f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {a} + {b} END AS `{s.name}`")
        elif s.kind in ("low", "high"):
            pick = "least" if s.kind == "low" else "greatest"  # both skip nulls
            out.append(f"{pick}({a}, {b}) AS `{s.name}`")
        else:
            n1, n2 = (f"coalesce(`{x}{s.name}_n`, 0)" for x in (left, right))
            u1, u2 = (f"`{x}{s.name}_mu`" for x in (left, right))
            q1, q2 = (f"`{x}{s.name}_m2`" for x in (left, right))
            one_side = f"CASE WHEN {n2} = 0 THEN {{0}} WHEN {n1} = 0 THEN {{1}} ELSE {{2}} END"
            mean = f"{u1} + ({u2} - {u1}) * {n2} / ({n1} + {n2})"
            spread = f"{q1} + {q2} + ({u2} - {u1}) * ({u2} - {u1}) * {n1} * {n2} / ({n1} + {n2})"
            out.append(f"{n1} + {n2} AS `{s.name}_n`")
            out.append(f"{one_side.format(u1, u2, mean)} AS `{s.name}_mu`")
            out.append(f"{one_side.format(q1, q2, spread)} AS `{s.name}_m2`")
    return out


def running_merge(frame: DataFrame, states: Sequence[State], group: str, order: Sequence[str], time: str | None) -> DataFrame:
    """Replace every state by its merge over all earlier rows of the same group, inclusive.

    A prefix scan in two levels, the same for every group: rows are merged within the days of their
    ``time``, the days' totals are merged per group, and each day takes over what was merged before it.
    No task orders more than a day of a group, or a row per day of it, however crowded a group is.
    ``time=None`` says that a group has few rows by construction; it is then one window.
    Rows of equal ``order`` must already be merged by the caller.
    """
    sorting = ", ".join(quoted(order))
    if time is None:
        return merge_over(frame, states, f"PARTITION BY `{group}` ORDER BY {sorting}")
    names = columns_of(states)
    ordered = f"PARTITION BY `{group}`, _day ORDER BY {sorting}"
    keep = quoted(c for c in frame.columns if c not in names)
    # the join below drops rows without group or day: with that said here, and the columns in the order
    # of what follows, both readers plan one and the same shuffle
    days = frame.selectExpr(*keep, f"to_date(`{time}`) AS _day", *quoted(names)).where(f"`{group}` IS NOT NULL AND _day IS NOT NULL")
    inside = merge_over(days.selectExpr("*", f"lead(1) OVER ({ordered}) IS NULL AS _last"), states, ordered)
    totals = inside.where("_last").selectExpr(f"`{group}`", "_day", *quoted(names))
    carry = merge_over(totals, states, f"PARTITION BY `{group}` ORDER BY _day", last="1 PRECEDING").selectExpr(
        f"`{group}` AS _carry_group", "_day AS _carry_day", *[f"`{c}` AS `_carry_{c}`" for c in names]
    )
    joined = inside.withColumnsRenamed({c: f"_here_{c}" for c in names}).join(
        carry, (F.col(group) == F.col("_carry_group")) & (F.col("_day") == F.col("_carry_day")), "inner"
    )
    return joined.selectExpr(*keep, *merge_pair(states, "_carry_", "_here_"))
