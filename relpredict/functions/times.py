"""Time arithmetic: the same shift on the driver (datetime) and in a query (Column)."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of a task window and the days each one counts for in a horizon.
UNIT_DAYS = {"days": 1, "weeks": 7, "months": 30}
FEW = 8  # moments that a time is compared with one by one rather than by a search


def ntz_sql(moment: dt.datetime) -> str:
    """A TIMESTAMP_NTZ literal; a Python datetime would be zoned and cast the data side."""
    return f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ', timespec='microseconds')}'"


def ntz(moment: dt.datetime) -> Column:
    return F.expr(ntz_sql(moment))


def shift(moment: dt.datetime, amount: int, unit: str) -> dt.datetime:
    """Move by days, weeks or calendar months; months clamp to the end of the month."""
    if unit == "months":
        years, month = divmod(moment.month - 1 + amount, 12)
        year = moment.year + years
        last = calendar.monthrange(year, month + 1)[1]
        return moment.replace(year=year, month=month + 1, day=min(moment.day, last))
    return moment + dt.timedelta(days=amount * UNIT_DAYS[unit])


def shift_column(moment: Column, amount: int, unit: str) -> Column:
    """``shift`` on a column. ``add_months`` would drop the time of day."""
    return moment + F.make_interval(**{unit: F.lit(amount)})


def moments_sql(moments: Sequence[dt.datetime]) -> str:
    return f"array({', '.join(map(ntz_sql, moments))})"


def moments_before(time: str, moments: Sequence[dt.datetime]) -> str:
    """SQL for how many of the sorted ``moments`` lie before a time (null for an unknown one).

    A binary search in a constant array: its steps grow with the logarithm of the list, and the
    expression has one size for any list. A list of ``FEW`` moments is a sum of comparisons, which
    compiles to plain code; the search is a lambda that is interpreted for every row.
    """
    if 0 < len(moments) <= FEW:
        return f"({' + '.join(f'CAST({ntz_sql(m)} < {time} AS INT)' for m in moments)})"
    middle = "shiftright(s.lo + s.hi, 1)"
    right, left = f"named_struct('lo', {middle} + 1, 'hi', s.hi)", f"named_struct('lo', s.lo, 'hi', {middle})"
    step = f"IF(s.lo < s.hi, IF(element_at({moments_sql(moments)}, {middle} + 1) < {time}, {right}, {left}), s)"
    found = f"aggregate(sequence(1, {len(moments).bit_length()}), named_struct('lo', 0, 'hi', {len(moments)}), (s, i) -> {step}, s -> s.lo)"
    return f"IF({time} IS NULL, NULL, {found})" if moments else f"IF({time} IS NULL, NULL, 0)"


def seconds(moment: Column) -> Column:
    """Seconds since 1970 of a zone-less time, without a detour through the session's zone."""
    days = F.unix_date(F.to_date(moment)).cast("bigint")
    return days * 86400 + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
