"""Built-in column expressions only; nothing here leaves the JVM."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.params import Window
from innsight.schemas import UMBRALES_VIP

MONEY_DIGITS = 12
MONEY = f"decimal({MONEY_DIGITS},2)"
SUM_MONEY = "decimal(22,2)"


def full_name(prefix: str = "") -> Column:
    """``nombres apellidos``; NULL when either part is NULL."""
    return F.concat(F.col(f"{prefix}nombres"), F.lit(" "), F.col(f"{prefix}apellidos"))


def text_key(column: str | Column, ci_ai: bool) -> Column:
    """The text itself, or a form that ignores case and accents when compared."""
    c = F.col(column) if isinstance(column, str) else column
    return F.collate(c, "UNICODE_CI_AI") if ci_ai else c


def half_open(column: str | Column, window: Window) -> Column:
    """``start <= column < end`` on the bare column, so it prunes row groups."""
    c = F.col(column) if isinstance(column, str) else column
    return (c >= F.lit(window.start)) & (c < F.lit(window.end))


def field_rank(column: str | Column, values: Sequence[str]) -> Column:
    """1-based position of the value in an explicit order; 0 when unlisted or NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """Exact quotient rounded half up to two places; NULL when ``whole`` is 0 or NULL.

    Divided as decimals: a binary quotient can fall on the wrong side of a tie.
    """
    exact = F.try_divide(part.cast("decimal(24,2)"), whole.cast("decimal(20,0)"))
    return F.round(exact, 2).cast("double")


def percentage(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed hours, truncated."""
    return F.timestamp_diff("HOUR", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def whole_days(start: Column, end: Column) -> Column:
    """Difference of the calendar dates, time of day ignored."""
    return F.datediff(end.cast("date"), start.cast("date"))


def month_of(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def nights(start: str, end: str) -> Column:
    """One calendar date per night of ``[start, end)``; empty for an empty range."""
    last = F.date_sub(F.col(end), 1)
    return F.when(F.col(end) > F.col(start), F.sequence(F.col(start), last)).otherwise(
        F.array().cast("array<date>")
    )


def month_nights(start: str, end: str) -> Column:
    """Exploded ``{mes, mascara}`` per month that ``[start, end)`` touches: one bit per night, the first of a month lowest."""
    first = F.trunc(F.col(start), "month")
    months = F.when(F.col(end) > F.col(start), F.sequence(first, F.date_sub(F.col(end), 1), F.expr("interval 1 month")))

    def bits(month: Column) -> Column:
        low = F.greatest(F.datediff(F.col(start), month), F.lit(0))
        high = F.least(F.datediff(F.col(end), month), F.dayofmonth(F.last_day(month)))
        one = F.lit(1).cast("long")
        nights = F.call_function("shiftleft", one, high) - F.call_function("shiftleft", one, low)
        return F.struct(month.alias("mes"), nights.alias("mascara"))

    return F.explode(F.transform(months, bits))


def ntz(moment: dt.datetime) -> Column:
    """A zone-less timestamp literal, whatever the zone of driver or session."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def money(value: Column) -> Column:
    return F.round(value, 2).cast(MONEY)


def beyond_money(value: Column) -> Column:
    """Whether an amount, rounded to cents, is wider than a stored amount."""
    return F.abs(F.round(value, 2)) >= F.lit(10 ** (MONEY_DIGITS - 2))


def total_money(column: str | Column) -> Column:
    """Exact sum of a money column."""
    return F.sum(column).cast(SUM_MONEY)


def greatest_strict(*columns: Column) -> Column:
    """``greatest`` that is NULL as soon as one argument is NULL."""
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, F.greatest(*columns))


def vip_level(count: Column, otherwise: Column, offset: int = 0) -> Column:
    """Level reached by a booking count; ``otherwise`` below the lowest threshold."""
    level = None
    for threshold, name in UMBRALES_VIP:
        reached = count >= threshold - offset
        level = F.when(reached, F.lit(name)) if level is None else level.when(reached, F.lit(name))
    return level.otherwise(otherwise)
