"""Report parameters: every date comes in as an argument, none from the clock."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass


def add_months(day: dt.date, months: int) -> dt.date:
    """Month arithmetic that clamps to the last day of the target month."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    month += 1
    last = calendar.monthrange(year, month)[1]
    return dt.date(year, month, min(day.day, last))


@dataclass(frozen=True)
class Window:
    """Half-open date range ``[start, end)``."""

    start: dt.date
    end: dt.date


@dataclass(frozen=True)
class Params:
    """The business date plus optional overrides of the default windows."""

    hoy: dt.date
    month: Window | None = None
    year: Window | None = None

    @property
    def last_month(self) -> Window:
        return self.month or Window(add_months(self.hoy, -1), self.tomorrow)

    @property
    def last_year(self) -> Window:
        return self.year or Window(add_months(self.hoy, -12), self.tomorrow)

    @property
    def tomorrow(self) -> dt.date:
        return self.hoy + dt.timedelta(days=1)
