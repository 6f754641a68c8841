"""Rounding, safe division and calendar windows."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(value: Column, places: int = 0) -> Column:
    """Rounds half up towards plus infinity, as `floor(x * 10^places + 0.5) / 10^places`; null stays null."""
    scale = float(10**places)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as doubles; null where the whole is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def exact_sum(value: Column, places: int = 8) -> Column:
    """Sum of doubles as decimals of so many places: the same in whatever order tasks bring them, as a sum of doubles is not."""
    return F.sum(value.cast(f"decimal(38,{places})")).cast("double")


def double_sum(value: Column) -> Column:
    """Sum of doubles as they are, rounded once: the same in any order of tasks, and for two values what adding them gives.

    Whole and broken parts are summed as integers, the latter in units of 2^-62.  Values with smaller bits and sums beyond 2^62
    are taken as decimals (`exact_sum`).
    """
    unit = F.lit(2**62)
    whole = value.try_cast("bigint")
    part = (value - whole) * unit.cast("double")
    units = part.try_cast("bigint")
    total = F.sum(whole.cast("decimal(20,0)")) * unit.cast("decimal(19,0)") + F.sum(units.cast("decimal(20,0)"))
    fits = (F.sum(F.abs(value)) < unit.cast("double")) & F.bool_and(part == units.cast("double"))
    return F.when(fits, total.cast("double") / unit.cast("double")).otherwise(exact_sum(value))


def months_back(as_of: date, months: int) -> date:
    """The date so many calendar months earlier; days past the end of that month run over into the next."""
    count = as_of.year * 12 + as_of.month - 1 - months
    year, month = divmod(count, 12)
    return date(year, month + 1, 1) + timedelta(days=as_of.day - 1)


def month_starts_after(as_of: date, count: int) -> list[date]:
    """First days of the next `count` calendar months."""
    out, day = [], as_of.replace(day=1)
    for _ in range(count):
        day += timedelta(days=monthrange(day.year, day.month)[1])
        out.append(day)
    return out


@dataclass(frozen=True)
class Window:
    """A stretch of dates with both ends included."""

    start: date
    end: date

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))


def trailing_months(as_of: date, months: int) -> Window:
    return Window(months_back(as_of, months), as_of)


def trailing_days(as_of: date, days: int) -> Window:
    return Window(as_of - timedelta(days=days), as_of)


def quarters(as_of: date) -> list[Window]:
    """Four chained windows of three months, oldest first; neighbours share their border date."""
    ends = [months_back(as_of, 3 * i) for i in range(4)]
    return [Window(months_back(e, 3), e) for e in reversed(ends)]
