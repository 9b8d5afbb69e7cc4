"""Bank dates: strict parsing, calendar arithmetic, comparison periods."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def bank_date(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a bank date: {text}")
    return date.fromisoformat(text)


def bank_date_column(text: Column) -> Column:
    """Null for what is no strict calendar date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def month_start(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}", text):
        raise ValueError(f"not a month: {text}")
    return date.fromisoformat(f"{text}-01")


def shift_months(day: date, n: int) -> date:
    """The same day n months on, or the last day of a shorter month."""
    year, month = divmod(day.year * 12 + day.month - 1 + n, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def shift_years(day: date, n: int) -> date:
    return shift_months(day, 12 * n)


def local_date(instant: datetime, zone: str = "America/Sao_Paulo") -> date:
    """The date at an instant, which must carry its offset."""
    if instant.tzinfo is None:
        raise ValueError("an instant needs an offset")
    return instant.astimezone(ZoneInfo(zone)).date()


def local_date_column(instant: Column, zone: str | Column = "America/Sao_Paulo") -> Column:
    return F.from_utc_timestamp(instant, zone).cast("date")


@dataclass(frozen=True)
class Period:
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def comparison(current: Period, kind: str, custom: Period | None = None, same_days: bool = False) -> tuple[Period, Period]:
    """The current period and the one that it is compared with; same_days cuts both to the shorter one."""
    if kind == "PREVIOUS_PERIOD":
        end = current.start - timedelta(days=1)
        other = Period(end - timedelta(days=current.days - 1), end)
    elif kind == "PREVIOUS_MONTH":
        other = Period(shift_months(current.start, -1), shift_months(current.end, -1))
    elif kind == "PREVIOUS_YEAR":
        other = Period(shift_years(current.start, -1), shift_years(current.end, -1))
    elif kind == "CUSTOM" and custom is not None:
        other = custom
    else:
        raise ValueError(f"no such comparison: {kind}")
    if max(current.days, other.days) > 367 or min(current.days, other.days) < 1:
        raise ValueError("a period must hold 1 to 367 days")
    if same_days:
        n = timedelta(days=min(current.days, other.days) - 1)
        current, other = Period(current.start, current.start + n), Period(other.start, other.start + n)
    return current, other
