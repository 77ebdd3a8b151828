"""Calendar expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def month_diff(later: Column, earlier: Column) -> Column:
    """Number of month boundaries between two dates (not elapsed months)."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("bigint")


def month_index(day: Column) -> Column:
    """Running month number, used as an equi-join bucket."""
    return F.year(day) * 12 + F.month(day)


def prev_month_end(day: Column) -> Column:
    return F.date_sub(F.trunc(day, "month"), 1)


def is_month_end(day: Column) -> Column:
    return F.last_day(day) == day


def last_closed_month(today: dt.date) -> dt.date:
    """Month end before ``today``; the caller always passes the day explicitly."""
    return today.replace(day=1) - dt.timedelta(days=1)


def months_before(day: dt.date, months: int) -> Column:
    """Literal look-back date, clamped to the month's last day."""
    return F.add_months(F.lit(day), -months)


def send_calendar(day: Column) -> dict[str, Column]:
    """Calendar features of a send date: month, weekday with Monday as 0, two season flags."""
    month = F.month(day)
    return {
        "mes_envio": month.cast("double"),
        "dia_semana_envio": F.weekday(day).cast("double"),
        "es_cyber_month": (month == 11).cast("double"),
        "es_diciembre": (month == 12).cast("double"),
    }


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
