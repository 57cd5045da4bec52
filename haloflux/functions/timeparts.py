"""Time selection and truncation on TIMESTAMP_NTZ, independent of the session zone.

Selections are half-open range predicates on the bare column, so they reach the Parquet
scan as pushed filters and prune ``ocean_date`` partitions where those exist.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _parse(text: str) -> tuple[datetime, datetime, bool]:
    """Start, end and whether ``text`` names a period (True) or an instant (False)."""
    whole, _, fraction = text.strip().partition(".")
    parts = [int(p) for p in re.split(r"[-T :]+", whole)]
    if fraction:
        if len(parts) < 6 or not fraction.isdigit() or len(fraction) > 6:
            raise ValueError(f"cannot read the fraction of {text!r}")
        parts.append(int(fraction.ljust(6, "0")))
    start = datetime(*(parts + [1] * (3 - len(parts)) if len(parts) < 3 else parts))
    if len(parts) == 1:
        return start, datetime(start.year + 1, 1, 1), True
    if len(parts) == 2:
        end = datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
        return start, end, True
    if len(parts) <= 5:
        unit = {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1)}[len(parts)]
        return start, start + unit, True
    return start, start, False


def at_time(text: str, column: str = "ocean_time", date_column: str | None = None) -> Column:
    """Rows within the year, month, day, hour or minute that ``text`` names, or at the
    exact instant when seconds are given.

    With ``date_column`` the days concerned are also selected on that partition column,
    so other partitions are not listed or read.
    """
    start, end, period = _parse(text)
    c = F.col(column)
    rows = (c >= ntz(start)) & (c < ntz(end)) if period else c == ntz(start)
    return rows & _days(start, end, period, date_column)


def between_times(first: str, last: str, column: str = "ocean_time", date_column: str | None = None) -> Column:
    """Inclusive range; a period as the upper bound is included whole."""
    start = _parse(first)[0]
    _, end, period = _parse(last)
    c = F.col(column)
    rows = (c >= ntz(start)) & ((c < ntz(end)) if period else (c <= ntz(end)))
    return rows & _days(start, end, period, date_column)


def _days(start: datetime, end: datetime, period: bool, date_column: str | None) -> Column:
    if date_column is None:
        return F.lit(True)
    last = end - timedelta(microseconds=1) if period else end
    return F.col(date_column).between(F.lit(start.date()), F.lit(last.date()))


def dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Days from ``first`` up to, **not including**, ``last``."""
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}' - INTERVAL 1 DAY)) AS ocean_date")


def epoch_micros(t: Column) -> Column:
    """Microseconds since 1970 by interval arithmetic (no time-zone conversion)."""
    return ((t - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(micros.cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)"))


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970, rounded down, by interval arithmetic (no time-zone conversion)."""
    return F.floor(epoch_micros(t) / 1_000_000)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def truncate(unit: str, t: Column) -> Column:
    """Start of the hour, day, month, quarter or year as TIMESTAMP_NTZ."""
    if unit in ("hour", "day"):
        size = 3600 if unit == "hour" else 86400
        s = epoch_seconds(t)
        return from_epoch_seconds(s - F.pmod(s, F.lit(size)))
    return F.trunc(t.cast("date"), unit).cast("timestamp_ntz")
