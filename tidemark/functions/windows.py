"""Analysis windows: durations and dates as ranges, comparison windows, equal slices of a series."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICES, SERIES_MONTHS = 12, 24
QUARTER = timedelta(days=365.25 / 4)


class InvalidWindow(ValueError):
    """Neither ``<n>d|w|m|y`` nor an ISO date, or no date in the past that can be represented."""


@dataclass(frozen=True)
class Range:
    since: datetime
    until: datetime

    @property
    def seconds(self) -> tuple[int, int]:
        """Both ends in whole epoch seconds."""
        return int(self.since.timestamp() // 1), int(self.until.timestamp() // 1)


def months_before(end: datetime, months: int) -> datetime:
    """Calendar months back; a day that the month lacks becomes its last."""
    index = end.year * 12 + end.month - 1 - months
    year, month = index // 12, index % 12 + 1
    return end.replace(year=year, month=month, day=min(end.day, calendar.monthrange(year, month)[1]))


def back(duration: str, end: datetime) -> datetime:
    """``end`` less a duration: days and weeks are fixed, months and years go by the calendar."""
    m = re.fullmatch(r"([1-9][0-9]*)([dwmy])", duration)
    if not m:
        raise InvalidWindow(duration)
    n, unit = int(m[1]), m[2]
    try:
        return end - timedelta(days=n * (7 if unit == "w" else 1)) if unit in "dw" else months_before(end, n * (12 if unit == "y" else 1))
    except (ValueError, OverflowError) as error:
        raise InvalidWindow(duration) from error


def window(since: str, now: datetime) -> Range:
    """From a duration back, or from midnight UTC of a date, until now."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", since):
        try:
            start = datetime.combine(date.fromisoformat(since), datetime.min.time(), UTC)
        except ValueError as error:
            raise InvalidWindow(since) from error
    else:
        start = back(since, now)
    if start > now:
        raise InvalidWindow(since)
    return Range(start, now)


def comparison(duration: str, now: datetime) -> tuple[Range, Range]:
    """(the window until now, the one of the same duration right before it)."""
    start = back(duration, now)
    return Range(start, now), Range(back(duration, start), start)


def series_since(window_: Range, oldest: datetime) -> datetime:
    """Start of the series: 24 months at least, the window if that is longer, not before the oldest commit."""
    return max(oldest, min(window_.since, months_before(window_.until, SERIES_MONTHS)))


def slices(whole: Range, most: int = SLICES) -> list[Range]:
    """Equal slices of about a quarter, oldest first; none if there would be fewer than two."""
    length = whole.until - whole.since
    n = min(most, int(length / QUARTER + 0.5))
    if n < 2:
        return []
    edges = [whole.since, *[whole.since + length * i / n for i in range(1, n)], whole.until]
    return [Range(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def slice_of(time_s: Column, ranges: list[Range]) -> Column:
    """Number of the slice a time falls in: how many slices after the first have begun; null outside all."""
    if not ranges:
        return F.lit(None).cast("int")
    starts = F.array(*[F.lit(r.seconds[0]).cast("long") for r in ranges[1:]])
    inside = (time_s >= ranges[0].seconds[0]) & (time_s <= ranges[-1].seconds[1])
    return F.when(inside, F.size(F.filter(starts, lambda s: s <= time_s)))


def step(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of the edges that a value reaches; null for null."""
    return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)))
