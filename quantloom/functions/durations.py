"""Durations such as "1d", "5min" or "1d12h": units y, m (month), d, h, min, s; and steps that dates are cut to."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r"(\d+)(y|min|m|d|h|s)"
#: How many of a unit make one of the next.
CARRY = (("s", 60), ("min", 60), ("h", 24), ("d", 30), ("m", 12))


def parse(duration: str) -> dict[str, int]:
    """Amount of each unit."""
    if not re.fullmatch(f"({PART})+", duration):
        raise ValueError(f"not a duration: {duration!r}")
    out = dict.fromkeys(("s", "min", "h", "d", "m", "y"), 0)
    for n, unit in re.findall(PART, duration):
        out[unit] += int(n)
    return out


def shift_datetime(base: datetime, duration: str, mode: str = "sub") -> datetime:
    """base minus (or, for "add", plus) a duration; days beyond a month's end move to it. "" moves nothing."""
    if mode not in ("add", "sub"):
        raise ValueError(f"mode must be add or sub, got {mode!r}")
    if not duration:
        return base
    n, sign = parse(duration), 1 if mode == "add" else -1
    year, month = divmod(base.year * 12 + base.month - 1 + sign * (12 * n["y"] + n["m"]), 12)
    moved = base.replace(year=year, month=month + 1, day=min(base.day, calendar.monthrange(year, month + 1)[1]))
    return moved + sign * timedelta(days=n["d"], hours=n["h"], minutes=n["min"], seconds=n["s"])


def multiply_duration(multiplier: int, duration: str) -> str:
    """A duration so many times over, in the largest units, the largest first."""
    if not duration:
        return duration
    n = {unit: amount * multiplier for unit, amount in parse(duration).items()}
    units = list(n)
    for (low, size), high in zip(CARRY, units[1:], strict=True):
        more, n[low] = divmod(n[low], size)
        n[high] += more
    return "".join(f"{n[u]}{u}" for u in reversed(units) if n[u] > 0) or "0s"


#: Bar widths in seconds, from and below, and the step that sums them up. 3 to 5 s have none.
STEPS = [(1, 3, "30s"), (5, 10, "3m"), (10, 30, "5m"), (30, 60, "15m"), (60, 180, "30m"), (180, 900, "1h"), (900, 86400, "5d"), (86400, 432000, "20d"), (432000, 31536000, "1y")]


def bar_frequency(width: timedelta) -> str | None:
    """The aggregation step that suits bars of a width."""
    seconds = width.total_seconds()
    return next((step for low, high, step in STEPS if low <= seconds < high), None)


#: Seconds of the units of a step, and months of those that have no fixed length.
STEP_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
STEP_MONTHS = {"mo": 1, "q": 3, "y": 12}


def truncated(date: Column, step: str) -> Column:
    """The start of the step that a date lies in: "30s", "5m" (minutes), "1h", "5d", "1w" (from Mondays), "1mo",
    "1q", "1y", counted from the beginning of 1970."""
    met = re.fullmatch(r"(\d+)(mo|[smhdwqy])", step)
    if not met or not int(met[1]):
        raise ValueError(f"not a step: {step!r}")
    n, unit = int(met[1]), met[2]
    when = date.cast("timestamp")
    if unit in STEP_MONTHS:
        months = (F.year(when) - 1970) * 12 + F.month(when) - 1
        size = n * STEP_MONTHS[unit]
        return F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(months / size) * size).cast("int")).cast("timestamp")
    size, offset = n * STEP_SECONDS[unit], 3 * 86400 if unit == "w" else 0
    return F.timestamp_seconds(F.floor((F.unix_timestamp(when) + offset) / size) * size - offset)


def aggregated(date: Column, step: str | None) -> Column:
    """``truncated``, with the months of the calendar for the step "20d" that daily bars have."""
    return F.date_trunc("month", date) if step == "20d" else truncated(date, step)
