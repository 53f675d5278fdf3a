"""Calendar bins by offset alias, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import ValidationError

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "MON TUE WED THU FRI SAT SUN".split()
SECONDS = {"D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1}


@dataclass(frozen=True)
class Period:
    """n units of a kind: 'month' (anchored at month `anchor` of a quarter or year), 'week' (ending on `anchor`) or 'second'."""

    n: int
    kind: str
    anchor: int = 0
    end: bool = False


def parse_period(alias: str) -> Period:
    m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", (alias or "").strip())
    if m:
        n, unit, at = int(m.group(1) or 1), m.group(2), m.group(3)
        if n and unit in SECONDS and not at:
            return Period(n * SECONDS[unit], "second")
        if n and unit == "W" and (at is None or at in DAYS):
            return Period(n, "week", DAYS.index(at or "SUN"))
        if n and unit in ("MS", "M", "ME") and not at:
            return Period(n, "month", 0, unit != "MS")
        if n and unit in ("QS", "Q", "QE") and (at is None or at in MONTHS):
            return Period(3 * n, "month", MONTHS.index(at or "JAN") % 3 if unit == "QS" else (MONTHS.index(at or "DEC") + 1) % 3, unit != "QS")
        if n and unit in ("YS", "AS", "Y", "A", "YE") and (at is None or at in MONTHS):
            start = unit in ("YS", "AS")
            return Period(12 * n, "month", MONTHS.index(at or "JAN") if start else (MONTHS.index(at or "DEC") + 1) % 12, not start)
    raise ValidationError(f"Invalid freq value {alias!r}")


def _months(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _month_start(k: Column) -> Column:
    return F.make_date(F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def bin_start(t: Column, period: Period, first: datetime) -> Column:
    """The label of the bin of t, given the first time of the data: the start of a bin, of weeks the closing day, of month ends the last day."""
    if period.kind == "second":
        day = datetime(first.year, first.month, first.day)
        origin = F.lit(day).cast("timestamp_ntz")
        passed = F.floor((F.unix_micros(t.cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / (period.n * 1_000_000))
        return F.timestamp_micros(F.unix_micros(origin.cast("timestamp")) + passed * period.n * 1_000_000).cast("timestamp_ntz")
    if period.kind == "week":
        week = F.next_day(F.date_sub(t.cast("date"), 1), DAYS[period.anchor])
        if period.n > 1:
            base = datetime(first.year, first.month, first.day)
            base += timedelta(days=(period.anchor - base.weekday()) % 7)
            late = F.ceil(F.datediff(week, F.lit(base.date())) / (7 * period.n))
            week = F.date_add(F.lit(base.date()), (late * 7 * period.n).cast("int"))
        return week.cast("timestamp_ntz")
    k0 = first.year * 12 + first.month - 1
    if period.n in (3, 12):  # quarters and years have their own anchors
        k0 = period.anchor
    elif period.n % 12 == 0 or (period.n % 3 == 0 and period.anchor):
        k0 -= (k0 - period.anchor) % (12 if period.n % 12 == 0 else 3)
    k = F.floor((_months(t) - k0) / period.n) * period.n + k0
    return F.date_sub(_month_start(k + period.n).cast("date"), 1).cast("timestamp_ntz") if period.end else _month_start(k)


def bin_labels(low: datetime, high: datetime, period: Period) -> list[datetime]:
    """All labels from the first to the last."""
    out = [low]
    while out[-1] < high:
        last = out[-1]
        if period.kind == "second":
            out.append(last + timedelta(seconds=period.n))
        elif period.kind == "week":
            out.append(last + timedelta(days=7 * period.n))
        elif period.end:
            k = (last + timedelta(days=1)).year * 12 + (last + timedelta(days=1)).month - 1 + period.n
            out.append(datetime(k // 12, k % 12 + 1, 1) - timedelta(days=1))
        else:
            k = last.year * 12 + last.month - 1 + period.n
            out.append(datetime(k // 12, k % 12 + 1, 1))
    return out


def guess_period(times: list[datetime]) -> str | None:
    """The alias of evenly spaced times: years, quarters and months by their calendar periods, else days, hours, minutes."""
    if len(times) < 3:
        return None
    months = [t.year * 12 + t.month - 1 for t in times]
    steps = {b - a for a, b in zip(times, times[1:])}
    jumps = {b - a for a, b in zip(months, months[1:])}
    if len(steps) == 1:
        s = steps.pop().total_seconds()
        if len(jumps) != 1 or 0 in jumps or s < 27 * 86400:
            for unit, size in (("D", 86400), ("h", 3600), ("min", 60), ("s", 1)):
                if s % size == 0:
                    n = int(s // size)
                    return f"{n if n > 1 else ''}{unit}"
            return None
    for name, place in (("YS", [t.year for t in times]), ("QS", [m // 3 for m in months]), ("MS", months)):
        apart = {b - a for a, b in zip(place, place[1:])}
        if len(apart) == 1 and (n := apart.pop()) > 0:
            return f"{n if n > 1 else ''}{name}"
    return None
