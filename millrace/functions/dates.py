"""Date and time functions where a dialect's rule is not Spark's. Naive timestamps count as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def start_of(unit: str, ts: Column) -> Column:
    """Truncation to second ... year (ISO weeks), naive."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def yyyymmdd(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts)).cast("int")


def day_of_week(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Complete units between two times."""
    return F.timestamp_diff(unit.upper(), start, end)


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Unit boundaries crossed between two times."""
    if unit in ("year", "quarter", "month"):
        per = {"year": 1, "quarter": 4, "month": 12}[unit]
        place = lambda t: F.year(t).cast("long") * per + {"year": F.lit(0), "quarter": F.quarter(t), "month": F.month(t)}[unit]
        return place(end) - place(start)
    micros = lambda t: F.unix_micros(F.date_trunc(unit, t).cast("timestamp"))
    return ((micros(end) - micros(start)) / F.lit(_SECONDS[unit] * 1_000_000)).cast("long")


def age(end: Column, start: Column) -> Column:
    """Whole months, then days, then microseconds from ``start`` to ``end``, as a struct of one sign."""
    flip = end < start
    a, b = F.when(flip, end).otherwise(start), F.when(flip, start).otherwise(end)
    months = F.timestamp_diff("MONTH", a, b)
    rest = F.unix_micros(b.cast("timestamp")) - F.unix_micros(F.timestamp_add("MONTH", months.cast("int"), a).cast("timestamp"))
    sign = F.when(flip, F.lit(-1)).otherwise(F.lit(1))
    day = F.lit(86_400_000_000)
    return F.struct((sign * months).alias("months"), (sign * F.floor(rest / day)).alias("days"), (sign * (rest % day)).alias("micros"))


def julian_day(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(2440587.5)


def modified(ts: Column, *modifiers: str) -> Column:
    """'+1 day', '-3 months', 'start of month' and so on, from left to right."""
    out = ts
    for m in modifiers:
        if m.startswith("start of "):
            out = start_of(m.removeprefix("start of "), out)
        else:
            number, unit = m.split()
            out = F.timestamp_add(unit.rstrip("s").upper(), F.lit(int(number)), out)
    return out


#: Template fields and the Java pattern letters that give the same text.
_TEMPLATES = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "DDD": "DDD", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "Mon": "MMM", "Month": "MMMM", "Dy": "EEE", "Day": "EEEE", "Q": "q"}
#: Percent codes and their Java patterns.
_PERCENT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm", "%M": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%p": "a", "%b": "MMM", "%a": "EEE"}


def _translated(template: str, table: dict[str, str]) -> str:
    import re

    parts = re.split("(" + "|".join(map(re.escape, sorted(table, key=len, reverse=True))) + ")", template)
    return "".join(table.get(p, "'" + p.replace("'", "''") + "'" if re.search("[A-Za-z']", p) else p) for p in parts)


def to_char(ts: Column, template: str) -> Column:
    return F.date_format(ts, _translated(template, _TEMPLATES))


def to_timestamp(text: Column, template: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(_translated(template, _TEMPLATES)))


def percent_format(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, _translated(pattern, _PERCENT))


def percent_parse(text: Column, pattern: str) -> Column:
    return F.to_timestamp_ntz(text, F.lit(_translated(pattern, _PERCENT)))


def at_time_zone(ts: Column, zone: str) -> Column:
    """A naive time in ``zone`` as naive UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def converted(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)
