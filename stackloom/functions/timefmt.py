"""Times of day, ranges, durations and units. ``parse_*`` on text run on the driver; the rest are column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def parse_time_ms(text: str, strict: bool = False) -> int:
    """``H:M:S[.f]`` or ``M:S`` to milliseconds; the fraction is cut or padded to three digits. ``strict`` needs H:M:S."""
    m = re.fullmatch(r"\s*(?:(\d+):)?(\d+):(\d+)(?:\.(\d+))?\s*", text)
    if not m or strict and m[1] is None:
        raise ValueError(f"invalid time: {text!r}")
    return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(((m[4] or "") + "000")[:3])


def parse_range(text: str) -> tuple[int, int]:
    """``A..B``, ``A-B`` or ``A B``, smaller first."""
    for mark in ("..", "-", " "):
        a, found, b = text.strip().partition(mark)
        if found:
            x, y = parse_time_ms(a), parse_time_ms(b)
            return min(x, y), max(x, y)
    raise ValueError(f"invalid range: {text!r}")


def time_ms(text: Column) -> Column:
    """Column form of :func:`parse_time_ms`; null for other texts."""
    ok = text.rlike(r"^(\d+:)?\d+:\d+(\.\d+)?$")
    whole, fraction = F.substring_index(text, ".", 1), F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    parts = F.split(whole, ":")
    n = F.size(parts)

    def at(i: int) -> Column:
        return F.coalesce(F.get(parts, n - i).try_cast("long"), F.lit(0))

    return F.when(ok, ((at(3) * 60 + at(2)) * 60 + at(1)) * 1000 + F.rpad(F.substring(fraction, 1, 3), 3, "0").try_cast("long"))


def format_ms(ms: Column, days: bool = False) -> Column:
    """``HH:MM:SS.mmm``; with ``days`` a ``+Nd `` comes first instead of hours past 24."""
    rest = ms % DAY_MS if days else ms
    hours, minutes, seconds = F.floor(rest / 3600000), F.floor(rest / 60000) % 60, F.floor(rest / 1000) % 60
    clock = F.format_string("%02d:%02d:%02d.%03d", hours, minutes, seconds, rest % 1000)
    return F.when(ms >= DAY_MS, F.concat(F.lit("+"), F.floor(ms / DAY_MS).cast("string"), F.lit("d "), clock)).otherwise(clock) if days else clock


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%.1fs", ms / 1000))


def format_unit(value: Column, units: list[str], step: int) -> Column:
    """The largest unit that keeps the number at 1 or more, with two decimals."""
    out = F.format_string(f"%.2f{units[-1]}", value / float(step ** (len(units) - 1)))
    for i in range(len(units) - 2, -1, -1):
        out = F.when(value < step ** (i + 1), F.format_string(f"%.2f{units[i]}", value / float(step**i))).otherwise(out)
    return out


#: Unit names (fixed values).
TIME_UNITS, BYTE_UNITS = ["ns", "us", "ms", "s"], ["B", "KB", "MB", "GB", "TB", "PB"]
