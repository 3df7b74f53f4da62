"""Dates in file names and parts of timestamps. All timestamps are without time zone."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name patterns in the order they are tried, and how their groups are read.
PATTERNS = [
    (r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})", 5),
    (r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})", 5),
    (r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})", 5),
    (r"(\d{4})(\d{2})(\d{2})(?!\d)", 3),
]
#: EXIF date tags in the order they are tried.
EXIF_TAGS = ["DateTimeOriginal", "DateTimeDigitized", "DateTime"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_timestamp(path: Column) -> Column:
    """The first valid date of the patterns in a path's last part, else null; seconds are dropped."""
    name = basename(path)

    def read(pattern: str, groups: int) -> Column:
        part = [F.regexp_extract(name, pattern, i) for i in range(1, groups + 1)] + [F.lit("00")] * (5 - groups)
        return F.try_to_timestamp(F.when(part[0] != "", F.concat_ws("-", *part)), F.lit("yyyy-MM-dd-HH-mm")).cast("timestamp_ntz")

    return F.coalesce(*(read(p, n) for p, n in PATTERNS))


def parse_filename(path: str | None, pattern: str | None = None) -> datetime | None:
    """The same for one name. A custom pattern has the groups date and perhaps time, or year, month, day and perhaps hour, minute."""
    if not path:
        return None
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    if pattern is None:
        tries = ((p, range(1, n + 1)) for p, n in PATTERNS)
    else:
        try:
            found = re.search(pattern, name)
        except re.error:
            return None
        if not found:
            return None
        group = found.groupdict()
        if group.get("date"):
            digits = re.sub(r"\D", "", group["date"])[:8] + re.sub(r"\D", "", group.get("time") or "")[:4].ljust(4, "0")
            parts = [digits[:4], digits[4:6], digits[6:8], digits[8:10], digits[10:12]]
        else:
            parts = [group.get(k) or ("0" if k in ("hour", "minute") else "") for k in ("year", "month", "day", "hour", "minute")]
        return _date(parts)
    for p, groups in tries:
        found = re.search(p, name)
        if found and (date := _date([found[i] for i in groups])):
            return date
    return None


def _date(parts: list[str]) -> datetime | None:
    try:
        return datetime(*map(int, parts))
    except ValueError:
        return None


def exif_timestamp(tags: Column) -> Column:
    """The first readable date among the tags of a map."""
    return F.coalesce(*(F.try_to_timestamp(tags[t], F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz") for t in EXIF_TAGS))


def hour_fraction(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def noon_score(ts: Column) -> Column:
    """1 at noon down to 0 six hours away; 0.5 without a time."""
    return F.coalesce(F.lit(1.0) - F.least(F.abs(hour_fraction(ts) - 12) / F.lit(6.0), F.lit(1.0)), F.lit(0.5))
