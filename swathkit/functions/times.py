"""Times: columns over minutes since the epoch, and date literals of queries.

A missing time is NULL; the minute form rounds starts down and ends up, so an interval only grows.
"""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS, DAY_MS = 60_000, 86_400_000
PATTERN = "yyyy-MM-dd'T'HH:mm:ss"


def start_minute(ms: Column) -> Column:
    """Whole minutes at or before a time in milliseconds."""
    return F.floor(ms / MINUTE_MS).cast("int")


def end_minute(ms: Column) -> Column:
    """Whole minutes at or after a time in milliseconds."""
    return F.ceil(ms / MINUTE_MS).cast("int")


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp (one without a zone is UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def without_fraction(text: Column) -> Column:
    """The text up to its last dot, if that is not its first character."""
    return F.regexp_replace(text, r"(?<=.)\.[^.]*$", "")


def parsed(text: Column, pattern: str = PATTERN) -> Column:
    """Milliseconds of a time text; NULL if empty or "null" (any case) or not a time. What follows the time is ignored."""
    known = F.when((F.trim(text) != "") & (F.lower(text) != "null"), without_fraction(text))
    if pattern == PATTERN:
        known = F.regexp_extract(known, r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})", 1)
        known = F.regexp_replace(F.regexp_replace(known, r"(?<=[-T:])(\d)(?=[-T:]|$)", "0$1"), r"^$", "")
        # The usual form is known by one pattern; what follows its 19 characters is ignored there, too.
        known = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.substring(text, 1, 19)).otherwise(known)
    return F.unix_millis(F.try_to_timestamp(known, F.lit(pattern)))


def minute_text(minute: Column) -> Column:
    """A minute as a time text; "null" for none."""
    return F.coalesce(F.date_format(F.timestamp_seconds(minute.cast("long") * 60), PATTERN), F.lit("null"))


def literal_ms(text: str | dt.datetime | None) -> int | None:
    """Milliseconds of a query's date literal: date and time, else date. None for none, and, with a warning, for anything else."""
    if text is None or isinstance(text, dt.datetime):
        return None if text is None else int(text.replace(tzinfo=text.tzinfo or dt.timezone.utc).timestamp() * 1000)
    if not text or text == "null":
        return None
    for pattern, n in (("%Y-%m-%dT%H:%M:%S", 19), ("%Y-%m-%d", 10)):
        try:
            return int(dt.datetime.strptime(text[:n], pattern).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        except ValueError:
            pass
    warnings.warn(f"not a date, so the range is open: {text}", stacklevel=2)
    return None


def stamp(now: dt.datetime | None = None) -> str:
    """A name part for archived files."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return now.strftime("%Y-%m-%d_%H-%M-%S_") + f"{now.microsecond // 1000:03d}"
