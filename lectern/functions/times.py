"""Clock text, rounding and pace functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column, hundredths: bool = True) -> Column:
    """HH:MM:SS.ss, hundredths cut off."""
    cs = F.floor(seconds * 100 + F.lit(1e-6)).cast("long")
    parts = [F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60]
    if hundredths:
        return F.format_string("%02d:%02d:%02d.%02d", *[p.cast("long") for p in parts], (cs % 100).cast("long"))
    return F.format_string("%02d:%02d:%02d", *[p.cast("long") for p in parts])


def seconds_of(text: Column) -> Column:
    """Seconds of `12.5s`, `m:s` or `h:m:s`; null for anything else."""
    parts = F.split(F.replace(text, F.lit("s"), F.lit("")), ":")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, n(1)).when(F.size(parts) == 2, n(1) * 60 + n(2)).when(F.size(parts) == 3, n(1) * 3600 + n(2) * 60 + n(3))


def stamped(at: Column) -> tuple[Column, Column, Column]:
    """A time as ISO 8601 in UTC, as part of a file's name, and as a clock's."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyyMMdd-HHmm"), F.date_format(at, "HH:mm:ss")


def rounded(x: Column, places: int) -> Column:
    return F.round(x * 10**places) / 10**places


def z_score(x: Column, median: Column, mad: Column) -> Column:
    """Modified z-score, 0 where the deviation is 0."""
    return F.when(mad > 0, (x - median) * 0.6745 / mad).otherwise(0.0)


def per(x: Column, n: Column) -> Column:
    return F.when(n > 0, x / n).otherwise(0.0)
