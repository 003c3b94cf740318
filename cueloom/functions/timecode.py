"""Times of subtitle files. Queries hold times as whole milliseconds, which add up exactly in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two digits of hours exactly, as in the files that are read; times of 100 hours and more are written, but not read back.
TIME = r"([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"
ARROW = rf"{TIME}\s*-->\s*{TIME}"


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves to even, negative times at 0."""
    return F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")


def timestamp(ms: Column) -> Column:
    ms = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda unit: F.floor(ms / unit).cast("long")
    digits = lambda n, k: F.right(F.concat(F.lit("0" * (k - 1)), n.cast("string")), F.lit(k))
    hours = part(3_600_000)
    shown = F.when(hours < 100, digits(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), digits(part(60_000) % 60, 2), F.lit(":"), digits(part(1000) % 60, 2), F.lit(","), digits(ms % 1000, 3))


def parse(line: Column, first: int = 1, pattern: str = TIME) -> Column:
    """Milliseconds from the four groups of pattern that begin with the given one; null without a match."""
    group = lambda i: F.nullif(F.regexp_extract(line, pattern, first + i), F.lit("")).cast("long")
    return group(0) * 3_600_000 + group(1) * 60_000 + group(2) * 1000 + group(3)
