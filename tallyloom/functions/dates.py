"""Dates that stand in several notations, the year first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import half_width, no_blanks


def day(c: Column) -> Column:
    """The date of `2024-3-1`, `2024/3/1`, `2024.3.1`, `2024年3月1日` or `20240301`; null for anything else and for days that no calendar has."""
    text = no_blanks(half_width(c))
    text = F.regexp_replace(text, r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$", "$1-$2-$3")
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def recorded_end(start: Column, end: Column) -> Column:
    """An end that is not after its start counts as not recorded; a missing start is the earliest."""
    return F.when(start.isNull() | (end > start), end)


def iso_instant(c: Column) -> Column:
    """The timestamp of an ISO text with Z; null where it can't be read."""
    return F.try_to_timestamp(c)
