"""Dates and periods as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of_text(c: Column, low: int = 1800, high: int = 2100) -> Column:
    """The year a text begins with: exactly four digits, within [low, high], else null."""
    y = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4})(?!\d)", 1).try_cast("int")
    return F.when(y.between(low, high), y)


def month_of_text(c: Column) -> Column:
    """The month of an ISO-like text (yyyy-mm...), 1 to 12, else null."""
    m = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^\d{4}-(\d{2})(?!\d)", 1).try_cast("int")
    return F.when(m.between(1, 12), m)


def tolerant_timestamp(c: Column, *formats: str) -> Column:
    """The first of the formats (or the default one) that reads, else null."""
    reads = [F.try_to_timestamp(c, F.lit(f)) for f in formats] or [F.try_to_timestamp(c)]
    return F.coalesce(*reads)


def quarter_of_month(month: Column) -> Column:
    return F.floor((month + 2) / 3).cast("int")


def period_index(year: Column, quarter: Column) -> Column:
    """year * 4 + quarter: consecutive over quarters."""
    return year * 4 + quarter


def yq(year: Column, quarter: Column) -> Column:
    """Quarters since 1960 (0 for 1960 q1)."""
    return (year - 1960) * 4 + quarter - 1


def months_of_quarter(quarter: Column) -> Column:
    return F.sequence((quarter * 3 - 2).cast("int"), (quarter * 3).cast("int"))


def first_valid_year(*texts: Column, low: int = 1800, high: int = 2100) -> Column:
    """The first year found anywhere in the texts, taken in order."""
    found = []
    for t in texts:
        y = F.regexp_extract(F.coalesce(t, F.lit("")), r"(?<!\d)(1[89]\d{2}|20\d{2})(?!\d)", 1).try_cast("int")
        found.append(F.when(y.between(low, high), y))
    return F.coalesce(*found)
