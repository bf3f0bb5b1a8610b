"""JSON pages, nested lists and maps as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, column: str, element_schema: str, keep: list[str], dedup: list[str] | None = None) -> DataFrame:
    """One row per element of a JSON array text, its fields as columns; texts that do not read give none.

    `dedup`: of elements that agree in these columns one is kept."""
    rows = df.select(*keep, F.inline(F.from_json(F.col(column), f"array<struct<{element_schema}>>")))
    return rows.dropDuplicates(dedup) if dedup else rows


def first_identifier(identifiers: Column, kind: str) -> Column:
    """The value of the first {type, value} struct of that type (any case), else ""."""
    own = F.filter(identifiers, lambda x: F.lower(x["type"]) == kind)
    return F.coalesce(F.try_element_at(own, F.lit(1))["value"], F.lit(""))


def author_list(authors: Column) -> Column:
    """"First Last; First Last" of an array of {first, last} structs."""
    return F.array_join(F.transform(authors, lambda a: F.trim(F.concat_ws(" ", a["first"], a["last"]))), "; ")


def map_total(m: Column) -> Column:
    """The sum of a map's values; 0 for an empty one."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def facet_rows(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep..., value, n): one row per entry of a map column."""
    return df.select(*keep, F.explode(F.map_entries(column)).alias("e")).select(*keep, F.col("e.key").alias("value"), F.col("e.value").alias("n"))
