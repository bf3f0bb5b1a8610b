"""Predicates and overrides: record validity, range and area filters, flags, precedence of decisions, point fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import number


def valid_coordinates(flag: Column, lat: Column, lon: Column) -> Column:
    """The flag says "1", both texts are numbers, both are in range; null counts as false."""
    return F.coalesce((F.trim(flag) == "1") & number(lat).between(-90, 90) & number(lon).between(-180, 180), F.lit(False))


def at_least(c: Column, limit: float) -> Column:
    """c >= limit; a missing value is false."""
    return F.coalesce(c >= limit, F.lit(False))


def main_track(c: Column) -> Column:
    """The main track, not a spur."""
    t = F.lower(F.trim(c))
    return F.coalesce((t == "main") & ~t.contains("spur"), F.lit(False))


def protected_areas(df: DataFrame, include_marine: bool = False, include_oecm: bool = False) -> DataFrame:
    """Designated, terrestrial areas: each rule applies only where the table has its column (STATUS, SITE_TYPE, MARINE, REALM)."""
    low = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    if "STATUS" in df.columns:
        df = df.where(low("STATUS").isin("designated", "inscribed", "established"))
    if "SITE_TYPE" in df.columns and not include_oecm:
        df = df.where(low("SITE_TYPE") == "pa")
    if "MARINE" in df.columns and not include_marine:
        df = df.where(low("MARINE").isin("0", "terrestrial"))
    if "REALM" in df.columns and not include_marine:
        df = df.where(~low("REALM").contains("marine"))
    return df


def resident_ranges(df: DataFrame, presence: str = "presence", origin: str = "origin", seasonal: str = "seasonal") -> DataFrame:
    """Extant, native, resident or breeding ranges."""
    return df.where((F.col(presence) == 1) & (F.col(origin) == 1) & F.col(seasonal).isin(1, 2))


def region_flag(continent: Column, country: Column, continents: list[str], countries: list[str]) -> Column:
    """1 in one of the continents or countries, else 0."""
    return F.coalesce(continent.isin(*continents) | country.isin(*countries), F.lit(False)).cast("int")


def complete_until(year: Column, window: int, last: Column | int) -> Column:
    """1 if the whole window after a year lies before the end of the data."""
    return (year + window <= last).cast("int")


def precedence(key: str, value: str, *sources: DataFrame) -> DataFrame:
    """(key, value, source int): the value of the first source that has a non-blank one for the key (sources in order of trust)."""
    ranked = None
    for i, s in enumerate(sources):
        own = s.where(F.trim(F.col(value)) != "").select(key, value, F.lit(i).alias("source"))
        ranked = own if ranked is None else ranked.unionByName(own)
    best = ranked.groupBy(key).agg(F.min(F.struct("source", value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), "b.source")


def with_fixes(df: DataFrame, key: str, fixes: dict[object, dict[str, object]]) -> DataFrame:
    """A few rows' columns set by hand, by key."""
    for column in {c for f in fixes.values() for c in f}:
        kind = df.schema[column].dataType
        value = None
        for k, f in fixes.items():
            if column in f:
                value = F.when(F.col(key) == k, F.lit(f[column]).cast(kind)) if value is None else value.when(F.col(key) == k, F.lit(f[column]).cast(kind))
        df = df.withColumn(column, value.otherwise(F.col(column)))
    return df


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by the order of a keyed hash: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
