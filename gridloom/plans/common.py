"""Tables that several queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.text import clean, key_form
from gridloom.functions.time import year_of_text
from gridloom.operators.skew import maybe_broadcast
from gridloom.plans.problems import CELL_SQL, _degrees_sql
from gridloom.session import load

#: Text columns of a located record, trimmed, null as "".
TEXTS = ("kingdom", "phylum", "class_name", "family", "genus", "inst", "country_iso", "source_group")


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Records inside a land cell: record_id, cell_id, year, month, bin (upper case), species (key form) and TEXTS."""
    cells = load(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct()
    rows = geo.with_points(load(spark, sf, "bold_minimal_records"), "latitude", "longitude")
    rows = rows.select(
        "record_id",
        geo.cell_id(F.col("lon"), F.col("lat")).alias("cell_id"),
        year_of_text(F.col("collection_year")).alias("year"),
        F.col("collection_month").try_cast("int").alias("month"),
        F.upper(clean(F.col("bin_uri"))).alias("bin"),
        key_form(clean(F.col("species"))).alias("species"),
        *[clean(F.col(c)).alias(c) for c in TEXTS],
    )
    return rows.join(maybe_broadcast(cells), "cell_id", "left_semi")


LOCATED = f"""located as (
  select record_id, cell as cell_id, year, month, bin, species, {', '.join(TEXTS)} from (
    select *, {CELL_SQL} as cell from (
      select record_id, {_degrees_sql('latitude', 'NS', 90)} as lat, {_degrees_sql('longitude', 'EW', 180)} as lon,
        case when try_cast(regexp_extract(trim(coalesce(collection_year, '')), '^(\\d{{4}})(?:\\D|$)', 1) as int) between 1800 and 2100 then try_cast(regexp_extract(trim(coalesce(collection_year, '')), '^(\\d{{4}})(?:\\D|$)', 1) as int) end as year,
        try_cast(collection_month as int) as month, upper(trim(coalesce(bin_uri, ''))) as bin, lower(regexp_replace(trim(coalesce(species, '')), '\\s+', ' ', 'g')) as species,
        {', '.join(f"trim(coalesce({c}, '')) as {c}" for c in TEXTS)}
      from bold_minimal_records) where lat is not null and lon is not null and not (lat = 0 and lon = 0))
  where cell in (select cell_id from bold_grid100_land_cells))"""


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:  # noqa: N802
    return load(spark, sf, name)
