"""The general record-processing problems as runnable queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import nearby, orphans, packed, tree
from gridloom.operators.skew import maybe_broadcast
from gridloom.session import load

PACKED_FIELDS = {"collectors": packed.PERSONS, "bold_recordset_code_arr": packed.CODES}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(load(spark, sf, "bold_minimal_records"), ["record_id"], PACKED_FIELDS, at_least=2)


def p3_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct records per single value, all texts included (one value or many)."""
    rows = packed.split_packed(load(spark, sf, "bold_minimal_records"), ["record_id"], PACKED_FIELDS)
    return rows.groupBy("field_name", "value").agg(F.countDistinct("record_id").alias("n_records"), F.max("pos").alias("max_pos"))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All references and all parents' validity; a key begins with its kind, so that both kinds go through one plan."""
    kind = lambda k, c: F.concat(F.lit(k), c)
    day = lambda c: F.to_timestamp(F.try_to_date(F.nullif(F.trim(F.col(c)), F.lit(""))))
    links = load(spark, sf, "bold_accession_links")
    parents = links.where(day("query_date").isNotNull()).select(kind("a", orphans.accession_key(F.col("accession"))).alias("key"), day("query_date").alias("valid_from"), day("withdrawn_date").alias("valid_to"))
    sets = load(spark, sf, "gbif_datasets").where(F.col("registered_at").isNotNull())
    parents = parents.unionByName(sets.select(kind("d", orphans.dataset_key(F.col("dataset_key"))).alias("key"), F.col("registered_at").cast("timestamp").alias("valid_from"), F.col("deleted_at").cast("timestamp").alias("valid_to")))
    refs = load(spark, sf, "bold_acc_cells").select(F.lit("bold_acc_cells").alias("ref_table"), F.col("row_id").alias("ref_id"), kind("a", orphans.accession_key(F.col("accession"))).alias("key"), F.date_trunc("day", "first_seen_at").cast("timestamp").alias("at"))
    for name, at in (("gbif_dataset_cells", "first_seen_at"), ("dataset_literature_cache", "fetched_at")):
        refs = refs.unionByName(load(spark, sf, name).select(F.lit(name).alias("ref_table"), F.col("row_id").alias("ref_id"), kind("d", orphans.dataset_key(F.col("dataset_key"))).alias("key"), F.col(at).cast("timestamp").alias("at")))
    return refs, parents


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = orphans.orphan_references(*_references(spark, sf))
    return found.select("ref_table", "ref_id", F.date_format("at", "yyyy-MM").alias("ref_period")).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    refs, parents = _references(spark, sf)
    return orphans.orphan_report(refs, orphans.orphan_references(refs, parents))


def _keyed_records(spark: SparkSession, sf: str) -> DataFrame:
    """(key_kind, key_value, record_id, species, year): one row per record and kind of key it has."""
    cells = load(spark, sf, "bold_grid100_land_cells").select(F.col("cell_id").alias("land"))
    records = load(spark, sf, "bold_minimal_records").select("record_id", "latitude", "longitude", F.upper(tree.text_or_null(F.col("bin_uri"))).alias("bin"), F.lower(F.regexp_replace(tree.text_or_null(F.col("species")), r"\s+", " ")).alias("species"), tree.text_or_null(F.col("collection_year")).alias("year"))
    rows = geo.with_points(records, "latitude", "longitude", outer=True)
    rows = rows.withColumn("cell", geo.cell_id(F.col("lon"), F.col("lat"))).join(maybe_broadcast(cells.distinct()), F.col("cell") == F.col("land"), "left")
    kinds = F.array(F.struct(F.lit("bin_uri").alias("key_kind"), F.col("bin").alias("key_value")), F.struct(F.lit("cell_id").alias("key_kind"), F.col("land").alias("key_value")))
    return rows.select("record_id", "species", "year", F.inline(kinds)).where(F.col("key_value").isNotNull())


def p6_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every bin and land cell with its distinct records, species and years."""
    n_rows = 2 * load(spark, sf, "bold_minimal_records").count()  # from the footers: two kinds of key a record
    return tree.key_profiles(_keyed_records(spark, sf), ["key_kind", "key_value"], "record_id", ["species", "year"], n_rows=n_rows)


def p6_found(spark: SparkSession, sf: str, share: float = 0.02) -> DataFrame:
    profiles = tree.key_profiles(_keyed_records(spark, sf), ["key_kind", "key_value"], "record_id", n_rows=2 * load(spark, sf, "bold_minimal_records").count())
    # A record has at most one key of a kind, so the records of a kind are the sum over its keys.
    total = profiles.groupBy("key_kind").agg(F.sum("n_records").alias("n_total"))
    return tree.heavy_keys(profiles, "key_kind", total, share).select("key_kind", "key_value")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """(record_id, lat, lon, cell_id): usable coordinates; cell_id is "" outside the land cells."""
    cells = load(spark, sf, "bold_grid100_land_cells").select(F.col("cell_id").alias("land")).distinct()
    rows = geo.with_points(load(spark, sf, "bold_minimal_records").select("record_id", "latitude", "longitude"), "latitude", "longitude")
    return rows.withColumn("cell", geo.cell_id(F.col("lon"), F.col("lat"))).join(maybe_broadcast(cells), F.col("cell") == F.col("land"), "left").select("record_id", "lat", "lon", F.coalesce("land", F.lit("")).alias("cell_id"))


def p7_found(spark: SparkSession, sf: str, km: float = 5.0) -> DataFrame:
    stations = load(spark, sf, "sampling_stations").select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return nearby.near_pairs(_points(spark, sf), stations, "record_id", "station_id", km, keep=["cell_id"]).select("record_id", "station_id", "cell_id").distinct()


def p7_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with a usable coordinate and the land cell around it ("" if none)."""
    return _points(spark, sf).select("record_id", "cell_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_value_counts": p3_value_counts, "p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_keys": p6_keys, "p7_found": p7_found, "p7_cells": p7_cells}

#: EPSG:6933 in plain arithmetic, as in gridloom.functions.geo, for lon/lat columns of those names.
_Q = f"(1 - {geo.E2!r}) * (sin(radians(lat)) / (1 - {geo.E2!r} * sin(radians(lat)) * sin(radians(lat))) - ln((1 - {geo.E!r} * sin(radians(lat))) / (1 + {geo.E!r} * sin(radians(lat)))) / (2 * {geo.E!r}))"
CELL_SQL = f"cast(cast(floor(radians(lon) * {geo.A * geo.K0!r} / 100000) as int) as varchar) || '_' || cast(cast(floor({_Q} * {geo.A / (2 * geo.K0)!r} / 100000) as int) as varchar)"
_NUMBER = r"try_cast(replace(regexp_extract({c}, '(\d{{1,3}}(?:[.,]\d*)?|[.,]\d+)', 1), ',', '.') as double)"
_PATTERN = r"regexp_full_match({c}, '\s*{letter}?\s*[+-]?\s*(\d{{1,3}}([.,]\d*)?|[.,]\d+)\s*°?\s*{letter}?\s*')"


def _degrees_sql(column: str, letters: str, limit: int) -> str:
    minus = letters[1]
    value = _NUMBER.format(c=column)
    return f"case when {_PATTERN.format(c=column, letter=f'[{letters}{letters.lower()}]')} and {value} <= {limit} then case when regexp_matches({column}, '[-{minus}{minus.lower()}]') then -{value} else {value} end end"


POINTS_SQL = f"""points as (
  select * from (select record_id, bin_uri, species, collection_year, {_degrees_sql('latitude', 'NS', 90)} as lat, {_degrees_sql('longitude', 'EW', 180)} as lon from bold_minimal_records)
  where lat is not null and lon is not null and not (lat = 0 and lon = 0)),
placed as (select p.*, coalesce(c.cell_id, '') as cell_id from points p left join (select distinct cell_id from bold_grid100_land_cells) c on c.cell_id = {CELL_SQL})"""
_KEYED_SQL = f"""with {POINTS_SQL},
keyed as (
  select 'bin_uri' as key_kind, upper(trim(bin_uri)) as key_value, record_id, species, collection_year from bold_minimal_records where trim(bin_uri) <> ''
  union all select 'cell_id', cell_id, record_id, species, collection_year from placed where cell_id <> '')"""
_ACC = r"nullif(regexp_replace(upper(trim(accession)), '\.[0-9]+$', ''), '')"
_DS = "nullif(regexp_replace(trim(lower(replace(replace(dataset_key, '{', ''), '}', ''))), '^urn:uuid:', ''), '')"
_ORPHAN_SQL = f"""with refs as (
  select distinct 'bold_acc_cells' as ref_table, row_id as ref_id, {_ACC} as k, date_trunc('day', first_seen_at)::timestamp as inst from bold_acc_cells
  union select distinct 'gbif_dataset_cells', row_id, {_DS}, first_seen_at from gbif_dataset_cells
  union select distinct 'dataset_literature_cache', row_id, {_DS}, fetched_at from dataset_literature_cache),
parents as (
  select 'a' as kind, {_ACC} as k, try_cast(query_date as timestamp) as f, coalesce(try_cast(nullif(trim(withdrawn_date), '') as timestamp), timestamp '9999-12-31') as u from bold_accession_links
  union all select 'd', {_DS}, registered_at, coalesce(deleted_at, timestamp '9999-12-31') from gbif_datasets),
judged as (
  select r.ref_table, r.ref_id, r.inst, r.k, count(p.k) as n_parents, coalesce(bool_or(p.f <= r.inst), false) as begun, coalesce(bool_or(p.f <= r.inst and p.u > r.inst), false) as held
  from (select * from refs where k is not null) r left join parents p on p.k = r.k and p.kind = (case when r.ref_table = 'bold_acc_cells' then 'a' else 'd' end) and p.f is not null
  group by all)"""

ORACLE = {
    "p4_found": _ORPHAN_SQL + " select distinct ref_table, ref_id, strftime(inst, '%Y-%m') as ref_period from judged where not held",
    "p4_report": _ORPHAN_SQL
    + """ select ref_table, strftime(inst, '%Y-%m') as ref_period, count(*) as n_refs,
  count(*) filter (n_parents = 0) as n_missing, count(*) filter (n_parents > 0 and not begun) as n_not_yet, count(*) filter (begun and not held) as n_ended from judged group by all""",
    "p6_keys": _KEYED_SQL
    + r""" select key_kind, key_value, count(distinct record_id) as n_records, count(distinct nullif(lower(regexp_replace(trim(species), '\s+', ' ', 'g')), '')) as n_species, count(distinct nullif(trim(collection_year), '')) as n_year
  from keyed group by all""",
    "p6_found": _KEYED_SQL
    + """, n as (select key_kind, key_value, count(distinct record_id) as n from keyed group by all)
  select key_kind, key_value from (select *, sum(n) over (partition by key_kind) as total from n) where n >= 0.02 * total""",
    "p7_found": f"with {POINTS_SQL}"
    + """ select distinct record_id, station_id, cell_id from placed p join sampling_stations s on abs(p.lat - s.latitude) < 0.05 and
  2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.latitude - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - p.lon) / 2), 2)))) <= 5""",
    "p7_cells": f"with {POINTS_SQL} select distinct record_id, cell_id from placed",
}
