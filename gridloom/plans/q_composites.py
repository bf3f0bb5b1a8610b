"""The composite pipelines over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import estimate, panel, spatial
from gridloom.operators.orphans import accession_key, dataset_key
from gridloom.plans import composites as comp
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located
from gridloom.plans.problems import CELL_SQL

book = Book()
VARIANT = panel.PanelVariant(first_year=2010, last_year=2024)
_YEARS = "(select unnest(range(2010, 2025))::int as year) y"
_CELLS = "(select distinct cell_id from bold_grid100_land_cells) c"


def _land(spark, sf):
    return T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct()


#: Outcome columns of the panel: conditions in SQL, read by both engines.
OUTCOMES = {
    "total_records": "true", "animalia_records": "kingdom = 'Animalia'", "plantae_records": "kingdom = 'Plantae'", "fungi_records": "kingdom = 'Fungi'", "bacteria_records": "kingdom = 'Bacteria'", "plantae_fungi_records": "kingdom in ('Plantae', 'Fungi')",
    "non_chordata_animalia_records": "kingdom = 'Animalia' and phylum <> 'Chordata'", "arthropoda_records": "phylum = 'Arthropoda'", "insecta_records": "class_name = 'Insecta'", "chordata_records": "phylum = 'Chordata'",
}
_NAMES = [*OUTCOMES, "n_bin", "n_new_bin"]


def _counts():
    k, p = F.col("kingdom"), F.col("phylum")
    conditions = [F.lit(True), k == "Animalia", k == "Plantae", k == "Fungi", k == "Bacteria", k.isin("Plantae", "Fungi"), (k == "Animalia") & (p != "Chordata"), p == "Arthropoda", F.col("class_name") == "Insecta", p == "Chordata"]
    return dict(zip(OUTCOMES, conditions))


@book.query("c_08_cell_year_panel", f"""with {LOCATED}, l as (select * from located where year between 2010 and 2024), first as (select bin, min(year) as year from l where bin <> '' group by 1),
  m as (select cell_id, year, {', '.join(f'count(*) filter ({c}) as {n}' for n, c in OUTCOMES.items())}, count(distinct nullif(bin, '')) as n_bin from l group by all),
  f as (select l.cell_id, l.year, count(distinct l.bin) as n_new_bin from l join first on l.bin = first.bin and l.year = first.year group by all),
  z as (select c.cell_id, y.year, {', '.join(f'coalesce({n}, 0) as {n}' for n in _NAMES)} from {_CELLS} cross join {_YEARS} left join m on m.cell_id = c.cell_id and m.year = y.year left join f on f.cell_id = c.cell_id and f.year = y.year)
  select *, {', '.join(f'cast({n} > 0 as int) as any_{n}, ln(1 + {n}) as log1p_{n}' for n in _NAMES)} from z""")
def c_08(spark, sf):
    return panel.cell_period_panel(located(spark, sf), _land(spark, sf), VARIANT, _counts(), "bin")


@book.query("c_08_cell_quarter_panel", f"""with {LOCATED}, l as (select *, cast(floor((month + 2) / 3) as int) as quarter from located where year between 2010 and 2024 and month between 1 and 12)
  select c.cell_id, y.year, q.quarter, coalesce(n, 0) as total_records, cast(coalesce(n, 0) > 0 as int) as any_total_records, ln(1 + coalesce(n, 0)) as log1p_total_records from {_CELLS} cross join {_YEARS} cross join (select unnest([1, 2, 3, 4])::int as quarter) q left join (select cell_id, year, quarter, count(*) as n from l group by all) m on m.cell_id = c.cell_id and m.year = y.year and m.quarter = q.quarter""")
def c_08_quarter(spark, sf):
    rows = located(spark, sf).where(F.col("month").between(1, 12)).withColumn("quarter", F.floor((F.col("month") + 2) / 3).cast("int"))
    return panel.cell_period_panel(rows, _land(spark, sf), panel.PanelVariant(first_year=2010, last_year=2024, quarterly=True), {"total_records": F.lit(True)})


@book.query("c_04_grid_counts", f"""with p as (select *, {CELL_SQL} as cell_id from (select longitude as lon, latitude as lat from sampling_stations)) select cell_id, count(*) as n from p group by 1""")
def c_04(spark, sf):
    pts = T(spark, sf, "sampling_stations").select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return comp.grid_counts(pts, 100_000).select("cell_id", "n")


@book.query("c_06_land_cells", "select cell_id, cell_x, cell_y, round(centroid_lon, 6) as lon, round(centroid_lat, 6) as lat from bold_grid100_land_cells")
def c_06(spark, sf):
    return comp.land_cells(spark, 100_000).join(_land(spark, sf), "cell_id", "left_semi").select("cell_id", "cell_x", "cell_y", F.round("centroid_lon", 6).alias("lon"), F.round("centroid_lat", 6).alias("lat"))


_ACC = "nullif(regexp_replace(upper(trim(accession)), '\\.[0-9]+$', ''), '')"
_LINKS = f"k as (select distinct {_ACC} as key, pubmed_id as pub_id, year(try_cast(query_date as date)) as year from bold_accession_links where pubmed_id is not null and {_ACC} is not null), w as (select distinct {_ACC} as key, cell_id, case when trim(coalesce(kingdom, '')) = '' then 'other_blank' else trim(kingdom) end as kingdom, year(first_seen_at) as y0 from bold_acc_cells where {_ACC} is not null and cell_id in (select cell_id from bold_grid100_land_cells))"


def _links(spark, sf):
    key = accession_key(F.col("accession")).alias("key")
    links = T(spark, sf, "bold_accession_links").where("pubmed_id is not null").select(key, F.col("pubmed_id").alias("pub_id"), F.year(F.try_to_date("query_date")).alias("year")).dropna(subset=["key"])
    cells = T(spark, sf, "bold_acc_cells").select(key, "cell_id", "kingdom", F.year("first_seen_at").alias("y0")).dropna(subset=["key"])
    return links, cells


@book.query("c_18_publication_exposure", f"with {_LINKS} select cell_id, year::int as year, coalesce(kingdom, 'all') as kingdom, count(distinct pub_id) as n_publications from k join w using (key) where year between 2010 and 2024 group by grouping sets ((cell_id, year, kingdom), (cell_id, year))")
def c_18(spark, sf):
    links, cells = _links(spark, sf)
    return comp.publication_exposure(links, cells, "key", _land(spark, sf), 2010, 2024)


@book.query("c_18_publication_wide", f"""with {_LINKS}, e as (select cell_id, year, coalesce(kingdom, 'all') as kingdom, count(distinct pub_id) as n from k join w using (key) where year between 2010 and 2024 group by grouping sets ((cell_id, year, kingdom), (cell_id, year))),
  z as (select c.cell_id, y.year, coalesce(max(n) filter (kingdom = 'all'), 0) as n_all, coalesce(max(n) filter (kingdom = 'Animalia'), 0) as n_animalia from {_CELLS} cross join {_YEARS} left join e on e.cell_id = c.cell_id and e.year = y.year group by all)
  select *, cast(n_all > 0 as int) as any_n_all, ln(1 + n_all) as log1p_n_all, cast(n_animalia > 0 as int) as any_n_animalia, ln(1 + n_animalia) as log1p_n_animalia from z""")
def c_18_wide(spark, sf):
    return comp.wide_publications(c_18(spark, sf), _land(spark, sf), VARIANT, ["all", "Animalia"])


@book.query("c_19_publication_yield", f"with {_LINKS} select cell_id, y0::int as year, win::int as window, coalesce(kingdom, 'all') as kingdom, count(distinct pub_id) as n_publications, cast(y0 + win <= 2024 as int) as complete from w join k using (key), (select unnest([3, 5, 10]) as win) where year - y0 between 0 and win group by grouping sets ((cell_id, y0, win, kingdom), (cell_id, y0, win))")
def c_19(spark, sf):
    links, cells = _links(spark, sf)
    from gridloom.functions.text import label_blank

    own = cells.join(_land(spark, sf), "cell_id", "left_semi").select("key", "cell_id", label_blank(F.col("kingdom"), "other_blank").alias("kingdom"), F.col("y0").alias("year"))
    return comp.publication_yield(own, links.withColumnRenamed("year", "pub_year"), "key", [3, 5, 10], 2024)


_DS = "nullif(regexp_replace(trim(lower(replace(replace(dataset_key, '{', ''), '}', ''))), '^urn:uuid:', ''), '')"


@book.query("c_20_dataset_exposure", f"""with d as (select distinct {_DS} as key, cell_id, year(first_seen_at) as y0 from gbif_dataset_cells where {_DS} is not null), p as (select distinct {_DS} as key, json_extract_string(e, '$.id') as pub_id, cast(json_extract_string(e, '$.year') as int) as y from (select dataset_key, unnest(cast(pages_json as json[])) as e from dataset_literature_cache where pages_json is not null))
  select cell_id, y0::int as year, win::int as window, count(distinct pub_id) as n_publications from d join p using (key), (select unnest([3, 5, 10]) as win) where y - y0 between 0 and win group by all""")
def c_20(spark, sf):
    from gridloom.functions import nested
    from gridloom.operators import joins

    d = T(spark, sf, "gbif_dataset_cells").select(dataset_key(F.col("dataset_key")).alias("key"), "cell_id", F.year("first_seen_at").alias("year")).dropna(subset=["key"])
    p = nested.json_rows(T(spark, sf, "dataset_literature_cache"), "pages_json", "id string, year int", ["dataset_key"])
    p = p.select(dataset_key(F.col("dataset_key")).alias("key"), F.col("id").alias("pub_id"), F.col("year").alias("pub_year"))
    # Cells and publications of a dataset are not paired: both grow with the input, their product as its square.
    return joins.cohort_counts(d, p, "key", "year", "pub_year", [3, 5, 10], ["cell_id"], "pub_id").withColumnRenamed("n", "n_publications")


_POS = "select *, (l_partkey * 7919 % 36000) / 100.0 - 180 + 0.003 as lon, (l_suppkey * 104729 % 17000) / 100.0 - 85 + 0.003 as lat, year(l_shipdate) as year from lineitem"


@book.query("c_21_event_panel", f"""with e as (select *, {CELL_SQL} as cell_id from ({_POS})), m as (select cell_id, year, count(*) as n_all, round(sum(l_quantity), 6) as deaths_all, count(*) filter (l_returnflag = 'A') as n_type_a, round(coalesce(sum(l_quantity) filter (l_returnflag = 'A'), 0), 6) as deaths_type_a, max(l_extendedprice) as strongest, round(avg(l_tax), 9) as mean_depth, count(distinct l_suppkey) as n_storms from e where year between 1995 and 2001 group by all)
  select c.cell_id, y.year, coalesce(n_all, 0) as n_all, coalesce(deaths_all, 0) as deaths_all, coalesce(n_type_a, 0) as n_type_a, coalesce(deaths_type_a, 0) as deaths_type_a, coalesce(strongest, 0) as strongest, coalesce(n_storms, 0) as n_storms, mean_depth from {_CELLS} cross join (select unnest(range(1995, 2002))::int as year) y left join m on m.cell_id = c.cell_id and m.year = y.year""")
def c_21(spark, sf):
    rows = T(spark, sf, "lineitem").withColumns({"lon": (F.col("l_partkey") * 7919 % 36000) / 100.0 - 180 + 0.003, "lat": (F.col("l_suppkey") * 104729 % 17000) / 100.0 - 85 + 0.003, "year": F.year("l_shipdate")})
    out = comp.event_panel(rows, _land(spark, sf), panel.PanelVariant(first_year=1995, last_year=2001), {"all": F.lit(True), "type_a": F.col("l_returnflag") == "A"}, {"deaths": F.col("l_quantity")}, {"strongest": F.col("l_extendedprice")}, {"mean_depth": F.col("l_tax")}, {"n_storms": F.col("l_suppkey")})
    return out.withColumns({"deaths_all": F.round("deaths_all", 6), "deaths_type_a": F.round("deaths_type_a", 6), "mean_depth": F.round("mean_depth", 9)})


@book.query("c_23_zonal_panel", f"""with px as (select *, {CELL_SQL} as cell_id from ({_POS})), m as (select cell_id, year, count(*) as n_pixels, sum(l_discount) as s, avg(l_discount) as a from px where l_discount >= 0.02 group by all) select c.cell_id, year, coalesce(n_pixels, 0) as n_pixels, round(s, 6) as zonal_sum, round(a, 6) as zonal_mean from {_CELLS} left join m using (cell_id)""")
def c_23(spark, sf):
    px = T(spark, sf, "lineitem").select(((F.col("l_partkey") * 7919 % 36000) / 100.0 - 180 + 0.003).alias("lon"), ((F.col("l_suppkey") * 104729 % 17000) / 100.0 - 85 + 0.003).alias("lat"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_discount").alias("value"))
    out = spatial.zonal(px, _land(spark, sf), ["year"], valid=lambda v: v >= 0.02)
    return out.select("cell_id", "year", "n_pixels", F.round("zonal_sum", 6).alias("zonal_sum"), F.round("zonal_mean", 6).alias("zonal_mean"))


_BOX = "(values ('west', -130.0, -40.0, -20.0, 40.0), ('east', 20.0, 120.0, -30.0, 60.0), ('north', -10.0, 30.0, 45.0, 75.0)) b(name, x0, x1, y0, y1)"


def _boxes(spark):
    boxes = [("west", -130.0, -40.0, -20.0, 40.0), ("east", 20.0, 120.0, -30.0, 60.0), ("north", -10.0, 30.0, 45.0, 75.0)]
    rows = [(n, [[(a, c), (b, c), (b, d), (a, d), (a, c)]]) for n, a, b, c, d in boxes]
    return spark.createDataFrame(rows, "name string, rings array<array<struct<lon:double,lat:double>>>")


@book.query("c_05_admin_counts", f"select name, count(*) as n from sampling_stations s join {_BOX} on longitude > x0 and longitude < x1 and latitude > y0 and latitude < y1 group by 1")
def c_05(spark, sf):
    pts = T(spark, sf, "sampling_stations").select("station_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return spatial.points_in_polygons(pts, _boxes(spark), "station_id", "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@book.query("c_25_static_overlay", f"select cell_id, coalesce(string_agg(name, ' | ' order by name), '') as names, count(name) as n_names from bold_grid100_land_cells left join {_BOX} on centroid_lon > x0 and centroid_lon < x1 and centroid_lat > y0 and centroid_lat < y1 group by 1")
def c_25(spark, sf):
    from gridloom.operators.aggregate import distinct_list

    pts = T(spark, sf, "bold_grid100_land_cells").select("cell_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    found = spatial.points_in_polygons(pts, _boxes(spark), "cell_id", "name", how="left")
    return found.groupBy("cell_id").agg(distinct_list(F.col("name"), " | ").alias("names"), F.count("name").alias("n_names"))


_SQUARES = "s as (select s_suppkey as id, cast(s_suppkey * 37 % 97 - 48 as int) as cx, cast(s_suppkey * 11 % 61 - 30 as int) as cy, (1 + s_suppkey % 9) / 10.0 as f from supplier)"


def _squares(spark, sf):
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 97 - 48).cast("int").alias("cx"), (F.col("s_suppkey") * 11 % 61 - 30).cast("int").alias("cy"), ((1 + F.col("s_suppkey") % 9) / 10.0).alias("f"))
    # A square of side f * 100 km centred on a cell corner: a quarter of it lies in each of four cells.
    h = F.col("f") * 50_000
    x, y = F.col("cx") * 100_000.0, F.col("cy") * 100_000.0
    ring = F.array(*[F.struct((x + a * h).alias("x"), (y + b * h).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return s.withColumn("ring", ring)


@book.query("c_29_clipped_area", f"with {_SQUARES} select id, (cx + dx) || '_' || (cy + dy) as cell_id, round(f * f * 10000 / 4, 6) as area_km2 from s, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy)")
def c_29_area(spark, sf):
    return spatial.cell_shares(_squares(spark, sf), "id").select("id", "cell_id", F.round("area_km2", 6).alias("area_km2"))


@book.query("c_29_protected_panel", f"""with {_SQUARES}, a as (select (cx + dx) || '_' || (cy + dy) as cell_id, cast(greatest(2010, 2005 + id % 15) as int) as year, f * f * 2500 as km2 from s, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy)), t as (select cell_id, year, sum(km2) as km2 from a group by all),
  c as (select c.cell_id, y.year, least(sum(coalesce(km2, 0)) over (partition by c.cell_id order by y.year), 10000.0) as stock from {_CELLS} cross join {_YEARS} left join t on t.cell_id = c.cell_id and t.year = y.year)
  select cell_id, year, round(stock, 4) as protected_km2, round(greatest(0, stock - coalesce(lag(stock) over (partition by cell_id order by year), 0)), 4) as new_km2, round(stock / 10000, 6) as protected_share from c""")
def c_29(spark, sf):
    squares = _squares(spark, sf)
    shares = spatial.cell_shares(squares, "id").join(squares.select("id", (2005 + F.col("id") % 15).cast("int").alias("year")), "id")
    out = comp.protected_panel(shares, _land(spark, sf), VARIANT, 10_000.0)
    return out.select("cell_id", "year", F.round("protected_km2", 4).alias("protected_km2"), F.round("new_km2", 4).alias("new_km2"), F.round("protected_share", 6).alias("protected_share"))


@book.query("c_27_road_length", "with s as (select s_suppkey as id, cast(s_suppkey * 37 % 97 - 48 as int) as cx, cast(s_suppkey * 11 % 61 - 30 as int) as cy from supplier), r as (select (cx + d) || '_' || cy as cell_id, case when d = 0 then 75.0 else 50.0 end as km from s, (select unnest([0, 1]) as d)) select cell_id, round(sum(km::double), 6) as length_km from r group by 1")
def c_27(spark, sf):
    s = T(spark, sf, "supplier").select((F.col("s_suppkey") * 37 % 97 - 48).cast("int").alias("cx"), (F.col("s_suppkey") * 11 % 61 - 30).cast("int").alias("cy"))
    x, y = F.col("cx") * 100_000.0, F.col("cy") * 100_000.0 + 50_000.0
    line = F.array(*[F.struct((x + d).alias("x"), y.alias("y")) for d in (25_000.0, 60_000.0, 150_000.0)])
    return spatial.line_lengths(s.select(line.alias("line"))).select("cell_id", F.round("length_km", 6).alias("length_km"))


@book.query("c_15_resolve_names", """with recursive t0 as (select taxonid, case when acceptednameusageid <> taxonid then acceptednameusageid end as p from taxon), ch as (select taxonid, taxonid as at_, p, 0 as hops from t0 union all select ch.taxonid, t0.taxonid, t0.p, ch.hops + 1 from ch join t0 on t0.taxonid = ch.p where ch.hops < 10), n as (select species_normalized as name, max(coalesce(kingdom_hint, '')) as hint from species_name_resolution where trim(species_normalized) <> '' group by 1), x as (select distinct taxonid, canonicalname, lower(canonicalname) as key, kingdom, acceptednameusageid as a from taxon where trim(canonicalname) <> ''),
  h as (select name, count(distinct taxonid) as c, min(taxonid) as t, count(distinct case when kingdom = hint then taxonid end) as c2, min(case when kingdom = hint then taxonid end) as t2 from n join x on x.key = n.name group by 1), p as (select name, case when c = 1 then t when c2 = 1 then t2 end as taxonid from h),
  r as (select p.name, ch.at_ as root from p join ch on ch.taxonid = p.taxonid and ch.p is null)
  select n.name, coalesce(t.canonicalname, '') as resolved_name, r.root as taxon_id, case when r.root is null then 'unresolved' else 'exact' end as method from n left join r using (name) left join taxon t on t.taxonid = r.root""")
def c_15(spark, sf):
    names = T(spark, sf, "species_name_resolution").where("trim(species_normalized) <> ''").select(F.col("species_normalized").alias("name"), "kingdom_hint")
    return comp.resolve_names(names, T(spark, sf, "taxon")).drop("kingdom")


#: Names whose first two words are a canonical name stand for what a matching service answered.
_ASKED = """k as (select lower(canonicalname) as key, min(taxonid) as taxonid from taxon where trim(canonicalname) <> '' group by 1), w as (select distinct species_normalized as name, array_to_string(string_split(species_normalized, ' ')[1:2], ' ') as two from species_name_resolution where trim(species_normalized) <> ''),
  f as (select w.name, k.taxonid from w join k on k.key = w.two)"""


@book.query("c_15_report", f"""with recursive t0 as (select taxonid, case when acceptednameusageid <> taxonid then acceptednameusageid end as p from taxon), ch as (select taxonid, taxonid as at_, p, 0 as hops from t0 union all select ch.taxonid, t0.taxonid, t0.p, ch.hops + 1 from ch join t0 on t0.taxonid = ch.p where ch.hops < 10), {_ASKED},
  n as (select species_normalized as name, max(coalesce(kingdom_hint, '')) as hint from species_name_resolution where trim(species_normalized) <> '' group by 1), x as (select distinct taxonid, lower(canonicalname) as key, kingdom from taxon where trim(canonicalname) <> ''),
  h as (select name, count(distinct taxonid) as c, min(taxonid) as t, count(distinct case when kingdom = hint then taxonid end) as c2, min(case when kingdom = hint then taxonid end) as t2 from n join x on x.key = n.name group by 1), e as (select name, case when c = 1 then t when c2 = 1 then t2 end as taxonid from h),
  p as (select name, taxonid, 'exact' as method from e where taxonid is not null union all select name, taxonid, 'fetched' from f where name not in (select name from e where taxonid is not null)), r as (select p.name, p.method, ch.at_ as root from p join ch on ch.taxonid = p.taxonid and ch.p is null),
  g as (select lower(canonicalname) as g, min(kingdom) as k from taxon where taxonrank = 'genus' and trim(canonicalname) <> '' group by 1)
  select coalesce(r.method, 'unresolved') as method, count(*) as n, count(coalesce(t.kingdom, g.k, nullif(n.hint, ''))) as with_kingdom from n left join r using (name) left join taxon t on t.taxonid = r.root left join g on g.g = string_split(n.name, ' ')[1] group by 1""")
def c_15_report(spark, sf):
    names = T(spark, sf, "species_name_resolution").where("trim(species_normalized) <> ''").select(F.col("species_normalized").alias("name"), "kingdom_hint")
    taxa = T(spark, sf, "taxon")
    known = taxa.where("trim(canonicalname) <> ''").groupBy(F.lower("canonicalname").alias("two")).agg(F.min("taxonid").alias("taxonid"))
    fetched = names.select("name", F.array_join(F.slice(F.split("name", " "), 1, 2), " ").alias("two")).distinct().join(known, "two").select("name", "taxonid")
    return comp.resolution_report(comp.resolve_names(names, taxa, fetched=fetched))


@book.query("c_16_species_universe", f"""with {LOCATED}, r as (select l.*, nullif(species, '') as own, lower(b.consensus_species) as c from located l left join (select distinct bin_uri, consensus_species from bin_consensus_lookup) b on b.bin_uri = l.bin)
  select coalesce(own, nullif(c, '')) as species, count(*) as n_records, count(distinct cell_id) as n_cells, min(year) as first_year, max(year) as last_year, count(*) filter (own is null) as from_bin from r where coalesce(own, nullif(c, '')) is not null group by 1""")
def c_16(spark, sf):
    consensus = T(spark, sf, "bin_consensus_lookup").select(F.col("bin_uri").alias("bin"), F.lower("consensus_species").alias("species")).distinct()
    return comp.species_universe(located(spark, sf), consensus)


@book.query("c_30_top_collectors", r"""with t as (select distinct record_id, regexp_replace(trim(unnest(string_split(regexp_replace(collectors, '(?i)\s+and\s+|[&;|]', ',', 'g'), ','))), '\s+', ' ', 'g') as person from bold_minimal_records where collectors is not null), c as (select person, count(*) as n_records from t where regexp_matches(person, '\p{L}{2,}') and not regexp_matches(person, '\d') group by 1)
  select cast(row_number() over (order by n_records desc, person) as int) as rank, person, n_records, round(n_records / sum(n_records) over (), 9) as share from c order by rank limit 25""")
def c_30(spark, sf):
    out = comp.top_collectors(T(spark, sf, "bold_minimal_records"), 25)
    return out.select("rank", "person", "n_records", F.round("share", 9).alias("share"))


@book.query("c_31_classifications", """with a as (select c_custkey as number, case when c_custkey % 4 <> 0 then c_mktsegment end as a from customer where c_custkey % 5 <> 0), b as (select c_custkey as number, case when c_custkey % 3 = 0 then 'OTHER' when c_custkey % 7 <> 0 then lower(c_mktsegment) end as b from customer)
  select status, count(*) as n, count(final) as n_final from (select case when number % 50 = 1 then 'reviewed' when a is null and b is null then 'unknown' when a is null then 'only_b' when b is null then 'only_a' when lower(a) = lower(b) then 'agree' else 'conflict' end as status, case when number % 50 = 1 then 'x' when a is not null and b is not null and lower(a) <> lower(b) then null else coalesce(a, b) end as final from a full join b using (number)) group by 1""")
def c_31(spark, sf):
    c = T(spark, sf, "customer").withColumnRenamed("c_custkey", "number")
    n = F.col("number")
    a = c.where(n % 5 != 0).select("number", F.when(n % 4 != 0, F.col("c_mktsegment")).alias("value"))
    b = c.select("number", F.when(n % 3 == 0, "OTHER").when(n % 7 != 0, F.lower("c_mktsegment")).alias("value"))
    decided = c.where(n % 50 == 1).select("number", F.lit("x").alias("value"))
    return comp.merge_classifications(a, b, decided).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("final").alias("n_final"))


@book.query("c_36_merge_all", f"""with {LOCATED}, n as (select cell_id, year, count(*) as n from located group by all), s as (select cell_id, count(*) as stations from (select {CELL_SQL} as cell_id from (select longitude as lon, latitude as lat from sampling_stations)) group by 1)
  select c.cell_id, y.year, c.iso_a3, coalesce(n, 0) as n, coalesce(stations, 0) as stations, round(coalesce(n / nullif(stations, 0), 0), 6) as per_station from bold_grid100_land_cells c cross join {_YEARS} left join n on n.cell_id = c.cell_id and n.year = y.year left join s on s.cell_id = c.cell_id""")
def c_36(spark, sf):
    from gridloom.functions.numeric import safe_ratio

    land = T(spark, sf, "bold_grid100_land_cells").select("cell_id", "iso_a3")
    base = panel.skeleton(land.select("cell_id"), VARIANT)
    n = located(spark, sf).where(F.col("year").isNotNull()).groupBy("cell_id", "year").agg(F.count(F.lit(1)).alias("n"))
    s = c_04(spark, sf).withColumnRenamed("n", "stations")
    out = comp.merge_all(base, [(n, ["cell_id", "year"]), (land, ["cell_id"]), (s, ["cell_id"])]).na.fill(0, ["n", "stations"])
    return out.select("cell_id", "year", "iso_a3", "n", "stations", F.round(safe_ratio(F.col("n"), F.col("stations")), 6).alias("per_station"))


_KINGDOMS = ("Animalia", "Plantae", "Fungi", "Bacteria", "Protista")
_GROUPS = ("animalia_insects", "plants", "bold_root", "chordata", "fungi", "arthropods_other")
_CELL_TABLES = {"dataset_rows": "gbif_dataset_cells", "accession_rows": "bold_acc_cells"}
_WIDE = {f"{k.lower()}_{m}": f"{e} filter (kingdom = '{k}')" for k in _KINGDOMS for m, e in (("n", "count(*)"), ("species", "count(distinct nullif(species, ''))"), ("bins", "count(distinct nullif(bin, ''))"))} | {f"from_{g}": f"count(*) filter (source_group = '{g}')" for g in _GROUPS} | {"institutions": "count(distinct nullif(inst, ''))", "genera": "count(distinct nullif(genus, ''))"}


@book.query("c_36_all_parts", f"""with {LOCATED}, w as (select cell_id, year, {', '.join(f'{e} as {n}' for n, e in _WIDE.items())} from located group by all), {', '.join(f"{n} as (select cell_id, year(first_seen_at)::int as year, count(distinct row_id) as {n} from {t} group by all)" for n, t in _CELL_TABLES.items())},
  s as (select cell_id, count(*) as stations from (select {CELL_SQL} as cell_id from (select longitude as lon, latitude as lat from sampling_stations)) group by 1)
  select c.cell_id, y.year, c.continent, c.country, {', '.join(f'coalesce(w.{n}, 0) as {n}' for n in _WIDE)}, {', '.join(f'coalesce({n}.{n}, 0) as {n}' for n in _CELL_TABLES)}, coalesce(stations, 0) as stations from bold_grid100_land_cells c cross join {_YEARS}
  left join w on w.cell_id = c.cell_id and w.year = y.year {' '.join(f'left join {n} on {n}.cell_id = c.cell_id and {n}.year = y.year' for n in _CELL_TABLES)} left join s on s.cell_id = c.cell_id""")
def c_36_all(spark, sf):
    """Twenty-seven parts of their own, as they come from other pipelines, merged onto the cells and years."""
    from gridloom.storage import checkpointed

    land = T(spark, sf, "bold_grid100_land_cells").select("cell_id", "continent", "country")
    rows = checkpointed(located(spark, sf).select("cell_id", "year", "kingdom", "source_group", "species", "bin", "inst", "genus").where("year is not null"))
    keys = ["cell_id", "year"]
    some = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    parts = []
    for k in _KINGDOMS:
        own = rows.where(F.col("kingdom") == k)
        parts += [(own.groupBy(*keys).agg(m.alias(f"{k.lower()}_{n}")), keys) for n, m in (("n", F.count(F.lit(1))), ("species", some("species")), ("bins", some("bin")))]
    parts += [(rows.where(F.col("source_group") == g).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"from_{g}")), keys) for g in _GROUPS]
    parts += [(rows.groupBy(*keys).agg(some(c).alias(n)), keys) for n, c in (("institutions", "inst"), ("genera", "genus"))]
    parts += [(T(spark, sf, t).groupBy("cell_id", F.year("first_seen_at").alias("year")).agg(F.countDistinct("row_id").alias(n)), keys) for n, t in _CELL_TABLES.items()]
    parts += [(land, ["cell_id"]), (c_04(spark, sf).withColumnRenamed("n", "stations"), ["cell_id"])]
    # Cut into written thirds: 27 joins in one plan are the driver's burden, not the executors'.
    out = panel.skeleton(land.select("cell_id"), VARIANT)
    for k in range(0, len(parts), 9):
        out = checkpointed(comp.merge_all(out, parts[k : k + 9]))
    return out.na.fill(0, [*_WIDE, *_CELL_TABLES, "stations"])


@book.query("e_01_fixed_effects", """with d as (select l_suppkey as u, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey) as y, l_quantity - avg(l_quantity) over (partition by l_suppkey) as x from lineitem), b as (select sum(x * y) / sum(x * x) as beta from d) select 'l_quantity' as term, round(beta, 4) as estimate, (select count(*) from d) as n from b""")
def e_01(spark, sf):
    fit = estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_suppkey")
    return fit.table(spark).select("term", F.round("estimate", 4).alias("estimate"), F.lit(fit.n).cast("long").alias("n"))


@book.query("e_14_sample_moments", "select count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd from orders where o_totalprice > 1000")
def e_14(spark, sf):
    y = F.col("o_totalprice")
    return T(spark, sf, "orders").where(y > 1000).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(y), 4).alias("mean"), F.round(F.stddev_samp(y), 4).alias("sd"))


@book.query("e_17_exposure_stock", f"with m as (select c_nationkey as u, year(o_orderdate)::int as t, count(*) as n from orders join customer on c_custkey = o_custkey group by all) select u, t, n, cast(coalesce(sum(n) over (partition by u order by t rows between unbounded preceding and 1 preceding), 0) as bigint) as l1_stock from m")
def e_17(spark, sf):
    from gridloom.operators.window import cumulative

    m = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("u"), F.year("o_orderdate").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return m.select("u", "t", "n", (cumulative(["u"], "t", F.col("n")) - F.col("n")).alias("l1_stock"))


@book.query("t_06_daily_windows", "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by all")
def t_06(spark, sf):
    return T(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@book.query("t_02_resumed_ingest", "select distinct event_id, user_id, event_type from events where event_type in ('view', 'click', 'purchase')")
def t_02(spark, sf):
    """The events table read as a stream in two runs that share a checkpoint, failures set apart; the good rows."""
    import uuid

    from gridloom.storage import shared_dir
    from gridloom.streaming import ingest

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T(spark, sf, "events").schema
    for _ in range(2):  # the second run finds everything covered
        stream = ingest.file_stream(spark, f"{sf}/events.parquet*", schema)
        ingest.write_available(stream, f"{base}/good", f"{base}/checkpoint", f"{base}/failed", F.col("event_type").isin("view", "click", "purchase")).awaitTermination()
    return spark.read.parquet(f"{base}/good").select("event_id", "user_id", "event_type").distinct()
