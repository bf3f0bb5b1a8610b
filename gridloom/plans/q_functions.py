"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geo, nested, numeric, text, time
from gridloom.plans.book import Book
from gridloom.plans.common import T
from gridloom.plans.problems import CELL_SQL

book = Book()


@book.query("f_01_slug", "select distinct inst, trim(regexp_replace(regexp_replace(lower(inst), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as slug from bold_minimal_records where inst is not null")
def f_01(spark, sf):
    return T(spark, sf, "bold_minimal_records").select("inst").where("inst is not null").distinct().withColumn("slug", text.slug(F.col("inst")))


@book.query("f_02_coordinate_pair", r"""with t as (select distinct record_id, regexp_extract_all('(' || coalesce(latitude, '') || ' | ' || coalesce(longitude, '') || ')', '-?\d+(?:\.\d+)?') as n from bold_minimal_records)
  select record_id, case when len(n) >= 2 then cast(n[1] as double) end as lat, case when len(n) >= 2 then cast(n[2] as double) end as lon, cast(len(n) >= 2 and abs(cast(n[1] as double)) <= 90 and abs(cast(n[2] as double)) <= 180 as int) as has_coord from t""")
def f_02(spark, sf):
    pair = F.concat(F.lit("("), F.coalesce("latitude", F.lit("")), F.lit(" | "), F.coalesce("longitude", F.lit("")), F.lit(")"))
    rows = T(spark, sf, "bold_minimal_records").select("record_id", F.regexp_extract_all(pair, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)).alias("n")).distinct()
    two = F.size("n") >= 2
    lat, lon = F.try_element_at("n", F.lit(1)).try_cast("double"), F.try_element_at("n", F.lit(2)).try_cast("double")
    return rows.select("record_id", F.when(two, lat).alias("lat"), F.when(two, lon).alias("lon"), numeric.flag(two & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)).alias("has_coord"))


_YEAR = r"case when try_cast(regexp_extract(trim(bin_created_date), '^(\d{4})(?:\D|$)', 1) as int) between 1800 and 2100 then try_cast(regexp_extract(trim(bin_created_date), '^(\d{4})(?:\D|$)', 1) as int) end"


@book.query("f_03_year_month", rf"""with t as (select {_YEAR} as year, try_cast(regexp_extract(trim(bin_created_date), '^\d{{4}}-(\d{{2}})(?:\D|$)', 1) as int) as m from bold_minimal_records)
  select year, case when m between 1 and 12 then m end as month, count(*) as n from t group by all""")
def f_03(spark, sf):
    c = F.col("bin_created_date")
    return T(spark, sf, "bold_minimal_records").groupBy(time.year_of_text(c).alias("year"), time.month_of_text(c).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@book.query("f_04_species_forms", r"""with d as (select distinct species from bold_minimal_records where species is not null),
  s as (select species, trim(regexp_replace(regexp_replace(trim(species), '\s+', ' ', 'g'), '^(\S+)\s+\([^)]*\)\s*', '\1 ')) as c from d)
  select species, case when not regexp_matches(c, '^\p{Lu}') then '' else trim(concat_ws(' ', regexp_extract(c, '^(\S+)', 1), regexp_extract(c, '^\S+ ([^(\s]\S*)', 1))) end as display,
    lower(regexp_replace(trim(species), '\s+', ' ', 'g')) as key, regexp_extract(trim(species), '^(\S+)', 1) as genus, cast(trim(species) <> '' and len(string_split_regex(trim(species), '\s+')) >= 2 as int) as binomial from s""")
def f_04(spark, sf):
    c = F.col("species")
    rows = T(spark, sf, "bold_minimal_records").select("species").where("species is not null").distinct()
    return rows.select("species", text.display_species(c).alias("display"), text.key_form(c).alias("key"), text.genus_of(c).alias("genus"), numeric.flag(text.is_binomial(c)).alias("binomial"))


@book.query("f_08_canonical_binomial", r"""with s as (select distinct input_name, regexp_replace(trim(input_name), '\s+', ' ', 'g') as c from species_name_resolution where input_name is not null)
  select input_name, case when regexp_matches(c, '^\p{Lu}\p{Ll}+(?:-\p{Ll}+)? \p{Ll}[\p{Ll}-]+') and not regexp_matches(c, '^\S+ (?:sp|spp|subsp|ssp|var|cf|aff|nr|indet|x|f)\b\.?') then regexp_extract(c, '^(\S+ \S+)', 1) end as binomial from s""")
def f_08(spark, sf):
    return T(spark, sf, "species_name_resolution").select("input_name").where("input_name is not null").distinct().withColumn("binomial", text.canonical_binomial(F.col("input_name")))


@book.query("f_09_accessions", r"""with t as (select record_id, regexp_replace(unnest(string_split_regex(upper(insdc_acs), '[|;,\s]+')), '\.[0-9]+$', '') as accession from bold_minimal_records where insdc_acs is not null)
  select accession, count(distinct record_id) as n_records from t where regexp_full_match(accession, '[A-Z0-9_]{5,25}') and regexp_matches(accession, '[A-Z]') and regexp_matches(accession, '[0-9]') group by 1""")
def f_09(spark, sf):
    rows = T(spark, sf, "bold_minimal_records").select("record_id", F.explode(text.accession_tokens(F.col("insdc_acs"))).alias("accession")).distinct()
    return rows.groupBy("accession").agg(F.count(F.lit(1)).alias("n_records"))


@book.query("f_10_aliases", "select distinct a as accession, unnest([a, 'NZ_' || a]) as alias from (select distinct upper(trim(accession)) as a from bold_accession_links where trim(accession) <> '')")
def f_10(spark, sf):
    a = F.upper(F.trim("accession")).alias("accession")
    return T(spark, sf, "bold_accession_links").select(a).where("accession <> ''").distinct().select("accession", F.explode(text.accession_aliases(F.col("accession"))).alias("alias"))


@book.query("f_11_publication_key", "select pubmed_id, case when cast(pubmed_id as bigint) % 2 = 0 then 'doi:10.5555/' || pubmed_id else 'pmid:' || pubmed_id end as publication_key from (select distinct pubmed_id from bold_accession_links where pubmed_id is not null)")
def f_11(spark, sf):
    rows = T(spark, sf, "bold_accession_links").select("pubmed_id").where("pubmed_id is not null").distinct()
    d = F.when(F.col("pubmed_id").cast("long") % 2 == 0, F.concat(F.lit(" HTTPS://DOI.org/10.5555/"), "pubmed_id", F.lit(".")))
    return rows.select("pubmed_id", text.publication_key(d, "pmid", F.col("pubmed_id")).alias("publication_key"))


@book.query("f_12_inchikey", "select n_name, cast(n_nationkey % 2 = 0 as int) as valid from nation")
def f_12(spark, sf):
    letters = F.upper(F.translate(F.md5("n_name"), "0123456789", "ghijklmnop"))
    key = F.concat(letters.substr(1, 14), F.lit("-"), letters.substr(15, 10), F.when(F.col("n_nationkey") % 2 == 0, "-N").otherwise("-n"))
    return T(spark, sf, "nation").select("n_name", numeric.flag(text.is_inchikey(key)).alias("valid"))


@book.query("f_13_uuid", "select distinct dataset_key, case when regexp_full_match(lower(trim(dataset_key)), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') then lower(trim(dataset_key)) end as uuid from gbif_dataset_cells where dataset_key is not null")
def f_13(spark, sf):
    return T(spark, sf, "gbif_dataset_cells").select("dataset_key").where("dataset_key is not null").distinct().withColumn("uuid", text.uuid_or_null(F.col("dataset_key")))


@book.query("f_14_persons", r"""with t as (select record_id, regexp_replace(trim(unnest(string_split(regexp_replace(collectors, '(?i)\s+and\s+|[&;|]', ',', 'g'), ','))), '\s+', ' ', 'g') as person from bold_minimal_records where collectors is not null)
  select person, count(distinct record_id) as n_records from t where regexp_matches(person, '\p{L}{2,}') and not regexp_matches(person, '\d') group by 1""")
def f_14(spark, sf):
    rows = T(spark, sf, "bold_minimal_records").select("record_id", F.explode(text.person_tokens(F.col("collectors"))).alias("person")).distinct()
    return rows.groupBy("person").agg(F.count(F.lit(1)).alias("n_records"))


_INST = {"univ.": "university", "mus.": "museum", "dept.": "department", "lab.": "laboratory"}


@book.query("f_15_institution_form", r"""select distinct inst, trim(regexp_replace(replace(replace(replace(replace(lower(regexp_replace(inst, '\([^)]*\)', ' ', 'g')), 'univ.', 'university'), 'mus.', 'museum'), 'dept.', 'department'), 'lab.', 'laboratory'), '[\s,.]+', ' ', 'g')) as form from bold_minimal_records where inst is not null""")
def f_15(spark, sf):
    return T(spark, sf, "bold_minimal_records").select("inst").where("inst is not null").distinct().withColumn("form", text.institution_form(F.col("inst"), _INST))


@book.query("f_16_iso3", "select distinct iso_a3, case when regexp_full_match(trim(string_split(iso_a3, ';')[1]), '[A-Z]{3}') then trim(string_split(iso_a3, ';')[1]) end as iso3 from bold_grid100_land_cells where iso_a3 is not null")
def f_16(spark, sf):
    return T(spark, sf, "bold_grid100_land_cells").select("iso_a3").where("iso_a3 is not null").distinct().withColumn("iso3", text.iso3_or_null(F.col("iso_a3")))


_RULES = [("museum", "collection"), ("garden", "collection"), ("univ", "teaching"), ("dep", "teaching"), ("centre", "research"), ("lab", "research")]


@book.query("f_17_keyword_class", r"""select case when contains(lower(coalesce(inst, '')), 'museum') then 'collection' when contains(lower(coalesce(inst, '')), 'garden') then 'collection' when contains(lower(coalesce(inst, '')), 'univ') then 'teaching' when contains(lower(coalesce(inst, '')), 'dep') then 'teaching' when contains(lower(coalesce(inst, '')), 'centre') then 'research' when contains(lower(coalesce(inst, '')), 'lab') then 'research' else 'other' end as class,
  cast(coalesce(regexp_matches(inst, '(?i)\bof\b'), false) as int) as has_of, count(*) as n from bold_minimal_records group by all""")
def f_17(spark, sf):
    return T(spark, sf, "bold_minimal_records").groupBy(text.first_keyword(F.col("inst"), _RULES, "other").alias("class"), numeric.flag(text.has_word(F.col("inst"), "of")).alias("has_of")).agg(F.count(F.lit(1)).alias("n"))


@book.query("f_19_compact_number", "select o_orderkey, case when o_totalprice >= 1000000 then printf('%.1fM', round(o_totalprice / 1000000, 1)) when o_totalprice >= 1000 then printf('%.1fK', round(o_totalprice / 1000, 1)) else printf('%d', cast(trunc(o_totalprice) as bigint)) end as short from (select distinct o_orderkey, o_totalprice from orders)")
def f_19(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", "o_totalprice").distinct().select("o_orderkey", text.compact_number(F.col("o_totalprice")).alias("short"))


@book.query("f_20_latex", r"select distinct p_name || ' & ' || p_brand as label, regexp_replace(p_name || ' & ' || p_brand, '([&%$#_{}])', '\\\1', 'g') as escaped from part")
def f_20(spark, sf):
    return T(spark, sf, "part").select(F.concat("p_name", F.lit(" & "), "p_brand").alias("label")).distinct().withColumn("escaped", text.latex(F.col("label")))


@book.query("f_22_record_key", "select distinct coalesce(nullif(trim(processid), ''), nullif(trim(record_id), ''), md5(concat_ws(chr(31), coalesce(genus, ''), coalesce(species, '')))) as key, md5(concat_ws(chr(31), coalesce(genus, ''), coalesce(species, ''))) as digest from bold_minimal_records")
def f_22(spark, sf):
    row = [F.col("genus"), F.col("species")]
    return T(spark, sf, "bold_minimal_records").select(text.record_key([F.col("processid"), F.col("record_id")], row).alias("key"), text.record_key([], row).alias("digest")).distinct()


@book.query("f_23_scrape", r"select doc_id, len(regexp_extract_all(replace(text, '&amp;', '&'), 'BOLD:[A-Z]{3}\d+')) as n_bins, array_to_string(regexp_extract_all(replace(text, '&amp;', '&'), '(BOLD:[A-Z]{3}\d+)', 1), ' ') as bins from documents where text is not null")
def f_23(spark, sf):
    found = text.scraped(F.col("text"), r"(BOLD:[A-Z]{3}\d+)")
    return T(spark, sf, "documents").where("text is not null").select("doc_id", F.size(found).cast("long").alias("n_bins"), F.array_join(found, " ").alias("bins"))


@book.query("f_30_periods", """select year(o_orderdate) as year, quarter(o_orderdate) as quarter, year(o_orderdate) * 4 + quarter(o_orderdate) as period, (year(o_orderdate) - 1960) * 4 + quarter(o_orderdate) - 1 as yq, cast(floor((month(o_orderdate) + 2) / 3) as int) as quarter_of_month, count(*) as n from orders group by all""")
def f_30(spark, sf):
    d = F.col("o_orderdate")
    y, q = F.year(d), F.quarter(d)
    return T(spark, sf, "orders").groupBy(y.cast("long").alias("year"), q.cast("long").alias("quarter"), time.period_index(y, q).cast("long").alias("period"), time.yq(y, q).cast("long").alias("yq"), time.quarter_of_month(F.month(d)).alias("quarter_of_month")).agg(F.count(F.lit(1)).alias("n"))


@book.query("f_31_tolerant_dates", "select withdrawn_date, try_cast(nullif(trim(withdrawn_date), '') as timestamp) as at, count(*) as n from bold_accession_links group by all")
def f_31(spark, sf):
    return T(spark, sf, "bold_accession_links").groupBy("withdrawn_date").agg(F.count(F.lit(1)).alias("n")).select("withdrawn_date", time.tolerant_timestamp(F.trim("withdrawn_date"), "yyyy-MM-dd").alias("at"), "n")


@book.query("f_34_quarter_months", "select q as quarter, unnest([3 * q - 2, 3 * q - 1, 3 * q]) as month from (select unnest([1, 2, 3, 4]) as q)")
def f_34(spark, sf):
    return spark.range(1, 5).select(F.col("id").cast("int").alias("quarter")).select("quarter", F.explode(time.months_of_quarter(F.col("quarter"))).alias("month"))


@book.query("f_35_first_year", r"""with t as (select bin_uri, nullif(regexp_extract(coalesce(site, ''), '(?:^|\D)(1[89]\d{2}|20\d{2})(?:\D|$)', 1), '') as a, nullif(regexp_extract(coalesce(bin_created_date, ''), '(?:^|\D)(1[89]\d{2}|20\d{2})(?:\D|$)', 1), '') as b from bold_minimal_records)
  select cast(coalesce(a, b) as int) as year, count(*) as n from t group by 1""")
def f_35(spark, sf):
    return T(spark, sf, "bold_minimal_records").groupBy(time.first_valid_year(F.col("site"), F.col("bin_created_date")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@book.query("f_40_numeric", """select event_id, round(ln(1 + value), 9) as log1p, floor(value / 7) as bin, try_cast(json_extract_string(props, '$.k') as double) as k, round(value * value, 6) as square, least(greatest(value, 1.0), 50.0) as clamped, round(coalesce(value / nullif(try_cast(json_extract_string(props, '$.k') as double), 0), 0), 9) as ratio
  from (select distinct event_id, value, props from events)""")
def f_40(spark, sf):
    v, k = F.col("value"), numeric.number(F.get_json_object("props", "$.k"))
    return T(spark, sf, "events").select("event_id", "value", "props").distinct().select("event_id", F.round(F.log1p(v), 9).alias("log1p"), F.floor(v / 7).cast("double").alias("bin"), k.alias("k"), F.round(v * v, 6).alias("square"), numeric.clamp(v, 1.0, 50.0).alias("clamped"), F.round(numeric.safe_ratio(v, k), 9).alias("ratio"))


@book.query("f_44_round_half_even", "select p_partkey, round_even(p_size / 8.0, 1) as half_even, cast(p_size is null or p_size > 25 as int) as above from (select distinct p_partkey, p_size from part)")
def f_44(spark, sf):
    return T(spark, sf, "part").select("p_partkey", "p_size").distinct().select("p_partkey", F.bround((F.col("p_size") / F.lit(8.0)), 1).alias("half_even"), numeric.gt_missing_high(F.col("p_size"), 25).cast("int").alias("above"))


@book.query("f_50_split_rows", "select doc_word as word, count(*) as n from (select trim(unnest(string_split(p_name, ' '))) as doc_word from part) where doc_word <> '' group by 1")
def f_50(spark, sf):
    return T(spark, sf, "part").select(F.explode(text.split_rows(F.col("p_name"), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@book.query("f_51_json_pages", """with t as (select row_id, dataset_key, unnest(cast(pages_json as json[])) as e from dataset_literature_cache where pages_json is not null and json_valid(pages_json))
  select distinct dataset_key, json_extract_string(e, '$.id') as id, cast(json_extract_string(e, '$.year') as int) as year from t""")
def f_51(spark, sf):
    pages = T(spark, sf, "dataset_literature_cache")
    return nested.json_rows(pages, "pages_json", "id string, year int", ["dataset_key"], ["dataset_key", "id", "year"])


@book.query("f_54_facets", "select e_type as value, sum(n)::bigint as n from (select event_type as e_type, count(*) as n from events group by 1) group by 1")
def f_54(spark, sf):
    one = T(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("facet"))
    return nested.facet_rows(one, "facet", [])


@book.query("f_53_names", "select doc as pair, total from (select 'a b; c d' as doc, cast(3 as bigint) as total)")
def f_53(spark, sf):
    row = spark.range(1).select(F.array(F.struct(F.lit("a").alias("first"), F.lit("b").alias("last")), F.struct(F.lit("c").alias("first"), F.lit("d").alias("last"))).alias("who"), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)).alias("m"))
    return row.select(nested.author_list(F.col("who")).alias("pair"), nested.map_total(F.col("m")).alias("total"))


@book.query("g_01_cells", f"select cell_id, {CELL_SQL.replace('lat', 'centroid_lat').replace('lon', 'centroid_lon')} as own from bold_grid100_land_cells")
def g_01(spark, sf):
    return T(spark, sf, "bold_grid100_land_cells").select("cell_id", geo.cell_id(F.col("centroid_lon"), F.col("centroid_lat")).alias("own"))


@book.query("g_02_centroids", "select cell_id, round(centroid_lon, 6) as lon, round(centroid_lat, 6) as lat from bold_grid100_land_cells")
def g_02(spark, sf):
    lon, lat = geo.cell_centroid(F.col("cell_x"), F.col("cell_y"))
    return T(spark, sf, "bold_grid100_land_cells").select("cell_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@book.query("g_03_corners", "select cell_id, 5 as n, true as holds from bold_grid100_land_cells")
def g_03(spark, sf):
    ring = geo.cell_corners(F.col("cell_x"), F.col("cell_y"))
    rows = T(spark, sf, "bold_grid100_land_cells").select("cell_id", "centroid_lon", "centroid_lat", ring.alias("r"))
    return rows.select("cell_id", F.size("r").alias("n"), (F.col("centroid_lon").between(F.col("r")[0]["lon"], F.col("r")[1]["lon"]) & F.col("centroid_lat").between(F.col("r")[0]["lat"], F.col("r")[2]["lat"])).alias("holds"))
