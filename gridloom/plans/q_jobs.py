"""Shapes and rasters against points and cells, service jobs over stand-ins for the services, audits and suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import nested, text
from gridloom.operators import aggregate, spatial
from gridloom.plans import composites as comp
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located
from gridloom.plans.problems import CELL_SQL
from gridloom.plans.q_composites import _BOX, _SQUARES, _boxes, _squares
from gridloom.plans.q_estimates import _SAMPLES, _within
from gridloom.plans.q_files import new, put
from gridloom.sources import binary, ingest, sinks
from gridloom.sources import text as source_text

book = Book()
REC = "bold_minimal_records"
_POINTS = "pt as (select station_id, longitude as lon, latitude as lat from sampling_stations)"


def _stations(spark, sf) -> DataFrame:
    return T(spark, sf, "sampling_stations").select("station_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))


@book.query("j_16_within", f"with {_POINTS} select station_id, name from pt join {_BOX} on lon > x0 and lon < x1 and lat > y0 and lat < y1")
def j_16(spark, sf):
    return spatial.points_in_polygons(_stations(spark, sf), _boxes(spark), "station_id", "name").select("station_id", "name")


@book.query("j_17_within_left", f"with {_POINTS} select station_id, name from pt left join {_BOX} on lon > x0 and lon < x1 and lat > y0 and lat < y1")
def j_17(spark, sf):
    return spatial.points_in_polygons(_stations(spark, sf), _boxes(spark), "station_id", "name", how="left").select("station_id", "name")


@book.query("g_05_point_in_polygon", f"with l as (select cell_id, centroid_lon as lon, centroid_lat as lat from bold_grid100_land_cells) select name, count(*) as n from l join {_BOX} on lon > x0 and lon < x1 and lat > y0 and lat < y1 group by 1")
def g_05(spark, sf):
    cells = T(spark, sf, "bold_grid100_land_cells").select("cell_id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))
    return spatial.points_in_polygons(cells, _boxes(spark), "cell_id", "name").groupBy("name").agg(F.count("*").alias("n"))


@book.query("j_18_intersects", f"with {_SQUARES} select id, (cx + dx) || '_' || (cy + dy) as cell_id from s, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy)")
def j_18(spark, sf):
    return spatial.cell_shares(_squares(spark, sf), "id").where("area_km2 > 0").select("id", "cell_id")


@book.query("j_19_overlay", f"with {_SQUARES}, a as (select (cx + dx) || '_' || (cy + dy) as cell_id, f * f * 2500 as km2 from s, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy)) select cell_id, round(sum(km2), 6) as area_km2 from a group by 1")
def j_19(spark, sf):
    return spatial.cell_shares(_squares(spark, sf), "id").groupBy("cell_id").agg(F.round(F.sum("area_km2"), 6).alias("area_km2"))


@book.query("g_04_area", f"with {_SQUARES} select id, round(f * f * 10000, 6) as area_km2 from s")
def g_04(spark, sf):
    return spatial.cell_shares(_squares(spark, sf), "id").groupBy("id").agg(F.round(F.sum("area_km2"), 6).alias("area_km2"))


@book.query("j_20_union_in_cell", f"with {_SQUARES}, a as (select (cx + dx) || '_' || (cy + dy) as cell_id, max(f * f * 2500) as km2 from s, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy) group by cx, cy, dx, dy), b as (select cell_id from (select distinct cx, cy from s) p, (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy), lateral (select (cx + dx) || '_' || (cy + dy) as cell_id) group by 1 having count(*) = 1) select cell_id, round(km2, 4) as area_km2 from a where cell_id in (select cell_id from b)")
def j_20(spark, sf):
    """Shapes of one centre lie in each other, so their union in a cell is the largest; cells that two centres reach are left to g_07."""
    squares = _squares(spark, sf)
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    h = F.col("f") * 50_000
    parts = squares.select("cx", "cy", "f", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0) for dy in (-1, 0)])).alias("d"))
    parts = parts.select("cx", "cy", "f", F.concat_ws("_", F.col("cx") + F.col("d.dx"), F.col("cy") + F.col("d.dy")).alias("cell_id"), (F.col("cx") * 100_000.0 + F.col("d.dx") * h).alias("x"), (F.col("cy") * 100_000.0 + F.col("d.dy") * h).alias("y"))
    rings = parts.select("cx", "cy", "cell_id", F.array(corner(0.0, 0.0), corner(h, 0.0), corner(h, h), corner(0.0, h)).alias("ring"))
    single = parts.select("cell_id", "cx", "cy").distinct().groupBy("cell_id").agg(F.count("*").alias("k")).where("k = 1").select("cell_id")
    return spatial.union_area(rings.join(single, "cell_id", "left_semi"), ["cell_id"], "ring").select("cell_id", F.round(F.col("area") / 1e6, 4).alias("area_km2"))


@book.query("g_09_line_length", "select '0_0' as cell_id, 75.0 as length_km union all select '1_0', 50.0")
def g_09(spark, sf):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(50_000.0).alias("y")) for x in (25_000.0, 60_000.0, 150_000.0)])
    return spatial.line_lengths(spark.range(1).select(line.alias("line"))).select("cell_id", F.round("length_km", 6).alias("length_km"))


_PIXELS = "px as (select longitude as lon, latitude as lat, station_id::double as value from sampling_stations)"


@book.query("j_22_zonal_join", f"with {_PIXELS}, z as (select {CELL_SQL} as cell_id, value from px) select c.cell_id, count(value) as n_pixels, round(sum(value), 6) as zonal_sum from (select distinct cell_id from bold_grid100_land_cells) c join z using (cell_id) group by 1")
def j_22(spark, sf):
    px = _stations(spark, sf).withColumn("value", F.col("station_id").cast("double"))
    return spatial.zonal(px, T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct()).where("n_pixels > 0").select("cell_id", "n_pixels", F.round("zonal_sum", 6).alias("zonal_sum"))


@book.query("c_26_zonal_static", f"with {_PIXELS}, z as (select {CELL_SQL} as cell_id, value from px) select c.cell_id, count(value) as n_pixels, round(coalesce(avg(value), 0), 6) as zonal_mean from (select distinct cell_id from bold_grid100_land_cells) c left join z using (cell_id) group by 1")
def c_26(spark, sf):
    px = _stations(spark, sf).withColumn("value", F.col("station_id").cast("double"))
    out = spatial.zonal(px, T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct(), empty_as_zero=True)
    return out.select("cell_id", "n_pixels", F.round(F.coalesce("zonal_mean", F.lit(0.0)), 6).alias("zonal_mean"))


@book.query("g_10_orientation", "select 0 as row, 0.5 as lon, 2.5 as lat, 1.0 as value union all select 2, 0.5, 0.5, 3.0")
def g_10(spark, sf):
    """Row 0 of a raster is its north; a pixel is where its centre is, half a cell in from the corner."""
    import numpy as np

    path = new(spark, "oriented")
    put(f"{path}/a.tif", binary.geotiff_bytes(np.array([[1.0], [-9.0], [3.0]], dtype="float32"), 0.0, 3.0, 1.0, nodata=-9.0))
    return binary.read_geotiff(spark, f"{path}/a.tif").where("value is not null").select("row", "lon", "lat", "value")


@book.query("c_28_species_richness", f"with {_SQUARES}, r as (select s.id, s_nationkey as species from s join supplier on s_suppkey = s.id where s_suppkey % 4 in (1, 2)) select (cx + dx) || '_' || (cy + dy) as cell_id, count(distinct r.species) as richness from r join s using (id), (select unnest([-1, 0]) as dx), (select unnest([-1, 0]) as dy) group by 1")
def c_28(spark, sf):
    """Distinct species whose resident ranges (presence 1, origin 1, seasonal 1 or 2) touch a cell."""
    from gridloom.operators import filters

    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("species"), F.lit(1).alias("presence"), F.lit(1).alias("origin"), (F.col("s_suppkey") % 4).alias("seasonal"))
    own = filters.resident_ranges(s).select("id", "species")
    touched = spatial.cell_shares(_squares(spark, sf), "id").where("area_km2 > 0").select("id", "cell_id")
    return touched.join(own, "id").groupBy("cell_id").agg(F.countDistinct("species").alias("richness"))


# audits and composites over the records -----------------------------------------------------------------------------------
@book.query("c_01_build_minimal", "select cast(o_orderkey as varchar) as record_id, cast(year(o_orderdate) as varchar) as collection_year, cast(month(o_orderdate) as varchar) as collection_month, case when o_orderkey % 3 = 0 then '1' else '0' end as has_coord, case when o_orderkey % 2 = 0 then 'Animalia' else '' end as kingdom from orders")
def c_01(spark, sf):
    k = F.col("o_orderkey")
    raw = T(spark, sf, "orders").select(k.cast("string").alias("record_id"), F.when(k % 2 == 0, " Animalia ").alias("kingdom"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("collection_date_start"), F.when(k % 3 == 0, "10.5, 20").otherwise("999, 20").alias("coord"))
    return comp.build_minimal(raw).select("record_id", "collection_year", "collection_month", "has_coord", "kingdom")


@book.query("c_02_class_counts", "select case when trim(coalesce(class_name, '')) = '' then 'Unknown' else trim(class_name) end as class_name, count(*) as n from bold_minimal_records where kingdom = 'Animalia' group by 1")
def c_02(spark, sf):
    return T(spark, sf, REC).where("kingdom = 'Animalia'").groupBy(text.label_blank(text.clean(F.col("class_name")), "Unknown").alias("class_name")).agg(F.count("*").alias("n"))


@book.query("c_11_link_accessions", "select distinct nullif(regexp_replace(upper(trim(accession)), '\\.[0-9]+$', ''), '') as accession, pubmed_id from bold_accession_links where pubmed_id is not null and trim(accession) <> ''")
def c_11(spark, sf):
    """Answers of a service in flat files, parsed and kept once a pair."""
    from gridloom.operators.orphans import accession_key

    links = T(spark, sf, "bold_accession_links").where("pubmed_id is not null").select(accession_key(F.col("accession")).alias("accession"), "pubmed_id").dropna()
    files = links.select(F.concat(F.lit("LOCUS x\nACCESSION   "), "accession", F.lit("\n   PUBMED   "), "pubmed_id", F.lit("\n//")).alias("entry"))
    parsed = source_text.parse_flat_file(files, "entry")
    return parsed.select("accession", F.explode("pubmed_ids").alias("pubmed_id")).distinct()


@book.query("c_12_publication_metadata", "select pubmed_id, concat('10.5/', pubmed_id) as doi, min(year(try_cast(query_date as date)))::int as year from bold_accession_links where pubmed_id is not null group by pubmed_id")
def c_12(spark, sf):
    """Metadata upserted by publication: the first identifier of its kind, the first year that reads as one."""
    from gridloom.functions.time import first_valid_year

    rows = T(spark, sf, "bold_accession_links").where("pubmed_id is not null").groupBy("pubmed_id").agg(F.min(F.try_to_date("query_date")).alias("d"))
    ids = F.array(F.struct(F.lit("pii").alias("type"), F.lit("x").alias("value")), F.struct(F.lit("doi").alias("type"), F.concat(F.lit("10.5/"), "pubmed_id").alias("value")))
    fresh = rows.select("pubmed_id", nested.first_identifier(ids, "doi").alias("doi"), first_valid_year(F.lit("n.d."), F.date_format("d", "yyyy-MM-dd")).cast("int").alias("year"), F.lit(2).alias("version"))
    stale = fresh.where(F.col("pubmed_id").cast("long") % 2 == 0).withColumn("year", F.lit(None).cast("int")).withColumn("version", F.lit(1))
    return sinks.upsert(stale, fresh, ["pubmed_id"], "version").select("pubmed_id", "doi", "year")


@book.query("c_13_dataset_publications", "select distinct lower(trim(dataset_key)) as dataset_key, row_id from dataset_literature_cache where lower(trim(status)) = 'ok' and trim(dataset_key) <> ''")
def c_13(spark, sf):
    cache = T(spark, sf, "dataset_literature_cache")
    return cache.where(F.lower(F.trim("status")) == "ok").select(F.lower(F.trim("dataset_key")).alias("dataset_key"), "row_id").where("dataset_key <> ''").distinct()


@book.query("c_32_fill_countries", f"with {LOCATED}, v as (select cell_id, country_iso, count(*) as n from located where country_iso <> '' group by all), t as (select cell_id, sum(n) as t from v group by 1), b as (select cell_id, country_iso from (select *, row_number() over (partition by cell_id order by n desc, country_iso) as k from v) join t using (cell_id) where k = 1 and n >= 0.5 * t) select l.record_id, b.country_iso as filled from (select distinct record_id, cell_id from located where country_iso = '') l join b using (cell_id)")
def c_32(spark, sf):
    """Records without a country take their cell's, if at least half of the cell's records agree."""
    rows = located(spark, sf)
    best = aggregate.plurality(rows.where("country_iso <> ''").select("cell_id", "country_iso"), ["cell_id"], "country_iso", 0.5)
    share = next(c for c in best.columns if c in ("concordance", "share"))
    value = next(c for c in best.columns if c in ("country_iso", "value", "consensus"))
    best = best.where(F.col(share) >= 0.5).select("cell_id", F.col(value).alias("filled"))
    return rows.where("country_iso = ''").select("record_id", "cell_id").distinct().join(best, "cell_id").select("record_id", "filled")


_FIELDS = ("genus", "species", "site", "collectors", "inst")


@book.query("c_34_field_audit", " union all ".join(f"select '{f}' as field, count(*) filter (trim({f}) <> '') as filled, count(distinct case when trim({f}) <> '' then trim({f}) end) as n_values from bold_minimal_records" for f in _FIELDS))
def c_34(spark, sf):
    rows = T(spark, sf, REC).select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(text.clean(F.col(f)), F.lit("")).alias("v")) for f in _FIELDS])))
    return rows.groupBy("field").agg(F.count("v").alias("filled"), F.countDistinct("v").alias("n_values"))


@book.query("p_21_status_machine", "select o_orderkey as number, case when o_orderkey % 5 = 0 then 'reviewed' when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'agree' when o_orderkey % 2 = 0 then 'only_a' when o_orderkey % 3 = 0 then 'only_b' else 'unknown' end as status from orders")
def p_21(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("number"))
    a = o.select("number", F.when(F.col("number") % 2 == 0, "x").otherwise(" ").alias("value"))
    b = o.select("number", F.when(F.col("number") % 3 == 0, "x").otherwise("").alias("value"))
    return comp.merge_classifications(a, b, o.where(F.col("number") % 5 == 0).select("number", F.lit("y").alias("value"))).select("number", "status")


@book.query("p_29_dry_run", "select 50 as rows")
def p_29(spark, sf):
    """A dry run's limit is the feature: a job over a few rows shows that it works."""
    return T(spark, sf, "orders").limit(50).agg(F.count("*").cast("int").alias("rows"))


@book.query("o_02_sorted_file", "select c_custkey, row_number() over (order by c_custkey) - 1 as place from customer")
def o_02(spark, sf):
    """Files written in key order: the same content in the same order, whatever the input's partitions."""
    path = new(spark, "sorted")
    sinks.write_csv(T(spark, sf, "customer").repartition(7).select("c_custkey"), path, ["c_custkey"])
    read = spark.read.schema(source_text.text_schema(["c_custkey"])).option("header", True).csv(path).select("c_custkey", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))

    per_file = read.groupBy("f").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    placed = read.join(F.broadcast(per_file.select("f", "before")), "f").withColumn("place", F.row_number().over(W.partitionBy("f").orderBy("i")) - 1 + F.col("before"))
    return placed.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("place").cast("long").alias("place"))


@book.query("k_12_histogram", "select cast(floor(least(value, 100) / 10) as int) as bin, count(*) as n from events where value is not null group by 1")
def k_12(spark, sf):
    """What a histogram shows; lines, bars, maps and heatmaps are drawn from tables like it."""
    v = F.least(F.col("value"), F.lit(100.0))
    return T(spark, sf, "events").where("value is not null").groupBy(F.floor(v / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@book.query("k_13_geojson", "select s_suppkey, 'Polygon' as kind from supplier")
def k_13(spark, sf):
    path = new(spark, "features")
    k = F.col("s_suppkey").cast("double")
    ring = F.array(*[F.struct((k + a).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))])
    sinks.geojson_features(T(spark, sf, "supplier").select("s_suppkey", F.array(ring).alias("rings"))).write.text(path)
    g = F.from_json("value", "struct<properties:struct<s_suppkey:long>,geometry:struct<type:string>>")
    return spark.read.text(path).select(g.alias("g")).select(F.col("g.properties.s_suppkey").alias("s_suppkey"), F.col("g.geometry.type").alias("kind"))


@book.query("e_15_summary", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd, round(min(o_totalprice), 4) as low, round(max(o_totalprice), 4) as high from orders group by 1")
def e_15(spark, sf):
    y = F.col("o_totalprice")
    return T(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), *[F.round(f(y), 4).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))])


@book.query("c_37_suite", " union all ".join(f"select '{y}/{n}' as spec, round({_within(w, y)}, 7) as estimate" for y in ("l_extendedprice", "l_discount") for n, w in _SAMPLES.items()))
def c_37(spark, sf):
    """Outcomes by samples: a suite of regressions from a table of settings."""
    from gridloom.operators import estimate

    specs = {f"{y}/{n}": {"y": y, "x": ["l_quantity"], "absorb": ["l_suppkey"], "cluster": "l_suppkey", "where": w} for y in ("l_extendedprice", "l_discount") for n, w in _SAMPLES.items()}
    return estimate.specifications(T(spark, sf, "lineitem"), specs).select("spec", F.round("estimate", 7).alias("estimate"))


@book.query("c_38_batch_runner", "select * from (values ('read', 'skipped'), ('build', 'ok'), ('check', 'failed'), ('publish', 'not run')) t(step, status)")
def c_38(spark, sf):
    def fail():
        raise ValueError("no")

    steps = [("read", lambda: None), ("build", lambda: T(spark, sf, "nation").count()), ("check", fail), ("publish", lambda: None)]
    return spark.createDataFrame(ingest.run_batch(steps, "build"), "step string, status string, message string").select("step", "status")


# services: stand-ins answer in their place ----------------------------------------------------------------------------------
@book.query("s_19_validated_downloads", "select o_orderstatus as query, count(*) as n, 'ok' as status from orders group by 1")
def s_19(spark, sf):
    """Each query is validated, summed up, fetched, and its status told by rows and bytes."""
    counts = T(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("query")).agg(F.count("*").alias("n"), F.sum(F.length("o_orderpriority")).alias("bytes"))
    return counts.select("query", "n", ingest.status_of(F.col("n"), F.col("bytes"), 1_000_000_000).alias("status"))


@book.query("s_21_facet_queries", "select s_nationkey as facet, count(*) as n from supplier group by 1")
def s_21(spark, sf):
    m = T(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_nationkey").cast("string").alias("k"), "n"))).alias("m"), F.lit(1).alias("one"))
    facets = nested.facet_rows(m, "m", ["one"]).toDF("one", "facet", "n")
    return facets.select(F.col("facet").cast("long").alias("facet"), "n")


@book.query("s_25_cached_match", "select distinct canonicalname as name, upper(canonicalname) as answer from taxon where canonicalname is not null")
def s_25(spark, sf):
    """Half the names are in the cache; the others are asked in batches, and no name twice."""
    names = T(spark, sf, "taxon").select(F.col("canonicalname").alias("name"))
    cache = names.dropna().distinct().where(F.xxhash64("name") % 2 == 0).withColumn("answer", F.upper("name"))
    seen: set[str] = set()

    def ask(part: list[str]) -> dict[str, str]:
        if seen & set(part):
            raise AssertionError("asked twice")
        seen.update(part)
        return {n: n.upper() for n in part}

    answers, full = ingest.cached_answers(names, cache, ask, 500)
    return ingest.cached_answers(names, full, ask, 500)[0] if answers.columns else answers


@book.query("s_27_rate_limit", "select 10 as calls, 0.9 as seconds")
def s_27(spark, sf):
    now = [0.0]

    def sleep(seconds: float) -> None:
        now[0] += seconds

    limit = ingest.RateLimiter(10, clock=lambda: now[0], sleep=sleep)
    for _ in range(10):
        limit.wait()
    return spark.createDataFrame([(10, round(now[0], 6))], "calls int, seconds double")


@book.query("s_28_yearly_paging", "select distinct n_nationkey from nation")
def s_28(spark, sf):
    """Pages by year that overlap: an id that comes twice is kept once."""
    ids = [r.n_nationkey for r in T(spark, sf, "nation").collect()]  # stands for a service
    got = [x for year in range(3) for page in ingest.pages(lambda at, size, y=year: ([i for i in ids if i % 3 in (y, 0)][at : at + size], None), 4) for x in page]
    return spark.createDataFrame([(i,) for i in got], "n_nationkey long").distinct()


@book.query("s_29_batches", "select cast(floor((row_number - 1) / 10) as int) as batch, count(*) as n from (select row_number() over (order by n_nationkey) as row_number from nation) group by 1")
def s_29(spark, sf):
    keys = sorted(r.n_nationkey for r in T(spark, sf, "nation").collect())
    return spark.createDataFrame([(i, len(b)) for i, b in enumerate(ingest.batches(keys, 10))], "batch int, n long")


@book.query("s_30_paged_by_year", "select year(o_orderdate)::int as year, count(*) as n from orders group by 1")
def s_30(spark, sf):
    """Each year paged to its end; the year's total tells that no page is missing."""
    total = {r.year: r.n for r in T(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).collect()}  # a row a year
    paged = [(y, sum(len(p) for p in ingest.pages(lambda at, size, n=n: (list(range(at, min(n, at + size))), n), 5000))) for y, n in total.items()]
    return spark.createDataFrame(paged, "year int, n long")


@book.query("s_31_download", "select length(s) as bytes, sha256(s) as sha256, true as kept from (select string_agg(r_name, chr(10) order by r_regionkey) as s from region)")
def s_31(spark, sf):
    body = "\n".join(r.r_name for r in T(spark, sf, "region").orderBy("r_regionkey").collect()).encode()
    path = f"{new(spark, 'download')}/a.txt"
    first = ingest.download(lambda: iter([body[:7], body[7:]]), path)
    again = ingest.download(lambda: iter([b"other"]), path)  # the file is there: not fetched again
    return spark.createDataFrame([(*first, first == again)], "bytes long, sha256 string, kept boolean")


@book.query("s_32_halving", "select n_nationkey from nation where n_nationkey % 6 <> 5")
def s_32(spark, sf):
    keys = sorted(r.n_nationkey for r in T(spark, sf, "nation").collect())
    good, _ = ingest.bisect_valid(keys, lambda part: not any(k % 6 == 5 for k in part))
    return spark.createDataFrame([(k,) for part in good for k in part], "n_nationkey long")


@book.query("s_33_wide_export", "select s_suppkey as cell_id, 2001 as year, s_acctbal as loss from supplier union all select s_suppkey, 2002, s_acctbal * 2 from supplier")
def s_33(spark, sf):
    """A zonal table exported by an image service, a column a year, as rows."""
    path = new(spark, "export")
    sinks.write_csv(T(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("loss_2001"), (F.col("s_acctbal") * 2).alias("loss_2002")), path)
    wide = source_text.read_delimited(spark, path, ["cell_id", "loss_2001", "loss_2002"])
    long = wide.unpivot(["cell_id"], ["loss_2001", "loss_2002"], "name", "loss")
    return long.select(F.col("cell_id").cast("long").alias("cell_id"), F.regexp_extract("name", r"(\d{4})$", 1).cast("int").alias("year"), F.col("loss").cast("double").alias("loss"))


@book.query("s_34_reference_layer", "select r_name as name, 1 as parts from region")
def s_34(spark, sf):
    path = new(spark, "layer")
    k = F.col("r_regionkey").cast("double")
    ring = F.array(*[F.struct((k + a).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))])
    rows = sinks.geojson_features(T(spark, sf, "region").select(F.col("r_name").alias("name"), F.array(ring).alias("rings"))).collect()  # five features
    put(f"{path}/a.geojson", ('{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in rows) + "]}").encode())
    return binary.read_geojson(spark, f"{path}/a.geojson", ["name"]).select("name", F.size("rings").alias("parts"))
