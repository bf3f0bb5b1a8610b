"""A row of its own for each predicate, function, join, aggregate, sort and set operation that larger queries use in passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import nested, numeric, text, time
from gridloom.operators import aggregate, filters, joins, panel, spatial, window
from gridloom.plans import composites as comp
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located
from gridloom.sources import ingest, sinks

book = Book()
REC, LINE, EVENTS = "bold_minimal_records", "lineitem", "events"


def select(name: str, table: str, columns, sql: str) -> None:
    """A query that selects expressions of one table (`columns` makes them), and its SQL select list."""

    @book.query(name, f"select {sql} from {table}")
    def run(spark, sf) -> DataFrame:
        return T(spark, sf, table).select(*[c.alias(n) for n, c in columns().items()])


def counted(name: str, table: str, columns, sql: str) -> None:
    """As `select`, its distinct rows counted: for tables of many rows."""

    @book.query(name, f"select *, count(*) as n from (select {sql} from {table}) group by all")
    def run(spark, sf) -> DataFrame:
        made = columns()
        return T(spark, sf, table).select(*[c.alias(n) for n, c in made.items()]).groupBy(*made).agg(F.count("*").alias("n"))


# predicates and projections ---------------------------------------------------------------------------------------
counted("p_02_clean", REC, lambda: {"genus": text.clean(F.col("genus")), "site": text.clean(F.col("site"))}, "trim(coalesce(genus, '')) as genus, trim(coalesce(site, '')) as site")
counted("p_03_first_present", REC, lambda: {"place": text.first_present(F.col("site"), F.col("sector"), F.col("region"), F.col("province_state"))}, "coalesce(nullif(trim(site), ''), nullif(trim(sector), ''), nullif(trim(region), ''), nullif(trim(province_state), ''), '') as place")
counted("p_04_label_blank", REC, lambda: {"country": text.label_blank(F.col("country_iso"), "(blank)")}, "case when trim(coalesce(country_iso, '')) = '' then '(blank)' else country_iso end as country")
counted("p_13_missing_high", REC, lambda: {"late": numeric.gt_missing_high(numeric.number(F.col("collection_year"), "int"), 2010), "early": numeric.lt_missing_high(numeric.number(F.col("collection_year"), "int"), 1990)}, "coalesce(try_cast(trim(collection_year) as int) > 2010, true) as late, coalesce(try_cast(trim(collection_year) as int) < 1990, false) as early")
counted("p_14_flags", REC, lambda: {"animal": numeric.flag(F.col("kingdom") == "Animalia"), "named": numeric.flag(F.trim("species") != "")}, "cast(coalesce(kingdom = 'Animalia', false) as int) as animal, cast(coalesce(trim(species) <> '', false) as int) as named")
select("p_18_safe_ratio", EVENTS, lambda: {"event_id": F.col("event_id"), "ratio": F.round(numeric.safe_ratio(F.col("value"), F.col("user_id") % 5), 6)}, "event_id, round(case when user_id % 5 = 0 then 0 else coalesce(value / (user_id % 5), 0) end, 6) as ratio")
select("p_19_clamp", EVENTS, lambda: {"event_id": F.col("event_id"), "v": numeric.clamp(F.col("value"), 5.0, 50.0)}, "event_id, case when value is null then 5.0 else least(50.0, greatest(5.0, value)) end as v")
select("p_20_units", "orders", lambda: {"o_orderkey": F.col("o_orderkey"), "km": F.round(numeric.scaled(F.col("o_totalprice"), "m", "km"), 6), "km2": F.round(numeric.scaled(F.col("o_totalprice"), "m2", "km2"), 9), "share": F.round(numeric.scaled(F.col("o_totalprice"), "percent", "share"), 6)}, "o_orderkey, round(o_totalprice / 1000, 6) as km, round(o_totalprice / 1000000, 9) as km2, round(o_totalprice / 100, 6) as share")
counted("p_22_keyword", REC, lambda: {"cls": text.first_keyword(F.lower("inst"), [("museum", "M"), ("university", "U"), ("garden", "G"), ("of", "O")], "other")}, "case when contains(lower(inst), 'museum') then 'M' when contains(lower(inst), 'university') then 'U' when contains(lower(inst), 'garden') then 'G' when contains(lower(inst), 'of') then 'O' else 'other' end as cls")
counted("p_23_dictionary", "orders", lambda: {"status": text.mapped(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other")}, "case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end as status")
counted("p_26_status", "dataset_literature_cache", lambda: {"state": ingest.status_of(F.col("total"), F.length("pages_json"), 100)}, "case when pages_json is null then 'missing' when length(pages_json) = 0 or coalesce(total = 0, false) then 'empty' when coalesce(total >= 100, false) then 'capped' else 'ok' end as state")


@book.query("p_05_year_window", "select year, count(*) as n from (select try_cast(regexp_extract(trim(coalesce(collection_year, '')), '^(\\d{4})(?:\\D|$)', 1) as int) as year from bold_minimal_records) where year between 1990 and 2015 group by 1")
def p_05(spark, sf):
    return T(spark, sf, REC).select(time.year_of_text(F.col("collection_year")).alias("year")).where(F.col("year").between(1990, 2015)).groupBy("year").agg(F.count("*").alias("n"))


@book.query("p_07_membership", "select record_id, kingdom from bold_minimal_records where kingdom in ('Animalia', 'Fungi') and source_group = 'bold_root'")
def p_07(spark, sf):
    return T(spark, sf, REC).where(F.col("kingdom").isin("Animalia", "Fungi") & (F.col("source_group") == "bold_root")).select("record_id", "kingdom")


@book.query("p_09_main_track", "select count(*) as n from events where event_type = 'view'")
def p_09(spark, sf):
    track = F.when(F.col("event_type") == "view", " MAIN ").when(F.col("event_type") == "click", "main-spur").otherwise("spur")
    return T(spark, sf, EVENTS).where(filters.main_track(track)).agg(F.count("*").alias("n"))


@book.query("p_11_resident_ranges", "select l_orderkey, l_linenumber from lineitem where l_linenumber % 2 = 1 and l_orderkey % 3 = 1 and l_partkey % 4 in (1, 2)")
def p_11(spark, sf):
    r = T(spark, sf, LINE).withColumns({"presence": F.col("l_linenumber") % 2, "origin": F.col("l_orderkey") % 3, "seasonal": F.col("l_partkey") % 4})
    return filters.resident_ranges(r).select("l_orderkey", "l_linenumber")


@book.query("p_12_restrictions", f"with {LOCATED}, y as (select cell_id, year, count(*) as n from located where year is not null group by all), k as (select cell_id from y group by 1 having sum(n) > 0 and count(*) >= 2) select cell_id, year, n from y where cell_id in (select cell_id from k) and year >= 2000")
def p_12(spark, sf):
    y = located(spark, sf).where("year is not null").groupBy("cell_id", "year").agg(F.count("*").alias("n"))
    kept = y.groupBy("cell_id").agg(F.sum("n").alias("t"), F.count("*").alias("k")).where("t > 0 and k >= 2").select("cell_id")
    return y.join(kept, "cell_id", "left_semi").where("year >= 2000")


@book.query("p_15_any_log1p", "select user_id, views, cast(views > 0 as int) as any_views, ln(1 + views) as log1p_views from (select user_id, count(*) filter (event_type = 'view') as views from events group by 1)")
def p_15(spark, sf):
    return numeric.log1p_all(T(spark, sf, EVENTS).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views")), ["views"])


@book.query("p_17_completeness", "select year(o_orderdate)::int as year, cast(year(o_orderdate) + 3 <= 1997 as int) as complete, count(*) as n from orders group by all")
def p_17(spark, sf):
    y = F.year("o_orderdate")
    return T(spark, sf, "orders").groupBy(y.alias("year"), filters.complete_until(y, 3, 1997).alias("complete")).agg(F.count("*").alias("n"))


@book.query("p_27_excluded_partitions", "select source_file, count(*) as n from bold_minimal_records where not regexp_matches(source_file, 'fung|root') group by 1")
def p_27(spark, sf):
    return T(spark, sf, REC).where(~F.col("source_file").rlike("fung|root")).groupBy("source_file").agg(F.count("*").alias("n"))


# joins --------------------------------------------------------------------------------------------------------------
@book.query("j_06_inner", "select c_nationkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1")
def j_06(spark, sf):
    return T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@book.query("j_07_skeleton", "select c.cell_id, y.year, q.quarter from (select distinct cell_id from bold_grid100_land_cells) c cross join (select unnest(range(2018, 2025))::int as year) y cross join (select unnest([1, 2, 3, 4])::int as quarter) q")
def j_07(spark, sf):
    return panel.skeleton(T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct(), panel.PanelVariant(first_year=2018, last_year=2024, quarterly=True))


@book.query("j_12_explode_join", "select g.dataset_key, c.cell_id, c.row_id from (select distinct lower(trim(dataset_key)) as dataset_key from gbif_datasets) g join gbif_dataset_cells c on g.dataset_key = c.dataset_key")
def j_12(spark, sf):
    keys = T(spark, sf, "gbif_datasets").select(F.lower(F.trim("dataset_key")).alias("dataset_key")).distinct()
    return keys.join(T(spark, sf, "gbif_dataset_cells").select("dataset_key", "cell_id", "row_id"), "dataset_key").select("dataset_key", "cell_id", "row_id")


@book.query("j_21_grid_join", f"with {LOCATED} select l.cell_id, min(c.country) as country, count(*) as n from located l join (select cell_id, min(country) as country from bold_grid100_land_cells group by 1) c using (cell_id) group by 1")
def j_21(spark, sf):
    cells = T(spark, sf, "bold_grid100_land_cells").groupBy("cell_id").agg(F.min("country").alias("country"))
    return located(spark, sf).groupBy("cell_id").agg(F.count("*").alias("n")).join(cells, "cell_id")


@book.query("j_24_series_map", "select record_id, coalesce(m.x, 'none') as mapped from bold_minimal_records left join (select canonicalname as k, min(kingdom) as x from taxon where canonicalname is not null group by 1) m on m.k = species")
def j_24(spark, sf):
    table = T(spark, sf, "taxon").where("canonicalname is not null").groupBy(F.col("canonicalname").alias("species")).agg(F.min("kingdom").alias("mapped"))
    return joins.lookup(T(spark, sf, REC).select("record_id", "species"), table, ["species"], {"mapped": F.lit("none")}).select("record_id", "mapped")


# aggregates ---------------------------------------------------------------------------------------------------------
@book.query("a_03_partial_final", "select kingdom, count(*) as n, count(distinct source_file) as files from bold_minimal_records group by 1")
def a_03(spark, sf):
    parts = T(spark, sf, REC).groupBy("kingdom", "source_file").agg(F.count("*").alias("n"))  # a state per chunk, merged
    return parts.groupBy("kingdom").agg(F.sum("n").alias("n"), F.count("source_file").alias("files"))


@book.query("a_05_min_max_mean", "select l_returnflag, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 6) as mean from lineitem group by 1")
def a_05(spark, sf):
    return T(spark, sf, LINE).groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@book.query("a_06_distinct", "select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from lineitem group by 1")
def a_06(spark, sf):
    return T(spark, sf, LINE).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@book.query("a_18_sets_per_window", "select w.w as window, coalesce(o_orderpriority, 'all') as priority, count(distinct o_custkey) as n from orders cross join (select unnest([1, 3, 5]) as w) w where year(o_orderdate) <= 1992 + w.w group by grouping sets ((w.w, o_orderpriority), (w.w)) having not (grouping(o_orderpriority) = 0 and o_orderpriority is null)")
def a_18(spark, sf):
    o = T(spark, sf, "orders").where("o_orderpriority is not null")
    wide = o.withColumn("window", F.explode(F.filter(F.array(*map(F.lit, (1, 3, 5))), lambda w: F.year("o_orderdate") <= 1992 + w))).withColumnRenamed("o_orderpriority", "priority")
    return aggregate.distinct_by_sets(wide, ["window"], ["priority"], "o_custkey", [["priority"], []])


@book.query("a_25_shares", "select o_orderpriority, count(*) as n, round(100.0 * count(*) / (select count(*) from orders), 2) as percent from orders group by 1")
def a_25(spark, sf):
    n = T(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("o_orderpriority", "n", numeric.percent(F.col("n"), F.col("t")).cast("double").alias("percent"))


@book.query("a_38_masked_sum", "select n_regionkey as zone, round(sum(case when s_acctbal > 0 then s_acctbal * 0.25 else 0 end), 4) as area from supplier join nation on s_nationkey = n_nationkey group by 1")
def a_38(spark, sf):
    pixels = T(spark, sf, "supplier").join(T(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return pixels.groupBy(F.col("n_regionkey").alias("zone")).agg(F.round(F.sum(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 0.25).otherwise(0.0)), 4).alias("area"))


# windows, sorts, sets -----------------------------------------------------------------------------------------------
@book.query("w_05_threshold_lookback", """with d as (select s_nationkey::int as u, (row_number() over (partition by s_nationkey order by s_suppkey))::int as t, s_acctbal as v from supplier)
  select u, t, cast(coalesce(v < 0 and t > 3 and lag(v, 1) over w > 0 and lag(v, 2) over w > 0 and lag(v, 3) over w > 0, false) as int) as shock from d window w as (partition by u order by t)""")
def w_05(spark, sf):
    d = T(spark, sf, "supplier").select(F.col("s_nationkey").cast("int").alias("u"), F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("t"), F.col("s_acctbal").alias("v"))
    return d.select("u", "t", numeric.flag((F.col("v") < 0) & (window.steady_lookback(["u"], "t", F.col("v") > 0, 3) == 1)).alias("shock"))


@book.query("w_06_onset", "select c_nationkey::int as u, c_custkey as t, min(c_custkey) filter (c_acctbal < 0) over (partition by c_nationkey) as onset from customer")
def w_06(spark, sf):
    return T(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("u"), F.col("c_custkey").alias("t"), window.onset(["c_nationkey"], "c_custkey", F.col("c_acctbal") < 0).alias("onset"))


@book.query("w_13_first_row", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as k from orders) where k = 1")
def w_13(spark, sf):
    return joins.latest_by(T(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), -F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@book.query("w_18_baseline", "with m as (select o_orderpriority as u, year(o_orderdate)::int as t, count(*) as n from orders group by all) select u, t, n, max(n) filter (t = 1995) over (partition by u) as base from m")
def w_18(spark, sf):
    m = T(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("u"), F.year("o_orderdate").alias("t")).agg(F.count("*").alias("n"))
    return m.select("u", "t", "n", window.baseline_value(["u"], "t", F.col("n"), 1995).alias("base"))


@book.query("w_20_stacked", "select s_suppkey, k.second from supplier cross join (select unnest([0, 1])::int as second) k")
def w_20(spark, sf):
    return window.stacked(T(spark, sf, "supplier").select("s_suppkey"), "second")


@book.query("o_01_mixed_sort", "select n_regionkey, n_name, row_number() over (order by n_regionkey desc, n_name) as place from nation")
def o_01(spark, sf):
    return window.rank_slice(T(spark, sf, "nation"), [], [F.col("n_regionkey").desc(), F.col("n_name")], 1, 1_000_000).select("n_regionkey", "n_name", F.col("rank").cast("long").alias("place"))


@book.query("o_04_top_without", "select species, n from (select trim(species) as species, count(*) as n from bold_minimal_records where trim(species) <> '' and not contains(lower(species), ' sp') group by 1) order by n desc, species limit 20")
def o_04(spark, sf):
    s = F.trim("species")
    return T(spark, sf, REC).where((s != "") & ~F.contains(F.lower("species"), F.lit(" sp"))).groupBy(s.alias("species")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species").limit(20)


@book.query("o_06_count_order", "select genus, n, row_number() over (order by n desc, genus) as place from (select genus, count(*) as n from bold_minimal_records where trim(genus) <> '' group by 1) order by n desc, genus limit 50")
def o_06(spark, sf):
    top = T(spark, sf, REC).where(F.trim("genus") != "").groupBy("genus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genus").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "genus")).cast("long"))  # fifty rows


@book.query("o_07_numeric_order", "select pubmed_id, row_number() over (order by cast(pubmed_id as bigint)) as place from (select distinct pubmed_id from bold_accession_links where regexp_full_match(pubmed_id, '\\d+')) order by cast(pubmed_id as bigint) limit 100")
def o_07(spark, sf):
    ids = T(spark, sf, "bold_accession_links").where(F.col("pubmed_id").rlike(r"^\d+$")).select("pubmed_id").distinct()
    top = ids.orderBy(F.col("pubmed_id").cast("long")).limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.col("pubmed_id").cast("long"))).cast("long"))  # a hundred rows


@book.query("o_08_limit_skip", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as k from orders) where k between 11 and 35")
def o_08(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(25)


@book.query("u_01_union_all", "select c_nationkey as k, 'c' as src, count(*) as n from customer group by 1 union all select s_nationkey, 's', count(*) from supplier group by 1")
def u_01(spark, sf):
    rows = T(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).unionByName(T(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")))
    return rows.groupBy("k", "src").agg(F.count("*").alias("n"))


@book.query("u_02_distinct", "select distinct row_id, accession, cell_id, kingdom, first_seen_at from bold_acc_cells")
def u_02(spark, sf):
    return T(spark, sf, "bold_acc_cells").select("row_id", "accession", "cell_id", "kingdom", "first_seen_at").distinct()


@book.query("u_07_list_dedup", "select event_id, 'a;b;c' as list from events")
def u_07(spark, sf):
    return T(spark, sf, EVENTS).select("event_id", F.array_join(F.array_distinct(text.split_rows(F.lit("a; b;a;;c;b"), ";")), ";").alias("list"))


@book.query("k_03_replaced", "select n_nationkey, n_name from nation where n_regionkey = 2")
def k_03(spark, sf):
    path = _new(spark, "replaced")
    nation = T(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for region in (1, 2):  # the second write takes the first one's place
        sinks.replace_table(nation.where(F.col("n_regionkey") == region).drop("n_regionkey"), path)
    return spark.read.parquet(path)


@book.query("k_07_insert_ignore", "with a as (select distinct row_id, dataset_key, cell_id from gbif_dataset_cells where first_seen_at < timestamp '2016-01-01'), b as (select row_id, min(dataset_key) as dataset_key, min(cell_id) as cell_id from gbif_dataset_cells where row_id not in (select row_id from a) group by 1) select * from a union all select * from b")
def k_07(spark, sf):
    rows = T(spark, sf, "gbif_dataset_cells")
    old = rows.where(F.col("first_seen_at") < F.lit("2016-01-01").cast("timestamp_ntz")).select("row_id", "dataset_key", "cell_id").distinct()
    new = rows.groupBy("row_id").agg(F.min("dataset_key").alias("dataset_key"), F.min("cell_id").alias("cell_id"))
    return sinks.insert_ignore(old, new, ["row_id"])


def _new(spark, name: str) -> str:
    import uuid

    from gridloom.storage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# functions ----------------------------------------------------------------------------------------------------------
_SP = r"regexp_replace(trim(coalesce(species, '')), '\s+', ' ', 'g')"
counted("f_05_key_form", REC, lambda: {"key": text.key_form(text.clean(F.col("species")))}, f"lower({_SP}) as key")
counted("f_06_genus", REC, lambda: {"genus": text.genus_of(text.clean(F.col("species")))}, f"string_split({_SP}, ' ')[1] as genus")
counted("f_07_binomial", REC, lambda: {"binomial": text.is_binomial(F.col("species"))}, f"{_SP} like '% %' as binomial")
counted("f_18_word", REC, lambda: {"local": text.has_word(F.col("inst"), "of")}, "coalesce(regexp_matches(inst, '(?i)\\bof\\b'), false) as local")
select("f_21_joined_key", "bold_grid100_land_cells", lambda: {"cell_id": F.col("cell_id"), "key": text.joined_key(F.col("cell_x"), F.col("cell_y"))}, "cell_id, concat(cell_x, '_', cell_y) as key")
counted("f_32_quarter", REC, lambda: {"q": time.quarter_of_month(F.col("collection_month").try_cast("int"))}, "cast(floor((try_cast(collection_month as int) - 1) / 3) as int) + 1 as q")
counted("f_33_period", "orders", lambda: {"p": time.period_index(F.year("o_orderdate"), F.quarter("o_orderdate"))}, "(year(o_orderdate) * 4 + quarter(o_orderdate))::int as p")
select("f_41_floor_cell", "sampling_stations", lambda: {"station_id": F.col("station_id"), "cx": F.floor(F.col("longitude") / 0.5).cast("int"), "cy": F.floor(F.col("latitude") / 0.5).cast("int")}, "station_id, floor(longitude / 0.5)::int as cx, floor(latitude / 0.5)::int as cy")
counted("f_42_coercion", REC, lambda: {"year": numeric.number(F.col("sequence_upload_year"), "int")}, "case when regexp_full_match(trim(sequence_upload_year), '[+-]?\\d+') then try_cast(trim(sequence_upload_year) as int) end as year")
select("f_43_finite", EVENTS, lambda: {"event_id": F.col("event_id"), "ok": numeric.finite(F.col("value") / F.nullif(F.col("user_id") % 3, F.lit(0)))}, "event_id, value is not null and user_id % 3 <> 0 as ok")
select("f_45_products", "part", lambda: {"p_partkey": F.col("p_partkey"), **{n: F.round(c, 6) for n, c in numeric.products({"size": F.col("p_size").cast("double"), "price": F.col("p_retailprice")}).items()}}, "p_partkey, round(p_size::double * p_size, 6) as size_sq, round(p_retailprice * p_retailprice, 6) as price_sq, round(p_size::double * p_retailprice, 6) as size_x_price")
select("f_52_identifier", "orders", lambda: {"o_orderkey": F.col("o_orderkey"), "doi": nested.first_identifier(F.array(F.struct(F.lit("pmid").alias("type"), F.lit("7").alias("value")), F.struct(F.lit("DOI").alias("type"), F.concat(F.lit("10.1/"), F.col("o_orderkey")).alias("value"))), "doi")}, "o_orderkey, concat('10.1/', o_orderkey) as doi")
select("g_11_density", "part", lambda: {"p_partkey": F.col("p_partkey"), "density": F.round(numeric.density_per_10000_km2(F.col("p_size"), F.col("p_retailprice")), 6)}, "p_partkey, round(p_size / p_retailprice * 10000, 6) as density")


@book.query("f_24_snake_case", "select * from (values ('decimalLatitude', 'decimal_latitude'), ('Country ISO', 'country_iso'), ('already_snake', 'already_snake')) t(name, snake)")
def f_24(spark, sf):
    return spark.createDataFrame([(n, text.snake_case(n)) for n in ("decimalLatitude", "Country ISO", "already_snake")], "name string, snake string")


@book.query("f_55_facet_rows", "select s_suppkey, k.facet, k.n from supplier cross join (values ('a', 3), ('b', 1)) k(facet, n)")
def f_55(spark, sf):
    s = T(spark, sf, "supplier").select("s_suppkey", F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(1)).alias("m"))
    return nested.facet_rows(s, "m", ["s_suppkey"]).toDF("s_suppkey", "facet", "n")


# composites ---------------------------------------------------------------------------------------------------------
@book.query("c_03_collection_years", "select trim(collection_year) as collection_year, count(*) as n from bold_minimal_records where trim(collection_year) <> '' group by 1")
def c_03(spark, sf):
    return comp.yearly_counts(T(spark, sf, REC), "collection_year")


@book.query("c_03_upload_years", "select trim(sequence_upload_year) as sequence_upload_year, count(*) as n from bold_minimal_records where trim(sequence_upload_year) <> '' group by 1")
def c_03_upload(spark, sf):
    return comp.yearly_counts(T(spark, sf, REC), "sequence_upload_year")


@book.query("c_03_years_by_kingdom", "select case when trim(coalesce(kingdom, '')) = '' then 'Unknown' else trim(kingdom) end as kingdom, trim(collection_year) as collection_year, count(*) as n from bold_minimal_records where trim(collection_year) <> '' group by all")
def c_03_kingdom(spark, sf):
    return comp.yearly_counts(T(spark, sf, REC), "collection_year", ["kingdom"])


_LAND = "(select distinct cell_id from bold_grid100_land_cells) c"


@book.query("c_10_preperiod_richness", f"""with {LOCATED}, b as (select cell_id, count(distinct nullif(species, '')) as richness, count(distinct nullif(genus, '')) as genera from located where kingdom = 'Plantae' and year between 1999 and 2004 group by 1),
  z as (select c.cell_id, coalesce(richness, 0) as richness, coalesce(genera, 0) as genera from {_LAND} left join b using (cell_id)), m as (select avg(richness) as a, stddev_pop(richness) as s, avg(genera) as ga, stddev_pop(genera) as gs from z)
  select cell_id, {', '.join(f"{n}, cast({n} > 0 as int) as {n}_any, round(ln(1 + {n}), 9) as {n}_log1p, round(case when {s} > 0 then ({n} - {a}) / {s} else 0 end, 6) as {n}_z" for n, a, s in (('richness', 'a', 's'), ('genera', 'ga', 'gs')))} from z, m""")
def c_10(spark, sf):
    plants = located(spark, sf).where("kingdom = 'Plantae'")
    out = comp.baseline_richness(plants, T(spark, sf, "bold_grid100_land_cells"), 1999, 2004, {"richness": "species", "genera": "genus"})
    return out.withColumns({f"{n}_{k}": F.round(f"{n}_{k}", d) for n in ("richness", "genera") for k, d in (("log1p", 9), ("z", 6))})


@book.query("c_10_occurrence_panel", f"""with {LOCATED}, n as (select cell_id, year, count(*) as occurrences, count(distinct nullif(species, '')) as species from located where kingdom = 'Plantae' group by all)
  select c.cell_id, y.year, coalesce(n.occurrences, 0) as occurrences, coalesce(n.species, 0) as species, cast(coalesce(n.occurrences, 0) > 0 as int) as any_occurrences, round(ln(1 + coalesce(n.occurrences, 0)), 9) as log1p_occurrences
  from {_LAND} cross join (select unnest(range(2005, 2025))::int as year) y left join n on n.cell_id = c.cell_id and n.year = y.year""")
def c_10_panel(spark, sf):
    plants = located(spark, sf).where("kingdom = 'Plantae'")
    n = plants.groupBy("cell_id", "year").agg(F.count("*").alias("occurrences"), F.countDistinct(F.nullif(F.col("species"), F.lit(""))).alias("species"))
    skel = panel.skeleton(T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct(), panel.PanelVariant(first_year=2005, last_year=2024))
    out = numeric.log1p_all(panel.zero_fill(skel, n, ["cell_id", "year"], ["occurrences", "species"]), ["occurrences"])
    return out.withColumn("log1p_occurrences", F.round("log1p_occurrences", 9))


@book.query("c_35_archive_universe", f"""with {LOCATED} select species, count(*) filter (year >= 2005) as main_records, max(cast(year >= 2005 as int)) as main_present, count(*) filter (year < 2005) as preperiod_records, max(cast(year < 2005 as int)) as preperiod_present, min(year) as first_year, max(year) as last_year
  from located where year is not null and species <> '' group by 1""")
def c_35(spark, sf):
    rows = located(spark, sf).where("year is not null").select("species", "year")
    return comp.archive_universe({"main": rows.where("year >= 2005"), "preperiod": rows.where("year < 2005")})


@book.query("c_24_stock_panel", """with u as (select distinct s_nationkey as cell_id from supplier), f as (select s_nationkey as cell_id, (1992 + s_suppkey % 7)::int as year, sum(abs(s_acctbal)) as loss from supplier group by all), b as (select c_nationkey as cell_id, sum(abs(c_acctbal)) as baseline from customer where c_nationkey > 3 group by 1),
  z as (select u.cell_id, y.year, coalesce(f.loss, 0) as loss, coalesce(b.baseline, 0) as baseline from u cross join (select unnest(range(1992, 1999))::int as year) y left join f on f.cell_id = u.cell_id and f.year = y.year left join b on b.cell_id = u.cell_id),
  k as (select *, sum(loss) over (partition by cell_id order by year) as cumulative_loss, lag(loss, 1) over (partition by cell_id order by year) as l1_loss, lag(loss, 2) over (partition by cell_id order by year) as l2_loss from z)
  select cell_id, year, round(loss, 4) as loss, round(baseline, 4) as baseline, round(case when baseline = 0 then 0 else loss / baseline end, 6) as loss_share, round(cumulative_loss, 4) as cumulative_loss, round(case when baseline = 0 then 0 else cumulative_loss / baseline end, 6) as cumulative_share, round(l1_loss, 4) as l1_loss, round(l2_loss, 4) as l2_loss from k""")
def c_24(spark, sf):
    s, c = T(spark, sf, "supplier"), T(spark, sf, "customer")
    flows = s.select(F.col("s_nationkey").alias("cell_id"), (1992 + F.col("s_suppkey") % 7).cast("int").alias("year"), F.abs("s_acctbal").alias("loss"))
    base = c.where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("cell_id")).agg(F.sum(F.abs("c_acctbal")).alias("baseline"))
    out = comp.stock_panel(flows.select("cell_id").distinct(), flows, base, 1992, 1998)
    return out.select("cell_id", "year", *[F.round(n, 4).alias(n) for n in ("loss", "baseline", "cumulative_loss", "l1_loss", "l2_loss")], *[F.round(n, 6).alias(n) for n in ("loss_share", "cumulative_share")])


_PEOPLE = r"""p0 as (select record_id, cell_id, year, country_iso as country, regexp_replace(trim(unnest(string_split(regexp_replace(collectors, '(?i)\s+and\s+|[&;|]', ',', 'g'), ','))), '\s+', ' ', 'g') as person from src),
  p as (select distinct * from p0 where regexp_matches(person, '\p{L}{2,}') and not regexp_matches(person, '\d')),
  hc as (select person, country, count(*) as n from p where country <> '' group by all), homes as (select person, country as home from (select *, row_number() over (partition by person order by n desc, country) as k from hc) where k = 1)"""
_SRC = f"{LOCATED}, r1 as (select record_id, min(collectors) as collectors from bold_minimal_records group by 1), src as (select l.*, r1.collectors from (select distinct record_id, cell_id, year, country_iso from located where year is not null) l join r1 using (record_id))"


def _collected(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with their collectors, each person's commonest country as home, and a region (second letter) of every country."""
    text_of = T(spark, sf, REC).groupBy("record_id").agg(F.min("collectors").alias("collectors"))
    src = located(spark, sf).where("year is not null").select("record_id", "cell_id", "year", F.col("country_iso").alias("country")).distinct().join(text_of, "record_id")
    people = src.select("record_id", "cell_id", "year", "country", F.explode(text.person_tokens(F.col("collectors"))).alias("person")).distinct().where("country <> ''")
    n = people.groupBy("person", "country").agg(F.count("*").alias("n"))
    homes = n.groupBy("person").agg(F.min(F.struct((-F.col("n")).alias("m"), "country")).alias("b")).select("person", F.col("b.country").alias("home"))
    regions = src.where("country <> ''").select("country", F.substring("country", 2, 1).alias("region")).distinct()
    return src, homes, regions


@book.query("c_33_foreign_collecting", f"""with {_SRC}, {_PEOPLE}, k as (select p.*, home, case when home = country then 'domestic' when substr(home, 2, 1) = substr(country, 2, 1) then 'regional' else 'distant' end as kind from p join homes using (person) where country <> ''),
  e as (select record_id, cell_id, year, count(*) filter (kind = 'domestic') / count(*) as ds, count(*) filter (kind = 'regional') / count(*) as rs, count(*) filter (kind = 'distant') / count(*) as fs, max(cast(kind = 'distant' as int)) as d, max(cast(kind = 'regional' as int)) as r, max(cast(kind = 'domestic' as int)) as o from k group by all),
  t as (select cell_id, year, count(*) as records_total, count(*) filter (record_id in (select record_id from p)) as records_with_collectors from src group by all),
  c as (select cell_id, year, count(*) as records_classified, count(*) filter (d = 0 and r = 0) as records_domestic, count(*) filter (d = 0 and r = 1) as records_regional, count(*) filter (d = 1) as records_distant, count(*) filter (o = 1 and (d = 1 or r = 1)) as records_collab, round(sum(ds), 4) as domestic_score_sum, round(sum(rs), 4) as regional_score_sum, round(sum(fs), 4) as distant_score_sum from e group by all),
  n as (select cell_id, year, count(distinct person) filter (kind = 'domestic') as n_collectors_domestic, count(distinct person) filter (kind <> 'domestic') as n_collectors_foreign from k group by all)
  select t.cell_id, t.year, records_total, records_with_collectors, {', '.join(f'coalesce({x}, 0) as {x}' for x in ('records_classified', 'records_domestic', 'records_regional', 'records_distant', 'records_collab', 'domestic_score_sum', 'regional_score_sum', 'distant_score_sum', 'n_collectors_domestic', 'n_collectors_foreign'))}, records_with_collectors - coalesce(records_classified, 0) as records_unclassified
  from t left join c using (cell_id, year) left join n using (cell_id, year)""")
def c_33(spark, sf):
    return comp.foreign_collecting(*_collected(spark, sf))


@book.query("a_28_collectors_by_class", f"with {_SRC}, {_PEOPLE} select country, count(distinct person) filter (home = country) as domestic, count(distinct person) filter (home <> country) as foreigners from p join homes using (person) where country <> '' group by 1")
def a_28(spark, sf):
    src, homes, _ = _collected(spark, sf)
    people = src.where("country <> ''").select("country", F.explode(text.person_tokens(F.col("collectors"))).alias("person")).distinct().join(homes, "person")
    own = F.col("home") == F.col("country")
    return people.groupBy("country").agg(F.countDistinct(F.when(own, F.col("person"))).alias("domestic"), F.countDistinct(F.when(~own, F.col("person"))).alias("foreigners"))


_CHEM = "chem as (select distinct lower(canonicalname) as species, taxonid % 97 as item from taxon where taxonrank = 'species' and canonicalname is not null and taxonid % 3 = 0), res as (select distinct species_normalized as species, lower(resolved_name) as resolved from species_name_resolution where trim(resolved_name) <> '' and trim(species_normalized) <> '')"


@book.query("c_17_linked_potential", f"""with {LOCATED}, {_CHEM}, bc as (select upper(trim(bin_uri)) as bin, min(lower(trim(consensus_species))) as b from bin_consensus_lookup where trim(consensus_species) <> '' group by 1),
  rows as (select cell_id, year, case when species <> '' then species else coalesce(b, '') end as species from located left join bc using (bin) where year between 2010 and 2024), st as (select r.species, min(resolved) as t from res r join (select distinct species as resolved from chem) using (resolved) group by 1),
  k as (select distinct cell_id, year, rows.species, coalesce(c.species, st.t) as target, case when c.species is not null then 'name' when st.t is not null then 'resolved' end as rule from rows left join (select distinct species from chem) c on c.species = rows.species left join st on st.species = rows.species where rows.species <> ''),
  i as (select cell_id, year, count(distinct item) as n_items from k join chem on chem.species = k.target group by all)
  select cell_id, year, count(distinct species) as n_species, count(distinct target) as n_linked, count(distinct target) filter (rule = 'name') as n_by_name, count(distinct target) filter (rule = 'resolved') as n_by_resolved, coalesce(any_value(n_items), 0) as n_items from k left join i using (cell_id, year) group by all""")
def c_17(spark, sf):
    chem = T(spark, sf, "taxon").where("taxonrank = 'species' and canonicalname is not null and taxonid % 3 = 0").select(F.lower("canonicalname").alias("species"), (F.col("taxonid") % 97).alias("item")).distinct()
    res = T(spark, sf, "species_name_resolution").where("trim(resolved_name) <> '' and trim(species_normalized) <> ''").select(F.col("species_normalized").alias("species"), F.lower("resolved_name").alias("resolved")).distinct()
    names = T(spark, sf, "bin_consensus_lookup").where("trim(consensus_species) <> ''").groupBy(F.upper(F.trim("bin_uri")).alias("bin")).agg(F.min(F.lower(F.trim("consensus_species"))).alias("bin_species"))
    rows = located(spark, sf).where("year between 2010 and 2024").join(names, "bin", "left")
    return comp.linked_potential(rows, chem, res)


@book.query("c_14_compounds_summary", "select initcap_name as species_name, n from (select upper(canonicalname[1]) || lower(canonicalname[2:]) as initcap_name, count(distinct taxonid) as n from taxon where taxonrank = 'species' and regexp_full_match(canonicalname, '[A-Z][a-z]+ [a-z]+') group by 1)")
def c_14(spark, sf):
    t = T(spark, sf, "taxon").where(F.col("canonicalname").rlike("^[A-Z][a-z]+ [a-z]+$") & (F.col("taxonrank") == "species"))
    key = F.concat(F.translate(F.lpad(F.col("taxonid").cast("string"), 14, "0"), "0123456789", "ABCDEFGHIJ"), F.lit("-ABCDEFGHIJ-N"))
    pairs = t.select(F.col("canonicalname").alias("species_name"), key.alias("inchikey"), "kingdom", F.lit(" Lotus ").alias("source"))
    return comp.species_compounds(pairs.unionByName(pairs.withColumn("inchikey", F.lit("bad key"))))[1].select("species_name", F.col("n_compounds").alias("n"))


@book.query("c_04_record_cells", f"with {LOCATED} select cell_id, kingdom, count(*) as n from located group by all")
def c_04_records(spark, sf):
    from gridloom.functions import geo

    pts = geo.with_points(T(spark, sf, REC), "latitude", "longitude").withColumn("kingdom", text.clean(F.col("kingdom")))
    return comp.grid_counts(pts, 100_000, ["kingdom"]).join(T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "kingdom", "n")


@book.query("c_09_country_stats", f"with {LOCATED} select country_iso, count(*) as n_records, count(distinct nullif(species, '')) as n_species, count(distinct cell_id) as n_cells from located where country_iso <> '' group by 1")
def c_09(spark, sf):
    r = located(spark, sf).where("country_iso <> ''")
    return r.groupBy("country_iso").agg(F.count("*").alias("n_records"), F.countDistinct(F.nullif(F.col("species"), F.lit(""))).alias("n_species"), F.countDistinct("cell_id").alias("n_cells"))


@book.query("c_22_cell_events", "select user_id % 50 as cell_id, year(ts)::int as year, count(*) as n, count(*) filter (value >= 50) as strong, round(max(value), 6) as highest from events group by all")
def c_22(spark, sf):
    e = T(spark, sf, EVENTS).select((F.col("user_id") % 50).alias("cell_id"), F.year("ts").alias("year"), "value")
    return e.groupBy("cell_id", "year").agg(F.count("*").alias("n"), F.count_if(filters.at_least(F.col("value"), 50)).alias("strong"), F.round(F.max("value"), 6).alias("highest"))


# shapes -------------------------------------------------------------------------------------------------------------
def _square(x, y, side=1.0):
    corners = ((0, 0), (side, 0), (side, side), (0, side), (0, 0))
    return F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in corners])


@book.query("g_07_union_area", "select n_regionkey as zone, round(sum(2.0 - 0.25), 6) as area from nation group by 1")
def g_07(spark, sf):
    """Two overlapping unit squares a nation, far from other nations': their union lacks the overlap."""
    k = F.col("n_nationkey").cast("double") * 5
    rings = T(spark, sf, "nation").select(F.col("n_regionkey").alias("zone"), F.explode(F.array(_square(k, F.lit(0.0)), _square(k + 0.5, F.lit(0.5)))).alias("ring"))
    return spatial.union_area(rings, ["zone"], "ring").select("zone", F.round("area", 6).alias("area"))


@book.query("g_08_dissolve", "select n_regionkey as zone, count(*) as parts, round(count(*) * 1.75, 6) as area from nation group by 1")
def g_08(spark, sf):
    """As g_07, with the number of shapes that went into each zone."""
    rings = T(spark, sf, "nation").select(F.col("n_regionkey").alias("zone"), (F.col("n_nationkey") * 5).cast("double").alias("k"))
    both = rings.select("zone", F.explode(F.array(_square(F.col("k"), F.lit(0.0)), _square(F.col("k") + 0.5, F.lit(0.5)))).alias("ring"))
    parts = rings.groupBy("zone").agg(F.count("*").alias("parts"))
    return spatial.union_area(both, ["zone"], "ring").join(parts, "zone").select("zone", "parts", F.round("area", 6).alias("area"))


@book.query("g_06_repaired_parts", "select n_nationkey, 4 as corners from nation")
def g_06(spark, sf):
    """Rings with repeated points, open rings and empty ones, in multipart shapes: one clean part of four corners is left."""
    k = F.col("n_nationkey").cast("double")
    p = lambda a, b: F.struct((k + a).alias("lon"), F.lit(float(b)).alias("lat"))
    parts = F.array(F.array(p(0, 0), p(1, 0), p(1, 0), p(1, 1), p(0, 1)), F.array(p(0, 0), p(1, 1)), F.array(p(2, 2), p(2, 2), p(2, 2), p(2, 2)))
    out = spatial.clean_parts(T(spark, sf, "nation").select("n_nationkey", parts.alias("rings")), "rings")
    return out.select("n_nationkey", (F.size("ring") - 1).alias("corners"))
