"""Aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numeric, text
from gridloom.operators import aggregate as agg
from gridloom.operators import panel
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located

book = Book()
REC = "(select *, trim(coalesce(kingdom, '')) as k, trim(coalesce(species, '')) as s, upper(trim(coalesce(bin_uri, ''))) as b from bold_minimal_records)"
LINE_KEYS = "select distinct * from lineitem"


def _rec(spark, sf):
    c = lambda n: text.clean(F.col(n))
    return T(spark, sf, "bold_minimal_records").withColumns({"k": c("kingdom"), "s": c("species"), "b": F.upper(c("bin_uri"))})


@book.query("a_01_counts_by_kingdom", f"select case when k = '' then 'Unknown' else k end as kingdom, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from {REC} group by 1")
def a_01(spark, sf):
    rows = _rec(spark, sf).groupBy(text.label_blank(F.col("k"), "Unknown").alias("kingdom")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("kingdom", "n", numeric.percent(F.col("n"), F.col("t")).cast("double").alias("percent"))


@book.query("a_02_conditional_counts", f"select source_group, count(*) as total_records, count(*) filter (k = 'Animalia') as animalia, count(*) filter (k = 'Animalia' and phylum <> 'Chordata') as non_chordata, count(*) filter (b <> '') as with_bin from {REC} group by 1")
def a_02(spark, sf):
    conds = {"total_records": F.lit(True), "animalia": F.col("k") == "Animalia", "non_chordata": (F.col("k") == "Animalia") & (F.col("phylum") != "Chordata"), "with_bin": F.col("b") != ""}
    return _rec(spark, sf).groupBy("source_group").agg(*panel.conditional_counts(conds))


@book.query("a_04_event_measures", "select event_type, count(*) as n, round(sum(value), 4) as total, round(min(value), 6) as lowest, round(max(value), 6) as highest, round(avg(value), 6) as mean from events group by 1")
def a_04(spark, sf):
    v = F.col("value")
    return T(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.min(v), 6).alias("lowest"), F.round(F.max(v), 6).alias("highest"), F.round(F.avg(v), 6).alias("mean"))


@book.query("a_07_distinct_nonblank", f"select source_group, count(distinct nullif(b, '')) as n_bins, count(distinct nullif(s, '')) as n_species from {REC} group by 1")
def a_07(spark, sf):
    return _rec(spark, sf).groupBy("source_group").agg(F.countDistinct(F.nullif(F.col("b"), F.lit(""))).alias("n_bins"), F.countDistinct(F.nullif(F.col("s"), F.lit(""))).alias("n_species"))


@book.query("a_08_cell_richness", f"with {LOCATED} select cell_id, count(distinct nullif(species, '')) as richness, count(*) as n from located group by 1")
def a_08(spark, sf):
    return located(spark, sf).groupBy("cell_id").agg(F.countDistinct(F.nullif(F.col("species"), F.lit(""))).alias("richness"), F.count(F.lit(1)).alias("n"))


@book.query("a_09_new_bins", f"""with {LOCATED}, f as (select bin, min(year) as year from located where bin <> '' and year is not null group by 1)
  select cell_id, l.year, count(distinct l.bin) as n_new from located l join f on l.bin = f.bin and l.year = f.year group by 1, 2""")
def a_09(spark, sf):
    return panel.first_appearance(located(spark, sf), "bin", "year", ["cell_id"])


_VOTES = f"v as (select b, s, count(*) as n from {REC} where b <> '' and s <> '' group by 1, 2), r as (select b as bin, s as species, n as votes, cast(sum(n) over (partition by b) as bigint) as total, row_number() over (partition by b order by n desc, s) as rk from v)"


@book.query("a_10_bin_consensus", f"with {_VOTES} select bin, species, votes, total, votes / total as concordance, cast(votes / total >= 0.8 as int) as is_strict from r where rk = 1")
def a_10(spark, sf):
    return agg.plurality(_rec(spark, sf).where("b <> ''").select(F.col("b").alias("bin"), F.col("s").alias("species")), ["bin"], "species")


@book.query("a_11_consensus_or_none", f"with {_VOTES} select bin, case when votes / total >= 0.6 then species end as species from r where rk = 1")
def a_11(spark, sf):
    return a_10(spark, sf).select("bin", F.when(F.col("concordance") >= 0.6, F.col("species")).alias("species"))


@book.query("a_12_mode", "select user_id, event_type as usual from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by 1, 2) where r = 1")
def a_12(spark, sf):
    return T(spark, sf, "events").groupBy("user_id").agg(agg.mode_of(F.col("event_type")).alias("usual"))


@book.query("a_13_first_nonempty", f"select b as bin, coalesce(arg_min(k, (record_id, k)) filter (k <> ''), '') as kingdom from {REC} where b <> '' group by 1")
def a_13(spark, sf):
    return _rec(spark, sf).where("b <> ''").groupBy(F.col("b").alias("bin")).agg(agg.first_nonempty(F.col("k"), F.struct("record_id", "k")).alias("kingdom"))


@book.query("a_14_distinct_list", f"select source_group, coalesce(string_agg(distinct nullif(k, ''), ',' order by nullif(k, '')), '') as kingdoms from {REC} group by 1")
def a_14(spark, sf):
    return _rec(spark, sf).groupBy("source_group").agg(agg.distinct_list(F.col("k")).alias("kingdoms"))


@book.query("a_15_examples", f"""with f as (select b, s, min(record_id) as p from {REC} where b <> '' and s <> '' group by 1, 2), r as (select *, row_number() over (partition by b order by p, s) as rk from f)
  select b as bin, string_agg(s, '|' order by rk) as examples from r where rk <= 3 group by 1""")
def a_15(spark, sf):
    rows = _rec(spark, sf).where("b <> '' and s <> ''").select(F.col("b").alias("bin"), "s", "record_id")
    return agg.examples(rows, ["bin"], "s", "record_id").select("bin", F.array_join("examples", "|").alias("examples"))


@book.query("a_16_substring_distinct", "select o_orderpriority, count(distinct o_custkey) filter (contains(o_orderstatus, 'F')) as n_f from orders group by 1")
def a_16(spark, sf):
    return T(spark, sf, "orders").groupBy("o_orderpriority").agg(F.countDistinct(F.when(F.col("o_orderstatus").contains("F"), F.col("o_custkey"))).alias("n_f"))


@book.query("a_17_grouping_sets", f"""with d as (select distinct source_group as g, case when k = '' then 'other' else k end as kingdom, s from {REC} where s <> '')
  select coalesce(g, 'all') as g, coalesce(kingdom, 'all') as kingdom, count(distinct s) as n from d group by grouping sets ((g, kingdom), (g), (kingdom), ())""")
def a_17(spark, sf):
    rows = _rec(spark, sf).where("s <> ''").select(F.col("source_group").alias("g"), text.label_blank(F.col("k"), "other").alias("kingdom"), "s")
    return agg.distinct_by_sets(rows, [], ["g", "kingdom"], "s", [["g", "kingdom"], ["g"], ["kingdom"], []])


@book.query("a_19_rollup_total", "select coalesce(o_orderstatus, 'TOTAL') as o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as price from orders group by rollup (o_orderstatus)")
def a_19(spark, sf):
    rows = T(spark, sf, "orders").withColumn("one", F.lit(1).cast("long")).select("o_orderstatus", F.col("one").alias("n"), F.col("o_totalprice").alias("price"))
    return agg.rollup_total(rows, "o_orderstatus", ["n", "price"]).withColumn("price", F.round("price", 2))


@book.query("a_20_nested_levels", f"""with t as (select k, phylum, class_name from {REC})
  select 'kingdom' as level, k as name, count(*) as n from t group by 2 union all select 'phylum', coalesce(phylum, ''), count(*) from t where k = 'Animalia' group by 2 union all select 'class', coalesce(class_name, ''), count(*) from t where k = 'Animalia' and phylum = 'Arthropoda' group by 2""")
def a_20(spark, sf):
    animal = F.col("k") == "Animalia"
    level = lambda name, c, cond: F.when(cond, F.array(F.struct(F.lit(name).alias("level"), F.coalesce(F.col(c), F.lit("")).alias("name")))).otherwise(F.array())
    every = F.concat(level("kingdom", "k", F.lit(True)), level("phylum", "phylum", animal), level("class", "class_name", animal & F.coalesce(F.col("phylum") == "Arthropoda", F.lit(False))))
    return _rec(spark, sf).select(F.inline(every)).groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"))


@book.query("a_21_combined_species", f"""with {LOCATED}, t as (select cell_id, case when source_group in ('fungi', 'bold_root') then 'a' else 'b' end as src, species from located)
  select cell_id, coalesce(src, 'combined') as src, count(*) as n_records, count(distinct nullif(species, '')) as n_species from t group by grouping sets ((cell_id, src), (cell_id))""")
def a_21(spark, sf):
    src = F.when(F.col("source_group").isin("fungi", "bold_root"), "a").otherwise("b")
    rows = located(spark, sf).withColumn("src", F.explode(F.array(src, F.lit("combined"))))
    return rows.groupBy("cell_id", "src").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(F.nullif(F.col("species"), F.lit(""))).alias("n_species"))


@book.query("a_22_robust_sets", f"""with {LOCATED} select cell_id, count(distinct nullif(species, '')) as n_all, count(distinct species) filter (species like '% %') as n_binomial, count(distinct species) filter (species <> '' and bin <> '') as n_with_bin, count(distinct species) filter (species like '% %' and bin <> '') as n_strict from located group by 1""")
def a_22(spark, sf):
    s, b = F.col("species"), F.col("bin")
    variants = {"n_all": s != "", "n_binomial": s.contains(" "), "n_with_bin": (s != "") & (b != ""), "n_strict": s.contains(" ") & (b != "")}
    return located(spark, sf).groupBy("cell_id").agg(*[F.countDistinct(F.when(c, s)).alias(n) for n, c in variants.items()])


@book.query("a_23_linked_sets", f"""with {LOCATED}, x as (select distinct lower(canonicalname) as species, taxonid from taxon where taxonrank = 'species' and canonicalname is not null)
  select cell_id, count(distinct l.species) as n_species, count(distinct x.species) as n_linked, count(distinct x.taxonid) as n_taxa from located l left join x on x.species = l.species where l.species <> '' group by 1""")
def a_23(spark, sf):
    x = T(spark, sf, "taxon").where("taxonrank = 'species' and canonicalname is not null").select(F.lower("canonicalname").alias("species"), "taxonid").distinct()
    rows = located(spark, sf).where("species <> ''").select("cell_id", "species").distinct().join(x, "species", "left")
    return rows.groupBy("cell_id").agg(F.countDistinct("species").alias("n_species"), F.countDistinct(F.when(F.col("taxonid").isNotNull(), F.col("species"))).alias("n_linked"), F.countDistinct("taxonid").alias("n_taxa"))


_CLASS = "case when inst like '%Museum%' then 'museum' when inst like '%University%' then 'university' when inst <> '' then 'other' end"


@book.query("a_26_fractional_scores", """with m as (select l_orderkey as unit, p_brand as cls, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2), t as (select *, sum(n) over (partition by unit) as t from m)
  select cls, round(sum(n / t), 4) as score from t group by 1""")
def a_26(spark, sf):
    rows = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("unit"), F.col("p_brand").alias("cls"))
    return agg.fractional_scores(rows, "unit", "cls", [])


@book.query("a_27_exclusive_classes", f"with {LOCATED} select cell_id, count(*) filter (c = 'museum') as museum, count(*) filter (c = 'university') as university, count(*) filter (c = 'other') as other, count(*) filter (c is not null) as classified, count(distinct case when c = 'museum' then inst end) as n_museums from (select *, {_CLASS} as c from located) group by 1")
def a_27(spark, sf):
    i = F.col("inst")
    c = F.when(i.contains("Museum"), "museum").when(i.contains("University"), "university").when(i != "", "other")
    rows = located(spark, sf).withColumn("c", c)
    return rows.groupBy("cell_id").agg(*[F.count_if(F.col("c") == n).alias(n) for n in ("museum", "university", "other")], F.count("c").alias("classified"), F.countDistinct(F.when(F.col("c") == "museum", i)).alias("n_museums"))


@book.query("a_29_country_collapse", f"with {LOCATED} select country_iso, count(*) as n_records, count(distinct cell_id) as n_cells, count(distinct year) as n_years, round(count(*) / nullif(count(distinct cell_id), 0), 6) as per_cell from located where country_iso <> '' group by 1")
def a_29(spark, sf):
    n, cells = F.count(F.lit(1)), F.countDistinct("cell_id")
    return located(spark, sf).where("country_iso <> ''").groupBy("country_iso").agg(n.alias("n_records"), cells.alias("n_cells"), F.countDistinct("year").alias("n_years"), F.round(n / cells, 6).alias("per_cell"))


@book.query("a_30_collapse", "select l_returnflag, round(avg(l_quantity), 6) as mean_q, round(sum(l_extendedprice), 2) as price, count(*) as n, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as weighted from lineitem group by 1")
def a_30(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"), F.round(agg.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("weighted"))


@book.query("a_31_describe", "select o_orderstatus, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, max(o_totalprice) as max from orders group by 1")
def a_31(spark, sf):
    out = agg.describe(T(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "p25", "p50", "p75")})


@book.query("a_32_crosstab_means", "select l_returnflag, round(avg(l_quantity) filter (l_linestatus = 'F'), 6) as f, round(avg(l_quantity) filter (l_linestatus = 'O'), 6) as o from lineitem group by 1")
def a_32(spark, sf):
    out = T(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return out.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@book.query("a_33_pivot_zero", f"with {LOCATED} select cell_id, count(*) filter (kingdom = 'Animalia') as \"Animalia\", count(*) filter (kingdom = 'Plantae') as \"Plantae\", count(*) filter (kingdom = 'Fungi') as \"Fungi\" from located group by 1")
def a_33(spark, sf):
    counts = located(spark, sf).groupBy("cell_id", "kingdom").agg(F.count(F.lit(1)).alias("n"))
    return agg.pivot_zero(counts, ["cell_id"], "kingdom", "n", ["Animalia", "Plantae", "Fungi"])


@book.query("a_34_wide_by_spec", f"with {LOCATED}, n as (select cell_id, kingdom, year, count(*) as n from located group by all) select cell_id, coalesce(max(n) filter (kingdom = 'Animalia' and year = 2015), 0) as animals_2015, coalesce(max(n) filter (kingdom = 'Plantae' and year = 2016), 0) as plants_2016 from n group by 1")
def a_34(spark, sf):
    counts = located(spark, sf).groupBy("cell_id", "kingdom", F.col("year").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return agg.wide_by_spec(counts, ["cell_id"], {"animals_2015": {"kingdom": "Animalia", "year": "2015"}, "plants_2016": {"kingdom": "Plantae", "year": "2016"}}, "n")


@book.query("a_35_correlations", """with t as (select l_returnflag, l_quantity as q, l_extendedprice as p, l_discount as d from lineitem)
  select l_returnflag, x, y, n, round(r, 6) as r from (select l_returnflag, 'q' as x, 'p' as y, count(*) as n, corr(q, p) as r from t group by 1 union all select l_returnflag, 'q', 'd', count(*), corr(q, d) from t group by 1 union all select l_returnflag, 'p', 'd', count(*), corr(p, d) from t group by 1)""")
def a_35(spark, sf):
    rows = T(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))
    return agg.correlations(rows, ["q", "p", "d"], ["l_returnflag"]).select("l_returnflag", "x", "y", "n", F.round("r", 6).alias("r"))


@book.query("a_37_zonal_mean", """with px as (select l_orderkey % 50 as zone, l_quantity as v, l_tax + 0.01 as w from lineitem) select zone, count(*) as n, round(sum(v * w) / sum(w), 6) as zonal_mean, round(coalesce(sum(case when v > 25 then w end), 0), 6) as masked from px group by 1""")
def a_37(spark, sf):
    v, w = F.col("l_quantity"), F.col("l_tax") + F.lit(0.01)
    return T(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v * w) / F.sum(w), 6).alias("zonal_mean"), F.round(F.coalesce(F.sum(F.when(v > 25, w)), F.lit(0.0)), 6).alias("masked"))


@book.query("a_39_temporal_composite", "select user_id, day(ts) as day, max(cast(event_type = 'error' as int)) as any_error, round(avg(value), 6) as mean_value from events group by all")
def a_39(spark, sf):
    return T(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("any_error"), F.round(F.avg("value"), 6).alias("mean_value"))


_YQ = "yq as (select o_orderpriority as unit, year(o_orderdate) as year, quarter(o_orderdate) as quarter, sum(o_totalprice) as price, count(distinct month(o_orderdate)) as months from orders group by all)"


@book.query("a_40_anomaly", f"with {_YQ}, base as (select unit, quarter, avg(price) as b from yq where year between 1995 and 1997 group by all) select unit, year, quarter, round(b, 4) as baseline, round(price - b, 4) as anomaly from yq left join base using (unit, quarter)")
def a_40(spark, sf):
    d = F.col("o_orderdate")
    rows = T(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year(d).cast("long").alias("year"), F.quarter(d).cast("long").alias("quarter")).agg(F.sum("o_totalprice").alias("price"))
    out = agg.climatology_anomaly(rows, ["unit"], ["quarter"], "year", "price", (1995, 1997))
    return out.select("unit", "year", "quarter", F.round("baseline", 4).alias("baseline"), F.round("anomaly", 4).alias("anomaly"))


@book.query("a_41_complete_sum", "with m as (select c_nationkey as n, date_trunc('month', o_orderdate) as m, sum(o_totalprice) as p from orders join customer on c_custkey = o_custkey group by all) select n, year(m) as y, quarter(m) as q, case when count(p) = 3 then round(sum(p), 2) end as total from m group by all")
def a_41(spark, sf):
    m = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("p"))
    return m.groupBy("n", F.year("m").cast("long").alias("y"), F.quarter("m").cast("long").alias("q")).agg(F.round(agg.complete_sum(F.col("p"), 3), 2).alias("total"))


_AUDIT = ("inst", "collectors", "identified_by", "funding_src", "collection_code")


@book.query("a_42_coverage", " union all ".join(f"select '{f}' as field, count(nullif(trim({f}), '')) as n_filled, count(distinct nullif(trim({f}), '')) as n_unique, count(distinct case when trim({f}) <> '' then country_iso end) as n_cells from bold_minimal_records" for f in _AUDIT))
def a_42(spark, sf):
    return agg.coverage(T(spark, sf, "bold_minimal_records"), list(_AUDIT), "country_iso")


@book.query("a_43_fill_rate", "select source_group, count(*) as n, count(*) filter (trim(insdc_acs) <> '') as filled, round(count(*) filter (trim(insdc_acs) <> '') / count(*), 6) as rate from bold_minimal_records group by 1")
def a_43(spark, sf):
    ok = F.coalesce(F.trim("insdc_acs") != "", F.lit(False))
    return T(spark, sf, "bold_minimal_records").groupBy("source_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("filled"), F.round(F.avg(ok.cast("int")), 6).alias("rate"))


@book.query("a_44_top_values", "with l as (" + " union all ".join(f"select '{f}' as field, trim({f}) as value from bold_minimal_records where trim({f}) <> ''" for f in _AUDIT) + """), c as (select field, value, count(*) as n from l group by all), r as (select *, row_number() over (partition by field order by n desc, value) as rank, sum(n) over (partition by field) as t from c)
  select field, cast(rank as int) as rank, value, n, round(n / t, 6) as share from r where rank <= 3""")
def a_44(spark, sf):
    return agg.top_values(T(spark, sf, "bold_minimal_records"), list(_AUDIT))


@book.query("a_45_key_overlap", f"with a as (select distinct b from {REC} where b <> ''), c as (select distinct bin_uri as b from bin_consensus_lookup) select (select count(*) from a) as n_left, (select count(*) from c) as n_right, (select count(*) from a join c using (b)) as n_both, (select count(*) from (select b from a union select b from c)) as n_union")
def a_45(spark, sf):
    a = _rec(spark, sf).where("b <> ''").select(F.col("b").alias("bin_uri"))
    return agg.key_overlap(a, T(spark, sf, "bin_consensus_lookup"), "bin_uri")


@book.query("a_46_disagreements", f"select b as bin, count(distinct k) as n_values, string_agg(distinct k, '|' order by k) as values from {REC} where b <> '' and k <> '' group by 1 having count(distinct k) > 1")
def a_46(spark, sf):
    return agg.disagreements(_rec(spark, sf).where("b <> ''").select(F.col("b").alias("bin"), "k"), "bin", "k")


@book.query("a_47_record_audit", f"""with {_VOTES} select source_group, count(*) as n, count(*) filter (s <> '' and c.species is not null and s = c.species) as agree, count(*) filter (s <> '' and c.species is not null and s <> c.species) as differ, count(*) filter (s = '' and c.species is not null) as filled_by_bin, count(*) filter (s = '' and c.species is null) as unknown
  from {REC} x left join (select * from r where rk = 1) c on c.bin = x.b group by 1""")
def a_47(spark, sf):
    best = a_10(spark, sf).select(F.col("bin").alias("b"), F.col("species").alias("c"))
    rows = _rec(spark, sf).join(best, "b", "left")
    s, c = F.col("s"), F.col("c")
    return rows.groupBy("source_group").agg(F.count(F.lit(1)).alias("n"), *panel.conditional_counts({"agree": (s != "") & (s == c), "differ": (s != "") & (s != c), "filled_by_bin": (s == "") & c.isNotNull(), "unknown": (s == "") & c.isNull()}))


@book.query("a_48_two_archives", """with t as (select lower(regexp_replace(trim(species), '\\s+', ' ', 'g')) as species, 'records' as src, try_cast(collection_year as int) as y from bold_minimal_records where trim(species) <> '' union all select species_normalized, 'names', null from species_name_resolution where trim(species_normalized) <> '')
  select species, min(y) as first_year, max(y) as last_year, max(cast(src = 'records' as int)) as in_records, max(cast(src = 'names' as int)) as in_names, count(*) as n from t group by 1""")
def a_48(spark, sf):
    a = T(spark, sf, "bold_minimal_records").where("trim(species) <> ''").select(text.key_form(F.col("species")).alias("species"), F.lit("records").alias("src"), F.col("collection_year").try_cast("int").alias("y"))
    b = T(spark, sf, "species_name_resolution").where("trim(species_normalized) <> ''").select(F.col("species_normalized").alias("species"), F.lit("names").alias("src"), F.lit(None).cast("int").alias("y"))
    flag = lambda n: F.max((F.col("src") == n).cast("int"))
    return a.unionByName(b).groupBy("species").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), flag("records").alias("in_records"), flag("names").alias("in_names"), F.count(F.lit(1)).alias("n"))


@book.query("c_07_cell_correlations", f"with {LOCATED}, w as (select cell_id, cast(count(*) filter (kingdom = 'Animalia') as double) as animalia, cast(count(*) filter (kingdom = 'Plantae') as double) as plantae from located group by 1) select 'animalia' as x, 'plantae' as y, count(*) as n, round(corr(ln(1 + animalia), ln(1 + plantae)), 6) as r from w")
def c_07(spark, sf):
    wide = a_33(spark, sf).select(F.log1p("Animalia").alias("animalia"), F.log1p("Plantae").alias("plantae"))
    return agg.correlations(wide, ["animalia", "plantae"]).select("x", "y", "n", F.round("r", 6).alias("r"))


@book.query("k_08_summary", f"with {LOCATED} select metric, value from (select count(*)::double as records_in_land_cells, count(distinct cell_id)::double as cells_with_records, count(*) filter (year is not null)::double as with_year, max(year)::double as last_year from located) unpivot (value for metric in (records_in_land_cells, cells_with_records, with_year, last_year))")
def k_08(spark, sf):
    return panel.metric_rows(located(spark, sf), {"records_in_land_cells": F.count(F.lit(1)), "cells_with_records": F.countDistinct("cell_id"), "with_year": F.count("year"), "last_year": F.max("year")})
