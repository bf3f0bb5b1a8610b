"""Joins, windows, sorts and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import joins, panel, window
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located
from gridloom.sources import sinks

book = Book()


@book.query("j_01_zero_fill", f"""with {LOCATED}, n as (select cell_id, year, count(*) as n from located group by all)
  select c.cell_id, y.year, coalesce(n.n, 0) as n from (select distinct cell_id from bold_grid100_land_cells) c cross join (select unnest(range(2010, 2025)) as year) y left join n on n.cell_id = c.cell_id and n.year = y.year""")
def j_01(spark, sf):
    variant = panel.PanelVariant(first_year=2010, last_year=2024)
    skel = panel.skeleton(T(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct(), variant)
    n = located(spark, sf).groupBy("cell_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return panel.zero_fill(skel, n, ["cell_id", "year"], ["n"])


@book.query("j_02_subset_sums", "select user_id, " + ", ".join(f"count(*) filter (event_type = '{t}') as n_{t}, round(coalesce(sum(value) filter (event_type = '{t}'), 0), 6) as value_{t}" for t in ("view", "click", "error")) + " from events group by 1")
def j_02(spark, sf):
    out = T(spark, sf, "events").groupBy("user_id").agg(*panel.subset_sums({"value": F.col("value")}, {t: F.col("event_type") == t for t in ("view", "click", "error")}))
    return out.withColumns({f"value_{t}": F.round(f"value_{t}", 6) for t in ("view", "click", "error")})


_NATION = "a as (select c_nationkey as k, count(*) as customers from customer where c_nationkey < 15 group by 1), b as (select s_nationkey as k, count(*) as suppliers from supplier where s_nationkey > 5 group by 1)"


@book.query("j_03_merge_1_1", f"with {_NATION} select coalesce(a.k, b.k) as k, customers, suppliers, case when a.k is not null and b.k is not null then 3 when a.k is not null then 1 else 2 end as _merge from a full join b on a.k = b.k")
def j_03(spark, sf):
    a = T(spark, sf, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = T(spark, sf, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return joins.merge_1_1(a, b, ["k"])


@book.query("j_04_merge_m_1", "select _merge, count(*) as n, count(s_suppkey) as n_suppliers from (select n.n_nationkey, s.s_suppkey, case when s.s_suppkey is not null and n.n_nationkey is not null then 3 when n.n_nationkey is null then 1 else 2 end as _merge from supplier s full join (select * from nation where n_nationkey < 20) n on s.s_nationkey = n.n_nationkey) group by 1")
def j_04(spark, sf):
    right = T(spark, sf, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.merge_m_1(T(spark, sf, "supplier"), right, ["s_nationkey"]).groupBy("_merge").agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("n_suppliers"))


@book.query("j_05_left_unique", "select c_custkey, n_name, cast(case when n_name is null then 1 else 3 end as int) as _merge from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def j_05(spark, sf):
    right = T(spark, sf, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.merge_m_1(T(spark, sf, "customer"), right, ["c_nationkey"], keep=(1, 3)).select("c_custkey", "n_name", "_merge")


@book.query("j_08_semi", f"with {LOCATED} select kingdom, count(*) as n from located where bin in (select bin_uri from bin_consensus_lookup) group by 1")
def j_08(spark, sf):
    keys = T(spark, sf, "bin_consensus_lookup").select(F.col("bin_uri").alias("bin")).distinct()
    return located(spark, sf).join(keys, "bin", "left_semi").groupBy("kingdom").agg(F.count(F.lit(1)).alias("n"))


@book.query("j_09_anti", "select distinct upper(trim(accession)) as accession from bold_acc_cells where trim(accession) <> '' and upper(trim(accession)) not in (select upper(trim(accession)) from bold_accession_links where accession is not null)")
def j_09(spark, sf):
    a = F.upper(F.trim("accession")).alias("accession")
    return T(spark, sf, "bold_acc_cells").where("trim(accession) <> ''").select(a).distinct().join(T(spark, sf, "bold_accession_links").select(a), "accession", "left_anti")


@book.query("j_10_lookup_default", "select o_orderkey, coalesce(c_mktsegment, 'none') as segment from (select distinct o_orderkey, o_custkey from orders) left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def j_10(spark, sf):
    table = T(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return joins.lookup(T(spark, sf, "orders").select("o_orderkey", "o_custkey").distinct(), table, ["o_custkey"], {"segment": F.lit("none")}).select("o_orderkey", "segment")


_WATER = """with n as (select distinct record_id, lower(regexp_replace(trim(coalesce(species, '')), '\\s+', ' ', 'g')) as species, upper(trim(coalesce(bin_uri, ''))) as bin from bold_minimal_records),
  t as (select lower(canonicalname) as species, min(taxonid) as id from taxon where taxonrank = 'species' and canonicalname <> '' group by 1),
  b as (select bin_uri as bin, min(id) as id from bin_consensus_lookup join t on lower(consensus_species) = t.species group by 1)"""


@book.query("j_11_waterfall", _WATER + " select case when t.id is not null then 'name' when b.id is not null then 'bin' else 'unresolved' end as method, count(*) as n, count(distinct coalesce(t.id, b.id)) as n_taxa from n left join t using (species) left join b using (bin) group by 1")
def j_11(spark, sf):
    n = T(spark, sf, "bold_minimal_records").select("record_id", F.lower(F.regexp_replace(F.trim(F.coalesce("species", F.lit(""))), r"\s+", " ")).alias("species"), F.upper(F.trim(F.coalesce("bin_uri", F.lit("")))).alias("bin")).distinct()
    t = T(spark, sf, "taxon").where("taxonrank = 'species' and canonicalname <> ''").groupBy(F.lower("canonicalname").alias("species")).agg(F.min("taxonid").alias("id"))
    b = T(spark, sf, "bin_consensus_lookup").select(F.col("bin_uri").alias("bin"), F.lower("consensus_species").alias("species")).join(t, "species").groupBy("bin").agg(F.min("id").alias("id"))
    out = joins.waterfall(n, [("name", t, ["species"], "id"), ("bin", b, ["bin"], "id")], "taxon", "method")
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("taxon").alias("n_taxa"))


_ACC = "nullif(regexp_replace(upper(trim(accession)), '\\.[0-9]+$', ''), '')"


@book.query("j_13_cohort_windows", f"""with c as (select distinct {_ACC} as k, cell_id, year(first_seen_at) as y0 from bold_acc_cells), e as (select distinct {_ACC} as k, pubmed_id, year(try_cast(query_date as date)) as y from bold_accession_links where pubmed_id is not null)
  select cell_id, y0 as year, w as window, count(distinct pubmed_id) as n_publications from c join e using (k), (select unnest([3, 5, 10]) as w) where y - y0 between 0 and w group by all""")
def j_13(spark, sf):
    from gridloom.operators.orphans import accession_key

    key = accession_key(F.col("accession")).alias("k")
    c = T(spark, sf, "bold_acc_cells").select(key, "cell_id", F.year("first_seen_at").cast("long").alias("year")).dropna(subset=["k"]).distinct()
    e = T(spark, sf, "bold_accession_links").where("pubmed_id is not null").select(key, "pubmed_id", F.year(F.try_to_date("query_date")).cast("long").alias("y")).dropna().distinct()
    return joins.cohort_windows(c, e, ["k"], "year", "y", [3, 5, 10]).groupBy("cell_id", "year", "window").agg(F.countDistinct("pubmed_id").alias("n_publications"))


@book.query("j_14_pointer_chain", """with recursive t as (select taxonid, case when acceptednameusageid <> taxonid then acceptednameusageid end as p from taxon), r as (select taxonid, taxonid as at, p, 0 as hops from t union all select r.taxonid, t.taxonid, t.p, r.hops + 1 from r join t on t.taxonid = r.p where r.hops < 10)
  select t.taxonid, e.at as root, e.hops from t left join (select * from r where p is null) e using (taxonid)""")
def j_14(spark, sf):
    return joins.resolve_pointers(T(spark, sf, "taxon"), "taxonid", "acceptednameusageid")


@book.query("j_15_unique_target", """with g as (select split_part(lower(canonicalname), ' ', 2) as epithet, taxonid, kingdom from taxon where taxonrank = 'species' and canonicalname like '% %')
  select epithet, case when count(distinct taxonid) = 1 then min(taxonid) when count(distinct case when kingdom = 'Animalia' then taxonid end) = 1 then min(case when kingdom = 'Animalia' then taxonid end) end as taxonid from g group by 1""")
def j_15(spark, sf):
    g = T(spark, sf, "taxon").where("taxonrank = 'species' and canonicalname like '% %'").select(F.split_part(F.lower("canonicalname"), F.lit(" "), F.lit(2)).alias("epithet"), "taxonid", "kingdom", F.lit("Animalia").alias("mine"))
    return joins.unique_target(g, "epithet", "taxonid", "kingdom", "mine")


@book.query("j_25_cooccurrence", "with m as (select distinct l_orderkey as o, p_brand as m from lineitem join part on l_partkey = p_partkey) select a.m as m, b.m as other, count(*) as n from m a join m b on a.o = b.o and a.m <> b.m group by all")
def j_25(spark, sf):
    m = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("m"))
    return joins.cooccurrence(m, "o", "m")


@book.query("j_26_neighbour_vote", """with m as (select distinct l_orderkey as o, p_brand as m from lineitem join part on l_partkey = p_partkey), p as (select a.m as m, b.m as other, count(*) as n from m a join m b on a.o = b.o and a.m <> b.m group by all),
  l as (select p_brand as other, case when max(p_size) % 2 = 0 then 'even' else 'odd' end as label from part where p_brand <> 'Brand#11' group by 1), k as (select p.m, label, n, row_number() over (partition by m order by n desc, p.other) as r from p join l using (other)),
  v as (select m, label, cast(sum(n) as bigint) as votes from k where r <= 7 group by all), s as (select *, votes / sum(votes) over (partition by m) as share, row_number() over (partition by m order by votes desc, label) as r from v) select m, label, votes, round(share, 6) as share from s where r = 1 and share >= 0.5""")
def j_26(spark, sf):
    labels = T(spark, sf, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("other")).agg(F.when(F.max("p_size") % 2 == 0, "even").otherwise("odd").alias("label"))
    return joins.neighbour_vote(j_25(spark, sf), labels, "m", top=7).select("m", "label", "votes", F.round("share", 6).alias("share"))


@book.query("j_27_latest", "select record_id, max(loaded_at) as loaded_at, arg_max(coalesce(identified_by, ''), (loaded_at, coalesce(identified_by, ''))) as identified_by from bold_minimal_records group by 1")
def j_27(spark, sf):
    rows = T(spark, sf, "bold_minimal_records").select("record_id", "loaded_at", F.coalesce("identified_by", F.lit("")).alias("identified_by"))
    return joins.latest_by(rows, ["record_id"], [F.col("loaded_at"), F.col("identified_by")])


@book.query("j_23_numbered", "select a.n_nationkey as number, n_name, r_name from nation a join region on n_nationkey = r_regionkey")
def j_23(spark, sf):
    return joins.numbered_join(T(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), "n_name"), T(spark, sf, "region").select(F.col("r_regionkey").alias("number"), "r_name"), "number")


# Windows: a gappy panel of daily event counts by user.
_DAYS = "d as (select user_id as u, cast(day(ts) as int) as t, count(*) as n, sum(value) as v from events where event_type = 'view' group by all)"


def _days(spark, sf):
    return T(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("u"), F.dayofmonth("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


@book.query("w_01_cumulative", f"with {_DAYS} select u, t, cast(sum(n) over (partition by u order by t) as bigint) as total from d")
def w_01(spark, sf):
    return _days(spark, sf).select("u", "t", window.cumulative(["u"], "t", F.col("n")).alias("total"))


@book.query("w_02_lags", f"with {_DAYS} select u, t, lag(n) over w as l1, lag(n, 2) over w as l2 from d window w as (partition by u order by t)")
def w_02(spark, sf):
    lag = lambda k: window.positional_lag(["u"], "t", F.col("n"), k)
    return _days(spark, sf).select("u", "t", lag(1).alias("l1"), lag(2).alias("l2"))


@book.query("w_03_time_lags", f"with {_DAYS} select a.u, a.t, b.n as l1, c.n as f1 from d a left join d b on a.u = b.u and b.t = a.t - 1 left join d c on a.u = c.u and c.t = a.t + 1")
def w_03(spark, sf):
    lag = lambda k: window.time_lag(["u"], "t", F.col("n"), k)
    return _days(spark, sf).select("u", "t", lag(1).alias("l1"), lag(-1).alias("f1"))


_FULL = f"{_DAYS}, f as (select u.u, t.t, coalesce(d.n, 0) as n from (select distinct u from d) u cross join (select unnest(range(1, 32))::int as t) t left join d on d.u = u.u and d.t = t.t)"


def _full(spark, sf):
    d = _days(spark, sf)
    skel = d.select("u").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(31))))
    return panel.zero_fill(skel, d, ["u", "t"], ["n"]).select("u", "t", "n")


@book.query("w_04_lookback_onset", f"""with {_FULL}, q as (select *, cast(count(n) over w = 2 and max(n) over w = 0 as int) as quiet, cast(sum(cast(n <= 1 as int)) over w = 2 as int) as low from f window w as (partition by u order by t rows between 2 preceding and 1 preceding))
  select u, t, coalesce(quiet, 0) as quiet, coalesce(low, 0) as low, min(case when quiet = 1 and n > 0 then t end) over (partition by u) as onset from q""")
def w_04(spark, sf):
    q = _full(spark, sf).withColumn("quiet", window.quiet_lookback(["u"], "t", F.col("n"), 2)).withColumn("low", window.steady_lookback(["u"], "t", F.col("n") <= 1, 2))
    return q.select("u", "t", "quiet", "low", window.onset(["u"], "t", (F.col("quiet") == 1) & (F.col("n") > 0)).alias("onset"))


@book.query("w_07_event_time", f"""with {_FULL}, o as (select u, t, min(case when n >= 3 then t end) over (partition by u) as g from f)
  select u, t, {', '.join([f"cast(coalesce(t - g <= -6, false) as int) as lead6"] + [f"cast(coalesce(t - g = {-k}, false) as int) as lead{k}" for k in range(5, 1, -1)] + [f"cast(coalesce(t - g = {k}, false) as int) as tau{k}" for k in range(0, 8)] + ["cast(coalesce(t - g >= 8, false) as int) as tau8"])} from o""")
def w_07(spark, sf):
    rows = _full(spark, sf).withColumn("g", window.onset(["u"], "t", F.col("n") >= 3))
    return window.event_dummies(rows, "t", "g").drop("n", "g")


@book.query("w_09_group_max", f"with {_FULL} select u, t, max(cast(n >= 3 as int)) over (partition by u) as ever, max(case when t = 5 then n end) over (partition by u) as at_5 from f")
def w_09(spark, sf):
    return _full(spark, sf).select("u", "t", window.group_max(["u"], (F.col("n") >= 3).cast("int")).alias("ever"), window.baseline_value(["u"], "t", F.col("n"), 5).alias("at_5"))


@book.query("w_10_step_stock", f"""with {_FULL}, a as (select u, greatest(t, 3) as t, sum(n) / 2 as x from f where n > 0 group by all), s as (select u, t from f where t >= 3), c as (select s.u, s.t, least(sum(coalesce(x, 0)) over (partition by s.u order by s.t), 20.0) as stock from s left join a on a.u = s.u and a.t = s.t)
  select u, t, round(stock, 6) as stock, round(greatest(0, stock - coalesce(lag(stock) over (partition by u order by t), 0)), 6) as new from c""")
def w_10(spark, sf):
    f = _full(spark, sf)
    added = f.where("n > 0").select("u", "t", (F.col("n") / 2.0).alias("x"))
    skel = f.where("t >= 3").select("u", "t").withColumn("cap", F.lit(20.0))
    out = window.step_stock(skel, added, "u", "t", "x", "cap")
    return out.select("u", "t", F.round("stock", 6).alias("stock"), F.round("new", 6).alias("new"))


@book.query("w_11_rank_share", "with c as (select inst, count(*) as n from bold_minimal_records where trim(inst) <> '' group by 1) select inst, n, cast(row_number() over o as int) as rank, round(sum(n) over (order by n desc, inst rows unbounded preceding) / sum(n) over (), 9) as cum_share from c window o as (order by n desc, inst)")
def w_11(spark, sf):
    c = T(spark, sf, "bold_minimal_records").where("trim(inst) <> ''").groupBy("inst").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("n"), "inst")  # over the few distinct institutions, not the records
    run = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    return c.select("inst", "n", F.row_number().over(w).alias("rank"), F.round(run / F.sum("n").over(W.partitionBy()), 9).alias("cum_share"))


@book.query("w_12_rank_slice", "select c_nationkey, c_custkey, cast(rank as int) as rank from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank between 3 and 7")
def w_12(spark, sf):
    return window.rank_slice(T(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3, 5).drop("c_acctbal")


@book.query("w_14_zscore", "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 6) as z_pop, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as z_samp from customer")
def w_14(spark, sf):
    out = window.zscore(window.zscore(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", True, "z_pop"), "c_acctbal", False, "z_samp")
    return out.select("c_custkey", F.round("z_pop", 6).alias("z_pop"), F.round("z_samp", 6).alias("z_samp"))


@book.query("w_15_dense_ids", "select c_custkey, dense_rank() over (order by c_nationkey, c_mktsegment) as gid from customer")
def w_15(spark, sf):
    out = window.dense_ids(T(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "gid")
    return out.select("c_custkey", F.col("gid").cast("long").alias("gid"))


@book.query("w_16_quantile_groups", "with c as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as q from customer) select c_custkey, cast(1 + (c_acctbal > q[1])::int + (c_acctbal > q[2])::int + (c_acctbal > q[3])::int as int) as q from customer, c")
def w_16(spark, sf):
    return window.quantile_groups(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4).select("c_custkey", "q")


@book.query("w_17_binned_means", "with c as (select quantile_cont(c_acctbal, [i / 20.0 for i in range(1, 20)]) as q from customer) select cast(1 + len(list_filter(q, lambda x: c_acctbal > x)) as int) as bin, count(*) as n, round(avg(c_acctbal), 6) as mean_x, round(avg(c_custkey), 6) as mean_y from customer, c group by 1")
def w_17(spark, sf):
    out = window.binned_means(T(spark, sf, "customer").select("c_acctbal", "c_custkey"), "c_acctbal", "c_custkey")
    return out.select("bin", "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"))


@book.query("w_19_quarters", "select n_nationkey, q as quarter, is_np from nation, (select unnest([1, 2, 3, 4]) as q), (select unnest([0, 1]) as is_np)")
def w_19(spark, sf):
    return window.stacked(T(spark, sf, "nation").select("n_nationkey").withColumn("quarter", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)]))), "is_np")


@book.query("o_03_top_k", "select inst, count(*) as n from bold_minimal_records where trim(inst) <> '' and not contains(lower(inst), 'university') group by 1 order by n desc, inst limit 20")
def o_03(spark, sf):
    return T(spark, sf, "bold_minimal_records").where("trim(inst) <> '' and not contains(lower(inst), 'university')").groupBy("inst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "inst").limit(20)


@book.query("o_05_top_per_key", "select * from (select event_type, user_id, count(*) as n, cast(row_number() over (partition by event_type order by count(*) desc, user_id) as int) as rank from events group by 1, 2) where rank <= 5")
def o_05(spark, sf):
    n = T(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return window.rank_slice(n, ["event_type"], [F.desc("n"), F.col("user_id")], 1, 5)


@book.query("u_03_first_by_key", "select trim(bin_uri) as bin_uri, min(record_id) as record_id from bold_minimal_records where trim(bin_uri) <> '' group by 1")
def u_03(spark, sf):
    rows = T(spark, sf, "bold_minimal_records").where("trim(bin_uri) <> ''").select(F.trim("bin_uri").alias("bin_uri"), "record_id")
    return rows.groupBy("bin_uri").agg(F.min("record_id").alias("record_id"))


@book.query("u_04_key_sets", """with a as (select distinct c_nationkey as k from customer where c_acctbal > 9000), b as (select distinct s_nationkey as k from supplier) select 'union' as op, k from (select k from a union select k from b) union all select 'both', k from (select k from a intersect select k from b) union all select 'left', k from (select k from a except select k from b)""")
def u_04(spark, sf):
    a = T(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = T(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda n, d: d.select(F.lit(n).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("both", a.intersect(b))).union(named("left", a.join(b, "k", "left_anti")))


@book.query("u_05_tagged_union", "select coalesce(a.k, b.k) as species, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'names' else 'taxa' end as tag from (select distinct species_normalized as k from species_name_resolution where trim(species_normalized) <> '') a full join (select distinct lower(canonicalname) as k from taxon where trim(canonicalname) <> '') b on a.k = b.k")
def u_05(spark, sf):
    a = T(spark, sf, "species_name_resolution").where("trim(species_normalized) <> ''").select(F.col("species_normalized").alias("species")).distinct()
    b = T(spark, sf, "taxon").where("trim(canonicalname) <> ''").select(F.lower("canonicalname").alias("species")).distinct()
    out = joins.merge_1_1(a, b, ["species"], check=False)
    return out.select("species", F.when(F.col("_merge") == 3, "both").when(F.col("_merge") == 1, "names").otherwise("taxa").alias("tag"))


@book.query("u_06_duplicates", "select record_id, count(*) as n from bold_minimal_records group by 1 having count(*) > 1")
def u_06(spark, sf):
    return T(spark, sf, "bold_minimal_records").groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@book.query("k_04_dedup_concat", "select distinct row_id, dataset_key, cell_id from gbif_dataset_cells")
def k_04(spark, sf):
    rows = T(spark, sf, "gbif_dataset_cells").select("row_id", "dataset_key", "cell_id")
    there = rows.where(F.col("row_id") % 3 != 0).distinct()  # two thirds are there already, and must be ignored
    return sinks.insert_ignore(there, rows, ["row_id", "dataset_key", "cell_id"])


@book.query("k_05_patch", "select s_suppkey, coalesce(n.x, s_name) as s_name from supplier left join (select n_nationkey as k, n_name as x from nation where n_regionkey = 1) n on n.k = s_suppkey")
def k_05(spark, sf):
    fix = T(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return sinks.patch(T(spark, sf, "supplier").select("s_suppkey", "s_name"), fix, ["s_suppkey"], "s_name")


@book.query("k_06_upsert", "with l as (select record_id, max(loaded_at) as loaded_at from bold_minimal_records where loaded_at >= timestamp '2016-01-01' group by 1), e as (select record_id, min(loaded_at) as loaded_at from bold_minimal_records where loaded_at < timestamp '2016-01-01' group by 1) select * from l union all select * from e where record_id not in (select record_id from l)")
def k_06(spark, sf):
    rows = T(spark, sf, "bold_minimal_records").select("record_id", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    cut = F.lit("2016-01-01").cast("timestamp")
    old = rows.where(F.col("loaded_at") < cut).groupBy("record_id").agg(F.min("loaded_at").alias("loaded_at"))
    return sinks.upsert(old, rows.where(F.col("loaded_at") >= cut), ["record_id"], "loaded_at")
