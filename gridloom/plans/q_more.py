"""Predicates, flags, overrides, further aggregations, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import aggregate, filters, window
from gridloom.plans.book import Book
from gridloom.plans.common import LOCATED, T, located
from gridloom.plans.q_relational import _DAYS, _days
from gridloom.sources import binary, sinks
from gridloom.sources import text as source_text
from gridloom.storage import shared_dir

book = Book()


@book.query("x_06_valid_records", r"select source_group, count(*) as n, count(*) filter (trim(has_coord) = '1' and regexp_full_match(trim(latitude), '[+-]?\d+(\.\d*)?') and abs(try_cast(trim(latitude) as double)) <= 90 and regexp_full_match(trim(longitude), '[+-]?\d+(\.\d*)?') and abs(try_cast(trim(longitude) as double)) <= 180) as valid from bold_minimal_records group by 1")
def x_06(spark, sf):
    ok = filters.valid_coordinates(F.col("has_coord"), F.col("latitude"), F.col("longitude"))
    return T(spark, sf, "bold_minimal_records").groupBy("source_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


@book.query("x_08_thresholds", "select event_type, count(*) filter (value >= 34) as strong, count(*) filter (value >= 64) as severe from events group by 1")
def x_08(spark, sf):
    return T(spark, sf, "events").groupBy("event_type").agg(F.count_if(filters.at_least(F.col("value"), 34)).alias("strong"), F.count_if(filters.at_least(F.col("value"), 64)).alias("severe"))


@book.query("x_10_protected_filter", "select s_suppkey from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 = 0")
def x_10(spark, sf):
    k = F.col("s_suppkey")
    sites = T(spark, sf, "supplier").select("s_suppkey", F.when(k % 3 == 0, " Designated").otherwise("Proposed").alias("STATUS"), F.when(k % 2 == 0, "0").otherwise("2").alias("MARINE"))
    return filters.protected_areas(sites).select("s_suppkey")


@book.query("x_16_region_flag", "select cell_id, cast(coalesce(continent = 'Halvane' or country = 'Wekivedor', false) as int) as flag from bold_grid100_land_cells")
def x_16(spark, sf):
    return T(spark, sf, "bold_grid100_land_cells").select("cell_id", filters.region_flag(F.col("continent"), F.col("country"), ["Halvane"], ["Wekivedor"]).alias("flag"))


@book.query("x_24_precedence", "select c_custkey, case when c_custkey % 7 = 0 then 'a' when c_custkey % 3 = 0 then 'b' else c_mktsegment end as label, case when c_custkey % 7 = 0 then 0 when c_custkey % 3 = 0 then 1 else 2 end as source from customer")
def x_24(spark, sf):
    c = T(spark, sf, "customer")
    k = F.col("c_custkey")
    fixed = c.where(k % 7 == 0).select("c_custkey", F.lit("a").alias("label"))
    reviewed = c.select("c_custkey", F.when(k % 3 == 0, "b").otherwise(" ").alias("label"))
    return filters.precedence("c_custkey", "label", fixed, reviewed, c.select("c_custkey", F.col("c_mktsegment").alias("label")))


@book.query("x_25_point_fixes", "select n_nationkey, case when n_nationkey = 3 then 'FIXED' else n_name end as n_name, case when n_nationkey in (3, 4) then 0 else n_regionkey end as n_regionkey from nation")
def x_25(spark, sf):
    return filters.with_fixes(T(spark, sf, "nation"), "n_nationkey", {3: {"n_name": "FIXED", "n_regionkey": 0}, 4: {"n_regionkey": 0}})


@book.query("a_24_kingdom_species", f"with {LOCATED} select cell_id, count(distinct species) filter (kingdom = 'Animalia') as n_animals, count(distinct species) filter (kingdom = 'Plantae') as n_plants, count(distinct species) filter (kingdom = 'Fungi') as n_fungi from located where species <> '' group by 1")
def a_24(spark, sf):
    s = lambda k: F.countDistinct(F.when(F.col("kingdom") == k, F.col("species")))
    return located(spark, sf).where("species <> ''").groupBy("cell_id").agg(s("Animalia").alias("n_animals"), s("Plantae").alias("n_plants"), s("Fungi").alias("n_fungi"))


@book.query("a_36_pairwise", "select 'price' as x, 'balance' as y, count(*) as n, round(corr(o_totalprice, c_acctbal), 6) as r, round(corr(o_totalprice, c_acctbal) * sqrt((count(*) - 2) / (1 - pow(corr(o_totalprice, c_acctbal), 2))), 4) as t from orders join customer on c_custkey = o_custkey where c_acctbal is not null and o_totalprice is not null")
def a_36(spark, sf):
    rows = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"))
    return aggregate.correlations(rows, ["price", "balance"]).select("x", "y", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@book.query("a_49_weighted_people", r"""with g as (select collectors, count(*) as w from bold_minimal_records where collectors is not null group by 1), t as (select distinct collectors, w, regexp_replace(trim(unnest(string_split(regexp_replace(collectors, '(?i)\s+and\s+|[&;|]', ',', 'g'), ','))), '\s+', ' ', 'g') as person from g)
  select person, cast(sum(w) as bigint) as n_records, count(*) as n_texts from t where regexp_matches(person, '\p{L}{2,}') and not regexp_matches(person, '\d') group by 1""")
def a_49(spark, sf):
    texts = T(spark, sf, "bold_minimal_records").where("collectors is not null").groupBy("collectors").agg(F.count(F.lit(1)).alias("w"))
    people = texts.select("w", F.explode(text.person_tokens(F.col("collectors"))).alias("person"))
    return people.groupBy("person").agg(F.sum("w").alias("n_records"), F.count(F.lit(1)).alias("n_texts"))


@book.query("w_08_composite_shock", f"""with {_DAYS}, s as (select *, (n >= 3 or v > 60) as shock from d) select u, t, cast(coalesce(shock, false) as int) as shock, min(case when shock then t end) over (partition by u) as onset from s""")
def w_08(spark, sf):
    rows = _days(spark, sf).withColumn("shock", F.coalesce((F.col("n") >= 3) | (F.col("v") > 60), F.lit(False)))
    return rows.select("u", "t", F.col("shock").cast("int").alias("shock"), window.onset(["u"], "t", F.col("shock")).alias("onset"))


@book.query("s_01_csv_round_trip", "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation")
def s_01(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(T(spark, sf, "nation"), path)
    return source_text.read_delimited(spark, path, ["n_nationkey", "n_name"])


@book.query("s_04_tolerant_scan", "select cast(n_nationkey as varchar) as key, n_name as name, '' as absent from nation union all select cast(r_regionkey as varchar), r_name, '' from region")
def s_04(spark, sf):
    base = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    T(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).coalesce(1).write.options(header=True, sep="\t").csv(f"{base}/a")
    T(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("x").alias("more"), F.col("r_regionkey").alias("key")).coalesce(1).write.options(header=True, sep="\t").csv(f"{base}/b")
    return source_text.read_tolerant(spark, source_text.discover(spark, base, r"\.csv$"), ["key", "name", "absent"])


@book.query("s_13_geojson_round_trip", "select n_name as name, 5 as points from nation")
def s_13(spark, sf):
    base = f"{shared_dir(spark)}/geojson-{uuid.uuid4().hex}"
    k = F.col("n_nationkey").cast("double")
    ring = F.array(*[F.struct((k + a).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    features = sinks.geojson_features(T(spark, sf, "nation").select(F.col("n_name").alias("name"), F.array(ring).alias("rings")))
    one = features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    one.coalesce(1).write.text(base)
    return binary.read_geojson(spark, base, ["name"]).select("name", F.size(F.col("rings")[0]).alias("points"))
