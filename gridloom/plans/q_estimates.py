"""Estimators against closed forms that SQL can say: balanced panels, one or two regressors within one effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import estimate
from gridloom.plans.book import Book
from gridloom.plans.common import T
from gridloom.sources import sinks

book = Book()

#: A balanced panel of nations by year, half of them treated from 1995 on: orders a year and their mean price.
_PANEL = """k as (select c_nationkey::int as u, year(o_orderdate)::int as t, count(*)::double as n, avg(o_totalprice) as v from orders join customer on c_custkey = o_custkey group by all),
  p as (select u.u, t.t, coalesce(n, 0) as y, coalesce(v, 0) as x, case when u.u % 2 = 0 then 1995 end as g from (select distinct u from k) u cross join (select unnest(range(1992, 1999))::int as t) t left join k on k.u = u.u and k.t = t.t)"""
_MEANS = "m as (select t, avg(y) filter (g is not null) as yt, avg(y) filter (g is null) as yc from p group by 1)"


def panel_of(spark, sf) -> DataFrame:
    from gridloom.operators import panel
    from gridloom.storage import checkpointed

    k = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").cast("int").alias("u"), F.year("o_orderdate").alias("t")).agg(F.count("*").cast("double").alias("y"), F.avg("o_totalprice").alias("x"))
    skel = panel.skeleton(k.select("u").distinct(), panel.PanelVariant(first_year=1992, last_year=1998)).withColumnRenamed("year", "t")
    return checkpointed(panel.zero_fill(skel, k, ["u", "t"], ["y", "x"]).withColumn("g", F.when(F.col("u") % 2 == 0, F.lit(1995))))


def _two(source: str, y: str, a: str, b: str, unit: str, names: tuple[str, str], where: str = "true") -> str:
    """SQL of a least squares fit of y on two regressors within one effect, by Cramer's rule."""
    src = f"src as (select {unit} as u, ({y})::double as y, ({a})::double as a, ({b})::double as b from {source} where {where})"
    d = "d as (select y - avg(y) over w as y, a - avg(a) over w as a, b - avg(b) over w as b from src window w as (partition by u)), s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as yb from d)"
    return f"{src}, {d} select '{names[0]}' as term, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 4) as estimate from s union all select '{names[1]}', round((yb * aa - ay * ab) / (aa * bb - ab * ab), 4) from s"


def _terms(spark, fit, digits: int = 4) -> DataFrame:
    return fit.table(spark).select("term", F.round("estimate", digits).alias("estimate"))


@book.query("e_01_clustered_se", """with d as (select l_suppkey as u, l_extendedprice - avg(l_extendedprice) over w as y, l_quantity - avg(l_quantity) over w as x, count(*) over w as c from lineitem window w as (partition by l_suppkey)), r as (select * from d where c > 1),
  b as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as xx, count(*) as n, count(distinct u) as g from r), s as (select u, sum(x * (y - beta * x)) as score from r, b group by 1)
  select round(sqrt(sum(score * score) / any_value(xx * xx) * any_value(g / (g - 1.0) * (n - 1.0) / (n - 2))), 4) as se, any_value(g) as clusters from s, b""")
def e_01_se(spark, sf):
    fit = estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_suppkey")
    return fit.table(spark).select(F.round("se", 4).alias("se"), F.lit(fit.clusters).cast("long").alias("clusters"))


@book.query("e_02_two_way", f"with {_PANEL}, d as (select y - avg(y) over (partition by u) - avg(y) over (partition by t) + avg(y) over () as y, x - avg(x) over (partition by u) - avg(x) over (partition by t) + avg(x) over () as x from p) select 'x' as term, round(sum(x * y) / sum(x * x), 8) as estimate from d")
def e_02(spark, sf):
    return _terms(spark, estimate.ols(panel_of(spark, sf), "y", ["x"], ["u", "t"], "u"), 8)


@book.query("e_03_interaction", "with " + _two("lineitem", "l_extendedprice", "l_quantity", "l_quantity * l_discount", "l_suppkey", ("l_quantity", "l_quantity_x_l_discount")))
def e_03(spark, sf):
    rows, names = estimate.interacted(T(spark, sf, "lineitem"), "l_quantity", ["l_discount"])
    return _terms(spark, estimate.ols(rows, "l_extendedprice", ["l_quantity", *names], ["l_suppkey"], "l_suppkey"))


@book.query("e_04_lincom", f"select round(sum(estimate), 3) as total from (with {_two('lineitem', 'l_extendedprice', 'l_quantity', 'l_discount', 'l_suppkey', ('a', 'b'))})")
def e_04(spark, sf):
    fit = estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey"], "l_suppkey")
    return spark.createDataFrame([(round(fit.lincom({"l_quantity": 1.0, "l_discount": 1.0})[0], 3),)], "total double")


@book.query("e_05_wald", """with d as (select l_suppkey as u, l_extendedprice - avg(l_extendedprice) over w as y, l_quantity - avg(l_quantity) over w as x, count(*) over w as c from lineitem window w as (partition by l_suppkey)), r as (select * from d where c > 1),
  b as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as xx, count(*) as n, count(distinct u) as g from r), s as (select u, sum(x * (y - beta * x)) as score from r, b group by 1)
  select round(any_value(beta * beta) / (sum(score * score) / any_value(xx * xx) * any_value(g / (g - 1.0) * (n - 1.0) / (n - 2))) / 1000, 3) as f_thousands, 1 as terms from s, b""")
def e_05(spark, sf):
    """With one term the joint test is the square of its t."""
    f, k = estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_suppkey").wald(["l_quantity"])
    return spark.createDataFrame([(round(f / 1000, 3), k)], "f_thousands double, terms int")


_STUDY = f"with {_PANEL}, {_MEANS} select case when t < 1995 then 'lead' || (1995 - t) else 'tau' || (t - 1995) end as term, round((yt - (select yt from m where t = 1994)) - (yc - (select yc from m where t = 1994)), 5) as estimate from m where t <> 1994"


@book.query("e_06_event_study", _STUDY)
def e_06(spark, sf):
    return _terms(spark, estimate.event_study(panel_of(spark, sf), "y", "u", "t", "g", -3, 3), 5)


@book.query("e_07_imputation", f"with {_PANEL}, {_MEANS}, b as (select avg(yt) as bt, avg(yc) as bc from m where t < 1995) select t - 1995 as horizon, round((yt - bt) - (yc - bc), 5) as estimate, (select count(*) from p where g is not null and p.t = m.t) as n from m, b where t >= 1995")
def e_07(spark, sf):
    return estimate.imputation(panel_of(spark, sf), "y", "u", "t", "g").select("horizon", F.round("estimate", 5).alias("estimate"), "n")


@book.query("e_08_distributed_lag", f"with {_PANEL}, q as (select *, lag(x) over (partition by u order by t) as lx from p), " + _two("q", "y", "x", "lx", "u", ("x", "l1_x"), "lx is not null").replace("4)", "8)"))
def e_08(spark, sf):
    rows, names = estimate.distributed_lags(panel_of(spark, sf), "x", ["u"], "t", 0, 1)
    return _terms(spark, estimate.ols(rows, "y", names, ["u"], "u"), 8)


@book.query("e_09_switchers", f"with {_PANEL}, {_MEANS} select t as time, round((yt - lag(yt) over (order by t)) - (yc - lag(yc) over (order by t)), 5) as did, (select count(distinct u) from p where g is not null) as n_switchers from m qualify t = 1995")
def e_09(spark, sf):
    p = panel_of(spark, sf).withColumn("d", F.coalesce(F.col("t") >= F.col("g"), F.lit(False)))
    return estimate.switchers_did(p, "y", "u", "t", "d").select(F.col("t").alias("time"), F.round("did", 5).alias("did"), "n_switchers")


@book.query("e_10_group_time", f"with {_PANEL}, {_MEANS} select 1995 as g, t, round((yt - (select yt from m where t = 1994)) - (yc - (select yc from m where t = 1994)), 5) as att, (select count(distinct u) from p where g is not null) as n_treated, (select count(distinct u) from p where g is null) as n_control from m where t >= 1995")
def e_10(spark, sf):
    return estimate.group_time_att(panel_of(spark, sf), "y", "u", "t", "g").select("g", "t", F.round("att", 5).alias("att"), "n_treated", "n_control")


@book.query("e_11_residuals", """with d as (select l_suppkey as u, l_extendedprice - avg(l_extendedprice) over w as y, l_quantity - avg(l_quantity) over w as x from lineitem window w as (partition by l_suppkey)), b as (select sum(x * y) / sum(x * x) as beta from d)
  select u, round(sum((y - beta * x) * (y - beta * x)) / 1e6, 4) as ss from d, b group by 1""")
def e_11(spark, sf):
    rows = estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_suppkey").rows
    return rows.groupBy(F.col("l_suppkey").alias("u")).agg(F.round(F.sum(F.col("_resid") * F.col("_resid")) / 1e6, 4).alias("ss"))


@book.query("e_12_stacked", """with s as (select l_suppkey * 10 + k.f as u, k.f, case when k.f = 0 then l_extendedprice else l_tax * 1000 end as y, l_quantity as x from lineitem cross join (values (0), (1)) k(f)), d as (select f, y - avg(y) over (partition by u) as y, x - avg(x) over (partition by u) as x from s),
  b as (select f, sum(x * y) / sum(x * x) as beta from d group by 1) select round((select beta from b where f = 1) - (select beta from b where f = 0), 3) as difference""")
def e_12(spark, sf):
    from gridloom.operators.window import stacked

    s = stacked(T(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_tax", "l_quantity"), "f")
    s = s.withColumns({"u": F.col("l_suppkey") * 10 + F.col("f"), "y": F.when(F.col("f") == 0, F.col("l_extendedprice")).otherwise(F.col("l_tax") * 1000), "x_f": F.col("l_quantity") * F.col("f")})
    fit = estimate.ols(s, "y", ["l_quantity", "x_f"], ["u"], "u")
    return spark.createDataFrame([(round(float(fit.beta[1]), 3),)], "difference double")


def _within(where: str, y: str = "l_extendedprice") -> str:
    return f"(select sum(x * y) / sum(x * x) from (select {y} - avg({y}) over w as y, l_quantity - avg(l_quantity) over w as x from lineitem where {where} window w as (partition by l_suppkey)))"


_SAMPLES = {"full": "true", "returned": "l_returnflag = 'R'", "large": "l_quantity > 25"}


@book.query("e_13_samples", " union all ".join(f"select '{n}' as spec, round({_within(w)}, 3) as estimate" for n, w in _SAMPLES.items()))
def e_13(spark, sf):
    """One regression over a set of samples."""
    specs = {n: {"y": "l_extendedprice", "x": ["l_quantity"], "absorb": ["l_suppkey"], "cluster": "l_suppkey", "where": w} for n, w in _SAMPLES.items()}
    return estimate.specifications(T(spark, sf, "lineitem"), specs).select("spec", F.round("estimate", 3).alias("estimate"))


@book.query("e_16_families", " union all ".join(f"select '{y}' as spec, round({_within('true', y)}, 6) as estimate" for y in ("l_extendedprice", "l_discount", "l_tax")))
def e_16(spark, sf):
    """A family of outcomes from a table of settings."""
    specs = {y: {"y": y, "x": ["l_quantity"], "absorb": ["l_suppkey"], "cluster": "l_suppkey"} for y in ("l_extendedprice", "l_discount", "l_tax")}
    return estimate.specifications(T(spark, sf, "lineitem"), specs).select("spec", F.round("estimate", 6).alias("estimate"))


@book.query("e_18_event_axis", "select * from (values ('lead6', -6), ('tau8', 8), ('L2.x', 2), ('F3.x', -3), ('pre2', -2), ('horizon4', 4), ('t_m6', -6), ('t_p8', 8), ('_cons', null)) t(name, tau)")
def e_18(spark, sf):
    names = ["lead6", "tau8", "L2.x", "F3.x", "pre2", "horizon4", "t_m6", "t_p8", "_cons"]
    return spark.createDataFrame(list(zip(names, estimate.on_event_axis(names))), "name string, tau int")


@book.query("e_19_average_effects", f"select 'first 3' as name, round(avg(estimate), 4) as estimate from ({_STUDY}) where term in ('tau0', 'tau1', 'tau2')")
def e_19(spark, sf):
    fit = estimate.event_study(panel_of(spark, sf), "y", "u", "t", "g", -3, 3)
    return spark.createDataFrame([(n, round(e, 4)) for n, e, _ in estimate.average_effects(fit, {"first 3": ["tau0", "tau1", "tau2"]})], "name string, estimate double")


@book.query("e_20_effort_control", "with " + _two("lineitem", "l_extendedprice", "l_quantity", "ln(1 + l_linenumber)", "l_suppkey", ("l_quantity", "log1p_lines"), "l_discount > 0"))
def e_20(spark, sf):
    rows = T(spark, sf, "lineitem").where("l_discount > 0").withColumn("log1p_lines", F.log1p("l_linenumber"))
    return _terms(spark, estimate.ols(rows, "l_extendedprice", ["l_quantity", "log1p_lines"], ["l_suppkey"], "l_suppkey"))


@book.query("k_11_regression_table", f"select concat('l\\_quantity & ', printf('%.1f', round({_within('true')}, 1))) as line")
def k_11(spark, sf):
    table = sinks.regression_table({"(1)": estimate.ols(T(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_suppkey")}, 1)
    return spark.createDataFrame([(x.removesuffix(" \\\\").rstrip("*"),) for x in table.split("\n") if x.startswith("l\\_")], "line string")
