"""Aggregations beyond the built-in ones: pluralities with a tie rule, distinct string lists, grouping sets of distinct
counts, pivots by a list of specifications, correlations, audits. All are DataFrame plans with map-side combination."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def plurality(df: DataFrame, group: list[str], value: str, threshold: float = 0.8) -> DataFrame:
    """(group..., value, votes, total, concordance, is_strict): each group's most frequent non-blank value.

    Ties take the smaller value. concordance = votes / total; is_strict = 1 at or above `threshold`. Two aggregations; a
    group's distinct values are reduced by max_by, never sorted in one task."""
    votes = df.where(F.trim(F.col(value)) != "").groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    # The smallest (-n, value) is the most votes, then the smaller value.
    best = votes.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    share = F.col("votes") / F.col("total")
    return best.select(*group, F.col("b.v").alias(value), (-F.col("b.m")).alias("votes"), "total").withColumn("concordance", share).withColumn("is_strict", (share >= threshold).cast("int"))


def mode_of(value: Column) -> Column:
    """The most frequent value as an aggregate, ties to the smaller one (deterministic)."""
    return F.mode(value, True)


def first_nonempty(value: Column, position: Column) -> Column:
    """The first non-blank value by position; "" if there is none."""
    return F.coalesce(F.min_by(value, F.when(F.trim(value) != "", position)), F.lit(""))


def distinct_list(value: Column, sep: str = ",") -> Column:
    """Sorted distinct non-blank values joined into one text."""
    return F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(value), F.lit("")))), sep)


def examples(df: DataFrame, group: list[str], value: str, position: str, n: int = 3) -> DataFrame:
    """(group..., examples array): at most n distinct values, the first seen first. Each value is reduced to its first
    position, and only the n first of a group are gathered."""
    first = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(position).alias("_pos"))
    w = W.partitionBy(*group).orderBy("_pos", value)
    top = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("_e")).select(*group, F.transform("_e", lambda x: x[value]).alias("examples"))


def distinct_by_sets(df: DataFrame, always: list[str], dims: list[str], value: str, sets: list[list[str]], label: str = "all", name: str = "n") -> DataFrame:
    """(always..., dims..., n): exact distinct `value` counts for several sets of dimensions; a dimension that is summed over reads `label`.

    Distinct counts do not add up, so each set counts for itself; the distinct rows are made once and expanded per set."""
    rows = df.select(*always, *dims, value).where(F.col(value).isNotNull()).distinct()
    each = F.explode(F.array(*[F.struct(*[(F.col(d) if d in s else F.lit(label)).alias(f"_{d}") for d in dims], F.lit(i).alias("_set")) for i, s in enumerate(sets)])).alias("_x")
    out = rows.select(*always, value, each).groupBy(*always, *[F.col(f"_x._{d}").alias(d) for d in dims], F.col("_x._set").alias("_set")).agg(F.countDistinct(value).alias(name))
    return out.drop("_set")


def rollup_total(df: DataFrame, by: str, sums: list[str], label: str = "TOTAL") -> DataFrame:
    """Sums by group and one TOTAL row."""
    out = df.rollup(by).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(by).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, label).otherwise(F.col(by)).alias(by), *sums)


def fractional_scores(df: DataFrame, unit: str, cls: str, keys: list[str]) -> DataFrame:
    """(keys..., class, score): each unit (record) splits 1.0 over the classes of its members; scores to 4 digits."""
    per = df.groupBy(*keys, unit, cls).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(*keys, unit).agg(F.sum("n").alias("t"))
    return per.join(total, [*keys, unit]).groupBy(*keys, cls).agg(F.round(F.sum(F.col("n") / F.col("t")), 4).alias("score"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Over the rows that have both."""
    ok = x.isNotNull() & w.isNotNull()
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def describe(df: DataFrame, group: list[str], column: str, percentiles: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, mean, sd, min, exact percentiles and max of a column by group."""
    c = F.col(column)
    return df.groupBy(*group).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), *[F.percentile(c, p).alias(f"p{int(p * 100)}") for p in percentiles], F.max(c).alias("max"))


def pivot_zero(df: DataFrame, index: list[str], column: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide with known column names, missing combinations 0."""
    return df.groupBy(*index).pivot(column, names).agg(F.sum(value)).na.fill(0, names)


def wide_by_spec(df: DataFrame, index: list[str], specs: dict[str, dict[str, str]], value: str) -> DataFrame:
    """Long to wide by specifications {new column: {column: value it must have}}, in one aggregation."""
    cols = []
    for name, must in specs.items():
        cond = None
        for c, v in must.items():
            cond = (F.col(c) == v) if cond is None else cond & (F.col(c) == v)
        cols.append(F.coalesce(F.max(F.when(cond, F.col(value))), F.lit(0)).alias(name))
    return df.groupBy(*index).agg(*cols)


def correlations(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., x, y, n, r, t): pairwise-complete Pearson correlations with their t statistic, one pass over the data."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [F.corr(F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return one.select(*by, F.inline(rows)).withColumn("t", t)


def coverage(df: DataFrame, fields: list[str], cell: str) -> DataFrame:
    """(field, n_filled, n_unique, n_cells): an audit of many text fields in one aggregation."""
    filled = lambda f: F.nullif(F.trim(F.col(f)), F.lit(""))
    aggs = []
    for i, f in enumerate(fields):
        aggs += [F.count(filled(f)).alias(f"a{i}"), F.countDistinct(filled(f)).alias(f"b{i}"), F.countDistinct(F.when(filled(f).isNotNull(), F.col(cell))).alias(f"c{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a{i}").alias("n_filled"), F.col(f"b{i}").alias("n_unique"), F.col(f"c{i}").alias("n_cells")) for i, f in enumerate(fields)])))


def top_values(df: DataFrame, fields: list[str], k: int = 3) -> DataFrame:
    """(field, rank, value, n, share): the k most frequent non-blank values of every field, ties by value."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields]))).where(F.col("value") != "")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("t"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(total), "field").select("field", "rank", "value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_left, n_right, n_both, n_union distinct non-null keys."""
    x = a.select(key).dropna().distinct().withColumn("_a", F.lit(1))
    y = b.select(key).dropna().distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_union"))


def disagreements(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values, values): keys with more than one distinct non-blank value."""
    rows = df.where(F.trim(F.col(value)) != "").select(key, F.trim(F.col(value)).alias("v")).dropna().distinct()
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.sort_array(F.collect_set("v")), "|").alias("values")).where(F.col("n_values") > 1)


def climatology_anomaly(df: DataFrame, unit: list[str], season: list[str], year: str, value: str, base: tuple[int, int]) -> DataFrame:
    """`df` with baseline (mean over the base years per unit and season) and anomaly (value minus it)."""
    keys = [*unit, *season]
    baseline = df.where(F.col(year).between(*base)).groupBy(*keys).agg(F.avg(value).alias("baseline"))
    return df.join(baseline, keys, "left").withColumn("anomaly", F.col(value) - F.col("baseline"))


def complete_sum(value: Column, n: int) -> Column:
    """The sum if exactly n values are there, else null (all-or-nothing)."""
    return F.when(F.count(value) == n, F.sum(value))
