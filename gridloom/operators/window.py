"""Panel time series: lags that know gaps, look-backs, onsets, event time, stocks, quantile groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulative(unit: list[str], time: str, c: Column) -> Column:
    """The running sum within a unit, in time order, null as 0."""
    return F.sum(F.coalesce(c, F.lit(0))).over(W.partitionBy(*unit).orderBy(time).rowsBetween(W.unboundedPreceding, 0))


def positional_lag(unit: list[str], time: str, c: Column, k: int = 1) -> Column:
    return F.lag(c, k).over(W.partitionBy(*unit).orderBy(time))


def time_lag(unit: list[str], time: str, c: Column, k: int = 1) -> Column:
    """The value k periods earlier (a lead for negative k), null across a gap. Times are unique integers within a unit."""
    w = W.partitionBy(*unit).orderBy(time).rangeBetween(-k, -k)
    return F.first(c).over(w)


def quiet_lookback(unit: list[str], time: str, c: Column, k: int) -> Column:
    """1 if all k periods before are present, not missing and 0; else 0."""
    w = W.partitionBy(*unit).orderBy(time).rangeBetween(-k, -1)
    return F.coalesce((F.count(c).over(w) == k) & (F.max(F.abs(c)).over(w) == 0), F.lit(False)).cast("int")


def steady_lookback(unit: list[str], time: str, cond: Column, k: int) -> Column:
    """1 if the condition held (true, not null) in all k periods before; else 0."""
    w = W.partitionBy(*unit).orderBy(time).rangeBetween(-k, -1)
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).over(w) == k, F.lit(False)).cast("int")


def onset(unit: list[str], time: str, flag: Column) -> Column:
    """The first time the flag holds, on every row of the unit; null if it never does."""
    return F.min(F.when(flag, F.col(time))).over(W.partitionBy(*unit))


def group_max(unit: list[str], c: Column) -> Column:
    return F.max(c).over(W.partitionBy(*unit))


def event_dummies(df: DataFrame, time: str, first: str, low: int = -6, high: int = 8, omit: int = -1) -> DataFrame:
    """lead<k> and tau<k> dummies of event time (time - first), the ends binned, `omit` left out, 0 for units never treated."""
    et = F.col(time) - F.col(first)
    cols = {}
    for k in range(low, high + 1):
        if k == omit:
            continue
        cond = et <= k if k == low else et >= k if k == high else et == k
        cols[f"lead{-k}" if k < 0 else f"tau{k}"] = F.coalesce(cond, F.lit(False)).cast("int")
    return df.withColumns(cols)


def step_stock(skeleton: DataFrame, additions: DataFrame, unit: str, time: str, amount: str, cap: str | None = None) -> DataFrame:
    """The stock of additions by time, carried forward over the skeleton, capped by a column of it, with its first difference.

    Adds `stock` and `new` (never negative; the first period's difference is to 0). Additions before the first period count
    into it, later than the last are dropped."""
    first = skeleton.agg(F.min(time).alias("_t0"))
    added = additions.crossJoin(F.broadcast(first)).groupBy(F.col(unit), F.greatest(F.col(time), F.col("_t0")).alias(time)).agg(F.sum(amount).alias("_add"))
    out = skeleton.join(added, [unit, time], "left")
    w = W.partitionBy(unit).orderBy(time)
    total = F.sum(F.coalesce("_add", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("stock", F.least(total, F.col(cap)) if cap else total)
    return out.withColumn("new", F.greatest(F.lit(0.0), F.col("stock") - F.coalesce(F.lag("stock").over(w), F.lit(0.0)))).drop("_add")


def zscore(df: DataFrame, column: str, population: bool = True, out: str | None = None) -> DataFrame:
    """(x - mean) / sd over the table, 0 where the sd is 0. One aggregate row is broadcast."""
    sd = F.stddev_pop if population else F.stddev_samp
    m = df.agg(F.avg(column).alias("_m"), sd(column).alias("_s"))
    z = F.when(F.col(column).isNull(), None).when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return df.crossJoin(F.broadcast(m)).withColumn(out or f"z_{column}", z).drop("_m", "_s")


def dense_ids(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Ids 1, 2, ... of the distinct value tuples in their order; null where any component is null.

    Ids are given on the distinct tuples (one row each), not on the rows; that sort is over a single ordering."""
    keys = df.select(*columns).dropna().distinct()
    ids = keys.withColumn(out, F.row_number().over(W.orderBy(*columns)))
    return df.join(ids, columns, "left")


def quantile_groups(df: DataFrame, column: str, n: int, out: str = "q") -> DataFrame:
    """Groups 1..n by exact percentile cut points; equal values stay together, null gives null."""
    cuts = df.agg(F.percentile(column, [i / n for i in range(1, n)]).alias("_c"))
    group = F.size(F.filter("_c", lambda c: F.col(column) > c)) + 1
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, F.when(F.col(column).isNotNull(), group)).drop("_c")


def binned_means(df: DataFrame, x: str, y: str, n: int = 20) -> DataFrame:
    """(bin, n, mean_x, mean_y): a binned scatter."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return quantile_groups(both, x, n, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def baseline_value(unit: list[str], time: str, c: Column, at: int) -> Column:
    """The value at one time, on every row of the unit."""
    return F.max(F.when(F.col(time) == at, c)).over(W.partitionBy(*unit))


def stacked(df: DataFrame, flag: str) -> DataFrame:
    """Every row twice, flag 0 and 1."""
    return df.withColumn(flag, F.explode(F.array(F.lit(0), F.lit(1))))


def rank_slice(df: DataFrame, by: list[str], order: list[Column], start: int, n: int) -> DataFrame:
    """Rows ranked start .. start + n - 1 within each group (rank in column `rank`)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank").between(start, start + n - 1))
