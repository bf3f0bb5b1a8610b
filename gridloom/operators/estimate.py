"""Fixed-effects estimation: absorbed OLS with clustered errors, tests, event studies, imputation.

Rows stay distributed: demeaning is iterated grouped means (each round a written table), and only the Gram matrices and
per-cluster score products, whose size is the number of regressors, reach the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.storage import checkpointed


@dataclass
class Fit:
    """names, coefficients, covariance, observations, clusters; `rows`: the demeaned rows with `_resid`."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int
    rows: DataFrame | None = None

    def table(self, spark) -> DataFrame:
        """(term, estimate, se, t) as a DataFrame."""
        se = np.sqrt(np.maximum(0.0, np.diag(self.cov)))
        return spark.createDataFrame([(t, float(b), float(s), float(b / s) if s > 0 else None) for t, b, s in zip(self.names, self.beta, se)], "term string, estimate double, se double, t double")

    def lincom(self, weights: dict[str, float]) -> tuple[float, float]:
        """A linear combination of coefficients and its standard error."""
        w = np.array([weights.get(n, 0.0) for n in self.names])
        return float(w @ self.beta), float(math.sqrt(max(0.0, w @ self.cov @ w)))

    def wald(self, terms: list[str]) -> tuple[float, int]:
        """The joint test that the terms are 0: F statistic and its numerator degrees of freedom."""
        i = [self.names.index(t) for t in terms]
        b, v = self.beta[i], self.cov[np.ix_(i, i)]
        return float(b @ np.linalg.pinv(v) @ b) / len(i), len(i)


def drop_singletons(df: DataFrame, absorb: list[str]) -> DataFrame:
    """Without the rows that are alone in a level of an absorbed effect, repeated until there are none (each round drops a row)."""
    n = df.count()
    while True:
        for fe in absorb:
            df = df.join(df.groupBy(fe).count().where("count > 1").select(fe), fe, "left_semi")
        df = checkpointed(df)
        before, n = n, df.count()
        if n == before:
            return df


def demeaned(df: DataFrame, columns: list[str], absorb: list[str], tolerance: float = 1e-8, rounds: int = 500) -> DataFrame:
    """The columns with the absorbed effects partialled out by alternating projections, until no mean of any effect exceeds
    the tolerance. An error if that takes more than `rounds` rounds."""
    for _ in range(rounds):
        for fe in absorb:
            means = df.groupBy(fe).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
            df = df.join(means, fe).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
        df = checkpointed(df)
        if len(absorb) < 2:
            return df
        # The last effect's means are 0 by construction; all others are looked at.
        worst = max(df.groupBy(fe).agg(*[F.abs(F.avg(c)).alias(c) for c in columns]).agg(F.max(F.greatest(F.lit(0.0), *[F.col(c) for c in columns]))).first()[0] or 0.0 for fe in absorb[:-1])
        if worst < tolerance:
            return df
    raise ArithmeticError(f"effects {absorb} did not converge in {rounds} rounds")


def ols(df: DataFrame, y: str, x: list[str], absorb: list[str] = (), cluster: str | None = None) -> Fit:
    """OLS of y on x with absorbed effects and standard errors clustered by `cluster` (heteroskedastic ones without).

    Rows with a null in any used column are dropped, then singletons. Collinear regressors get coefficient 0 (pseudo-inverse).
    Degrees of freedom: absorbed effects nested in the cluster are not counted; the others count their levels less one."""
    absorb = list(absorb)
    used = list(dict.fromkeys([y, *x, *absorb, *([cluster] if cluster else [])]))
    rows = df.select(*used).dropna()
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c in (y, *x) and c not in absorb and c != cluster else F.col(c) for c in used])
    names = list(x)
    if absorb:
        rows = demeaned(drop_singletons(rows, absorb), [y, *x], absorb)
    else:
        rows = rows.withColumn("_const", F.lit(1.0))
        names = [*x, "_const"]
    rows = rows.withColumn("_cl", F.col(cluster) if cluster else F.monotonically_increasing_id())
    rows = checkpointed(rows)
    k = len(names)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"c{i}") for i, a in enumerate(names)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = one["n"]
    if not n:
        return Fit(names, np.zeros(k), np.zeros((k, k)), 0, 0, rows)
    gram = np.array([[one[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inverse = np.linalg.pinv(gram, hermitian=True)
    beta = inverse @ np.array([one[f"c{i}"] for i in range(k)], dtype=float)
    fitted = sum((F.col(a) * float(b) for a, b in zip(names, beta)), F.lit(0.0))
    rows = rows.withColumn("_resid", F.col(y) - fitted)
    scores = rows.groupBy("_cl").agg(*[F.sum(F.col(a) * F.col("_resid")).alias(f"s{i}") for i, a in enumerate(names)])
    meat_row = scores.agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[meat_row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    clusters = meat_row["m"]
    lost = 0
    for fe in absorb:
        if fe == cluster:
            continue
        lost += max(0, rows.select(fe).distinct().count() - 1)
    free = max(1, n - k - lost - (1 if absorb else 0))
    scale = clusters / max(1, clusters - 1) * (n - 1) / free if cluster else n / free
    return Fit(names, beta, inverse @ meat @ inverse * scale, n, clusters, rows)


def event_study(df: DataFrame, y: str, unit: str, time: str, first: str, low: int = -6, high: int = 8, cluster: str | None = None, controls: list[str] = ()) -> Fit:
    """Two-way fixed effects on binned event-time dummies (lead<k>, tau<k>; one period before is the reference)."""
    from gridloom.operators.window import event_dummies

    wide = event_dummies(df, time, first, low, high)
    names = [c for c in wide.columns if c not in df.columns]
    return ols(wide, y, [*names, *controls], [unit, time], cluster or unit)


def imputation(df: DataFrame, y: str, unit: str, time: str, first: str, horizons: range = range(9)) -> DataFrame:
    """(horizon, estimate, n): effects by event time, as outcome minus the fixed effects fitted on untreated rows alone.

    Effects come from alternating means over the rows not yet treated; treated rows of a unit or time without such a row have
    no counterfactual and are left out."""
    data = df.select(unit, time, first, F.col(y).cast("double").alias(y)).where(F.col(y).isNotNull() & F.col(unit).isNotNull() & F.col(time).isNotNull())
    untreated = checkpointed(data.where(F.col(first).isNull() | (F.col(time) < F.col(first))).select(unit, time, y))
    a = untreated.select(unit).distinct().withColumn("_a", F.lit(0.0))
    b = untreated.select(time).distinct().withColumn("_b", F.lit(0.0))
    for _ in range(200):
        new_a = untreated.join(b, time).groupBy(unit).agg(F.avg(F.col(y) - F.col("_b")).alias("_a"))
        new_b = checkpointed(untreated.join(new_a, unit).groupBy(time).agg(F.avg(F.col(y) - F.col("_a")).alias("_b")))
        move = new_b.join(b.withColumnRenamed("_b", "_old"), time).agg(F.max(F.abs(F.col("_b") - F.col("_old")))).first()[0] or 0.0
        a, b = new_a, new_b
        if move < 1e-9:
            break
    else:
        raise ArithmeticError("the untreated effects did not converge in 200 rounds")
    treated = data.where(F.col(first).isNotNull() & (F.col(time) >= F.col(first))).withColumn("horizon", F.col(time) - F.col(first)).where(F.col("horizon").isin(*horizons))
    effect = treated.join(a, unit).join(b, time).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b"))
    return effect.groupBy("horizon").agg(F.avg("_e").alias("estimate"), F.count(F.lit(1)).alias("n"))


def group_time_att(df: DataFrame, y: str, unit: str, time: str, first: str) -> DataFrame:
    """(first, time, att, n_treated, n_control): outcome change since the period before treatment, less that of units not yet treated.

    Unconditional group-time effects; the controls of a (first, time) are never treated or treated after `time`."""
    data = df.select(unit, time, first, F.col(y).cast("double").alias("_y")).dropna(subset=[unit, time, "_y"])
    groups = data.where(F.col(first).isNotNull()).select(F.col(first).alias("_g")).distinct()
    base = data.select(unit, F.col(time).alias("_t0"), F.col("_y").alias("_y0"))
    # Cohorts are few (one per period): each row meets every cohort's base period by an equi-join on (unit, base period).
    pairs = data.crossJoin(F.broadcast(groups)).where((F.col(time) >= F.col("_g")) & (F.col(first).isNull() | (F.col(first) == F.col("_g")) | (F.col(first) > F.col(time)))).withColumn("_t0", F.col("_g") - 1)
    change = pairs.join(base, [unit, "_t0"]).withColumn("_d", F.col("_y") - F.col("_y0")).withColumn("_tr", F.coalesce(F.col(first) == F.col("_g"), F.lit(False)))
    out = change.groupBy(F.col("_g").alias(first), time).agg((F.avg(F.when(F.col("_tr"), F.col("_d"))) - F.avg(F.when(~F.col("_tr"), F.col("_d")))).alias("att"), F.count_if("_tr").alias("n_treated"), F.count_if(~F.col("_tr")).alias("n_control"))
    return out.where(F.col("att").isNotNull())


def average_effects(fit: Fit, spans: dict[str, list[str]]) -> list[tuple[str, float, float]]:
    """(name, estimate, se) of averages of coefficients, e.g. over the first 3, 5 or 9 periods after onset."""
    return [(name, *fit.lincom({t: 1 / len(terms) for t in terms})) for name, terms in spans.items() if terms]


def interacted(df: DataFrame, x: str, by: list[str]) -> tuple[DataFrame, list[str]]:
    """`df` with the products x_x_<b> of a regressor with continuous moderators, and their names."""
    names = {f"{x}_x_{b}": F.col(x).cast("double") * F.col(b) for b in by}
    return df.withColumns(names), list(names)


def distributed_lags(df: DataFrame, x: str, unit: list[str], time: str, leads: int = 5, lags: int = 5) -> tuple[DataFrame, list[str]]:
    """`df` with gap-aware leads f<k>_x and lags l<k>_x of a continuous treatment, and all terms' names in time order."""
    from gridloom.operators.window import time_lag

    cols = {f"f{k}_{x}": time_lag(unit, time, F.col(x), -k) for k in range(leads, 0, -1)} | {f"l{k}_{x}": time_lag(unit, time, F.col(x), k) for k in range(1, lags + 1)}
    names = [c for c in cols if c[0] == "f"] + [x] + [c for c in cols if c[0] == "l"]
    return df.withColumns(cols), names


def specifications(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """(spec, term, estimate, se, n): a family of regressions from a table of settings: {name: {y, x, absorb, cluster, where}}.

    One fit after another on the same (written) rows; `where` restricts the sample (an SQL condition)."""
    spark, out = df.sparkSession, []
    for name, s in specs.items():
        fit = ols(df.where(s["where"]) if s.get("where") else df, s["y"], s["x"], s.get("absorb", ()), s.get("cluster"))
        se = np.sqrt(np.maximum(0.0, np.diag(fit.cov)))
        out += [(name, t, float(b), float(e), fit.n) for t, b, e in zip(fit.names, fit.beta, se)]
    return spark.createDataFrame(out, "spec string, term string, estimate double, se double, n long")


def on_event_axis(names: list[str]) -> list[int | None]:
    """Event times of coefficients named by different estimators: lead6, tau8, L2.x, F3.x, pre2, horizon4, t_m6, t_p8; None for others."""
    forms = ((r"lead(\d+)|pre(\d+)|[Ff](\d+)[._].*|t_m(\d+)", -1), (r"tau(\d+)|horizon(\d+)|[Ll](\d+)[._].*|t_p(\d+)", 1))
    out: list[int | None] = []
    for n in names:
        hit = next(((sign, m) for pattern, sign in forms if (m := re.fullmatch(pattern, n))), None)
        out.append(hit[0] * int(next(g for g in hit[1].groups() if g)) if hit else None)
    return out


def switchers_did(df: DataFrame, y: str, unit: str, time: str, treated: str) -> DataFrame:
    """(time, did, n_switchers): the change of y of the units whose treatment begins at a time, less that of the units untreated before and then.

    Robust to effects that differ between units and times: only units that stay untreated serve as controls. Times without
    switchers or without such controls are left out. One row per (unit, time)."""
    w = W.partitionBy(unit).orderBy(time)
    rows = df.select(unit, time, F.col(y).cast("double").alias("_y"), F.col(treated).cast("int").alias("_d"))
    step = rows.withColumns({"_dy": F.col("_y") - F.lag("_y").over(w), "_before": F.lag("_d").over(w), "_gap": F.col(time) - F.lag(time).over(w)}).where("_gap = 1 and _before = 0 and _dy is not null")
    new, stay = F.col("_d") == 1, F.col("_d") == 0
    out = step.groupBy(time).agg((F.avg(F.when(new, F.col("_dy"))) - F.avg(F.when(stay, F.col("_dy")))).alias("did"), F.count_if(new).alias("n_switchers"))
    return out.where("did is not null")
