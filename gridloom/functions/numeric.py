"""Numbers as columns: tolerant casts, safe ratios, clamps, missing values that count as largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column, kind: str = "double") -> Column:
    """A text as a finite number, null where it does not read as one (NaN and infinities included)."""
    x = F.trim(c).try_cast(kind)
    return F.when(finite(x), x) if kind == "double" else x


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, `default` where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(F.lit(low), c)
    return F.least(F.lit(high), c) if high is not None else c


def flag(cond: Column) -> Column:
    """1 or 0; null counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(100.0 * a / b, digits)


def gt_missing_high(c: Column, limit: float) -> Column:
    """c > limit where a missing value is larger than any number."""
    return c.isNull() | (c > limit)


def lt_missing_high(c: Column, limit: float) -> Column:
    return c.isNotNull() & (c < limit)


def density_per_10000_km2(n: Column, area_km2: Column) -> Column:
    return safe_ratio(n * 10_000.0, area_km2, None)


def log1p_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """any_<c> (0/1) and log1p_<c> for every listed column; null counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.withColumns({f"any_{c}": (zero(c) > 0).cast("int") for c in columns} | {f"log1p_{c}": F.log1p(zero(c).cast("double")) for c in columns})


#: How many of the second unit one of the first is.
UNITS = {("m", "km"): 1e-3, ("m2", "km2"): 1e-6, ("ha", "km2"): 1e-2, ("percent", "share"): 1e-2}


def scaled(c: Column, unit: str, to: str) -> Column:
    """A measure in another unit."""
    return c * F.lit(UNITS[unit, to]) if (unit, to) in UNITS else c / F.lit(UNITS[to, unit])


def products(columns: dict[str, Column]) -> dict[str, Column]:
    """Squares <name>_sq and products <a>_x_<b> of every pair, for interactions."""
    names = list(columns)
    out = {f"{n}_sq": columns[n] * columns[n] for n in names}
    return out | {f"{a}_x_{b}": columns[a] * columns[b] for i, a in enumerate(names) for b in names[i + 1 :]}
