"""Cell-by-period panels: complete skeletons, conditional aggregation in one pass, zero filling, audit summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import log1p_all
from gridloom.operators.skew import maybe_broadcast
from gridloom.storage import checkpointed


@dataclass(frozen=True)
class PanelVariant:
    """What distinguishes one panel from another: cell size, periods and whether quarters are kept."""

    cell_m: float = 100_000
    first_year: int = 2005
    last_year: int = 2024
    quarterly: bool = False

    @property
    def keys(self) -> list[str]:
        return ["cell_id", "year", *["quarter"] * self.quarterly]


VARIANTS = {"annual_100km": PanelVariant(), "annual_50km": PanelVariant(cell_m=50_000), "quarterly_50km": PanelVariant(cell_m=50_000, quarterly=True)}


def skeleton(units: DataFrame, variant: PanelVariant) -> DataFrame:
    """Every unit in every period, made where the units are: no join."""
    out = units.withColumn("year", F.explode(F.sequence(F.lit(variant.first_year), F.lit(variant.last_year))))
    return out.withColumn("quarter", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)]))) if variant.quarterly else out


def zero_fill(skel: DataFrame, measures: DataFrame, keys: list[str], zero: list[str], keep_null: list[str] = ()) -> DataFrame:
    """The skeleton with the measures where there are any; `zero` columns become 0 elsewhere, `keep_null` stay null.

    Measures must be unique by key; rows outside the skeleton are dropped."""
    return skel.join(measures.select(*keys, *zero, *keep_null), keys, "left").na.fill(0, list(zero))


def conditional_counts(conditions: dict[str, Column]) -> list[Column]:
    """One count per condition, all in one pass; null conditions count as false."""
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]


def subset_sums(measures: dict[str, Column], subsets: dict[str, Column]) -> list[Column]:
    """<measure>_<subset> sums and n_<subset> counts in one pass, instead of one aggregation and outer join per subset."""
    out = []
    for s, cond in subsets.items():
        ok = F.coalesce(cond, F.lit(False))
        out += [F.count_if(ok).alias(f"n_{s}")]
        out += [F.coalesce(F.sum(F.when(ok, m)), F.lit(0)).alias(f"{name}_{s}") for name, m in measures.items()]
    return out


def first_appearance(df: DataFrame, item: str, period: str, where: list[str]) -> DataFrame:
    """(where..., period, n_new): distinct items in the period in which they appear anywhere for the first time.

    An item is credited to every place it appears in then. Blank and null items do not count. Two aggregations with map-side
    combination; no window over an item's rows, so a frequent item is no hot task."""
    rows = df.where(F.trim(F.col(item)) != "").select(item, period, *where).where(F.col(period).isNotNull()).distinct()
    first = rows.groupBy(item).agg(F.min(period).alias(period))
    return rows.join(first, [item, period], "left_semi").groupBy(*where, period).agg(F.count(F.lit(1)).alias("n_new"))


def cell_period_panel(records: DataFrame, land: DataFrame, variant: PanelVariant, counts: dict[str, Column], item: str | None = None) -> DataFrame:
    """The zero-filled outcome panel of `records` (cell_id, year[, quarter], ...) over the land cells.

    Records outside the land cells or periods are left out. With `item`, n_<item> distinct non-blank items and n_new_<item>
    items seen for the first time anywhere (over all records inside the land cells) are added; any_ and log1p_ of all follow."""
    keys = variant.keys
    inside = records.join(maybe_broadcast(land.select("cell_id").distinct()), "cell_id", "left_semi").where(F.col("year").between(variant.first_year, variant.last_year))
    aggs = conditional_counts(counts)
    if item:
        aggs.append(F.countDistinct(F.nullif(F.trim(F.col(item)), F.lit(""))).alias(f"n_{item}"))
    # Geocoding is done once: the measures and the first appearances read what it leaves.
    inside = checkpointed(inside) if item else inside
    measures = inside.groupBy(*keys).agg(*aggs)
    names = [*counts, *[f"n_{item}"] * bool(item)]
    if item:
        period = F.col("year") * 4 + F.col("quarter") if variant.quarterly else F.col("year")
        fresh = first_appearance(inside.withColumn("_period", period), item, "_period", ["cell_id"])
        year = F.floor((F.col("_period") - 1) / 4).cast("int") if variant.quarterly else F.col("_period")
        fresh = fresh.withColumn("year", year)
        if variant.quarterly:
            fresh = fresh.withColumn("quarter", (F.col("_period") - F.col("year") * 4).cast("int"))
        measures = measures.join(fresh.select(*keys, F.col("n_new").alias(f"n_new_{item}")), keys, "left").na.fill(0, [f"n_new_{item}"])
        names.append(f"n_new_{item}")
    return log1p_all(zero_fill(skeleton(land, variant), measures, keys, names), names)


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value): an audit summary from one aggregation, one row per metric."""
    one = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(metrics.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(metrics)])
    return one.select(F.inline(pairs))
