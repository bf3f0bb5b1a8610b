"""Hot keys: finding them, joining around them, and broadcasting only what is proven small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most so many rows and bytes (checked by a count that stops there).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if `df` has at most `max_rows` rows, and `max_bytes` bytes written out as text; reads no further than the rows."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    size = F.octet_length(F.to_json(F.struct(*plain.columns)))
    one = plain.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return one["n"] <= max_rows and (one["bytes"] or 0) <= max_bytes


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint where its rows and bytes are proven few, else one for a merge join.

    Without the latter the planner could still broadcast it on an estimate, which Python stages and exploded rows fool."""
    return F.broadcast(df) if small(df, max_rows) else df.hint("merge")


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """The key tuples holding at least `share` of all rows, with their counts `n_rows` and a split count.

    There are at most 1/share of them whatever the input, so the result may be broadcast.
    Null keys count as keys. An empty input gives no rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("n_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row: the grand total
        .where(F.col("n_rows") >= F.lit(share) * F.col("n_total"))
        .withColumn("n_split", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(share) / F.col("n_total"))).cast("int"))
        .drop("n_total")
    )


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.01, salt_by: Column | None = None) -> DataFrame:
    """Equi-join whose hot left keys are spread over several tasks.

    Keys with at least `share` of the left rows are split by a hash of `salt_by` (default: all left columns)
    and the right rows of exactly these keys are repeated once per split; all other rows join as usual.
    `how`: inner, left, left_semi or left_anti. Row order is not kept; null keys never match.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support how={how!r}")
    hot = F.broadcast(hot_keys(left.select(*keys).dropna(), keys, share).select(*keys, "n_split"))
    by = salt_by if salt_by is not None else F.xxhash64(*left.columns)
    lhs = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("n_split") > 1, F.pmod(by, F.col("n_split"))).otherwise(F.lit(0)).cast("int")).drop("n_split")
    rhs = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_split"), F.lit(1)) - 1)))
        .drop("n_split")
    )
    # A merge join whatever the planner estimates: either side may be far larger than its source.
    return lhs.join(rhs.hint("merge"), [*keys, "_salt"], how).drop("_salt")
