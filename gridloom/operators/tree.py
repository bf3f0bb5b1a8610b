"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

Rows are cut into chunks of a fixed expected size by a hash that ignores the key, each chunk combines its own rows
per key, and the states are merged in rounds of a fixed fan-in until one is left per key. No task ever receives all
rows, or all partial states, of a key: a hot key's rows are spread over all chunks and its states over a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 250_000
FAN_IN = 16


def tree_merge(states: DataFrame, keys: list[str], sums: list[str], n_chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge additive states (keys..., chunk, sums...) to one row per key in ceil(log_fan_in(n_chunks)) rounds."""
    while n_chunks > 1:
        n_chunks = math.ceil(n_chunks / fan_in)
        # In the last round there is one chunk: grouping by the keys alone.
        chunk = [F.floor(F.col("chunk") / fan_in).cast("int").alias("chunk")] if n_chunks > 1 else []
        states = states.groupBy(*keys, *chunk).agg(*[F.sum(s).alias(s) for s in sums])
    return states.drop("chunk")


def chunk_count(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> int:
    return max(1, math.ceil(df.count() / chunk_rows))


def key_profiles(df: DataFrame, keys: list[str], row_id: str, distinct_of: list[str] = (), chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, n_rows: int | None = None) -> DataFrame:
    """Per key: n_records (distinct non-null `row_id`) and, for each column c of `distinct_of`, n_<c> (distinct non-null c).

    Exact. A key column may be null (it is then a key of its own); a null row_id counts no record, but its other values
    count. Repeated rows count once. An empty input gives no rows. Columns not named are not read, whatever their names.

    A chunk is a hash range of the row id, so the records of different chunks are different and their counts add up;
    a distinct value is carried as a state (key, column, value) and counted once its states are merged. `n_rows`: about how
    many rows `df` has, where that is known from files' footers; else they are counted.
    """
    df = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(row_id).alias("_id"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(distinct_of)])
    ks = [f"_k{i}" for i in range(len(keys))]
    n_chunks = chunk_count(df, chunk_rows) if n_rows is None else max(1, math.ceil(n_rows / chunk_rows))
    chunk = F.pmod(F.xxhash64("_id"), F.lit(n_chunks)).cast("int").alias("chunk")
    records = df.groupBy(*ks, chunk, "_id").agg(F.lit(1).alias("n")) if not distinct_of else df.groupBy(*ks, chunk, "_id", *[f"_v{i}" for i in range(len(distinct_of))]).agg(F.lit(1).alias("n"))
    if not distinct_of:
        leaves = records.groupBy(*ks, "chunk").agg(F.count("_id").alias("n_records"))
        merged = tree_merge(leaves, ks, ["n_records"], n_chunks, fan_in)
        if n_chunks == 1:
            merged = merged.groupBy(*ks).agg(F.sum("n_records").alias("n_records"))
    else:
        # attr -1: the record itself; attr i: the i-th distinct column.
        attrs = F.array(F.struct(F.lit(-1).alias("attr"), F.col("_id").cast("string").alias("value")), *[F.struct(F.lit(i).alias("attr"), F.col(f"_v{i}").cast("string").alias("value")) for i in range(len(distinct_of))])
        each = records.select(*ks, "chunk", F.inline(attrs)).where(F.col("value").isNotNull())
        # Records are distinct within their chunk and never meet another chunk's: counted at the leaf, not carried.
        leaves = each.where(F.col("attr") == -1).distinct().groupBy(*ks, "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("attr", F.lit(-1)).withColumn("value", F.lit(None).cast("string"))
        values = each.where(F.col("attr") >= 0).groupBy(*ks, "attr", "value", "chunk").agg(F.lit(1).cast("long").alias("n"))
        both = leaves.select(*ks, "attr", "value", "chunk", "n").unionByName(values.select(*ks, "attr", "value", "chunk", "n"))
        merged = tree_merge(both, [*ks, "attr", "value"], ["n"], n_chunks, fan_in)
        merged = merged.groupBy(*ks).agg(
            F.coalesce(F.sum(F.when(F.col("attr") == -1, F.col("n"))), F.lit(0)).alias("n_records"),
            *[F.count_if(F.col("attr") == i).alias(f"n_{c}") for i, c in enumerate(distinct_of)],
        )
    return merged.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], F.col("n_records").cast("long").alias("n_records"), *[f"n_{c}" for c in distinct_of])


def heavy_keys(profiles: DataFrame, kind: str, total: DataFrame, share: float) -> DataFrame:
    """The profiles with at least `share` of their kind's `n_total` (total: one row per kind, bounded by the kinds)."""
    return profiles.join(F.broadcast(total), kind).where(F.col("n_records") >= F.lit(share) * F.col("n_total"))


def text_or_null(c: Column) -> Column:
    """Trimmed (any white space); blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
