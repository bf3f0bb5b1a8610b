"""References to records that do not exist: keys that are missing, no longer hold, or did not yet hold.

Distinct non-null keys of the referring tables are anti-joined with the parents' keys (never there), and the rest
are held against the parents' validity in time; the verdicts are joined back to the rows. A hot key costs no more
than its distinct instants: both sides are reduced to (key, instant) before anything is sorted, and what is sorted
per key is cut into days whose carried state is one value each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import salted_join
from gridloom.storage import checkpointed, written

#: A parent with no end is valid until this instant.
FOREVER = "9999-12-31 00:00:00"


def accession_key(c: Column) -> Column:
    """Trimmed, upper case, without a ".digits" ending; blank becomes null."""
    v = F.regexp_replace(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\.[0-9]+$", "")
    return F.nullif(v, F.lit(""))


def dataset_key(c: Column) -> Column:
    """Trimmed, lower case, without braces or a "urn:uuid:" prefix; blank becomes null."""
    v = F.regexp_replace(F.lower(F.regexp_replace(c, r"[{}]", "")), r"^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(v, r"^urn:uuid:\s*", ""), F.lit(""))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` (ref_table, ref_id, key, at) whose key no row of `parents` (key, valid_from, valid_to) holds at `at`.

    A parent holds from valid_from on (null: always did) until before valid_to (null: no end). Returns each distinct
    (ref_table, ref_id, at) once with `reason`: "missing" (the key has no parent at all), "not_yet" (all its parents
    begin later) or "ended" (it had one, none holds now). Null keys are no references. A null `at` can only be
    "missing". Parents with a null key are ignored. Empty refs give no rows; empty parents make every reference missing.
    All times are timestamps.
    """
    # Written once: keys are normalised in one scan, and the join back reads what is left of the rows.
    refs, _ = written(refs.where(F.col("key").isNotNull()).select("ref_table", "ref_id", "key", "at"), "references")
    parents = parents.where(F.col("key").isNotNull())
    begin, forever = F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit(FOREVER).cast("timestamp")
    fks = checkpointed(refs.select("key", "at").distinct())
    # One state per (key, begin): at an instant t a key is held if and only if, among the parents that begin at or before t,
    # the latest end lies after t.
    starts = checkpointed(parents.groupBy("key", F.coalesce("valid_from", begin).alias("t")).agg(F.max(F.coalesce("valid_to", forever)).alias("until")))
    missing = fks.select("key").distinct().join(starts.select("key").distinct(), "key", "left_anti").withColumn("missing", F.lit(True))

    asked = fks.where(F.col("at").isNotNull()).select("key", F.col("at").alias("t"), F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("ask"))
    events = starts.select("key", "t", "until", F.lit(0).alias("ask")).unionByName(asked).withColumn("day", F.to_date("t"))
    days = starts.groupBy("key", F.to_date("t").alias("day")).agg(F.max("until").alias("until")).unionByName(asked.select("key", F.to_date("t").alias("day"), "until").distinct())
    carried = days.groupBy("key", "day").agg(F.max("until").alias("until")).select("key", "day", F.max("until").over(W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    within = events.withColumn("own", F.max("until").over(W.partitionBy("key", "day").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0)))
    held = within.where(F.col("ask") == 1).join(carried, ["key", "day"]).withColumn("best", F.greatest("own", "before"))
    dead = held.where(F.col("best").isNull() | (F.col("best") <= F.col("t"))).select("key", F.col("t").alias("at"), F.when(F.col("best").isNull(), "not_yet").otherwise("ended").alias("reason"))

    # Null-safe on the instant: a reference without a time can be missing too.
    no_time = fks.where(F.col("at").isNull()).select("key", "at", F.lit(None).cast("string").alias("reason"))
    verdicts = dead.unionByName(no_time).join(missing, "key", "left").select("key", F.coalesce("at", begin).alias("inst"), F.when(F.col("missing"), "missing").otherwise(F.col("reason")).alias("reason"))
    verdicts = checkpointed(verdicts.where(F.col("reason").isNotNull()))
    return salted_join(refs.withColumn("inst", F.coalesce("at", begin)), verdicts, ["key", "inst"]).select("ref_table", "ref_id", "at", "reason").distinct()


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and month (yyyy-MM of `at`): n_refs (distinct rows with a key), and the orphans among them by reason.

    Months without references are absent; a null `at` is reported under a null period."""
    period = F.date_format("at", "yyyy-MM")
    total = refs.where(F.col("key").isNotNull()).select("ref_table", "ref_id", "at").distinct().groupBy("ref_table", period.alias("ref_period")).agg(F.count(F.lit(1)).alias("n_refs"))
    found = orphans.groupBy("ref_table", period.alias("ref_period")).agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "not_yet", "ended")])
    joined = total.alias("t").join(found.alias("f"), F.col("t.ref_table").eqNullSafe(F.col("f.ref_table")) & F.col("t.ref_period").eqNullSafe(F.col("f.ref_period")), "left")
    return joined.select("t.ref_table", "t.ref_period", "n_refs", *[F.coalesce(f"n_{r}", F.lit(0)).alias(f"n_{r}") for r in ("missing", "not_yet", "ended")])
