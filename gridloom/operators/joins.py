"""Merges with uniqueness checks, lookups, waterfalls, intervals, pointer chains, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import maybe_broadcast, salted_join
from gridloom.storage import checkpointed, written


class NotUniqueError(ValueError):
    """A side of a merge has several rows per key."""


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df`, after a check (a Spark job) that no key tuple repeats; nulls compare as equal."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if bad:
        raise NotUniqueError(f"{name} is not unique by {keys}: {[tuple(r)[:-1] for r in bad]}")
    return df


def _indicated(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    right = right.withColumnsRenamed({c: f"{c}_using" for c in clash})
    out = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, how)
    merge = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 3).when(F.col("_l").isNotNull(), 1).otherwise(2)
    return out.withColumn("_merge", merge).drop("_l", "_r")


def merge_1_1(left: DataFrame, right: DataFrame, keys: list[str], keep: tuple[int, ...] = (1, 2, 3), check: bool = True) -> DataFrame:
    """Full outer join with both sides unique by key and `_merge`: 1 left only, 2 right only, 3 both; `keep` selects.

    A column that clashes comes from the left, the other as <name>_using. Null keys match nothing."""
    if check:
        assert_unique(left, keys, "left side"), assert_unique(right, keys, "right side")
    return _kept(left, right, keys, keep)


def merge_m_1(left: DataFrame, right: DataFrame, keys: list[str], keep: tuple[int, ...] = (1, 2, 3), check: bool = True) -> DataFrame:
    """As merge_1_1, only the right side unique."""
    if check:
        assert_unique(right, keys, "right side")
    return _kept(left, right, keys, keep)


def _kept(left: DataFrame, right: DataFrame, keys: list[str], keep: tuple[int, ...]) -> DataFrame:
    how = {(1, 3): "left", (2, 3): "right", (3,): "inner"}.get(tuple(sorted(keep)), "full")
    out = _indicated(left, right, keys, how)
    return out if how != "full" or set(keep) == {1, 2, 3} else out.where(F.col("_merge").isin(*keep))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Left join with a table unique by key; a value column of `table` that found no match takes its default."""
    out = df.join(maybe_broadcast(table.select(*keys, *values)), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), default) for c, default in values.items()})


def waterfall(df: DataFrame, rules: list[tuple[str, DataFrame, list[str], str]], result: str, method: str) -> DataFrame:
    """Ordered lookups, the first success counts: rules are (method name, table unique by its keys, keys, value column).

    Adds `result` (null if no rule finds one) and `method` ("unresolved" then). Keys of a rule are columns of `df`."""
    out = df
    for i, (_, table, keys, value) in enumerate(rules):
        out = out.join(table.select(*keys, F.col(value).alias(f"_w{i}")), keys, "left")
    found = [F.col(f"_w{i}") for i in range(len(rules))]
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for c, (name, *_) in zip(found, rules)], F.lit("unresolved"))
    return out.withColumn(result, F.coalesce(*found)).withColumn(method, how).drop(*[f"_w{i}" for i in range(len(rules))])


def cohort_windows(cohorts: DataFrame, events: DataFrame, keys: list[str], start: str, at: str, windows: list[int]) -> DataFrame:
    """Pairs of a cohort and an event of the same key with 0 <= at - start <= w, once for every window w that holds it.

    An equi-join on the key, hot keys split, with the largest window as range condition; the windows are expanded after it."""
    pairs = salted_join(cohorts, events, keys).where((F.col(at) - F.col(start)).between(0, max(windows)))
    wide = F.filter(F.array(*[F.lit(w) for w in sorted(windows)]), lambda w: F.col(at) - F.col(start) <= w)
    return pairs.withColumn("window", F.explode(wide))


def cohort_counts(cohorts: DataFrame, events: DataFrame, key: str, start: str, at: str, windows: list[int], by: list[str], member: str) -> DataFrame:
    """(by..., start, window, n): distinct members of the events that `by` meets through any of its keys, with 0 <= at - start <= window.

    As a distinct count over cohort_windows (0 where only events without a member are met), but without its pairs, which grow as
    cohorts times events. Members of the same keys and times are one class with a weight. Classes of one key are disjoint over keys,
    so their weights are summed by (key, start) before any cohort is met; only classes of several keys go to the cohorts by themselves."""
    times = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(member, key).agg(F.sort_array(F.collect_set(at)).alias("_at"))
    # Events without a member are no member that joins keys: a class for each key.
    owners = times.groupBy(member, F.when(F.col(member).isNull(), F.col(key)).alias("_own")).agg(F.sort_array(F.collect_list(F.struct(key, "_at"))).alias("_links"))
    classes = owners.groupBy("_links").agg(F.count(member).alias("_n"), F.min(member).alias("_first"))
    links = classes.select("_n", F.when(F.size("_links") > 1, F.col("_first")).alias("_class"), F.inline("_links"))

    cohorts, _ = written(cohorts.select(key, *by, start).dropna(subset=[key, start]).distinct(), "cohorts")  # read for times, hot keys and the join
    met = links.join(cohorts.select(key, start).distinct().hint("merge"), key)
    lag = F.array_min(F.filter("_at", lambda t: t >= F.col(start))) - F.col(start)
    met = met.withColumn("_lag", lag).where(F.col("_lag") <= max(windows))
    names = {w: f"_n{w}" for w in sorted(windows)}
    counts = met.groupBy(key, start, "_class").agg(*[F.sum(F.when(F.col("_lag") <= w, F.col("_n"))).alias(n) for w, n in names.items()])

    # A class of several keys counts once for a cohort, however many of them it meets; what is summed already adds up.
    once = [F.when(F.col("_class").isNull(), F.sum(n)).otherwise(F.max(n)).alias(n) for n in names.values()]
    total = salted_join(cohorts, counts, [key, start]).groupBy(*by, start, "_class").agg(*once).groupBy(*by, start).agg(*[F.sum(n).alias(n) for n in names.values()])
    rows = F.inline(F.array(*[F.struct(F.lit(w).alias("window"), F.col(n).alias("n")) for w, n in names.items()]))
    return total.select(*by, start, rows).where("n is not null")


def resolve_pointers(df: DataFrame, node: str, parent: str, max_hops: int = 10) -> DataFrame:
    """(node, root, hops): follows parent pointers to a node without one; root is null for a cycle, a missing parent or a longer chain.

    By pointer doubling: after k rounds 2**k hops are known, so ceil(log2(max_hops)) + 1 joins suffice; each round is a
    written table. `df` is unique by node; a null parent, or a node that is its own parent, is a root."""
    nodes = df.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("p"))
    state = checkpointed(nodes.select("n", F.coalesce("p", F.col("n")).alias("at"), F.when(F.col("p").isNull(), 0).otherwise(1).alias("hops"), F.col("p").isNull().alias("done")))
    span = 1
    while span < max_hops + 1:
        nxt = state.select(F.col("n").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("done").alias("end"))
        step = state.join(nxt, "at", "left")
        moved = step.select("n", F.when(F.col("done"), F.col("at")).otherwise(F.col("to")).alias("at"), F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.col("more")).alias("hops"), (F.col("done") | F.coalesce("end", F.lit(False))).alias("done"))
        state = checkpointed(moved)
        span *= 2
    good = F.col("done") & (F.col("hops") <= max_hops) & F.col("at").isNotNull()
    return state.select(F.col("n").alias(node), F.when(good, F.col("at")).alias("root"), F.when(good, F.col("hops")).alias("hops"))


def unique_target(df: DataFrame, key: str, target: str, hint: str | None = None, own_hint: str | None = None) -> DataFrame:
    """(key, target): candidates of a key reduced to one: the only distinct target, else the only one whose `hint` equals the row's `own_hint`, else null."""
    agg = [F.countDistinct(target).alias("n"), F.min(target).alias("one")]
    if hint:
        same = F.when(F.col(hint) == F.col(own_hint), F.col(target))
        agg += [F.countDistinct(same).alias("n_same"), F.min(same).alias("one_same")]
    out = df.groupBy(key).agg(*agg)
    pick = F.when(F.col("n") == 1, F.col("one"))
    pick = pick.when(F.col("n_same") == 1, F.col("one_same")) if hint else pick
    return out.select(key, pick.alias(target))


def cooccurrence(df: DataFrame, unit: str, member: str) -> DataFrame:
    """(member, other, n): in how many units two different members meet, counted from both sides; repeated rows count once."""
    one = df.select(unit, member).dropna().distinct()
    other = one.withColumnRenamed(member, "other")
    return salted_join(one, other, [unit]).where(F.col(member) != F.col("other")).groupBy(member, "other").agg(F.count(F.lit(1)).alias("n"))


def neighbour_vote(pairs: DataFrame, labels: DataFrame, member: str, top: int = 20, share: float = 0.5) -> DataFrame:
    """(member, label, votes, share): the label that at least `share` of the votes of a member's `top` neighbours (by n, then name) have.

    pairs: (member, other, n); labels: (other, label) unique by other. Votes are weighted by n; ties take the smaller label."""
    w = W.partitionBy(member).orderBy(F.desc("n"), "other")
    near = pairs.join(labels.where(F.col("label").isNotNull()), "other").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    votes = near.groupBy(member, "label").agg(F.sum("n").alias("votes"))
    total = W.partitionBy(member)
    ranked = votes.withColumn("share", F.col("votes") / F.sum("votes").over(total)).withColumn("r", F.row_number().over(total.orderBy(F.desc("votes"), "label")))
    return ranked.where((F.col("r") == 1) & (F.col("share") >= share)).drop("r")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in the given order (which must be total for a defined result), all columns kept.

    An aggregation (max_by of a struct), so a hot key is combined map-side and no window sorts it."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def numbered_join(left: DataFrame, right: DataFrame, number: str) -> DataFrame:
    """Row i with row i, by an explicit number on both sides (never by physical position)."""
    return merge_1_1(left, right, [number], keep=(3,)).drop("_merge")
