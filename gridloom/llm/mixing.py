"""Mixing sources to target weights, in tokens.

Sources' token shares are exponentiated: with q the natural shares and p the targets, the mixture of exponent t is
q**(1-t) * p**t, normalised (t = 1 meets the targets, t = 0 takes the corpus as it is); without targets it is q**t.
The exponent is bisected to the largest (or the one of a target entropy) at which no source must repeat more often
than it may. The weights are realised as budgets: each source's documents are permuted by a keyed hash, whole epochs
are taken as often as the budget holds, and a last partial epoch takes a prefix of the next permutation.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents of a hash bucket of a source's permutation, about, and the most buckets (as powers of two): a budget's end
#: falls into one bucket, which alone is sorted.
BUCKET_ROWS, MOST_BITS = 100_000, 16


def bucket_bits(rows: int) -> int:
    return min(MOST_BITS, max(4, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))


def default_tokenizer_path() -> str:
    """The vocabulary of the default tokenizer, from the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(keep..., n_tokens long): tokens of each row's whole text; null and empty texts have none."""
    path = tokenizer_path or default_tokenizer_path()
    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in keep) + ", n_tokens long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = b[keep].copy()
            out["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["_text"]]
            yield out

    return d.mapInPandas(count, schema)


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(tokens: dict[str, int], targets: dict[str, float] | None, t: float) -> dict[str, float]:
    """Normalised weights of the sources that have tokens, at exponent t."""
    total = sum(tokens.values())
    raw = {}
    for s, n in tokens.items():
        if n <= 0 or targets is not None and targets.get(s, 0.0) <= 0:
            continue
        q = n / total
        raw[s] = q**t if targets is None else q ** (1 - t) * targets[s] ** t
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()} if norm else {}


def repeats_allow(weights: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], budget: float) -> bool:
    return all(w * budget <= repeats.get(s, 1) * tokens[s] * (1 + 1e-9) for s, w in weights.items())


def largest_budget(weights: dict[str, float], tokens: dict[str, int], repeats: dict[str, int]) -> int:
    """The most tokens that can be drawn at these weights within the repetition limits."""
    return math.floor(min((repeats.get(s, 1) * tokens[s] / w for s, w in weights.items()), default=0))


def mixture(tokens: dict[str, int], targets: dict[str, float] | None, repeats: dict[str, int], budget: int | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], float, int]:
    """(weights, exponent, budget in tokens).

    With targets and no budget the exponent is 1 and the budget the largest the limits allow: the targets are met. With
    a budget the exponent is the largest in [0, 1] within the limits (0 where none is; the budget then shrinks). With a
    target entropy (no targets) it is the one that gives it, lowered further where the limits ask for it.
    """
    if not any(n > 0 for n in tokens.values()):
        return {}, 1.0, 0
    low, high = 0.0, 1.0
    if targets is None and target_entropy is not None:
        # Smaller exponents are flatter: entropy falls as t grows.
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(tempered(tokens, None, mid)) > target_entropy else (low, mid)
        start = (low + high) / 2
    else:
        start = 1.0
    weights = tempered(tokens, targets, start)
    if budget is None:
        return weights, start, largest_budget(weights, tokens, repeats)
    if repeats_allow(weights, tokens, repeats, budget):
        return weights, start, budget
    # Towards the corpus's own shares (t = 0 with targets, t = 1 without) sources repeat less.
    low, high = (0.0, start) if targets is not None else (start, 1.0)
    for _ in range(60):
        mid = (low + high) / 2
        ok = repeats_allow(tempered(tokens, targets, mid), tokens, repeats, budget)
        if targets is not None:
            low, high = (mid, high) if ok else (low, mid)
        else:
            low, high = (low, mid) if ok else (mid, high)
    t = low if targets is not None else high
    weights = tempered(tokens, targets, t)
    return weights, t, min(budget, largest_budget(weights, tokens, repeats))


def draw(counted: DataFrame, weights: dict[str, float], budget: int, doc_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, source, copy int, place long, n_tokens): the documents drawn, one row per copy.

    `counted`: one row per document (doc_id, source, n_tokens). A source of T tokens and budget B gives floor(B / T)
    whole copies and, of one more permutation, the longest prefix that stays within the rest, so that its tokens fall
    short of B by less than one document. `place` orders each copy's permutation, which is another for every copy; rows
    in the order (copy, place) are the source's stream. Sources without weight and documents without tokens give nothing.
    """
    spark = counted.sparkSession
    rows = counted.select(F.col(doc_id).alias("_doc"), F.col(source).alias("_source"), "n_tokens").where(F.col("n_tokens") > 0)
    budgets = F.broadcast(spark.createDataFrame([(s, int(w * budget)) for s, w in weights.items()], "_source string, budget long"))  # one row per target
    totals = rows.groupBy("_source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n_docs")).join(budgets, "_source").withColumn("epochs", F.floor(F.col("budget") / F.col("total"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("total"))
    known = totals.collect()  # one row per target
    bits = bucket_bits(max((r.n_docs for r in known), default=0))
    held = F.broadcast(spark.createDataFrame([(r._source, r.epochs, r.rest) for r in known], "_source string, epochs long, rest long"))
    keyed = rows.join(held, "_source")
    place = lambda copy: F.xxhash64(F.lit(seed), copy.cast("int"), F.col("_doc"))  # noqa: E731  a permutation per copy
    bucketed = keyed.where(F.col("rest") > 0).withColumn("copy", (F.col("epochs") + 1).cast("int")).withColumn("place", place(F.col("copy")))
    bucketed = bucketed.withColumn("bucket", F.shiftright("place", 64 - bits).cast("int"))
    sums = bucketed.groupBy("_source", "bucket").agg(F.sum("n_tokens").alias("n"))  # at most 2**bits rows per target
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("_source").orderBy("bucket")) - F.col("n")).select("_source", "bucket", "before", "n")
    placed = bucketed.join(F.broadcast(before), ["_source", "bucket"])
    inside = placed.where(F.col("before") + F.col("n") <= F.col("rest"))
    edge = placed.where((F.col("before") + F.col("n") > F.col("rest")) & (F.col("before") < F.col("rest")))
    run = F.sum("n_tokens").over(W.partitionBy("_source", "bucket").orderBy("place", "_doc").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("run", F.col("before") + run).where(F.col("run") <= F.col("rest")).drop("run")
    columns = ["_doc", "_source", "copy", "place", "n_tokens"]
    whole = keyed.where(F.col("epochs") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))).withColumn("place", place(F.col("copy")))
    return whole.select(columns).unionByName(inside.select(columns)).unionByName(edge.select(columns)).select(F.col("_doc").alias(doc_id), F.col("_source").alias(source), "copy", "place", "n_tokens")


def counted_once(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written: tokens are counted where the texts lie, and only the counts are shuffled.

    Of rows with one doc_id the one of the first source, then of the fewest tokens, counts.
    """
    from gridloom.storage import written

    each = token_counts(docs.select("doc_id", "source", "text").where(F.col("doc_id").isNotNull()), ["doc_id", "source"], tokenizer_path=tokenizer_path)
    one = each.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("m"))
    return written(one.select("doc_id", "m.source", "m.n_tokens"), "tokens")[0]


def mix(docs: DataFrame, targets: DataFrame, budget: int | float | None = None, target_entropy: float | None = None, tokenizer_path: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of `docs` (doc_id, source, text) for `targets` (source, target_share, max_repeats).

    `budget`: tokens to draw; a float is a multiple of the tokens the targets' sources have; None draws as much as the
    limits allow at the weights. Without `target_entropy` (in nats) the weights go from the targets (exponent 1) towards
    the corpus's own shares (0) as far as the limits ask; with it the target shares are left aside and the corpus's own are
    tempered to that entropy.

    selection: doc_id, source, copy (1, 2, ...), place, n_tokens. shares: one row per target: source, target_share,
    max_repeats, n_tokens in the corpus, drawn_tokens, weight (what was aimed at), actual_share of all drawn (0 for a source
    without documents; its share falls to the others), repeats (drawn over corpus), exponent. Rows repeated with one doc_id
    are one document. Documents of no target, of a null source, without id, and without a token are not drawn. Targets
    are a configuration: one row per source, with at most some thousands of sources; null shares count as 0, null
    repeats as 1.
    """
    spark = docs.sparkSession
    counted = counted_once(docs, tokenizer_path)
    goal = {r.source: (r.target_share or 0.0, r.max_repeats or 1) for r in targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).collect()}
    per_source = counted.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    tokens = {r.source: r.n for r in per_source.collect()}  # one row per target
    shares = {s: p for s, (p, _) in goal.items() if p > 0 and tokens.get(s, 0) > 0}
    have = {s: tokens[s] for s in shares}
    wanted = int(budget * sum(have.values())) if isinstance(budget, float) else budget
    weights, exponent, total = mixture(have, None if target_entropy is not None else shares, {s: k for s, (_, k) in goal.items()}, wanted, target_entropy)
    selection = draw(counted, weights, total, seed=seed)
    drawn = selection.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"))
    rows = [(s, p, k, tokens.get(s, 0) or 0, weights.get(s, 0.0), exponent) for s, (p, k) in goal.items()]
    table = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_tokens long, weight double, exponent double").join(drawn, "source", "left").na.fill(0, ["drawn_tokens"])
    every = F.sum("drawn_tokens").over(W.partitionBy())
    actual = F.when(every > 0, F.col("drawn_tokens") / every).otherwise(F.lit(0.0))
    repeats = F.when(F.col("n_tokens") > 0, F.col("drawn_tokens") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return selection, table.select("source", "target_share", "max_repeats", "n_tokens", "drawn_tokens", "weight", actual.alias("actual_share"), repeats.alias("repeats"), "exponent")
