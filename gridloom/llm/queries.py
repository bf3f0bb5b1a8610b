"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import canonical, leakage, mixing, names, residue, topn
from gridloom.operators.tree import text_or_null
from gridloom.session import load


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.name_pairs(names.same_names(load(spark, sf, "name_spellings")))


def p2_votes(spark: SparkSession, sf: str) -> DataFrame:
    """(bin_uri, species, votes): distinct records per bin and species, both normalised."""
    bin_uri, species = F.upper(text_or_null(F.col("bin_uri"))), F.lower(F.regexp_replace(text_or_null(F.col("species")), r"\s+", " "))
    rows = load(spark, sf, "bold_minimal_records").select(bin_uri.alias("bin_uri"), species.alias("species"), "record_id").dropna()
    # Distinct records first, spread by record; then counts, combined before they are sent: a hot bin is no task's burden.
    return rows.distinct().groupBy("bin_uri", "species").agg(F.count(F.lit(1)).alias("votes"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    listed = load(spark, sf, "bin_consensus_lookup").select("bin_uri", F.upper(text_or_null(F.col("bin_uri"))).alias("bin")).dropna().distinct()
    votes = p2_votes(spark, sf).withColumnRenamed("bin_uri", "bin").join(listed.select("bin").distinct(), "bin", "left_semi")
    best = topn.top_n_per_group(votes, "bin", "species", "votes", 3)
    # The best rows come from a Python stage over file names, which the planner takes for tiny: never broadcast them.
    return best.join(listed.hint("merge"), "bin").select("bin_uri", "rank_no", "species")


def _records_by_load(spark: SparkSession, sf: str) -> DataFrame:
    """(bin, record_id, loaded): the last load of every record, in microseconds, by normalised bin."""
    rows = load(spark, sf, "bold_minimal_records").select(F.upper(text_or_null(F.col("bin_uri"))).alias("bin"), "record_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded")).dropna()
    return rows.groupBy("bin", "record_id").agg(F.max("loaded").alias("loaded"))


def p2_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each bin's five records loaded last: groups of a tenth of all rows, most of whose row groups are skipped."""
    return topn.top_n_per_group(_records_by_load(spark, sf), "bin", "record_id", "loaded", 5)


def p2_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups read and skipped by p2_latest, by file."""
    return topn.row_groups_skipped(_records_by_load(spark, sf), "bin", "record_id", "loaded", 5)


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    taxa = load(spark, sf, "taxon")
    typed = load(spark, sf, "species_name_resolution").select("input_id", "species_normalized").where(F.regexp_replace("species_normalized", r"\s", "") != "")
    exact = taxa.select(F.lower("canonicalname").alias("species_normalized")).where(F.col("species_normalized").isNotNull()).distinct()
    open_rows = typed.join(exact, "species_normalized", "left_anti")
    species = taxa.where(F.lower(F.trim("taxonrank")) == "species").select("taxonid", "canonicalname")
    found = canonical.match_names(open_rows, "species_normalized", species, "taxonid", "canonicalname")
    return open_rows.join(found, "species_normalized", "left")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_matches(spark, sf).select("input_id", F.coalesce("taxonid", F.lit(-1)).cast("long").alias("taxonid")).distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The leaked pairs with the share of the item's words held and the weighted shingle similarity."""
    return leakage.leaks(load(spark, sf, "documents"), load(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).select("doc_id", "item_id")


#: A share of the corpus at which the limits of the small sources bind; and an entropy (nats) flatter than the corpus's own.
BUDGET, ENTROPY = 0.98, 1.8


def _mix(spark: SparkSession, sf: str, **how) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(load(spark, sf, "documents"), load(spark, sf, "mix_targets"), **how)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The copies drawn so that the targets are met."""
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_budget_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A budget at which the repetition limits bind: the exponent is bisected."""
    return _mix(spark, sf, budget=BUDGET)[1]


def p9_entropy_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus's own shares tempered to a target entropy."""
    return _mix(spark, sf, target_entropy=ENTROPY)[1]


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of each selection by source: counted from its rows, against the targets' table."""
    out = None
    for name, how in (("targets", {}), ("budget", {"budget": BUDGET}), ("entropy", {"target_entropy": ENTROPY})):
        selection, shares = _mix(spark, sf, **how)
        per_copy = selection.groupBy("source", "copy").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest"))
        drawn = per_copy.groupBy("source").agg(F.sum("t").alias("t"), F.max("copy").alias("copies"), F.min((F.col("n") == F.col("d")).cast("int")).alias("once"))
        every = per_copy.agg(F.sum("t").alias("every"), F.max("longest").alias("longest"))
        rows = shares.join(drawn, "source", "left").crossJoin(F.broadcast(every))  # one row
        flat = F.sum(F.when(F.col("weight") > 0, -F.col("weight") * F.log("weight")).otherwise(0.0)).over(W.partitionBy())
        # An exponent below 1 is the largest allowed only if some source is drawn to its limit.
        limit = F.col("max_repeats") * F.col("n_tokens")
        full = F.max((F.coalesce("t", F.lit(0)) >= 0.98 * limit - F.col("longest")) & (limit > 0)).over(W.partitionBy())
        checks = rows.select(
            F.lit(name).alias("mixture"),
            "source",
            (F.coalesce("t", F.lit(0)) <= F.col("max_repeats") * F.col("n_tokens")).alias("within_limit"),
            (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("copies_within_limit"),
            (F.coalesce("once", F.lit(1)) == 1).alias("once_a_copy"),
            (F.abs(F.coalesce("t", F.lit(0)) - F.col("weight") * F.col("every")) < 0.01 * F.col("every") + 2 * F.col("longest")).alias("meets_weight"),
            {"targets": F.abs(F.col("weight") - F.col("target_share")) < 0.03, "budget": F.col("exponent").between(0, 1) & ((F.col("exponent") == 1) | full), "entropy": F.abs(flat - ENTROPY) < 1e-6}[name].alias("meets_aim"),
        )
        out = checks if out is None else out.unionByName(checks)
    return out


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(load(spark, sf, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with residue by source and kind."""
    docs = load(spark, sf, "documents").select("doc_id", "source").distinct()
    return residue.residue(load(spark, sf, "documents")).join(docs, "doc_id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_votes": p2_votes, "p2_latest": p2_latest, "p2_skipped": p2_skipped, "p5_found": p5_found, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_budget_shares": p9_budget_shares, "p9_entropy_shares": p9_entropy_shares, "p9_checks": p9_checks, "p10_found": p10_found, "p10_kinds": p10_kinds}


_VOTES = r"""select upper(trim(bin_uri)) as bin_uri, lower(regexp_replace(trim(species), '\s+', ' ', 'g')) as species, count(distinct record_id) as votes
  from bold_minimal_records where trim(bin_uri) <> '' and trim(species) <> '' group by 1, 2"""


def _grams_sql(table: str, key: str) -> str:
    """Distinct runs of four words of a table's texts, markup left out."""
    words = r"regexp_extract_all(lower(regexp_replace(text, '</?[a-zA-Z!][^<>]*>|&[a-zA-Z]{2,8};|&#\d+;', ' ', 'g')), '[\p{L}\p{N}]+')"
    return f"""(select distinct {key}, w[i : i + 3] as g from (select {key}, w, unnest(range(1, len(w) - 2)) as i from (select distinct {key}, {words} as w from {table} where text is not null)))"""


#: A second definition of a leak, by brute force: a sixth of an item's distinct runs of four words. Where passages of three
#: tenths have few changed words and borrowed phrases are short, both give the same pairs.
_LEAKS = f"""with i as {_grams_sql('eval_items', 'item_id')}, d as {_grams_sql('documents', 'doc_id')}, n as (select item_id, count(*) as n from i group by 1)
  select doc_id, item_id from d join i using (g) join n using (item_id) group by doc_id, item_id, n having count(*) >= n / 6.0"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": _LEAKS,
        "p9_checks": """select m.mixture, t.source, true as within_limit, true as copies_within_limit, true as once_a_copy, true as meets_weight, true as meets_aim
  from mix_targets t, (values ('targets'), ('budget'), ('entropy')) m(mixture)""",
        "p2_latest": """with r as (select upper(trim(bin_uri)) as bin, record_id, max(epoch_us(loaded_at)) as loaded from bold_minimal_records
  where trim(bin_uri) <> '' and record_id is not null and loaded_at is not null group by 1, 2)
  select bin, cast(rank_no as int) as rank_no, record_id, loaded from (select *, row_number() over (partition by bin order by loaded desc, record_id) as rank_no from r) where rank_no <= 5""",
        "p2_votes": _VOTES,
        "p2_found": f"""with v as ({_VOTES}), r as (select *, row_number() over (partition by bin_uri order by votes desc, species) as rank_no from v)
  select l.bin_uri, cast(r.rank_no as int) as rank_no, r.species from r join (select distinct bin_uri from bin_consensus_lookup) l on upper(trim(l.bin_uri)) = r.bin_uri where r.rank_no <= 3""",
    }
