"""Named pipelines composed of the operators: record cleaning, panels, linkage, universes, affiliations, merges.

Each takes DataFrames and gives a lazy plan; the columns it needs are named in its docstring, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo, numeric, text, time
from gridloom.operators import aggregate, joins, panel, window
from gridloom.operators.skew import maybe_broadcast

#: Raw record columns and their names in a minimal record; where several are given the first non-blank counts.
MINIMAL = {
    "processid": ["processid"], "record_id": ["record_id"], "kingdom": ["kingdom"], "phylum": ["phylum"], "class_name": ["class", "class_name"], "order": ["order", "order_name"], "family": ["family"], "genus": ["genus"], "species": ["species"],
    "country_ocean": ["country/ocean", "country_ocean"], "country_iso": ["country_iso", "geopol_denorm.country_iso3"], "province_state": ["province/state", "province_state"], "region": ["region"], "sector": ["sector"], "site": ["site"],
    "bin_uri": ["bin_uri"], "bin_created_date": ["bin_created_date"], "insdc_acs": ["insdc_acs"], "inst": ["inst"], "collection_code": ["collection_code"], "collectors": ["collectors"], "identified_by": ["identified_by"], "sequence_run_site": ["sequence_run_site"], "funding_src": ["funding_src"],
}


def build_minimal(raw: DataFrame) -> DataFrame:
    """Raw all-text records as minimal records: coordinates from the pair text `coord`, year and month from
    `collection_date_start`, upload year from `sequence_upload_date`; absent columns and nulls become ""."""
    col = lambda names: text.first_present(*[F.col(f"`{n}`") for n in names if n in raw.columns]) if any(n in raw.columns for n in names) else F.lit("")
    have = lambda n: F.col(n) if n in raw.columns else F.lit("")
    df = raw.withColumn("_n", F.regexp_extract_all(F.coalesce(have("coord"), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)))
    lat, lon = F.try_element_at("_n", F.lit(1)), F.try_element_at("_n", F.lit(2))
    ok = (F.size("_n") >= 2) & (F.abs(lat.try_cast("double")) <= 90) & (F.abs(lon.try_cast("double")) <= 180)
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.select(
        *[col(names).alias(new) for new, names in MINIMAL.items()],
        F.when(ok, lat).otherwise("").alias("latitude"),
        F.when(ok, lon).otherwise("").alias("longitude"),
        F.coalesce(ok, F.lit(False)).cast("int").cast("string").alias("has_coord"),
        some(time.year_of_text(have("collection_date_start"))).alias("collection_year"),
        some(time.month_of_text(have("collection_date_start"))).alias("collection_month"),
        some(time.year_of_text(have("sequence_upload_date"))).alias("sequence_upload_year"),
    )


def grid_counts(points: DataFrame, cell_m: float, by: list[str] = ()) -> DataFrame:
    """(cell_id, cell_x, cell_y, by..., n, centroid_lon, centroid_lat) of points (lon, lat, by...)."""
    x, y = geo.grid_xy(F.col("lon"), F.col("lat"), cell_m)
    n = points.select(x.alias("cell_x"), y.alias("cell_y"), *by).dropna(subset=["cell_x", "cell_y"]).groupBy("cell_x", "cell_y", *by).agg(F.count(F.lit(1)).alias("n"))
    lon, lat = geo.cell_centroid(F.col("cell_x"), F.col("cell_y"), cell_m)
    return n.select(F.concat_ws("_", "cell_x", "cell_y").alias("cell_id"), "cell_x", "cell_y", *by, "n", lon.alias("centroid_lon"), lat.alias("centroid_lat"))


def land_cells(spark, cell_m: float, countries: DataFrame | None = None, drop: list[str] = ()) -> DataFrame:
    """All cells of the grid with their centroids, overlaid with country polygons (name, rings) where given; cells in none are
    left out, `drop` names too. The grid is generated where it is used: no driver loop."""
    half_x, half_y = int(17_367_530 // cell_m) + 1, int(7_342_230 // cell_m) + 1
    cells = spark.range(-half_x, half_x).select(F.col("id").cast("int").alias("cell_x")).withColumn("cell_y", F.explode(F.sequence(F.lit(-half_y), F.lit(half_y - 1))))
    lon, lat = geo.cell_centroid(F.col("cell_x"), F.col("cell_y"), cell_m)
    cells = cells.select(F.concat_ws("_", "cell_x", "cell_y").alias("cell_id"), "cell_x", "cell_y", lon.alias("centroid_lon"), lat.alias("centroid_lat")).where(F.abs("centroid_lon") <= 180)
    if countries is None:
        return cells
    from gridloom.operators.spatial import points_in_polygons

    found = points_in_polygons(cells.withColumnsRenamed({"centroid_lon": "lon", "centroid_lat": "lat"}), countries, "cell_id", "name").groupBy("cell_id").agg(F.min("name").alias("country"))
    return cells.join(found, "cell_id").where(~F.col("country").isin(*drop) if drop else F.lit(True))


def event_panel(events: DataFrame, land: DataFrame, variant: panel.PanelVariant, subsets: dict[str, Column], sums: dict[str, Column], maxima: dict[str, Column] | None = None, means: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None) -> DataFrame:
    """Georeferenced events (lon, lat, year[, quarter], ...) by cell and period over the land cells.

    Counts and sums by subset, and distinct counts, are 0 where nothing happened; maxima are too; means stay null."""
    keys, maxima, means, distinct = variant.keys, maxima or {}, means or {}, distinct or {}
    rows = events.withColumn("cell_id", geo.cell_id(F.col("lon"), F.col("lat"), variant.cell_m)).where(F.col("year").between(variant.first_year, variant.last_year))
    rows = rows.join(maybe_broadcast(land.select("cell_id").distinct()), "cell_id", "left_semi")
    measures = rows.groupBy(*keys).agg(*panel.subset_sums(sums, subsets), *[F.max(c).alias(n) for n, c in maxima.items()], *[F.countDistinct(c).alias(n) for n, c in distinct.items()], *[F.avg(c).alias(n) for n, c in means.items()])
    zero = [c for c in measures.columns if c not in keys and c not in means]
    return panel.zero_fill(panel.skeleton(land, variant), measures, keys, zero, list(means))


def publication_exposure(links: DataFrame, cells: DataFrame, key: str, land: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(cell_id, year, source 'all', kingdom or 'all', n_publications): distinct publications by cell, year of publication and kingdom.

    links: (key, pub_id, year); cells: (key, cell_id, kingdom). Totals are distinct counts of their own; zero-filled wide
    forms come from `wide_publications`."""
    own = links.where(F.col("year").between(first_year, last_year)).select(key, "pub_id", "year").distinct()
    where = cells.join(maybe_broadcast(land.select("cell_id").distinct()), "cell_id", "left_semi").select(key, "cell_id", text.label_blank(F.col("kingdom"), "other_blank").alias("kingdom")).distinct()
    return aggregate.distinct_by_sets(own.join(where, key), ["cell_id", "year"], ["kingdom"], "pub_id", [["kingdom"], []], name="n_publications")


def wide_publications(long: DataFrame, land: DataFrame, variant: panel.PanelVariant, kingdoms: list[str]) -> DataFrame:
    """The zero-filled panel with n_<kingdom> columns (all included), any_ and log1p_ of each."""
    names = {f"n_{k.lower()}": {"kingdom": k} for k in kingdoms}
    wide = aggregate.wide_by_spec(long, variant.keys, names, "n_publications")
    return numeric.log1p_all(panel.zero_fill(panel.skeleton(land, variant), wide, variant.keys, list(names)), list(names))


def publication_yield(cohorts: DataFrame, events: DataFrame, key: str, windows: list[int], max_year: int | None = None) -> DataFrame:
    """(cell_id, year, kingdom or 'all', window, n_publications[, complete]): distinct publications within `window` years after a cohort year.

    cohorts: (key, cell_id, kingdom, year); events: (key, pub_id, pub_year). complete: the window lies before `max_year`."""
    pairs = joins.cohort_windows(cohorts.distinct(), events.distinct(), [key], "year", "pub_year", windows)
    out = aggregate.distinct_by_sets(pairs, ["cell_id", "year", "window"], ["kingdom"], "pub_id", [["kingdom"], []], name="n_publications")
    return out if max_year is None else out.withColumn("complete", (F.col("year") + F.col("window") <= max_year).cast("int"))


def species_compounds(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned species-compound pairs, and a summary by species, of (species_name, inchikey, kingdom, source).

    Pairs keep valid keys and display names; sources are joined into a sorted set. Summary: n_compounds, per-source counts by
    set membership, the first non-empty kingdom."""
    rows = pairs.select(text.display_species(F.col("species_name")).alias("species_name"), F.trim("inchikey").alias("inchikey"), text.clean(F.col("kingdom")).alias("kingdom"), F.lower(F.trim("source")).alias("source"))
    rows = rows.where((F.col("species_name") != "") & text.is_inchikey(F.col("inchikey")))
    clean = rows.groupBy("species_name", "inchikey").agg(aggregate.first_nonempty(F.col("kingdom"), F.struct("source", "kingdom")).alias("kingdom"), aggregate.distinct_list(F.col("source"), ",").alias("source_set"))
    clean = clean.withColumn("genus", text.genus_of(F.col("species_name")))
    summary = clean.groupBy("species_name", "genus").agg(F.count(F.lit(1)).alias("n_compounds"), F.countDistinct(F.when(F.array_contains(F.split("source_set", ","), "lotus"), F.col("inchikey"))).alias("n_lotus"), F.countDistinct(F.when(F.array_contains(F.split("source_set", ","), "coconut"), F.col("inchikey"))).alias("n_coconut"), aggregate.first_nonempty(F.col("kingdom"), F.struct("inchikey", "kingdom")).alias("kingdom"))
    return clean, summary


def resolve_names(names: DataFrame, taxa: DataFrame, max_hops: int = 10, fetched: DataFrame | None = None) -> DataFrame:
    """(name, resolved_name, taxon_id, method, kingdom): names (name, kingdom_hint) against a backbone (taxonid, canonicalname,
    acceptednameusageid, kingdom, taxonrank), synonyms led to their accepted names. Exact names first; a homonym is decided by the
    hint; then what a matching service once answered (`fetched`: name, taxonid, the cache of a run that asked it); a genus
    tells at least the kingdom. Every input name comes out once."""
    own = names.select("name", F.coalesce("kingdom_hint", F.lit("")).alias("kingdom_hint")).groupBy("name").agg(F.max("kingdom_hint").alias("kingdom_hint")).withColumn("key", text.key_form(F.col("name")))
    listed = taxa.where(F.trim("canonicalname") != "").select("taxonid", "canonicalname", text.key_form(F.col("canonicalname")).alias("key"), "kingdom")
    hits = own.join(listed, "key").select("name", "taxonid", "kingdom", "kingdom_hint")
    picked = joins.unique_target(hits, "name", "taxonid", "kingdom", "kingdom_hint").where("taxonid is not null")
    picked = picked.withColumn("method", F.lit("exact"))
    if fetched is not None:
        asked = fetched.groupBy("name").agg(F.min("taxonid").alias("taxonid"))
        rest = own.select("name").join(picked.select("name"), "name", "left_anti")
        picked = picked.unionByName(rest.join(asked, "name").withColumn("method", F.lit("fetched")))
    roots = joins.resolve_pointers(taxa, "taxonid", "acceptednameusageid", max_hops)
    accepted = taxa.select(F.col("taxonid").alias("root"), F.col("canonicalname").alias("resolved_name"), "kingdom")
    done = picked.join(roots, "taxonid").join(accepted, "root", "left").select("name", "resolved_name", F.col("root").alias("taxon_id"), "kingdom", "method")
    genus = taxa.where("taxonrank = 'genus' and trim(canonicalname) <> ''").groupBy(F.lower("canonicalname").alias("g")).agg(F.min("kingdom").alias("genus_kingdom"))
    out = own.join(done, "name", "left").join(genus, F.lower(text.genus_of(F.col("name"))) == F.col("g"), "left")
    method = F.when(F.col("taxon_id").isNotNull(), F.col("method")).otherwise("unresolved")
    return out.select("name", F.coalesce("resolved_name", F.lit("")).alias("resolved_name"), "taxon_id", method.alias("method"), F.coalesce(F.col("kingdom"), F.col("genus_kingdom"), F.nullif(F.col("kingdom_hint"), F.lit(""))).alias("kingdom"))


def species_universe(records: DataFrame, consensus: DataFrame) -> DataFrame:
    """(species, n_records, n_cells, first_year, last_year, from_bin): species of records (species, bin, cell_id, year), those without a
    name taking their bin's consensus (bin, species)."""
    c = consensus.select("bin", F.col("species").alias("_c"))
    rows = records.join(c, "bin", "left").withColumn("_own", F.nullif(F.col("species"), F.lit("")))
    rows = rows.withColumn("name", F.coalesce("_own", F.nullif(F.col("_c"), F.lit("")))).where("name is not null")
    return rows.groupBy(F.col("name").alias("species")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("cell_id").alias("n_cells"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("_own").isNull()).alias("from_bin"))


def top_collectors(records: DataFrame, n: int) -> DataFrame:
    """(rank, person, n_records, share, cum_share) of the n persons with most records (record_id, collectors)."""
    from pyspark.sql import Window as W

    people = records.select("record_id", F.explode(text.person_tokens(F.col("collectors"))).alias("person")).distinct().groupBy("person").agg(F.count(F.lit(1)).alias("n_records"))
    total = people.agg(F.sum("n_records").alias("t"))
    top = people.orderBy(F.desc("n_records"), "person").limit(n).crossJoin(F.broadcast(total))
    w = W.orderBy(F.desc("n_records"), "person")  # n rows
    return top.select(F.row_number().over(w).alias("rank"), "person", "n_records", (F.col("n_records") / F.col("t")).alias("share"), (F.sum("n_records").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.col("t")).alias("cum_share"))


def merge_classifications(a: DataFrame, b: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(number, a, b, final, status): two classifications (number, value) of the same items, reviewed decisions (number, value) first.

    status: reviewed, agree, only_a, only_b, conflict (final then null) or unknown."""
    both = joins.merge_1_1(a.select("number", F.nullif(F.trim("value"), F.lit("")).alias("a")), b.select("number", F.nullif(F.trim("value"), F.lit("")).alias("b")), ["number"]).drop("_merge")
    if decisions is not None:
        both = both.join(decisions.select("number", F.col("value").alias("d")), "number", "left")
    else:
        both = both.withColumn("d", F.lit(None).cast("string"))
    x, y, d = F.col("a"), F.col("b"), F.col("d")
    status = F.when(d.isNotNull(), "reviewed").when(x.isNull() & y.isNull(), "unknown").when(x.isNull(), "only_b").when(y.isNull(), "only_a").when(F.lower(x) == F.lower(y), "agree").otherwise("conflict")
    final = F.when(status == "conflict", None).otherwise(F.coalesce(d, x, y))
    return both.select("number", "a", "b", final.alias("final"), status.alias("status"))


def merge_all(base: DataFrame, parts: list[tuple[DataFrame, list[str]]], full: bool = False) -> DataFrame:
    """Many panels and attribute tables merged onto one by their keys, each checked to be unique; clashing columns keep the base's.

    full: keep rows that only a part has (as an outer merge does); else only the base's rows."""
    out = base
    for part, keys in parts:
        joins.assert_unique(part, keys, "part")
        fresh = [c for c in part.columns if c not in out.columns]
        out = out.join(part.select(*keys, *fresh), keys, "full" if full else "left")
    return out


def protected_panel(shares: DataFrame, land: DataFrame, variant: panel.PanelVariant, cell_area_km2: float) -> DataFrame:
    """(cell_id, year, protected_km2, new_km2, protected_share) of polygon areas by cell (cell_id, year, area_km2): overlaps add up and are
    capped; an unknown year counts from the first period, a later one than the last not at all."""
    skel = panel.skeleton(land.select("cell_id").distinct(), variant).withColumn("cap", F.lit(float(cell_area_km2)))
    added = shares.select("cell_id", F.coalesce("year", F.lit(variant.first_year)).alias("year"), "area_km2")
    out = window.step_stock(skel, added, "cell_id", "year", "area_km2", "cap")
    return out.select("cell_id", "year", F.col("stock").alias("protected_km2"), F.col("new").alias("new_km2"), (F.col("stock") / F.col("cap")).alias("protected_share"))


def yearly_counts(records: DataFrame, year: str, by: list[str] = ()) -> DataFrame:
    """(by..., year text, n): records by a year column as it is typed, blank years left out; blank `by` values are "Unknown"."""
    typed = text.clean(F.col(year))
    groups = [text.label_blank(text.clean(F.col(b)), "Unknown").alias(b) for b in by]
    return records.where(typed != "").groupBy(*groups, typed.alias(year)).agg(F.count(F.lit(1)).alias("n"))


def baseline_richness(records: DataFrame, land: DataFrame, first_year: int, last_year: int, items: dict[str, str]) -> DataFrame:
    """(cell_id, <name>, <name>_any, <name>_log1p, <name>_z ...): distinct non-blank items of a base period for every land cell.

    `items`: output name -> column. Cells without records get 0; z is over all land cells, population sd."""
    inside = records.where(F.col("year").between(first_year, last_year))
    counts = inside.groupBy("cell_id").agg(*[F.countDistinct(F.nullif(text.clean(F.col(c)), F.lit(""))).alias(n) for n, c in items.items()])
    out = land.select("cell_id").distinct().join(counts, "cell_id", "left").na.fill(0, list(items))
    for n in items:
        out = window.zscore(out.withColumns({f"{n}_any": (F.col(n) > 0).cast("int"), f"{n}_log1p": F.log1p(n)}), n, True, f"{n}_z")
    return out


def archive_universe(archives: dict[str, DataFrame]) -> DataFrame:
    """(species, <tag>_records, <tag>_present ..., first_year, last_year) of archives {tag: (species, year)}; blank species are left out."""
    rows = None
    for tag, df in archives.items():
        own = df.select("species", "year", F.lit(tag).alias("_tag")).where(F.coalesce(F.trim("species"), F.lit("")) != "")
        rows = own if rows is None else rows.unionByName(own)
    aggs = [a for tag in archives for a in (F.count_if(F.col("_tag") == tag).alias(f"{tag}_records"), F.max((F.col("_tag") == tag).cast("int")).alias(f"{tag}_present"))]
    return rows.groupBy("species").agg(*aggs, F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def stock_panel(units: DataFrame, flows: DataFrame, baseline: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(cell_id, year, baseline, loss, loss_share, cumulative_loss, cumulative_share, l1_loss, l2_loss): a yearly loss against a baseline stock.

    units: cell_id; flows: (cell_id, year, loss); baseline: (cell_id, baseline). Absent flows and baselines are 0; a share of no
    baseline is 0; lags are the year before's, null at the start."""
    skel = panel.skeleton(units, panel.PanelVariant(first_year=first_year, last_year=last_year))
    out = panel.zero_fill(skel, flows.groupBy("cell_id", "year").agg(F.sum("loss").alias("loss")), ["cell_id", "year"], ["loss"])
    out = out.join(baseline.select("cell_id", "baseline"), "cell_id", "left").na.fill(0, ["baseline"])
    share = lambda c: numeric.safe_ratio(F.col(c), F.col("baseline"))
    out = out.withColumn("loss_share", share("loss")).withColumn("cumulative_loss", window.cumulative(["cell_id"], "year", F.col("loss"))).withColumn("cumulative_share", share("cumulative_loss"))
    return out.withColumns({f"l{k}_loss": window.positional_lag(["cell_id"], "year", F.col("loss"), k) for k in (1, 2)})


def foreign_collecting(records: DataFrame, homes: DataFrame, regions: DataFrame) -> DataFrame:
    """By (cell_id, year): how records were collected, by collectors from the country itself, its region, or elsewhere.

    records: (record_id, cell_id, year, country, collectors); homes: (person, home), one row a person; regions: (country,
    region). A record is as distant as its most distant known collector; scores share it among its known collectors; it is
    a collaboration if collectors of the country and others meet. Distinct collectors are counted by kind."""
    own = records.select("record_id", "cell_id", "year", "country", text.person_tokens(F.col("collectors")).alias("_people"))
    people = own.select("record_id", "cell_id", "year", "country", F.explode(F.array_distinct("_people")).alias("person"))
    known = joins.lookup(people, homes, ["person"], {"home": F.lit(None).cast("string")}).where(F.col("home").isNotNull() & (F.col("country") != ""))
    region = regions.select(F.col("country").alias("_c"), F.col("region").alias("_r"))
    known = known.join(region.withColumnsRenamed({"_c": "country", "_r": "region"}), "country", "left").join(region.withColumnsRenamed({"_c": "home", "_r": "home_region"}), "home", "left")
    kind = F.when(F.col("home") == F.col("country"), "domestic").when(F.col("home_region") == F.col("region"), "regional").otherwise("distant")
    known = known.withColumn("kind", kind)
    share = lambda k: (F.count_if(F.col("kind") == k) / F.count(F.lit(1))).alias(f"{k}_score")
    has = lambda k: F.bool_or(F.col("kind") == k)
    each = known.groupBy("record_id", "cell_id", "year").agg(share("domestic"), share("regional"), share("distant"), F.when(has("distant"), "distant").when(has("regional"), "regional").otherwise("domestic").alias("class"), (has("domestic") & F.bool_or(F.col("kind") != "domestic")).alias("collab"))
    total = own.groupBy("cell_id", "year").agg(F.count(F.lit(1)).alias("records_total"), F.count_if(F.size("_people") > 0).alias("records_with_collectors"))
    classes = each.groupBy("cell_id", "year").agg(
        F.count(F.lit(1)).alias("records_classified"), *[F.count_if(F.col("class") == k).alias(f"records_{k}") for k in ("domestic", "regional", "distant")], F.count_if("collab").alias("records_collab"), *[F.round(F.sum(f"{k}_score"), 4).alias(f"{k}_score_sum") for k in ("domestic", "regional", "distant")]
    )
    names = known.groupBy("cell_id", "year").agg(*[F.countDistinct(F.when(c, F.col("person"))).alias(n) for n, c in (("n_collectors_domestic", F.col("kind") == "domestic"), ("n_collectors_foreign", F.col("kind") != "domestic"))])
    out = total.join(classes, ["cell_id", "year"], "left").join(names, ["cell_id", "year"], "left").na.fill(0)
    return out.withColumn("records_unclassified", F.col("records_with_collectors") - F.col("records_classified"))


def linked_potential(records: DataFrame, pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """By (cell_id, year): species with linked items, found by name first, then by resolved name, then by bin consensus.

    records: (cell_id, year, species, bin_species, kingdom), species as keys; pairs: (species, item, source), the links;
    resolved: (species, resolved). n_species, n_linked, n_items (distinct items of the linked species), n_linked by rule."""
    linked = pairs.select("species").distinct()
    flag = linked.withColumn("hit", F.col("species"))
    step = resolved.join(linked.withColumnRenamed("species", "resolved"), "resolved").groupBy("species").agg(F.min("resolved").alias("to"))
    rows = records.withColumn("species", F.when(F.col("species") != "", F.col("species")).otherwise(F.coalesce("bin_species", F.lit("")))).where("species <> ''")
    names = rows.select("species").distinct()
    found = joins.waterfall(names, [("name", flag, ["species"], "hit"), ("resolved", step, ["species"], "to")], "target", "rule")
    keyed = rows.select("cell_id", "year", "species").distinct().join(found, "species")
    counts = keyed.groupBy("cell_id", "year").agg(F.countDistinct("species").alias("n_species"), F.countDistinct("target").alias("n_linked"), *[F.countDistinct(F.when(F.col("rule") == r, F.col("target"))).alias(f"n_by_{r}") for r in ("name", "resolved")])
    items = keyed.where("target is not null").select("cell_id", "year", F.col("target").alias("species")).distinct().join(pairs.select("species", "item").distinct(), "species").groupBy("cell_id", "year").agg(F.countDistinct("item").alias("n_items"))
    return counts.join(items, ["cell_id", "year"], "left").na.fill(0, ["n_items"])


def resolution_report(resolved: DataFrame) -> DataFrame:
    """(method, n, with_kingdom): how many names each rung of `resolve_names` settled, and for how many a kingdom is known."""
    return resolved.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kingdom").isNotNull()).alias("with_kingdom"))
