import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import nested, numeric, text
from gridloom.operators import aggregate, estimate, joins, panel, spatial, window
from gridloom.plans import composites, registry
from gridloom.plans.common import located
from gridloom.session import load


def test_panel_invariants(spark, sf):
    land = load(spark, sf, "bold_grid100_land_cells").select("cell_id").distinct()
    p = registry.queries()["c_08_cell_year_panel"](spark, sf)
    n = land.count()
    assert p.count() == n * 15 == p.select("cell_id", "year").distinct().count()
    inside = located(spark, sf).where("year between 2010 and 2024")
    assert p.agg(F.sum("total_records")).first()[0] == inside.count()
    assert p.where("n_new_bin > n_bin or any_n_bin <> cast(n_bin > 0 as int) or abs(log1p_total_records - ln(1 + total_records)) > 1e-12").count() == 0
    assert p.agg(F.sum("n_new_bin")).first()[0] >= inside.where("bin <> ''").select("bin").distinct().count()


def test_windows_nest(spark, sf):
    y = registry.queries()["c_19_publication_yield"](spark, sf).where("kingdom = 'all'")
    wide = y.groupBy("cell_id", "year").pivot("window", [3, 5, 10]).agg(F.max("n_publications")).na.fill(0)
    assert wide.where("`3` > `5` or `5` > `10`").count() == 0


def test_merges_check_uniqueness(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    m = {r.k: (r.v, r.v_using, r._merge) for r in joins.merge_1_1(a, b, ["k"]).collect()}
    assert m == {1: ("x", None, 1), 2: ("y", "z", 3), 3: (None, "w", 2)}
    with pytest.raises(joins.NotUniqueError):
        joins.merge_m_1(a, b.union(b), ["k"])
    assert joins.merge_m_1(a.union(a), b, ["k"], keep=(3,)).count() == 2


def test_pointer_chains(spark):
    chain = [(i, i + 1) for i in range(1, 12)] + [(12, None)]
    rows = chain + [(20, 21), (21, 20), (30, 30), (40, 99)]
    got = {r.n: (r.root, r.hops) for r in joins.resolve_pointers(spark.createDataFrame(rows, "n int, p int"), "n", "p").collect()}
    assert got[2] == (12, 10) and got[1] == (None, None)  # eleven hops are too many
    assert got[12] == (12, 0) and got[30] == (30, 0)
    assert got[20] == got[21] == got[40] == (None, None)


def test_gap_aware_lags(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 4, 40)], "u string, t int, x int")
    got = {r.t: (r.l, r.p, r.f) for r in df.select("t", window.time_lag(["u"], "t", F.col("x")).alias("l"), window.positional_lag(["u"], "t", F.col("x")).alias("p"), window.time_lag(["u"], "t", F.col("x"), -2).alias("f")).collect()}
    assert got == {1: (None, None, None), 2: (10, 10, 40), 4: (None, 20, None)}


def test_text_functions(spark):
    one = spark.createDataFrame([("Mycale (Carmia) microsigmatosa", " AB123456.1|ab123456; xx", "https://doi.org/10.1000/ABC.", "A & B; Cy Dow and Eva", "Übér-Name  x")], "s string, a string, d string, c string, u string")
    r = one.select(text.display_species(F.col("s")), text.accession_tokens(F.col("a")), text.doi(F.col("d")), text.person_tokens(F.col("c")), text.slug(F.col("u")), text.first_present(F.lit(None).cast("string"), F.lit(" "), F.col("u"))).first()
    assert r[0] == "Mycale microsigmatosa" and r[1] == ["AB123456"] and r[2] == "10.1000/abc" and r[3] == ["Cy Dow", "Eva"] and r[4] == "b_r_name_x" and r[5] == "Übér-Name  x"
    assert text.snake_case("SpeciesName 2") == "species_name_2"
    n = one.select(numeric.number(F.lit("NaN")), numeric.number(F.lit(" 1.5 ")), numeric.safe_ratio(F.lit(1), F.lit(0)), nested.first_identifier(F.array(F.struct(F.lit("DOI").alias("type"), F.lit("x").alias("value"))), "doi")).first()
    assert tuple(n) == (None, 1.5, 0.0, "x")


def test_plurality_and_lists(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", " ", 3), ("g", None, 4), ("h", "c", 5), ("h", "c", 6), ("h", "d", 7)], "g string, v string, p int")
    got = {r.g: (r.v, r.votes, r.total, r.is_strict) for r in aggregate.plurality(df, ["g"], "v").collect()}
    assert got == {"g": ("a", 1, 2, 0), "h": ("c", 2, 3, 0)}
    assert [r.examples for r in aggregate.examples(df.where("g = 'h'"), ["g"], "v", "p").collect()] == [["c", "d"]]


def test_minimal_records(spark):
    raw = spark.createDataFrame([("p1", "r1", "(-12.5, 3)", "2010-13-01", "NA", None), ("p2", "r2", "(91, 3)", "2010-05", " ", "b"), ("p3", "r3", None, "210", "X", "c")], "processid string, record_id string, coord string, collection_date_start string, country_iso string, `country/ocean` string")
    got = {r.record_id: (r.latitude, r.longitude, r.has_coord, r.collection_year, r.collection_month, r.country_iso, r.country_ocean, r.genus) for r in composites.build_minimal(raw).collect()}
    assert got == {"r1": ("-12.5", "3", "1", "2010", "", "NA", "", ""), "r2": ("", "", "0", "2010", "5", "", "b", ""), "r3": ("", "", "0", "", "", "X", "c", "")}


def test_species_compounds(spark):
    rows = [("Aa bb", "ABCDEFGHIJKLMN-ABCDEFGHIJ-N", "", "LOTUS"), ("Aa  bb", "ABCDEFGHIJKLMN-ABCDEFGHIJ-N", "Plantae", "coconut"), ("aa bb", "ABCDEFGHIJKLMN-ABCDEFGHIJ-N", "x", "lotus"), ("Cc dd", "bad", "x", "lotus")]
    pairs, summary = composites.species_compounds(spark.createDataFrame(rows, "species_name string, inchikey string, kingdom string, source string"))
    assert [tuple(r) for r in pairs.select("species_name", "source_set", "kingdom").collect()] == [("Aa bb", "coconut,lotus", "Plantae")]
    assert [tuple(r) for r in summary.select("n_compounds", "n_lotus", "n_coconut").collect()] == [(1, 1, 1)]


def _twfe(rows, y, xs, a, b):
    """OLS with explicit dummies."""
    ua, ub = sorted({r[a] for r in rows}), sorted({r[b] for r in rows})
    m = np.array([[*(r[x] for x in xs), *((r[a] == u) * 1.0 for u in ua), *((r[b] == u) * 1.0 for u in ub[1:])] for r in rows])
    return np.linalg.lstsq(m, np.array([r[y] for r in rows]), rcond=None)[0][: len(xs)]


def test_absorbed_ols_equals_dummies(spark):
    rng = np.random.default_rng(1)
    rows = [{"u": f"u{i}", "t": t, "x": float(rng.normal()), "z": float(rng.normal())} for i in range(12) for t in range(6) if rng.random() > 0.2]
    for r in rows:
        r["y"] = 2 * r["x"] - r["z"] + int(r["u"][1:]) * 0.3 + r["t"] * 0.7 + float(rng.normal()) * 0.1
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "u string, t int, x double, z double, y double")
    fit = estimate.ols(df, "y", ["x", "z"], ["u", "t"], "u")
    assert np.allclose(fit.beta, _twfe(rows, "y", ["x", "z"], "u", "t"), atol=1e-6)
    assert fit.clusters == 12 and fit.n == len(rows)
    total, se = fit.lincom({"x": 1, "z": 1})
    assert abs(total - fit.beta.sum()) < 1e-12 and se > 0
    assert fit.wald(["x", "z"])[0] > 100
    assert estimate.ols(df.limit(0), "y", ["x"], ["u"], "u").n == 0


def test_event_study_and_imputation_find_the_effect(spark):
    rows = [(u, t, g, u * 0.5 + t * 0.2 + (3.0 if g is not None and t >= g else 0.0)) for u, g in ((1, 4), (2, 5), (3, None), (4, None), (5, 4)) for t in range(1, 9)]
    df = spark.createDataFrame(rows, "u int, t int, g int, y double")
    fit = estimate.event_study(df, "y", "u", "t", "g", low=-3, high=3)
    assert all(abs(b - (3.0 if n.startswith("tau") else 0.0)) < 1e-6 for n, b in zip(fit.names, fit.beta))
    assert all(abs(r.estimate - 3.0) < 1e-6 for r in estimate.imputation(df, "y", "u", "t", "g").collect())
    att = estimate.group_time_att(df, "y", "u", "t", "g").collect()
    assert att and all(abs(r.att - 3.0) < 1e-9 for r in att)
    assert estimate.average_effects(fit, {"post": ["tau0", "tau1"]})[0][1] == pytest.approx(3.0)


def test_clipping():
    ring = np.array([(-1, -1), (3, -1), (3, 3), (-1, 3)], dtype=float)
    assert spatial.ring_area(ring) == 16
    assert spatial.ring_area(spatial.clip_ring(ring, 0, 0, 2, 2)) == 4
    assert len(spatial.clip_ring(ring, 5, 5, 6, 6)) == 0
    assert spatial.clip_length(np.array([(-1.0, 0.5), (3.0, 0.5)]), 0, 0, 2, 2) == 2
    hole = [ring, np.array([(0, 0), (1, 0), (1, 1), (0, 1)], dtype=float)]
    assert list(spatial.inside(np.array([0.5, 2.0, 9.0]), np.array([0.5, 2.0, 9.0]), hole)) == [False, True, False]
