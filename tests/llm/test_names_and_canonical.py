import random

import numpy as np
import pytest

from gridloom.llm import canonical, names, textkeys


def _full(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_against_the_full_table():
    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in "ab")
        for most in (0, 1, 2, 3):
            assert textkeys.edits(a, b, most) == min(_full(a, b), most + 1)
    assert textkeys.edits("x" * 100_000, "x" * 99_999 + "y", 2) == 1


def test_similarities():
    assert textkeys.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert textkeys.monge_elkan(["ann", "lee"], ["lee", "ann"]) == 1.0
    assert textkeys.monge_elkan([], ["a"]) == 0.0


GROUPS = [
    ["Michael W. Theyucadu", "THEYUCADU Michael", "Theyucadu, M.W.", "M W Theyucadu", "Mike Theyucadu", "Michael Theyuacdu", "theyucadu michael", "Prof. Michael Theyucadu", "Michael Theyuçadu"],
    ["William J. Theyucadu", "W.J. Theyucadu", 'William "Will" Theyucadu', "William Theyucadu"],
    ["Lawrence E. Zolokike", "Larry Zolokike", "Lawernce Zolokike"],
    ["Ingrid A. Wezecacur", "Wezecacur IA", "WEZECACUR Ingrid"],
]
INSTITUTES = [
    ["Garden of Marine Biology, Fewoshamouth", "GMB Fewoshamouth", "Gdn. Mar. Biol., Fewoshamouth", "Fewoshamouth Garden of Marine Biology", "The Garden of Marine Biology at Fewoshamouth", "Marine Biology Garden, Fewoshamouth", "GARDEN OF MARINE BIOLOGY, FEWOSHAMOUTH", "Garden of Marine Biology (GMB), Fewoshamouth", "Garrden of Marine Biology, Féwoshamouth"],
    ["Museum of Marine Biology, Fewoshamouth", "Mus. Marine Biology - Fewoshamouth"],
    ["Garden of Plant Sciences, Fewoshamouth"],
    ["Garden of Marine Biology, Zizayawick"],
]


def _known_givens():
    # Enough surnames behind each given name for it to count as one.
    givens = [f"{g} {m}. {s}" for g, m in (("Michael", "A"), ("William", "B"), ("Lawrence", "C"), ("Ingrid", "D")) for s in ("Bacagod", "Dufihuk", "Lemonip", "Rasotuv")]
    # Nicknames are learned from spellings that give both names.
    return givens + [f'{g} "{n}" {s}' for g, n in (("Michael", "Mike"), ("Lawrence", "Larry"), ("Charlotte", "Lottie")) for s in ("Gibecol", "Hotadam", "Juvirep")]


def test_bands_find_words_a_slip_apart():
    rnd = random.Random(2)
    bands = names.bands_needed(names.FLOOR, names.RECALL, names.ROWS_PER_BAND)
    a, b = names._band_hashes(bands, names.ROWS_PER_BAND)
    keys = lambda w: set(names._band_keys(w, bands, names.ROWS_PER_BAND, a, b))
    pairs, met = 0, 0
    for _ in range(400):
        w = "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(4, 12)))
        k = rnd.randrange(1, len(w) - 1)
        for v in (w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + "z" + w[k + 1 :]):
            if v != w and names._close(w, v):
                pairs += 1
                met += bool(keys(w) & keys(v))
    assert met >= 0.98 * pairs
    for w, v in (("smith", "smiht"), ("lopez", "lpoez"), ("park", "prak"), ("wong", "wnog"), ("barnes", "bames")):
        assert keys(w) & keys(v), (w, v)


def test_threshold_decides(spark):
    rows = [(1, "collectors", "Charlotte Smith", ""), (2, "collectors", "Lottie Smith", ""), (3, "collectors", "Bertram Smith", "")]
    rows += [(100 + k, "collectors", s, "") for k, s in enumerate(_known_givens())]
    assert [p for p in _pairs(spark, rows) if p[1] < 100] == [(1, 2)]
    person = lambda s: names.parse_person(s) | {"means": ""}
    assert names.same_person(person("Ann B. Smith"), person("Smith, A.B.")) == 1.0
    assert names.same_person(person("Ann B. Smith"), person("Ann C. Smith")) < names.THRESHOLD
    assert 0 < names.same_person(person("Ann Smith"), person("Ann Jones")) < names.THRESHOLD


def _pairs(spark, rows):
    df = spark.createDataFrame(rows, "name_id long, field_name string, spelling string, core string")
    return sorted(map(tuple, names.name_pairs(names.same_names(df)).collect()))


def test_groups_come_out_whole(spark):
    rows, want = [], []
    for field, groups in (("collectors", GROUPS), ("inst", INSTITUTES)):
        for g in groups:
            ids = [len(rows) + i for i in range(len(g))]
            rows += [(i, field, s, "x") for i, s in zip(ids, g)]
            want += [(a, b) for a in ids for b in ids if a < b]
    rows += [(1000 + i, "collectors", s, None) for i, s in enumerate(_known_givens())]
    assert _pairs(spark, rows) == sorted(want)


def test_name_edges(spark):
    rows = [(1, "collectors", None, "x"), (2, "collectors", "", "x"), (3, None, "Ann B. Smith", "x"), (None, "collectors", "Ann B. Smith", "x"), (4, "collectors", "Ann B. Smith", "x"), (4, "collectors", "Ann B. Smith", "x"), (5, "collectors", "Smith, A.B.", "x"), (6, "inst", "Ann B. Smith", "x"), (7, "collectors", "?? 12", "x"), (8, "collectors", "z" * 50_000, "x"), (9, "inst", "q" * 50_000 + " Museum", "x")]
    assert _pairs(spark, rows) == [(4, 5)]
    empty = spark.createDataFrame([], "name_id long, field_name string, spelling string")
    assert names.name_pairs(names.same_names(empty)).count() == 0


def test_bands_reach_the_recall():
    bands = names.bands_needed(0.5, 0.99, 3)
    assert 1 - (1 - 0.5**3) ** bands >= 0.99 > 1 - (1 - 0.5**3) ** (bands - 1)
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 1 << 62, bands * 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, bands * 3, dtype=np.uint64)
    rnd, met = random.Random(4), 0
    for _ in range(200):
        w = "".join(rnd.choice("bcdfghjklm") + rnd.choice("aeiou") for _ in range(4))
        i = rnd.randrange(1, 7)
        v = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        met += bool(set(names._band_keys(w, bands, 3, a, b)) & set(names._band_keys(v, bands, 3, a, b)))
    assert met >= 190


TAXA = [(1, "Cusohoites fuweyaosa"), (2, "Cusohoites vefeyoa"), (3, "Lizagoaria goluensis"), (4, "Takipoella papizium"), (5, None), (6, ""), (7, "Cusohoites fuweyaosa"), (8, "Lejoleella"), (9, "Botemiites jysewium")]
TYPED = {
    "cusohoites fueyaosa": 1, "cusohites fuweyaosa (loko, 1825)": 1, "c. fuweyaosa": 1, "cus. fuweyaosa voucher 8572": 1, "lizgoaria golunsis": 3, "papizium, takipoella": 4, "takipoellapapizium": 4, "takipoella-papizium": 4, "takipoella cf. papizium": 4,
    "takipoella (dege) papizium": 4, "takipoella takipoella papizium": 4, "lizagoaria goluensus": 3, "botemyites jisewium": 9, "takipoella sp.": None, "takipoella sp. 12": None, "takipoella": None, "lizagoaria tokamuris": None, "takipoella spp": None, "unknown moth": None, "8169ziku": None, "kuseleaceae indet.": None, " ": None, "": None, None: None,
}


def test_typed_names_lead_to_the_list(spark):
    values = spark.createDataFrame([(v, 1) for v in TYPED] * 2, "v string, cosine int")
    taxa = spark.createDataFrame([(*t, "x") for t in TAXA], "taxonid long, name string, value string")
    for block in (1, 200_000):
        got = canonical.match_names(values, "v", taxa, "taxonid", "name", block_forms=block).collect()
        assert {r.v: r.taxonid for r in got} == {k: v for k, v in TYPED.items() if v}
        assert len(got) == len({r.v for r in got})
    assert canonical.match_names(values.limit(0), "v", taxa, "taxonid", "name").count() == 0
    assert canonical.match_names(values, "v", taxa.limit(0), "taxonid", "name").count() == 0


def test_rivals_are_left_unmatched(spark):
    taxa = spark.createDataFrame([(1, "Takipoella papizium"), (2, "Takiwoella papizium")], "taxonid long, name string")
    got = canonical.match_names(spark.createDataFrame([("t. papizium",), ("takiqoella papizium",), ("x" * 100_000,)], "v string"), "v", taxa, "taxonid", "name")
    assert got.count() == 0
