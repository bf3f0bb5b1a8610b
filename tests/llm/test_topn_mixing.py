import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm import mixing, topn


def test_top_n_against_sorting(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + [f"g{i}" for i in range(40)]), f"i{k:05d}", rnd.randint(0, 50)) for k in range(6000)]
    rows += rows[:5]
    want = {}
    for g, i, s in rows:
        want.setdefault(g, []).append((-s, i))
    expect = sorted((g, r, i, -s) for g, v in want.items() for r, (s, i) in enumerate(sorted(v)[:3], 1))
    extra = [(None, "x", 1), ("g", None, 1), ("g", "x", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows + extra], "bin string, species string, votes int, rank_no int")
    for file_rows in (700, 1_000_000):
        got = topn.top_n_per_group(df, "bin", "species", "votes", 3, file_rows=file_rows, row_group_bytes=8 << 10)
        assert sorted(map(tuple, got.collect())) == expect
    assert topn.top_n_per_group(df.limit(0), "bin", "species", "votes", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "bin", "species", "votes", 0)


def test_hot_groups_over_several_files_skip_row_groups(spark):
    # Three groups of thousands of rows each and many small ones: most row groups of the large ones are never read.
    rows = [("hot%d" % (k % 3), f"i{k:06d}", (k * 7919) % 100_003) for k in range(60_000)] + [(f"g{k % 500}", f"i{k:06d}", k % 11) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, i string, s int")
    want = {}
    for g, i, s in rows:
        want.setdefault(g, []).append((-s, i))
    expect = sorted((g, r, i, -s) for g, v in want.items() for r, (s, i) in enumerate(sorted(v)[:4], 1))
    got = topn.top_n_per_group(df, "g", "i", "s", 4, file_rows=15_000, row_group_bytes=16 << 10)
    assert sorted(map(tuple, got.collect())) == expect
    counts = topn.row_groups_skipped(df, "g", "i", "s", 4, file_rows=15_000, row_group_bytes=16 << 10).collect()
    assert len(counts) > 1 and sum(r.groups_skipped for r in counts) > sum(r.groups_read for r in counts) / 2 > 0
    assert topn.row_groups_skipped(df.where("g = 'g1'"), "g", "i", "s", 100).count() == 0


def test_row_groups_below_the_nth_score_are_skipped(tmp_path):
    path = str(tmp_path / "a.parquet")
    table = pa.table({"g": ["a"] * 1000 + ["b"] * 10, "i": [f"{k:04d}" for k in range(1010)], "s": list(range(1000, 0, -1)) + [5] * 10})
    pq.write_table(table, path, row_group_size=100)
    best, read, skipped = topn.read_top("file://" + path, "g", "i", "s", 3)
    assert skipped == 9 and read == 2
    assert best["i"].tolist() == ["0000", "0001", "0002", "1000", "1001", "1002"]
    ties = pa.table({"g": ["a"] * 20, "i": [f"{k:02d}" for k in range(20)], "s": [7] * 20})
    pq.write_table(ties, path, row_group_size=5)
    best, read, skipped = topn.read_top("file://" + path, "g", "i", "s", 3)
    assert (read, skipped) == (4, 0) and best["i"].tolist() == ["00", "01", "02"]  # equal scores are never skipped


def test_mixture_exponents():
    tokens, targets, repeats = {"a": 900, "b": 90, "c": 10}, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 2, "c": 5}
    w, t, budget = mixing.mixture(tokens, targets, repeats)
    assert t == 1.0 and w == pytest.approx(targets) and budget == 100  # c: 5 * 10 / 0.5
    w, t, budget = mixing.mixture(tokens, targets, repeats, budget=500)
    assert 0 < t < 1 and mixing.repeats_allow(w, tokens, repeats, 500)
    more = mixing.tempered(tokens, targets, min(1.0, t + 0.01))
    assert not mixing.repeats_allow(more, tokens, repeats, 500)
    w, t, _ = mixing.mixture(tokens, None, dict.fromkeys(tokens, 100), target_entropy=0.9)
    assert mixing.entropy(w) == pytest.approx(0.9, abs=1e-6)
    assert mixing.mixture({}, None, {}) == ({}, 1.0, 0) and mixing.mixture({"a": 0}, {"a": 1.0}, {}) == ({}, 1.0, 0)


def _docs(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["big"] * 8 + ["small", None]), " ".join(rnd.choice(["alpha", "beta", "gamma ray"]) for _ in range(rnd.randint(0, 30))), 0) for k in range(3000)]
    rows += rows[:50] + [(None, "big", "x y", 0), (9001, "big", None, 0), (9002, "big", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")


def test_mix_meets_its_targets(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].actual_share == 0 and s["big"].actual_share == pytest.approx(2 / 3, abs=0.002) and s["small"].actual_share == pytest.approx(1 / 3, abs=0.002)
    assert s["small"].repeats == pytest.approx(4.0, abs=0.05) or s["big"].repeats == pytest.approx(1.0, abs=0.01)
    rows = selection.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert max(r.copy for r in rows if r.source == "small") <= 4 and {r.copy for r in rows if r.source == "big"} == {1}
    again = mixing.mix(docs, targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_budgets_are_filled_but_for_one_document(spark):
    rnd = random.Random(5)
    rows = [(k, s, rnd.randint(0, 40)) for k, s in enumerate(["a"] * 700 + ["b"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    total = {s: sum(n for _, x, n in rows if x == s) for s in "ab"}
    got = mixing.draw(df, {"a": 0.5, "b": 0.5}, 2 * int(total["b"] * 2.5)).groupBy("source").sum("n_tokens").collect()
    for r in got:
        assert 0 <= total["b"] * 2.5 - r[1] <= 41
    assert mixing.draw(df.limit(0), {"a": 1.0}, 100).count() == 0


def test_mix_edges(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    assert selection.count() == 0 and shares.count() == 0
    some = spark.createDataFrame([("big", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs.limit(0), some)
    assert selection.count() == 0 and shares.count() == 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a b " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 100_000
