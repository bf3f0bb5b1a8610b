import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import nearby, orphans, skew, tree

T = lambda s: datetime.fromisoformat(s) if s else None


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: datetime(2020, rnd.randint(1, 12), rnd.randint(1, 28))
    parents = [(rnd.choice("abcd"), rnd.choice([None, day()]), rnd.choice([None, day()])) for _ in range(30)]
    refs = [("t", i, rnd.choice(["hot"] * 3 + list("abcdex") + [None]), rnd.choice([day(), day(), None])) for i in range(400)]
    refs += refs[:20]
    want = set()
    for t, i, k, at in refs:
        if k is None:
            continue
        own = [(f, u) for p, f, u in parents if p == k]
        if not own or at is not None and not any((f is None or f <= at) and (u is None or u > at) for f, u in own):
            want.add((t, i, at))
    r = spark.createDataFrame(refs, "ref_table string, ref_id long, key string, at timestamp")
    p = spark.createDataFrame(parents, "key string, valid_from timestamp, valid_to timestamp")
    got = orphans.orphan_references(r, p).collect()
    assert {(x.ref_table, x.ref_id, x.at) for x in got} == want and len(got) == len(want)
    report = {(x.ref_table, x.ref_period): x for x in orphans.orphan_report(r, orphans.orphan_references(r, p)).collect()}
    assert sum(x.n_missing + x.n_not_yet + x.n_ended for x in report.values()) == len(want)
    assert orphans.orphan_references(r.limit(0), p).count() == 0
    assert orphans.orphan_references(r, p.limit(0)).count() == len({x[:2] + x[3:] for x in refs if x[2] is not None})


def test_keys(spark):
    row = spark.createDataFrame([(" ab12.3 ", "{A-B} ", " urn:uuid:A-B", "  ", None)], "a string, b string, c string, d string, e string")
    got = row.select(orphans.accession_key(F.col("a")), orphans.dataset_key(F.col("b")), orphans.dataset_key(F.col("c")), orphans.accession_key(F.col("d")), orphans.dataset_key(F.col("e"))).first()
    assert tuple(got) == ("AB12", "a-b", "a-b", None, None)


def test_tree_profiles_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *map(str, range(300))]), rnd.choice(["x", "y", None, "z"]), rnd.randint(1, 4), "extra") for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, id string, v string, y int, n string")
    want = {}
    for k, i, v, y, _ in rows:
        a, b, c = want.setdefault(k, (set(), set(), set()))
        a.add(i), b.add(v), c.add(y)
    expect = {k: (len(a - {None}), len(b - {None}), len(c)) for k, (a, b, c) in want.items()}
    for chunk in (50, 10_000):
        got = {r.k: (r.n_records, r.n_v, r.n_y) for r in tree.key_profiles(df, ["k"], "id", ["v", "y"], chunk_rows=chunk, fan_in=3).collect()}
        assert got == expect
        only = {r.k: r.n_records for r in tree.key_profiles(df, ["k"], "id", chunk_rows=chunk, fan_in=3).collect()}
        assert only == {k: v[0] for k, v in expect.items()}
    assert tree.key_profiles(df.limit(0), ["k"], "id", ["v"]).count() == 0


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(7)
    spot = lambda: rnd.choice([(rnd.uniform(-90, 90), rnd.uniform(-180, 180)), (10 + rnd.uniform(-1, 1), rnd.choice([179.5, -179.5]) + rnd.uniform(-0.4, 0.4)), (89.7 + rnd.uniform(0, 0.3), rnd.uniform(-180, 180)), (5.0, 5.0)])
    left = [(str(i), *spot(), "c") for i in range(400)] + [("n", None, 1.0, "c"), ("m", float("nan"), 1.0, "c"), ("o", 95.0, 1.0, "c"), ("d", 5.0, 5.0, "c"), ("d", 5.0, 5.0, "c")]
    right = [(i, *spot()) for i in range(200)] + [(900, 5.0, None)]
    a = spark.createDataFrame(left, "id string, lat double, lon double, band string")
    b = spark.createDataFrame(right, "sid long, lat double, lon double").withColumn("km", F.lit(0))
    for km in (60.0, 300.0):
        want = sorted((i, s) for i, la, lo, _ in left if la is not None and la == la and abs(la) <= 90 for s, sa, so in right if so is not None and _km(la, lo, sa, so) <= km)
        for rows in (20, 100_000):
            got = sorted((r.id, r.sid) for r in nearby.near_pairs(a, b, "id", "sid", km, keep=["band"], strip_rows=rows).collect())
            assert got == want
    assert nearby.near_pairs(a.limit(0), b, "id", "sid", 5.0).count() == 0
    assert nearby.near_pairs(a, b.limit(0), "id", "sid", 5.0).count() == 0


def test_near_pairs_of_a_crowded_band(spark):
    # Half of both sides lies in one band of latitude, a part of it in one degree and across the date line.
    rnd = random.Random(12)
    spot = lambda k: (20.0 + rnd.uniform(0, 0.04), rnd.uniform(-180, 180) if k % 3 else rnd.choice([179.99, -179.99, 7.5]) + rnd.uniform(-0.01, 0.01)) if k % 2 else (rnd.uniform(-90, 90), rnd.uniform(-180, 180))
    left, right = [(k, *spot(k // 2)) for k in range(1200)], [(k, *spot(k // 2)) for k in range(1200)]
    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "sid long, lat double, lon double")
    want = sorted((i, s) for i, la, lo in left for s, sa, so in right if _km(la, lo, sa, so) <= 5.0)
    bands, pieces = nearby._strips(a.withColumnRenamed("lat", "_lat").withColumnRenamed("lon", "_lon"), 0.05, 60)
    assert any(cut for _, cut in bands) and max(k for *_, k in pieces) > 1
    assert sorted(map(tuple, nearby.near_pairs(a, b, "id", "sid", 5.0, strip_rows=60).select("id", "sid").collect())) == want


def test_salted_join_equals_plain_join(spark):
    rnd = random.Random(9)
    a = spark.createDataFrame([(rnd.choice(["hot"] * 9 + list("abc") + [None]), i) for i in range(300)], "k string, i int")
    b = spark.createDataFrame([(k, v) for k in ("hot", "a", "z", None) for v in range(3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        x, y = skew.salted_join(a, b, ["k"], how, share=0.2), a.join(b, ["k"], how)
        assert sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect()))
    assert skew.hot_keys(a.limit(0), ["k"]).count() == 0
    assert skew.small(a, 300) and not skew.small(a, 299)
    assert not skew.small(a, 300, 100) and skew.small(a.limit(0), 1, 1)


def test_written_tables_are_cleared(spark):
    from gridloom import storage

    storage.clear_written(spark)
    df, path = storage.written(spark.range(3), "cleared")
    assert df.count() == 3 and storage.clear_written(spark) == 1 and storage.clear_written(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
