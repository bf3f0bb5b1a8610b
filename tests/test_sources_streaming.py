import gzip
import sqlite3
import struct
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.session import load
from gridloom.sources import binary, ingest, sinks
from gridloom.sources import text as src
from gridloom.streaming import ingest as stream


def test_tolerant_and_discovery(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a/x.tsv").write_text("id\tname\n1\tann\n2\t\n")
    (tmp_path / "b/y.tsv").write_text("name\tid\textra\nbo\t3\tz\nbad\n")
    (tmp_path / "b/skip_y.tsv").write_text("id\n9\n")
    found = src.discover(spark, str(tmp_path), exclude="skip_")
    assert [f.rsplit("/", 2)[1] for f in found] == ["a", "b"]
    got = sorted(map(tuple, src.read_tolerant(spark, found, ["id", "name", "gone"]).collect()))
    assert got == [("1", "ann", ""), ("2", "", ""), ("3", "bo", "")]
    prov = src.with_provenance(spark.read.option("header", True).option("sep", "\t").csv(found[:1]), str(tmp_path)).select("source_file", "source_group").distinct().collect()
    assert [tuple(r) for r in prov] == [("a/x.tsv", "a")]
    audit = src.file_audit(spark, found[:1], "id").first()
    assert (audit.n_rows, audit.first_id, audit.last_id) == (2, "1", "2")


def test_delimited_variants(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("k,v\n1,x\n")
    assert src.read_delimited(spark, str(tmp_path / "a.csv.gz"), ["v"]).collect()[0].v == "x"
    (tmp_path / "w.csv").write_bytes("k,v\n1,é\n".encode("cp1252"))
    assert src.read_delimited(spark, str(tmp_path / "w.csv"), ["v"], encoding="windows-1252").first().v == "é"
    with pytest.raises(ValueError):
        src.read_delimited(spark, str(tmp_path / "w.csv"), ["nope"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.csv", "a,b\n1,2\n3,\n")
    assert sorted(map(tuple, src.read_zip_member(spark, str(tmp_path / "z.zip"), "in.csv", ["b", "a"]).collect())) == [("", "3"), ("2", "1")]
    (tmp_path / "u.csv").write_text("SID,WIND\n ,kts\nA, \nB,34\n")
    assert [tuple(r) for r in src.read_with_units_row(spark, str(tmp_path / "u.csv"), "WIND", "kts").orderBy("SID").collect()] == [("A", None), ("B", "34")]
    (tmp_path / "r.txt").write_text("1|Ann|US\njunk\n2|Bo|DE\n")
    assert src.read_records(spark, str(tmp_path / "r.txt"), r"^(\d+)\|([^|]+)\|(\w+)$", ["n", "name", "c"]).count() == 2
    (tmp_path / "d.tsv").write_text('id\tnote\tx\n1\t"open\t2\n2\tb\n')
    rows = src.read_darwin_core(spark, str(tmp_path / "d.tsv"), ["id"], ["id", "note", "x", "absent"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", '"open', "2", None), ("2", "b", None, None)]
    assert src.read_named_extras(spark, {"n": str(tmp_path / "u.csv")}, ["SID"]).select("source").distinct().first().source == "n"
    assert src.read_named_extras(spark, {}, ["SID"]).count() == 0


def test_flat_file(spark):
    e = "LOCUS x\nACCESSION   ab123\nREFERENCE 1\n   PUBMED   11\nREFERENCE 2\n   PUBMED   12\n   PUBMED   11\n//"
    r = src.parse_flat_file(spark.createDataFrame([(e,)], "t string"), "t").first()
    assert (r.accession, r.pubmed_ids) == ("AB123", ["11", "12"])


def test_binary_formats(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("create table t (k int, v text)"), con.executemany("insert into t values (?, ?)", [(1, "x"), (2, "y")]), con.commit(), con.close()
    assert binary.read_sqlite(spark, str(tmp_path / "a.db"), "select k, v from t", "k long, v string").count() == 2
    pd.DataFrame({"k": [1, 2], "v": ["x", "y"], "w": [0.5, 1.5]}).to_stata(tmp_path / "a.dta", write_index=False)
    assert sorted(r.v for r in binary.read_stata(spark, str(tmp_path / "a.dta"), ["k", "v"], "k long, v string").collect()) == ["x", "y"]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"name":"m"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"properties":{"name":"pt"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    got = {r.name: len(r.rings) for r in binary.read_geojson(spark, str(tmp_path / "g.json"), ["name"]).collect()}
    assert got == {"p": 1, "m": 2}
    (tmp_path / "r.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    px = {(r.row, r.col): (r.lon, r.lat, r.value) for r in binary.read_ascii_grid(spark, str(tmp_path / "r.asc")).collect()}
    assert px[0, 0] == (10.5, 21.5, 1.0) and px[1, 1] == (11.5, 20.5, None) and len(px) == 6
    cube = spark.createDataFrame([("2020-01", 1.0, [5.0, 6.0], [7.0, 8.0])], "time string, lat double, lons array<double>, values array<double>")
    assert binary.pixels_of_cube(cube).count() == 2


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + record)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    head = struct.pack("<4BIHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 6) + b"\0" * 20
    (tmp_path / "s.dbf").write_bytes(head + field + b"\r" + b" alpha")
    r = binary.read_shapefile(spark, str(tmp_path / "s.shp"), ["NAME"]).first()
    assert r.NAME == "alpha" and [(p.lon, p.lat) for p in r.rings[0]] == ring


def test_sinks(spark, sf, tmp_path):
    nation = load(spark, sf, "nation")
    sinks.write_csv(nation, str(tmp_path / "n"), ["n_nationkey"])
    assert src.read_delimited(spark, str(tmp_path / "n"), ["n_name"]).count() == 25
    small = nation.orderBy("n_nationkey").limit(2).select("n_nationkey", "n_name")
    sinks.csv_with_preamble(small, str(tmp_path / "p.csv"), {"rows": "2"})
    assert (tmp_path / "p.csv").read_text().splitlines()[:2] == ["# rows,2", "n_nationkey,n_name"]
    assert r"\hline" in sinks.latex_table(small, "x") and "| n_nationkey | n_name |" in sinks.markdown_report(small, "t")
    with pytest.raises(ValueError):
        sinks.latex_table(spark.range(sinks.REPORT_ROWS + 1), "x")
    assert len(sinks.file_manifest(spark, str(tmp_path / "p.csv")).first().sha256) == 64 and len(sinks.sha256_of(str(tmp_path / "p.csv"))) == 64
    feature = sinks.geojson_features(spark.createDataFrame([("a", [[(0.0, 1.0)]])], "name string, rings array<array<struct<lon:double,lat:double>>>")).first().feature
    assert '"coordinates":[[[0.0,1.0]]]' in feature
    path = str(tmp_path / "t")
    small.write.parquet(path)
    sinks.replace_table(sinks.patch(spark.read.parquet(path), spark.createDataFrame([(0, "new")], "n_nationkey int, n_name string"), ["n_nationkey"], "n_name"), path)
    assert {r.n_name for r in spark.read.parquet(path).collect()} >= {"new"}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.insert_ignore(old, spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string"), ["k"]).count() == 3
    up = sinks.upsert(old, spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), ["k"], "v").collect()
    assert sorted(map(tuple, up)) == [(1, "a"), (2, "d")]


def test_ingest_helpers(spark):
    ok, bad = ingest.bisect_valid([1, 2, 3, 4, 5], lambda c: 3 not in c)
    assert sorted(sum(ok, [])) == [1, 2, 4, 5] and bad == [3]
    assert sum(ingest.pages(lambda o, n: (list(range(7))[o : o + n], 7), 3), []) == list(range(7))
    slept, tries = [], iter([OSError(), OSError(), 5])

    def call():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert ingest.with_backoff(call, sleep=slept.append) == 5 and len(slept) == 2
    clock = [0.0]
    limiter = ingest.RateLimiter(2, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(5):
        limiter.wait()
    assert clock[0] >= 2.0
    tree = {"type": "and", "predicates": [{"type": "in", "key": "K", "values": [1, 2]}, {"type": "not", "predicate": {"type": "equals", "key": "V", "value": "x"}}]}
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "k int, v string")
    assert [r.k for r in df.where(ingest.predicate(tree)).collect()] == [2]
    assert ingest.pending(df, df.where("k = 1"), ["k"]).count() == 2


def test_streams(spark, sf, tmp_path):
    schema = load(spark, sf, "events").schema
    src_dir = f"{sf}/events.parquet*"
    for run in range(2):
        q = stream.write_available(stream.file_stream(spark, src_dir, schema), str(tmp_path / "good"), str(tmp_path / "ck"), str(tmp_path / "bad"), F.col("event_type") != "error")
        q.awaitTermination()
        good, bad = spark.read.parquet(str(tmp_path / "good")).count(), spark.read.parquet(str(tmp_path / "bad")).count()
        assert good + bad == load(spark, sf, "events").count() and bad > 0
    distinct = stream.distinct_events(stream.file_stream(spark, src_dir, schema).withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "1 day")
    q = distinct.writeStream.format("memory").queryName("distinct_events").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_events").count() == load(spark, sf, "events").select("event_id").distinct().count()
    counts = stream.period_counts(stream.file_stream(spark, src_dir, schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", quarterly=True)
    q = counts.writeStream.format("memory").queryName("period_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("period_counts").where("year <> 2024 or quarter <> 1").count() == 0
    assert stream.versioned_path("a", 2) == "a/v2"
