"""Round trips: whole tables written in the forms the sources read, and read again; sinks, reports, streams, job control."""

from __future__ import annotations

import io
import sqlite3
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import filters
from gridloom.plans import composites as comp
from gridloom.plans.book import Book
from gridloom.plans.common import T
from gridloom.sources import binary, ingest, sinks
from gridloom.sources import text as source_text
from gridloom.storage import shared_dir
from gridloom.streaming import ingest as streams

book = Book()


def new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(path: str, content: bytes) -> None:
    """One file in the shared folder, whatever its file system."""
    import pyarrow.fs as pafs

    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as f:
        f.write(content)


def suppliers(spark, sf) -> pd.DataFrame:
    """The supplier table as pandas: a file of formats that Spark does not write."""
    return T(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey").toPandas()


_TEXT_ROWS = "select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier"
COLUMNS = ["s_suppkey", "s_name", "s_nationkey"]


@book.query("s_02_discovery", "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders where year(o_orderdate) % 3 <> 1")
def s_02(spark, sf):
    base = new(spark, "discover")
    o = T(spark, sf, "orders").withColumn("k", F.year("o_orderdate") % 3)
    for k, name in enumerate(("keep_a", "drop_b", "keep_c")):
        o.where(F.col("k") == k).select("o_orderkey", "o_orderpriority").write.options(header=True, sep="\t").csv(f"{base}/{name}")
    found = source_text.discover(spark, base, r"\.csv$", "drop_")
    return source_text.read_tolerant(spark, found, ["o_orderkey", "o_orderpriority"])


@book.query("s_03_provenance", "select concat('g', s_nationkey % 3) as source_group, count(*) as n, count(distinct s_suppkey) as keys from supplier group by 1")
def s_03(spark, sf):
    base = new(spark, "provenance")
    T(spark, sf, "supplier").withColumn("g", F.concat(F.lit("g"), F.col("s_nationkey") % 3)).select("g", "s_suppkey").write.parquet(base + "-flat")
    flat = spark.read.parquet(base + "-flat")
    for k in range(3):
        flat.where(F.col("g") == f"g{k}").select("s_suppkey").write.option("header", True).csv(f"{base}/g{k}")
    rows = source_text.with_provenance(spark.read.option("header", True).csv([f"{base}/g{k}" for k in range(3)]), base.removeprefix("file://"))
    return rows.groupBy("source_group").agg(F.count("*").alias("n"), F.countDistinct("s_suppkey").alias("keys"))


@book.query("s_05_darwin_core", "select cast(o_orderkey as varchar) as occurrenceID, o_orderpriority as species, cast(null as varchar) as locality from orders")
def s_05(spark, sf):
    path = new(spark, "dwc")
    T(spark, sf, "orders").select(F.col("o_orderkey").alias("occurrenceID"), F.col("o_orderpriority").alias("species")).write.options(header=True, sep="\t", quote="").csv(path)
    return source_text.read_darwin_core(spark, path, ["occurrenceID", "species"], ["occurrenceID", "species", "locality"])


@book.query("s_06_gzip", "select cast(c_custkey as varchar) as c_custkey, c_name from customer")
def s_06(spark, sf):
    path = new(spark, "gzip")
    T(spark, sf, "customer").select("c_custkey", "c_name").write.options(header=True, compression="gzip").csv(path)
    return source_text.read_delimited(spark, path, ["c_custkey", "c_name"])


@book.query("s_07_zip_member", _TEXT_ROWS)
def s_07(spark, sf):
    path, raw = new(spark, "zip"), io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.csv", "a\n1\n")
        z.writestr("supplier.csv", suppliers(spark, sf).to_csv(index=False))
    put(f"{path}/a.zip", raw.getvalue())
    return source_text.read_zip_member(spark, f"{path}/a.zip", "supplier.csv", COLUMNS)


@book.query("s_08_named_extras", "select n_name as name, 'x' as source from nation union all select r_name, 'y' from region")
def s_08(spark, sf):
    a, b = new(spark, "extra"), new(spark, "extra")
    sinks.write_csv(T(spark, sf, "nation").select(F.col("n_name").alias("name")), a)
    sinks.write_csv(T(spark, sf, "region").select(F.col("r_name").alias("name")), b)
    return source_text.read_named_extras(spark, {"x": a, "y": b}, ["name"])


@book.query("s_09_text_records", "select cast(p_partkey as varchar) as key, p_name as name from part")
def s_09(spark, sf):
    path = new(spark, "records")
    p = T(spark, sf, "part")
    p.select(F.concat("p_partkey", F.lit(" | "), "p_name").alias("value")).union(p.select(F.concat(F.lit("# note "), "p_partkey"))).write.text(path)
    return source_text.read_records(spark, path, r"^(\d+)\s*\|(.*)$", ["key", "name"])


@book.query("s_10_units_row", "select cast(s_suppkey as varchar) as s_suppkey, case when s_nationkey = 3 then null else s_name end as s_name from supplier")
def s_10(spark, sf):
    path = new(spark, "units")
    rows = suppliers(spark, sf)[["s_suppkey", "s_name", "s_nationkey"]]
    rows.loc[rows["s_nationkey"] == 3, "s_name"] = "NA"
    body = rows[["s_suppkey", "s_name"]].to_csv(index=False).split("\n", 1)
    put(f"{path}/a.csv", (body[0] + "\nkey,text\n" + body[1]).encode())
    return source_text.read_with_units_row(spark, f"{path}/a.csv", "s_suppkey", "key", null_value="NA")


@book.query("s_11_code_page", "select cast(s_suppkey as varchar) as s_suppkey, concat(s_name, ' é–') as s_name from supplier")
def s_11(spark, sf):
    path = new(spark, "cp1252")
    rows = suppliers(spark, sf)[["s_suppkey", "s_name"]]
    rows["s_name"] += " é–"
    put(f"{path}/a.csv", rows.to_csv(index=False).encode("cp1252"))
    return source_text.read_delimited(spark, f"{path}/a.csv", ["s_suppkey", "s_name"], encoding="windows-1252")


@book.query("s_12_stata", "select s_suppkey, s_name from supplier")
def s_12(spark, sf):
    path, raw = new(spark, "stata"), io.BytesIO()
    suppliers(spark, sf).to_stata(raw, write_index=False, version=118)
    put(f"{path}/a.dta", raw.getvalue())
    return binary.read_stata(spark, f"{path}/a.dta", ["s_suppkey", "s_name"], "s_suppkey long, s_name string")


@book.query("s_14_netcdf", "select k.t as time, cast(s.s_nationkey as double) as lat, cast(r.r_regionkey as double) as lon, cast(s.n * (k.t + 1) + r.r_regionkey as double) as value from (select s_nationkey, count(*) as n from supplier group by 1) s cross join region r cross join (values (0), (1)) k(t)")
def s_14(spark, sf):
    import numpy as np

    path = new(spark, "netcdf")
    n = T(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).orderBy("s_nationkey").toPandas()
    lons = [float(r.r_regionkey) for r in T(spark, sf, "region").orderBy("r_regionkey").collect()]
    values = np.stack([n["n"].to_numpy()[:, None] * (t + 1) + np.array(lons)[None, :] for t in (0, 1)]).astype("float64")
    put(f"{path}/a.nc", binary.netcdf_bytes({"time": np.array([0.0, 1.0]), "lat": n["s_nationkey"].to_numpy().astype("float64"), "lon": np.array(lons)}, "ppt", values))
    return binary.read_netcdf(spark, f"{path}/a.nc", "ppt").select(F.col("time").cast("int").alias("time"), "lat", "lon", "value")


@book.query("s_15_ascii_grid", "select s_nationkey::int as row, k.c as col, cast(count(*) + k.c as double) as value from supplier cross join (values (0), (1), (2)) k(c) group by s_nationkey, k.c")
def s_15(spark, sf):
    path = new(spark, "grid")
    n = T(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).orderBy("s_nationkey").toPandas()
    last = int(n["s_nationkey"].max())
    held = dict(zip(n["s_nationkey"], n["n"]))
    body = "\n".join(" ".join(str(held[k] + c) if k in held else "-9999" for c in range(3)) for k in range(last + 1))
    put(f"{path}/a.asc", f"ncols 3\nnrows {last + 1}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n{body}\n".encode())
    return binary.read_ascii_grid(spark, f"{path}/a.asc").where("value is not null").select("row", "col", "value")


@book.query("s_15_geotiff", "select s_nationkey::int as row, k.c as col, 10.5 + k.c as lon, cast(count(*) + k.c as double) as value from supplier cross join (values (0), (1), (2)) k(c) group by s_nationkey, k.c")
def s_15_tiff(spark, sf):
    import numpy as np

    path = new(spark, "tiff")
    n = T(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).orderBy("s_nationkey").toPandas()
    values = np.full((int(n["s_nationkey"].max()) + 1, 3), -1.0, dtype="float32")
    values[n["s_nationkey"].to_numpy()] = n["n"].to_numpy()[:, None] + np.arange(3)[None, :]
    put(f"{path}/a.tif", binary.geotiff_bytes(values, 10.0, 50.0, 1.0, nodata=-1.0))
    return binary.read_geotiff(spark, f"{path}/a.tif").where("value is not null").select("row", "col", "lon", "value")


@book.query("s_16_sqlite", "select s_suppkey, s_name from supplier where s_nationkey > 4")
def s_16(spark, sf):
    path = new(spark, "sqlite")
    con = sqlite3.connect(":memory:")
    suppliers(spark, sf).to_sql("supplier", con, index=False)
    con.commit()
    put(f"{path}/a.db", con.serialize())
    return binary.read_sqlite(spark, f"{path}/a.db", "select s_suppkey, s_name from supplier where s_nationkey > 4", "s_suppkey long, s_name string")


@book.query("s_17_probe", "select s_suppkey, s_name from supplier order by s_suppkey limit 5")
def s_17(spark, sf):
    names, rows = source_text.probe(T(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey"), 5)
    return spark.createDataFrame(rows, "s_suppkey long, s_name string").select(*names)


@book.query("s_18_file_audit", "select count(*) as n_rows, cast(min(s_suppkey) as varchar) as first_id, cast(max(s_suppkey) as varchar) as last_id from supplier")
def s_18(spark, sf):
    path = new(spark, "audit")
    put(f"{path}/a.tsv", suppliers(spark, sf).to_csv(index=False, sep="\t").encode())
    return source_text.file_audit(spark, [f"{path}/a.tsv"], "s_suppkey").select("n_rows", "first_id", "last_id")


@book.query("s_22_bisection", "select o_orderkey, 0 as rejected from orders where o_orderkey % 7 <> 3 union all select o_orderkey, 1 from orders where o_orderkey % 7 = 3")
def s_22(spark, sf):
    """Queries of a service refused where they hold a bad key: halved until all good ones are through."""
    keys = [r[0] for r in T(spark, sf, "orders").groupBy((F.col("o_orderkey") % 7).alias("k")).count().select("k").collect()]  # seven keys
    good, bad = ingest.bisect_valid(sorted(keys), lambda items: 3 not in items)
    status = spark.createDataFrame([(k, 0) for part in good for k in part] + [(k, 1) for k in bad], "k long, rejected int")
    return T(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 7).join(F.broadcast(status), "k").select("o_orderkey", "rejected")


@book.query("s_23_predicate", "select o_orderkey from orders where o_orderstatus in ('O', 'F') and o_totalprice between 1000 and 90000 and not (o_orderpriority = '1-URGENT')")
def s_23(spark, sf):
    tree = {"type": "and", "predicates": [{"type": "in", "key": "o_orderstatus", "values": ["O", "F"]}, {"type": "range", "key": "o_totalprice", "low": 1000, "high": 90000}, {"type": "not", "predicate": {"type": "equals", "key": "o_orderpriority", "value": "1-URGENT"}}]}
    return T(spark, sf, "orders").where(ingest.predicate(tree)).select("o_orderkey")


@book.query("s_24_paging", "select n_nationkey, n_name from nation")
def s_24(spark, sf):
    rows = [(r.n_nationkey, r.n_name) for r in T(spark, sf, "nation").orderBy("n_nationkey").collect()]  # stands for a service
    got = [r for page in ingest.pages(lambda offset, size: (rows[offset : offset + size], len(rows)), 7) for r in page]
    return spark.createDataFrame(got, "n_nationkey long, n_name string")


@book.query("s_20_pending", "select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def s_20(spark, sf):
    o = T(spark, sf, "orders")
    return ingest.pending(o, o.where("o_orderstatus = 'P'"), ["o_custkey"])


@book.query("s_26_flat_file", "select concat('AB', o_orderkey) as accession, 2 as n_pubmed from orders")
def s_26(spark, sf):
    key = F.col("o_orderkey").cast("string")
    entry = F.concat(F.lit("LOCUS       x\nACCESSION   ab"), key, F.lit("\n  PUBMED   1"), key, F.lit("\n  PUBMED   2"), key, F.lit("\n//"))
    return source_text.parse_flat_file(T(spark, sf, "orders").select(entry.alias("entry")), "entry").select("accession", F.size("pubmed_ids").alias("n_pubmed"))


# sinks ------------------------------------------------------------------------------------------------------------------
@book.query("k_01_csv_sink", "select cast(c_custkey as varchar) as c_custkey, c_mktsegment from customer")
def k_01(spark, sf):
    path = new(spark, "csv")
    sinks.write_csv(T(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path, ["c_custkey"])
    return source_text.read_delimited(spark, path, ["c_custkey", "c_mktsegment"])


@book.query("k_02_appended", "select s_suppkey, s_nationkey from supplier")
def k_02(spark, sf):
    path = new(spark, "append")
    for k in range(3):
        T(spark, sf, "supplier").where(F.col("s_suppkey") % 3 == k).select("s_suppkey", "s_nationkey").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@book.query("k_09_preamble", "select * from (values ('# rows,' || (select count(*) from region)), ('r_regionkey,r_name')) t(line) union all select concat(r_regionkey, ',', r_name) from region")
def k_09(spark, sf):
    path = new(spark, "preamble")
    region = T(spark, sf, "region").select("r_regionkey", "r_name")
    put(f"{path}/a.csv", sinks.preamble_text(region, {"rows": str(region.count())}).encode())
    return spark.read.text(f"{path}/a.csv").withColumnRenamed("value", "line")


@book.query("k_10_latex", "select concat(r_regionkey, ' & ', r_name, ' \\\\') as line from region")
def k_10(spark, sf):
    table = sinks.latex_table(T(spark, sf, "region").select("r_regionkey", "r_name"), "Regions")
    return spark.createDataFrame([(x,) for x in table.split("\n") if x.endswith("\\\\") and x[:1].isdigit()], "line string")


@book.query("k_14_stata_sink", "select s_suppkey, s_name, s_nationkey from supplier")
def k_14(spark, sf):
    path = new(spark, "dta")
    sinks.write_stata(T(spark, sf, "supplier").select(*COLUMNS), path)
    return binary.read_stata(spark, path, COLUMNS, "s_suppkey long, s_name string, s_nationkey long")


@book.query("k_15_text_list", "select distinct canonicalname as value from taxon where trim(canonicalname) <> ''")
def k_15(spark, sf):
    path = new(spark, "list")
    T(spark, sf, "taxon").where("trim(canonicalname) <> ''").select("canonicalname").distinct().write.text(path)
    return spark.read.text(path)


@book.query("k_16_markdown", "select concat('| ', r_regionkey, ' | ', r_name, ' |') as line from region")
def k_16(spark, sf):
    text_of = sinks.markdown_report(T(spark, sf, "region").select("r_regionkey", "r_name"), "Regions")
    return spark.createDataFrame([(x,) for x in text_of.split("\n")[4:] if x], "line string")


@book.query("k_17_mirrored", "select n_nationkey, n_name from nation")
def k_17(spark, sf):
    a, b = new(spark, "artefact"), new(spark, "published")
    T(spark, sf, "nation").select("n_nationkey", "n_name").write.parquet(a)
    sinks.mirror(spark, a, b)
    return spark.read.parquet(b)


@book.query("k_18_manifest", "select 'a.csv' as name, length(s) as bytes, sha256(s) as sha256 from (select 'r_regionkey' || chr(10) || string_agg(r_regionkey::varchar || chr(10), '' order by r_regionkey) as s from region)")
def k_18(spark, sf):
    path = new(spark, "manifest")
    put(f"{path}/a.csv", T(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").toPandas().to_csv(index=False).encode())
    return sinks.file_manifest(spark, path).select(F.regexp_extract("file", "([^/]+)$", 1).alias("name"), "bytes", "sha256")


@book.query("k_19_cached", "select o_orderstatus, count(*) as n from orders group by 1")
def k_19(spark, sf):
    path, made = new(spark, "cache"), []

    def build() -> DataFrame:
        made.append(1)
        return T(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    sinks.cached_table(spark, path, build)
    out = sinks.cached_table(spark, path, build)  # read, not built again
    if len(made) != 1:
        raise AssertionError("the cache was built twice")
    return out


# jobs -------------------------------------------------------------------------------------------------------------------
@book.query("p_01_minimal", "select cast(o_orderkey as varchar) as record_id, year(o_orderdate)::int as year, case when o_orderkey % 2 = 0 then '12.5' else '' end as lat from orders")
def p_01(spark, sf):
    o = T(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("record_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("collection_date_start"), F.when(F.col("o_orderkey") % 2 == 0, "(12.5, -7)").alias("coord"))
    m = comp.build_minimal(raw)
    return m.select("record_id", F.col("collection_year").cast("int").alias("year"), F.col("latitude").alias("lat"))


@book.query("p_28_sample", "select 100 as n, 100 as distinct_keys, true as in_table")
def p_28(spark, sf):
    """A seeded sample: the same hundred keys whatever the partitioning."""
    o = T(spark, sf, "orders").select("o_orderkey")
    a, b = filters.sample_rows(o, 100, 7, "o_orderkey"), filters.sample_rows(o.repartition(13), 100, 7, "o_orderkey")
    return a.join(b, "o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"), F.bool_and(F.col("o_orderkey").isNotNull()).alias("in_table"))


@book.query("t_01_chunk_counters", "select count(*) as rows, count(*) filter (trim(species) <> '') as named from bold_minimal_records")
def t_01(spark, sf):
    """Counters of a batch job, taken while it writes."""
    from pyspark.sql import Observation

    seen = Observation("progress")
    rows = T(spark, sf, "bold_minimal_records").select("record_id", "species")
    rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.trim("species") != "").alias("named")).write.parquet(new(spark, "job"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["named"])], "rows long, named long")


@book.query("t_03_distinct_events", "select distinct event_id from events")
def t_03(spark, sf):
    base = new(spark, "distinct")
    schema = T(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema
    twice = f"{base}/in"
    for _ in range(2):
        T(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(twice)
    stream = streams.distinct_events(streams.file_stream(spark, twice, schema), ["event_id"], "ts", "3650 days")
    streams.write_available(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id")


@book.query("t_04_failures", "select event_id, value >= 10 as good from events")
def t_04(spark, sf):
    good, bad = streams.split_failures(T(spark, sf, "events"), F.col("value") >= 10)
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@book.query("t_05_backoff", "select 4 as calls, 7.0 as waited")
def t_05(spark, sf):
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("busy")
        return True

    ingest.with_backoff(call, jitter=0.0, sleep=waits.append)
    return spark.createDataFrame([(len(calls), float(sum(waits)))], "calls int, waited double")


@book.query("t_07_versions", "select 2 as version, count(*) as n from nation")
def t_07(spark, sf):
    base = new(spark, "versions")
    for v in (1, 2):
        T(spark, sf, "nation").limit(25 if v == 2 else 1).write.parquet(streams.versioned_path(base, v))
    return spark.read.parquet(streams.versioned_path(base, 2)).agg(F.count("*").alias("n")).select(F.lit(2).alias("version"), "n")
