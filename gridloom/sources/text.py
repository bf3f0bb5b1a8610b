"""Delimited and free text: projected scans, file discovery, provenance, schema-tolerant and archive reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPARK_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = ",", quote: str = '"', encoding: str = "UTF-8", mode: str = "PERMISSIVE", **options: str) -> DataFrame:
    """All listed columns as text, by header name; gzip and other Hadoop codecs are transparent.

    Needs the full header order in `columns` only for the first file's schema: columns are matched by name through an
    inferred header, then projected; a missing one raises. Short rows are padded with null (PERMISSIVE) or dropped
    (DROPMALFORMED)."""
    if encoding.lower() not in SPARK_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # lets the session read with any charset of the JVM
    df = spark.read.options(header=True, sep=sep, quote=quote, encoding=encoding, mode=mode, inferSchema=False, **options).csv(paths)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*columns)


def discover(spark: SparkSession, root: str, include: str = r"\.tsv$", exclude: str | None = None) -> list[str]:
    """Files below a folder whose path matches, sorted (through Hadoop's file system; the list is metadata, not data)."""
    import re

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        p = files.next().getPath().toString()
        if re.search(include, p) and not (exclude and re.search(exclude, p)):
            found.append(p)
    return sorted(found)


def with_provenance(df: DataFrame, root: str) -> DataFrame:
    """source_file (path below root) and source_group (its first folder) of every row of a file scan."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^(?:file|hdfs|s3a?)?:?/*", "/")
    below = F.regexp_replace(path, "^" + root.replace(".", r"\.").rstrip("/") + "/", "")
    return df.withColumn("source_file", below).withColumn("source_group", F.when(below.contains("/"), F.element_at(F.split(below, "/"), 1)).otherwise(F.lit("")))


def read_tolerant(spark: SparkSession, paths: list[str], wanted: list[str], sep: str = "\t") -> DataFrame:
    """Wanted columns of files with different headers, absent ones "", null "", malformed lines dropped.

    Files with the same header are read in one scan."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        head = spark.read.option("sep", sep).option("header", True).csv(p).columns
        by_header.setdefault(tuple(head), []).append(p)
    out = None
    for head, own in by_header.items():
        df = spark.read.schema(text_schema(list(head))).options(header=True, sep=sep, mode="DROPMALFORMED", columnPruning=False).csv(own)  # a pruned scan would not notice short lines
        part = df.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in head else F.lit("")).alias(c) for c in wanted])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], text_schema(wanted))


def read_darwin_core(spark: SparkSession, path: str, required: list[str], columns: list[str]) -> DataFrame:
    """A Darwin Core occurrence TSV: unquoted, short rows padded with null, required columns checked."""
    df = spark.read.options(header=True, sep="\t", quote="", mode="PERMISSIVE").csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_zip_member(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited member of ZIP archives, all text; archives are read in parallel, each by one task, in blocks of rows.

    A ZIP member has no split points; archives are bounded by what their publishers pack into one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    yield from (c[columns] for c in pd.read_csv(f, sep=sep, dtype=str, keep_default_na=False, chunksize=50_000))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, text_schema(columns))


def read_named_extras(spark: SparkSession, extras: dict[str, str], columns: list[str]) -> DataFrame:
    """Extra CSV sources {name: path} with the same columns, `source` added; no extras give an empty table."""
    out = spark.createDataFrame([], text_schema([*columns, "source"]))
    for name, path in extras.items():
        out = out.unionByName(read_delimited(spark, path, columns).withColumn("source", F.lit(name)))
    return out


def read_records(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Text lines that match a pattern, its groups as columns; other lines are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.trim(F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def read_with_units_row(spark: SparkSession, path: str, key: str, unit_value: str, null_value: str = " ") -> DataFrame:
    """A CSV whose second line holds units: that row (recognised by `unit_value` in column `key`) is left out."""
    df = spark.read.options(header=True, nullValue=null_value).csv(path)
    return df.where(F.col(key).isNull() | (F.trim(F.col(key)) != unit_value))


def probe(df: DataFrame, n: int = 5) -> tuple[list[str], list]:
    """Column names and the first rows (a look at a file, nothing more)."""
    return df.columns, df.limit(n).collect()


def file_audit(spark: SparkSession, paths: list[str], key: str, sep: str = "\t") -> DataFrame:
    """(file, bytes, n_rows, first_id, last_id) of delimited files."""
    df = spark.read.options(header=True, sep=sep).csv(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col(key).alias("k"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    return df.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows"), F.min_by("k", F.struct("start", "i")).alias("first_id"), F.max_by("k", F.struct("start", "i")).alias("last_id"))


def parse_flat_file(df: DataFrame, column: str) -> DataFrame:
    """(accession, pubmed_ids array) of GenBank-style flat-file entries, one entry per row of text."""
    entry = F.col(column)
    return df.select(F.upper(F.regexp_extract(entry, r"(?m)^ACCESSION\s+(\S+)", 1)).alias("accession"), F.array_distinct(F.regexp_extract_all(entry, F.lit(r"(?m)^\s+PUBMED\s+(\d+)"), F.lit(1))).alias("pubmed_ids")).where(F.col("accession") != "")
