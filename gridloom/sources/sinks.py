"""Writers: tables, summaries with preambles, reports, GeoJSON, manifests, upserts and repairs of written tables."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import latex
from gridloom.storage import drop_written

#: A report is a small table; more rows than this are refused rather than brought to the driver.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """One distributed write with headers; Spark's commit protocol leaves no partial file."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def _report(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the table instead")
    return rows


def preamble_text(df: DataFrame, metadata: dict[str, str]) -> str:
    """A small table as CSV text with "# key,value" lines before its header."""
    lines = [*(f"# {k},{v}" for k, v in metadata.items()), ",".join(df.columns), *(",".join("" if v is None else str(v) for v in r) for r in _report(df))]
    return "\n".join(lines) + "\n"


def csv_with_preamble(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A small CSV with "# key,value" lines before its header, as one file of the driver's."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(preamble_text(df, metadata))


def write_stata(df: DataFrame, path: str) -> None:
    """Stata files (version 118), one a partition, written where the rows lie; a task that is repeated replaces its own file."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        rows = list(batches)
        whole = pd.concat(rows) if rows else pd.DataFrame()
        if len(whole):
            raw = io.BytesIO()
            whole.to_stata(raw, write_index=False, version=118)
            fs, where = pafs.FileSystem.from_uri(path)
            fs.create_dir(where, recursive=True)
            with fs.open_output_stream(f"{where}/part-{TaskContext.get().partitionId():05d}.dta") as f:
                f.write(raw.getvalue())
        yield pd.DataFrame({"n": [len(whole)]})

    df.mapInPandas(part, "n long").agg(F.sum("n")).collect()


def mirror(spark, path: str, target: str) -> None:
    """An artefact copied as it is to where it is published, between any two file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"could not copy {path} to {target}")


def cached_table(spark, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table read from `path` where a former run finished writing it, else built and written there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def latex_table(df: DataFrame, caption: str) -> str:
    """A small table in LaTeX, its texts escaped."""
    rows = _report(df.select(*[latex(F.col(c).cast("string")).alias(c) for c in df.columns]))
    body = "\n".join(" & ".join(v or "" for v in r) + r" \\" for r in rows)
    names = " & ".join(c.replace("_", r"\_") for c in df.columns)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\hline\n{names} \\\\\n\\hline\n{body}\n\\hline\n\\end{{tabular}}\n\\end{{table}}\n"


def regression_table(fits: dict[str, object], digits: int = 3) -> str:
    """Coefficients with stars and standard errors, one column per model."""
    terms = list(dict.fromkeys(t for f in fits.values() for t in f.names))
    lines = [" & ".join(["", *fits]) + r" \\"]
    for t in terms:
        cells, ses = [t.replace("_", r"\_")], [""]
        for f in fits.values():
            if t in f.names:
                i = f.names.index(t)
                se = float(f.cov[i, i]) ** 0.5
                z = abs(float(f.beta[i])) / se if se > 0 else 0.0
                cells.append(f"{f.beta[i]:.{digits}f}" + "*" * sum(z > c for c in (1.645, 1.96, 2.576)))
                ses.append(f"({se:.{digits}f})")
            else:
                cells.append(""), ses.append("")
        lines += [" & ".join(cells) + r" \\", " & ".join(ses) + r" \\"]
    lines.append(" & ".join(["N", *(str(f.n) for f in fits.values())]) + r" \\")
    return "\n".join(lines) + "\n"


def markdown_report(df: DataFrame, title: str) -> str:
    rows = _report(df)
    table = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    return f"# {title}\n\n" + "\n".join(f"| {x} |" for x in table) + "\n"


def geojson_features(df: DataFrame, rings: str = "rings") -> DataFrame:
    """(feature): one GeoJSON feature text per row, all other columns as properties; write it with `write.text`."""
    props = [c for c in df.columns if c != rings]
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def file_manifest(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sha256_of(path: str) -> str:
    """One local file's digest, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The existing rows and those new ones whose key is not there; of new rows with one key one is kept. Null keys equal each other."""
    there = existing.select(*[F.col(k).alias(f"_there_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in keys])
    return existing.unionByName(new.dropDuplicates(keys).join(there, same, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the new row that is last in `order`, else the existing one."""
    from gridloom.operators.joins import latest_by

    last = latest_by(new, keys, [F.col(order)])
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def patch(existing: DataFrame, mapping: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`column` replaced where the mapping (keys..., column; unique by key) has a non-null value; other rows as they are."""
    fresh = mapping.select(*keys, F.col(column).alias("_new"))
    return existing.join(fresh, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*existing.columns)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table that `df` may itself read: written beside it, then renamed over it."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    df.write.parquet(fresh)
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    drop_written(spark, path)
    if not fs.rename(new, old):
        raise OSError(f"could not move {fresh} to {path}")
