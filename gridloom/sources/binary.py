"""Binary formats without their native libraries: SQLite tables, Stata files, shapefiles, GeoJSON, ASCII grids, GeoTIFFs, classic NetCDF cubes."""

from __future__ import annotations

import io
import math
import os
import sqlite3
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, block: int = 50_000) -> DataFrame:
    """The rows of a query on SQLite files; each file is one task, rows come in blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # a task's own scratch copy, gone with it
                    f.write(content)
                    f.flush()
                    con = sqlite3.connect(f.name)
                    try:
                        yield from pd.read_sql_query(query, con, chunksize=block)
                    finally:
                        con.close()

    return _files(spark, path).mapInPandas(rows, schema)


def read_stata(spark: SparkSession, path: str, columns: list[str], schema: str, block: int = 50_000) -> DataFrame:
    """Projected columns of Stata .dta files, each file one task, in blocks of rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with pd.read_stata(io.BytesIO(content), columns=columns, chunksize=block) as reader:
                    for chunk in reader:
                        yield chunk[columns]

    return _files(spark, path).mapInPandas(rows, schema)


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """(properties..., rings array<array<struct<lon,lat>>>): Polygon and MultiPolygon features; other types are left out."""
    doc = spark.read.text(path, wholetext=True)
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    feats = doc.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    g = F.col("f.geometry")
    poly = F.from_json(g["coordinates"], "array<array<array<double>>>")
    multi = F.flatten(F.from_json(g["coordinates"], "array<array<array<array<double>>>>"))
    rings = F.when(g["type"] == "Polygon", poly).when(g["type"] == "MultiPolygon", multi)
    named = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return feats.select(*[F.col("f.properties").getItem(p).alias(p) for p in properties], named.alias("rings")).where(F.col("rings").isNotNull())


def shapefile_rings(content: bytes) -> Iterator[list[np.ndarray]]:
    """The rings of every record of a .shp file (Polygon or PolyLine types; null shapes give none)."""
    at = 100
    while at + 8 <= len(content):
        length = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
        body = content[at + 8 : at + 8 + length]
        at += 8 + length
        kind = struct.unpack("<i", body[:4])[0]
        if kind not in (3, 5, 13, 15, 23, 25):
            yield []
            continue
        parts, points = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = np.frombuffer(body, dtype="<f8", count=points * 2, offset=44 + 4 * parts).reshape(-1, 2)
        yield [xy[a:b] for a, b in zip(starts, starts[1:])]


def dbf_rows(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """The attribute rows of a .dbf file as text, deleted ones included (they align with the shapes)."""
    n, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for i in range(n):
        row, pos = content[head + i * width : head + (i + 1) * width], 1
        out = {}
        for name, size in fields:
            out[name] = row[pos : pos + size].decode(encoding, "replace").strip()
            pos += size
        yield out


def read_shapefile(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """(properties..., rings): shapefiles (.shp with their .dbf beside them), one task per file."""
    shp = _files(spark, path).select(F.regexp_replace("path", r"\.shp$", "").alias("stem"), F.col("content").alias("shp"))
    dbf = _files(spark, path.replace(".shp", ".dbf")).select(F.regexp_replace("path", r"\.dbf$", "").alias("stem"), F.col("content").alias("dbf"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, d in zip(b["shp"], b["dbf"]):
                out = [[*(a.get(p, "") for p in properties), [[{"lon": float(x), "lat": float(y)} for x, y in r] for r in rings]] for rings, a in zip(shapefile_rings(s), dbf_rows(d))]
                yield pd.DataFrame(out, columns=[*properties, "rings"])

    schema = ", ".join([*(f"`{p}` string" for p in properties), "rings array<array<struct<lon:double,lat:double>>>"])
    return shp.join(dbf, "stem").mapInPandas(rows, schema)


def read_ascii_grid(spark: SparkSession, path: str, block_rows: int = 500) -> DataFrame:
    """(raster, row, col, lon, lat, value) of Arc/Info ASCII grids: pixel centres, north up, NODATA as null."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                f = io.BytesIO(content)
                head = {}
                while len(head) < 6:
                    at = f.tell()
                    k, *v = f.readline().decode().split()
                    if not k[0].isalpha():
                        f.seek(at)
                        break
                    head[k.lower()] = float(v[0])
                size, cols, n = head["cellsize"], int(head["ncols"]), int(head["nrows"])
                half = size / 2
                x0 = head["xllcorner"] + half if "xllcorner" in head else head["xllcenter"]
                y0 = head["yllcorner"] + half if "yllcorner" in head else head["yllcenter"]
                for start in range(0, n, block_rows):
                    take = min(block_rows, n - start)
                    values = np.array([f.readline().split() for _ in range(take)], dtype=float)
                    r, c = np.meshgrid(np.arange(start, start + take), np.arange(cols), indexing="ij")
                    flat = values.ravel()
                    flat[flat == head.get("nodata_value", -9999.0)] = np.nan
                    out = pd.DataFrame({"raster": os.path.basename(p), "row": r.ravel(), "col": c.ravel(), "lon": x0 + c.ravel() * size, "lat": y0 + (n - 1 - r.ravel()) * size})
                    out["value"] = pd.array(flat, dtype="Float64")
                    yield out

    return _files(spark, path).mapInPandas(rows, "raster string, row int, col int, lon double, lat double, value double")


def pixels_of_cube(cube: DataFrame, time: str = "time") -> DataFrame:
    """Pixel rows (time, lon, lat, value) of a cube stored as one row per (time, lat) with an array of values over `lons`."""
    return cube.select(time, "lat", F.explode(F.arrays_zip("lons", "values")).alias("p")).select(time, F.col("p.lons").alias("lon"), "lat", F.col("p.values").alias("value"))


#: The classic NetCDF types by number (byte, char, short, int, float, double), big-endian.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def _pad(n: int) -> int:
    return -n % 4


def netcdf_bytes(axes: dict[str, np.ndarray], name: str, values: np.ndarray, fill: float | None = None) -> bytes:
    """A classic NetCDF file (64-bit offsets): one variable of doubles over the axes, each axis with its coordinates."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * _pad(len(s))
    number = lambda key, x: struct.pack(">ii", 12, 1) + text(key) + struct.pack(">iid", 6, 1, x)
    none = struct.pack(">ii", 0, 0)
    dims = struct.pack(">ii", 10, len(axes)) + b"".join(text(k) + struct.pack(">i", len(v)) for k, v in axes.items())
    variables = [(k, [i], v) for i, (k, v) in enumerate(axes.items())] + [(name, list(range(len(axes))), values)]

    def header(offsets: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", 0) + dims + none + struct.pack(">ii", 11, len(variables))
        for (k, ids, v), at in zip(variables, offsets):
            attributes = number("_FillValue", fill) if k == name and fill is not None else none
            out += text(k) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + attributes + struct.pack(">iiq", 6, v.size * 8, at)
        return out

    at, offsets = len(header([0] * len(variables))), []
    for _, _, v in variables:
        offsets.append(at)
        at += v.size * 8
    return header(offsets) + b"".join(np.ascontiguousarray(v, dtype=">f8").tobytes() for _, _, v in variables)


def parse_netcdf(content: bytes) -> tuple[dict[str, int], dict[str, tuple[list[str], dict, np.ndarray]]]:
    """(dimensions, variables: name -> (dimension names, attributes, values)) of a classic NetCDF file (CDF-1 or CDF-2)."""
    if content[:3] != b"CDF" or content[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    at, wide = 8, content[3] == 2
    n_records = struct.unpack(">i", content[4:8])[0]

    def integer() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", content[at - 4 : at])[0]

    def text() -> str:
        nonlocal at
        n = integer()
        s = content[at : at + n].decode()
        at += n + _pad(n)
        return s

    def attributes() -> dict:
        nonlocal at
        _, n, out = integer(), integer(), {}
        for _ in range(n):
            key, kind, count = text(), integer(), integer()
            size = np.dtype(NC_TYPES[kind]).itemsize * count
            raw = content[at : at + size]
            at += size + _pad(size)
            out[key] = raw.decode() if kind == 2 else np.frombuffer(raw, NC_TYPES[kind])
        return out

    _, n_dims = integer(), integer()
    dims = [(text(), integer()) for _ in range(n_dims)]
    attributes()
    _, n_vars = integer(), integer()
    found = []
    for _ in range(n_vars):
        name, rank = text(), integer()
        ids = [integer() for _ in range(rank)]
        own, kind, size = attributes(), integer(), integer()
        begin = struct.unpack(">q" if wide else ">i", content[at : at + (8 if wide else 4)])[0]
        at += 8 if wide else 4
        found.append((name, ids, own, kind, size, begin))
    per_record = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    stride = sum(v[4] for v in per_record) if len(per_record) != 1 else int(np.prod([dims[i][1] for i in per_record[0][1][1:]])) * np.dtype(NC_TYPES[per_record[0][3]]).itemsize
    out = {}
    for name, ids, own, kind, _, begin in found:
        shape = [dims[i][1] for i in ids]
        if ids and shape[0] == 0:  # the record dimension: one piece a record
            shape[0], piece = n_records, int(np.prod(shape[1:]))
            values = np.stack([np.frombuffer(content, NC_TYPES[kind], piece, begin + r * stride) for r in range(n_records)]) if n_records else np.empty(0)
        else:
            values = np.frombuffer(content, NC_TYPES[kind], int(np.prod(shape)), begin)
        out[name] = ([dims[i][0] for i in ids], own, values.reshape(shape))
    return {k: n for k, n in dims}, out


def read_netcdf(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(file, time, lat, lon, value) of a (time, lat, lon) variable of classic NetCDF files, one task a file, a time step at a time.

    The variable is found by name, whatever its case; scale, offset and missing values are applied; latitudes may run either way."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                _, variables = parse_netcdf(content)
                low = {k.lower(): k for k in variables}
                if variable.lower() not in low:
                    raise ValueError(f"{p} has no variable {variable}")
                names, own, cube = variables[low[variable.lower()]]
                times, lats, lons = (variables[n][2].astype(float) if n in variables else np.arange(cube.shape[k], dtype=float) for k, n in enumerate(names))
                missing = [own[k][0] for k in ("_FillValue", "missing_value") if k in own]
                scale, offset = float(own.get("scale_factor", [1.0])[0]), float(own.get("add_offset", [0.0])[0])
                lat, lon = np.meshgrid(lats, lons, indexing="ij")
                for k, t in enumerate(times):
                    step = cube[k]
                    value = step.astype(float) * scale + offset
                    for m in missing:
                        value[step == m] = np.nan
                    yield pd.DataFrame({"file": os.path.basename(p), "time": t, "lat": lat.ravel(), "lon": lon.ravel(), "value": pd.array(value.ravel(), dtype="Float64")})

    return _files(spark, path).mapInPandas(rows, "file string, time double, lat double, lon double, value double")


#: TIFF field types by number and their sizes, and the tags that are read.
TIFF_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "samples", 278: "rows_per_strip", 279: "sizes", 317: "predictor", 322: "tile_width", 324: "tiles", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata"}


def geotiff_bytes(values: np.ndarray, west: float, north: float, size: float, nodata: float | None = None) -> bytes:
    """A north-up GeoTIFF of one band of 32-bit floats in deflated strips of a row each."""
    strips = [zlib.compress(np.ascontiguousarray(r, dtype="<f4").tobytes()) for r in values]
    h, w = values.shape
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32]), (259, 3, [8]), (273, 4, [0] * h), (277, 3, [1]), (278, 4, [1]), (279, 4, [len(s) for s in strips]), (339, 3, [3]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
    if nodata is not None:
        tags.append((42113, 2, [c.encode() for c in f"{nodata:g}\0"]))
    table = 8 + 2 + 12 * len(tags) + 4

    def layout(first: int) -> bytes:
        """The directory and the values that do not fit into it, with strips from `first` on."""
        at, entries, more = table, b"", b""
        for tag, kind, v in tags:
            if tag == 273:
                v = [first + sum(len(s) for s in strips[:k]) for k in range(h)]
            raw = struct.pack(f"<{len(v)}{TIFF_TYPES[kind]}", *v)
            if len(raw) <= 4:
                entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
            else:
                entries += struct.pack("<HHII", tag, kind, len(v), at)
                more, at = more + raw, at + len(raw)
        return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + more

    return layout(len(layout(0))) + b"".join(strips)


def parse_tiff(content: bytes) -> tuple[dict, Iterator[tuple[int, np.ndarray]]]:
    """(tags, pieces of rows of the first band: (first row, values)) of a classic TIFF in strips, raw or deflated."""
    order = "<" if content[:2] == b"II" else ">"
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict = {"compression": (1,), "samples": (1,), "predictor": (1,), "format": (1,)}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        e = at + 2 + 12 * k
        tag, kind, n = struct.unpack(order + "HHI", content[e : e + 8])
        if tag in TIFF_TAGS and kind in TIFF_TYPES:
            size = struct.calcsize("<" + TIFF_TYPES[kind]) * n
            where = e + 8 if size <= 4 else struct.unpack(order + "I", content[e + 8 : e + 12])[0]
            tags[TIFF_TAGS[tag]] = struct.unpack(f"{order}{n}{TIFF_TYPES[kind]}", content[where : where + size])
    if "strips" not in tags or tags["compression"][0] not in (1, 8, 32946) or tags["predictor"][0] != 1:
        raise ValueError("only raw or deflated strips without a predictor are read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags["format"][0]] + str(tags["bits"][0] // 8))
    width, height, samples = tags["width"][0], tags["height"][0], tags["samples"][0]
    per_strip = tags.get("rows_per_strip", (height,))[0]

    def pieces() -> Iterator[tuple[int, np.ndarray]]:
        for k, (start, size) in enumerate(zip(tags["strips"], tags["sizes"])):
            raw = content[start : start + size]
            raw = raw if tags["compression"][0] == 1 else zlib.decompress(raw)
            rows = min(per_strip, height - k * per_strip)
            yield k * per_strip, np.frombuffer(raw, dtype, rows * width * samples).reshape(rows, width, samples)[:, :, 0]

    return tags, pieces()


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(raster, row, col, lon, lat, value) of north-up GeoTIFFs: pixel centres of the first band, NODATA as null, a strip at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                tags, pieces = parse_tiff(content)
                (dx, dy, _), tie = tags["scale"], tags["tie"]
                west, north = tie[3] - tie[0] * dx, tie[4] + tie[1] * dy
                nodata = float(b"".join(tags["nodata"]).rstrip(b"\0 ")) if "nodata" in tags else math.nan
                for first, values in pieces:
                    r, c = np.meshgrid(np.arange(first, first + len(values)), np.arange(values.shape[1]), indexing="ij")
                    flat = values.astype(float).ravel()
                    flat[flat == nodata] = np.nan
                    out = pd.DataFrame({"raster": os.path.basename(p), "row": r.ravel(), "col": c.ravel(), "lon": west + (c.ravel() + 0.5) * dx, "lat": north - (r.ravel() + 0.5) * dy})
                    out["value"] = pd.array(flat, dtype="Float64")
                    yield out

    return _files(spark, path).mapInPandas(rows, "raster string, row int, col int, lon double, lat double, value double")
