"""Polygons, lines and rasters against points and equal-area cells.

Cells are axis-aligned squares in EPSG:6933, so covering, clipping and zonal labels are arithmetic: shapes are cut to
the cells their bounding boxes touch, joined by cell key, and clipped exactly in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo


def ring_area(ring: np.ndarray) -> float:
    """Shoelace area of an (n, 2) ring, open or closed."""
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def inside(px: np.ndarray, py: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings (holes are rings too); points on an edge may fall on either side."""
    odd = np.zeros(len(px), dtype=bool)
    for ring in rings:
        x, y = ring[:, 0], ring[:, 1]
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        for a, b, c, d in zip(x, y, x2, y2):
            if b != d:
                crosses = (b > py) != (d > py)
                odd ^= crosses & (px < (c - a) * (py - b) / (d - b) + a)
    return odd


def clip_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Sutherland-Hodgman: the ring cut to a rectangle."""
    pts = [tuple(p) for p in ring]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    for axis, limit, keep_less in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        out = []
        for i, p in enumerate(pts):
            q = pts[i - 1]
            p_in = p[axis] <= limit if keep_less else p[axis] >= limit
            q_in = q[axis] <= limit if keep_less else q[axis] >= limit
            if p_in != q_in:
                t = (limit - q[axis]) / (p[axis] - q[axis])
                cut = (limit, q[1] + t * (p[1] - q[1])) if axis == 0 else (q[0] + t * (p[0] - q[0]), limit)
                out.append(cut)
            if p_in:
                out.append(p)
        pts = out
        if not pts:
            break
    return np.array(pts, dtype=float).reshape(-1, 2)


def clip_length(line: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Liang-Barsky: the length of a polyline within a rectangle."""
    total = 0.0
    for (ax, ay), (bx, by) in zip(line[:-1], line[1:]):
        dx, dy, t0, t1 = bx - ax, by - ay, 0.0, 1.0
        for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if t1 > t0:
            total += (t1 - t0) * math.hypot(dx, dy)
    return total


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, how: str = "inner", bucket: float = 2.0) -> DataFrame:
    """(point_id, polygon_id): points (lon, lat) within polygons (rings array<array<struct<lon,lat>>>); how: inner or left.

    Both sides meet in squares of `bucket` degrees (a polygon in all its bounding box touches); the exact test follows. With
    how="left" points in no polygon come with a null. Overlapping polygons give several rows. Null rings hold nothing."""
    square = lambda v, low: F.floor((v - low) / bucket).cast("int")
    pts = points.select(point_id, F.col("lon").alias("px"), F.col("lat").alias("py")).withColumn("bx", square(F.col("px"), -180.0)).withColumn("by", square(F.col("py"), -90.0))
    flat = F.flatten("rings")
    lo = lambda f: F.array_min(F.transform(flat, lambda p: p[f]))
    hi = lambda f: F.array_max(F.transform(flat, lambda p: p[f]))
    polys = polygons.select(polygon_id, "rings").where(F.size("rings") > 0)
    polys = polys.withColumn("bx", F.explode(F.sequence(square(lo("lon"), -180.0), square(hi("lon"), -180.0)))).withColumn("by", F.explode(F.sequence(square(lo("lat"), -90.0), square(hi("lat"), -90.0))))
    pairs = pts.join(polys, ["bx", "by"]).select(point_id, "px", "py", polygon_id, "rings")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for _, rows in b.reset_index(drop=True).groupby(polygon_id, sort=False).groups.items():
                own = b.iloc[rows]
                rings = [np.array([(p["lon"], p["lat"]) for p in r], dtype=float) for r in own["rings"].iloc[0]]
                keep[rows] = inside(own["px"].to_numpy(), own["py"].to_numpy(), rings)
            yield b.loc[keep, [point_id, polygon_id]]

    found = pairs.mapInPandas(test, pairs.select(point_id, polygon_id).schema)
    if how == "inner":
        return found
    return points.select(point_id).join(found, point_id, "left")


def cell_shares(polygons: DataFrame, polygon_id: str, cell_m: float = 100_000) -> DataFrame:
    """(polygon_id, cell_id, area_km2): each polygon's area in every cell it touches, by exact clipping.

    `ring` is array<struct<x,y>> in EPSG:6933 metres (one row per ring; several rings of an id add up). Empty rings give none."""
    at = lambda f: F.transform("ring", lambda p: p[f])
    cell = lambda v: F.floor(v / cell_m).cast("int")
    covered = (
        polygons.where(F.size("ring") >= 3)
        .withColumn("cx", F.explode(F.sequence(cell(F.array_min(at("x"))), cell(F.array_max(at("x"))))))
        .withColumn("cy", F.explode(F.sequence(cell(F.array_min(at("y"))), cell(F.array_max(at("y"))))))
        .select(polygon_id, "ring", "cx", "cy")
    )

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            areas = []
            for ring, cx, cy in zip(b["ring"], b["cx"], b["cy"]):
                r = np.array([(p["x"], p["y"]) for p in ring], dtype=float)
                cut = clip_ring(r, cx * cell_m, cy * cell_m, (cx + 1) * cell_m, (cy + 1) * cell_m)
                areas.append(ring_area(cut) / 1e6 if len(cut) >= 3 else 0.0)
            yield b[[polygon_id, "cx", "cy"]].assign(area_km2=areas)

    kind = polygons.schema[polygon_id].dataType.simpleString()
    out = covered.mapInPandas(clip, f"`{polygon_id}` {kind}, cx int, cy int, area_km2 double")
    return out.where(F.col("area_km2") > 0).groupBy(polygon_id, F.concat_ws("_", "cx", "cy").alias("cell_id")).agg(F.sum("area_km2").alias("area_km2"))


def line_lengths(lines: DataFrame, cell_m: float = 100_000) -> DataFrame:
    """(cell_id, length_km): the length of all lines (`line` array<struct<x,y>> in metres) in every cell."""
    segments = lines.where(F.size("line") >= 2).select(F.explode(F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))).alias("s"))
    s = segments.select(F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    cell = lambda v: F.floor(v / cell_m).cast("int")
    s = s.withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx"))))).withColumn("cy", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))))
    x0, y0 = F.col("cx") * cell_m, F.col("cy") * cell_m
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    lows, highs = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for p, q in ((-dx, F.col("ax") - x0), (dx, x0 + cell_m - F.col("ax")), (-dy, F.col("ay") - y0), (dy, y0 + cell_m - F.col("ay"))):
        lows.append(F.when(p < 0, q / p).otherwise(0.0))
        highs.append(F.when(p > 0, q / p).otherwise(1.0))
        outside = outside | ((p == 0) & (q < 0))
    part = F.greatest(F.lit(0.0), F.least(*highs) - F.greatest(*lows))
    km = F.when(outside, 0.0).otherwise(part * F.sqrt(dx * dx + dy * dy) / 1000)
    return s.withColumn("km", km).where(F.col("km") > 0).groupBy(F.concat_ws("_", "cx", "cy").alias("cell_id")).agg(F.sum("km").alias("length_km"))


def zonal(pixels: DataFrame, cells: DataFrame, keys: list[str] = (), cell_m: float = 100_000, empty_as_zero: bool = False, weight: str | None = None, valid=None) -> DataFrame:
    """(cell_id, keys..., n_pixels, zonal_sum, zonal_mean): pixel values (lon, lat, value) by cell, all cells kept.

    A pixel belongs to the cell around its centre. Null values, and those `valid` (a predicate on a column) refuses, are masked.
    Cells without a pixel have null means (0 where `empty_as_zero`). With `weight`, sums and means are weighted."""
    rows = pixels.where(F.col("value").isNotNull())
    if valid is not None:
        rows = rows.where(valid(F.col("value")))
    w = F.col(weight) if weight else F.lit(1.0)
    agg = rows.withColumn("cell_id", geo.cell_id(F.col("lon"), F.col("lat"), cell_m)).groupBy("cell_id", *keys).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(F.col("value") * w).alias("zonal_sum"), (F.sum(F.col("value") * w) / F.sum(w)).alias("zonal_mean"))
    out = cells.select("cell_id").distinct().join(agg, "cell_id", "left").na.fill(0, ["n_pixels"])
    return out.na.fill(0.0, ["zonal_sum", "zonal_mean"]) if empty_as_zero else out


def union_area_of(shapes: list[np.ndarray]) -> float:
    """The exact area that simple rings cover together: overlaps count once.

    A sweep over slabs: between neighbouring abscissas of vertices and crossings no two edges cross, so the covered height
    is linear in each slab and its value at the middle is its mean. Work is quadratic in the edges of the shapes given."""
    edges = []
    for n, ring in enumerate(shapes):
        a, b = ring, np.roll(ring, -1, axis=0)
        for (x0, y0), (x1, y1) in zip(a, b):
            if x0 != x1:
                edges.append((n, *((x0, y0, x1, y1) if x0 < x1 else (x1, y1, x0, y0))))
    if not edges:
        return 0.0
    e = np.array([x[1:] for x in edges], dtype=float)
    owner = np.array([x[0] for x in edges])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    stops = [e[:, 0], e[:, 2]]
    for i in range(len(e) - 1):
        other = slope[i + 1 :] != slope[i]
        x = (base[i + 1 :][other] - base[i]) / (slope[i] - slope[i + 1 :][other])
        low, high = np.maximum(e[i, 0], e[i + 1 :, 0][other]), np.minimum(e[i, 2], e[i + 1 :, 2][other])
        stops.append(x[(x > low) & (x < high)])
    xs = np.unique(np.concatenate(stops))
    total = 0.0
    for left, right in zip(xs, xs[1:]):
        middle = (left + right) / 2
        here = np.flatnonzero((e[:, 0] <= left) & (e[:, 2] >= right))
        y = base[here] + slope[here] * middle
        spans = []
        for n in np.unique(owner[here]):
            own = np.sort(y[owner[here] == n])
            spans += list(zip(own[::2], own[1::2]))  # a simple ring: in and out in turn
        top = -math.inf
        for low, high in sorted(spans):
            total += max(0.0, high - max(low, top)) * (right - left)
            top = max(top, high)
    return total


def union_area(df: DataFrame, keys: list[str], ring: str) -> DataFrame:
    """(keys..., area): the area that the rings (arrays of (lon, lat) or (x, y) in one plane) of every key cover together.

    For shapes already cut to cells (`cell_shares`), so that a key holds what touches one cell. Null rings count nothing."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def covered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shapes = [np.array([tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in r], dtype=float).reshape(-1, 2) for r in rows[ring]]
        return pd.DataFrame([(*key, union_area_of([s for s in shapes if len(s) >= 3]))], columns=[*keys, "area"])

    return df.where(F.col(ring).isNotNull()).select(*keys, ring).groupBy(*keys).applyInPandas(covered, f"{kinds}, area double")


def clean_parts(df: DataFrame, rings: str) -> DataFrame:
    """Multipart shapes exploded into clean rings (`ring`, in place of `rings`): repeated points dropped, open rings closed, rings without an area left out."""
    at = lambda r, i: F.get(r, i)
    single = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != at(r, i - 1)))
    part = df.withColumn("ring", F.explode(rings)).drop(rings).withColumn("ring", single(F.col("ring")))
    part = part.where(F.size(F.array_distinct("ring")) >= 3)
    return part.withColumn("ring", F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))))
