"""Points near other points: a sweep over latitude strips.

Latitude is cut into bands at least as high as the search distance. A histogram of the bands (bounded by their
number, whatever the input) is turned into strips of about equal row counts: sparse bands are put together, a
crowded one is cut by longitude into overlapping pieces (only a place where a single degree is still crowded is split
by a hash of its left points). Each left point has one owning strip; right points are repeated into every strip they
can reach. Within a strip both sides are sorted by latitude and swept: the active right points,
those within reach in latitude, are held in longitude order and probed by range; distances are then verified.
A pair is found only in its left point's strip, so it comes out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
STRIP_ROWS = 100_000
#: Pieces of a crowded band, by degrees of longitude.
SLOTS = 360


def _haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def sweep(left_lat: np.ndarray, left_lon: np.ndarray, right_lat: np.ndarray, right_lon: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (left positions, right positions, distances in km) of all pairs within `km`.

    Left points are taken in latitude order, in slabs no higher than the reach; the right points active for a slab
    are kept in longitude order (shifted copies beyond the date line included) and each left point probes its range.
    """
    if not len(left_lat) or not len(right_lat):
        return
    reach = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    lo, ro = np.argsort(left_lat, kind="stable"), np.argsort(right_lat, kind="stable")
    ll, rl = left_lat[lo], right_lat[ro]
    start = 0
    while start < len(ll):
        stop = int(np.searchsorted(ll, ll[start] + reach, side="right"))
        stop = min(stop, start + 50_000)
        low, high = ll[start] - reach, ll[stop - 1] + reach
        active = ro[np.searchsorted(rl, low, side="left") : np.searchsorted(rl, high, side="right")]
        slab = lo[start:stop]
        start = stop
        if not len(active):
            continue
        # Half width in longitude at the slab's highest absolute latitude; the whole circle near a pole.
        top = max(abs(low), abs(high))
        half = 180.0 if top >= 89.9 else min(180.0, math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(top))))) * (1 + 1e-9))
        lon = right_lon[active]
        index = np.concatenate([active, active[lon > 180 - half], active[lon < half - 180]])
        at = np.concatenate([lon, lon[lon > 180 - half] - 360, lon[lon < half - 180] + 360])
        order = np.argsort(at, kind="stable")
        index, at = index[order], at[order]
        first = np.searchsorted(at, left_lon[slab] - half, side="left")
        count = np.searchsorted(at, left_lon[slab] + half, side="right") - first
        begin = 0
        while begin < len(slab):
            # As many left points as give about a million candidates at a time: memory stays flat.
            end = begin + max(1, int(np.searchsorted(np.cumsum(count[begin:]), 1_000_000, side="right")))
            n = count[begin:end]
            left = np.repeat(slab[begin:end], n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            right = index[np.repeat(first[begin:end], n) + offset]
            km_apart = _haversine(left_lat[left], left_lon[left], right_lat[right], right_lon[right])
            near = km_apart <= km
            if half >= 180.0 or (near.any() and half > 90.0):  # shifted copies may then reach a point twice
                pairs = np.unique(np.stack([left[near], right[near]]), axis=1)
                yield pairs[0], pairs[1], _haversine(left_lat[pairs[0]], left_lon[pairs[0]], right_lat[pairs[1]], right_lon[pairs[1]])
            else:
                yield left[near], right[near], km_apart[near]
            begin = end


def _strips(left: DataFrame, height: float, strip_rows: int) -> tuple[list[tuple[int, bool]], list[tuple[int, int, int, int]]]:
    """(band, cut) for every band, and (band, slot, first strip, splits) for every band (slot -1) or slot of a cut band.

    Bands are at most 180 / height + 1; a band is cut only if it holds more than strip_rows rows."""
    band = F.floor((F.col("_lat") + 90.0) / height).cast("int").alias("band")
    counts = {r.band: r.n for r in left.groupBy(band).agg(F.count(F.lit(1)).alias("n")).collect()}
    crowded = [b for b, n in counts.items() if n > strip_rows]
    by_slot: dict[int, dict[int, int]] = {b: {} for b in crowded}
    if crowded:
        held = F.broadcast(left.sparkSession.createDataFrame([(b,) for b in crowded], "band int"))
        slots = left.select(band, _slot(F.col("_lon")).alias("slot")).join(held, "band").groupBy("band", "slot").agg(F.count(F.lit(1)).alias("n"))
        for r in slots.collect():  # at most SLOTS rows for each crowded band
            by_slot[r.band][r.slot] = r.n
    cut, out, strip, filled = [], [], 0, 0

    def place(b: int, slot: int, n: int) -> None:
        nonlocal strip, filled
        k = max(1, math.ceil(n / strip_rows))
        if filled and filled + n > strip_rows:
            strip, filled = strip + 1, 0
        out.append((b, slot, strip, k))
        filled += n
        if k > 1:
            strip, filled = strip + k, 0

    for b in range(math.floor(180 / height) + 1):
        cut.append((b, b in by_slot))
        if b in by_slot:
            for slot in range(SLOTS):
                place(b, slot, by_slot[b].get(slot, 0))
        else:
            place(b, -1, counts.get(b, 0))
    return cut, out


def _slot(lon: Column) -> Column:
    """The degree of longitude, 180 taken for -180."""
    return F.pmod(F.floor(lon + 180.0).cast("int"), F.lit(SLOTS))


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, keep: list[str] = (), lat: str = "lat", lon: str = "lon", strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(left_id, right_id, keep..., km double): every pair within `km` kilometres on the mean sphere, however many.

    `keep`: further columns of `left`. Rows with a null or NaN coordinate, or one out of range, meet nothing. Null ids
    are kept as ids. Repeated left rows give repeated pairs; repeated right rows count once. An empty side gives no rows. Works across the date
    line and at the poles; km up to a quarter of the circumference.
    """
    spark = left.sparkSession
    if left_id in keep or right_id in keep or left_id == right_id:
        raise ValueError("left_id, right_id and keep must be different names")
    ok = lambda: F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180)  # noqa: E731  NaN is greater than all numbers
    ls = left.select(F.col(left_id), *keep, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where(ok())
    rs = right.select(F.col(right_id), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where(ok())
    height = max(0.05, math.degrees(km / EARTH_KM) * (1 + 1e-9))
    top = math.floor(180 / height)
    bands, pieces = _strips(ls, height, strip_rows)
    bands = F.broadcast(spark.createDataFrame(bands, "_band int, _cut boolean"))  # at most 3,601 rows
    pieces = F.broadcast(spark.createDataFrame(pieces, "_band int, _slot int, _first int, _splits int"))  # and SLOTS for each crowded band
    band = F.floor((F.col("_lat") + 90.0) / height).cast("int")
    ls = ls.withColumn("_band", band).join(bands, "_band").withColumn("_slot", F.when(F.col("_cut"), _slot(F.col("_lon"))).otherwise(-1)).join(pieces, ["_band", "_slot"])
    ls = ls.withColumn("_strip", F.col("_first") + F.pmod(F.xxhash64(F.col(left_id), "_lat", "_lon"), F.col("_splits")).cast("int")).drop("_band", "_cut", "_slot", "_first", "_splits")
    reached = F.sequence(F.greatest(band - 1, F.lit(0)), F.least(band + 1, F.lit(top)))
    # Degrees of longitude within reach, seen from the farthest latitude a partner can have; near a pole all of them.
    far = F.abs("_lat") + height
    ratio = math.sin(min(km / EARTH_KM, math.pi / 2)) / F.cos(F.radians(far))
    span = F.when((far >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) * (1 + 1e-9))
    low, high = F.floor(F.col("_lon") + 180.0 - span).cast("int"), F.floor(F.col("_lon") + 180.0 + span).cast("int")
    slots = F.when(F.col("_cut"), F.transform(F.sequence(low, F.least(high, low + SLOTS - 1)), lambda x: F.pmod(x, F.lit(SLOTS)))).otherwise(F.array(F.lit(-1)))
    rs = rs.withColumn("_band", F.explode(reached)).join(bands, "_band").withColumn("_slot", F.explode(slots)).join(pieces, ["_band", "_slot"])
    rs = rs.withColumn("_strip", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_splits") - 1)))
    rs = rs.drop("_band", "_cut", "_slot", "_first", "_splits").distinct()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ls.schema if f.name in (left_id, *keep)] + [f"`{right_id}` {rs.schema[right_id].dataType.simpleString()}", "km double"])

    def of_strip(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(sweep(a["_lat"].to_numpy(), a["_lon"].to_numpy(), b["_lat"].to_numpy(), b["_lon"].to_numpy(), km))
        i = np.concatenate([f[0] for f in found]) if found else np.array([], dtype=int)
        j = np.concatenate([f[1] for f in found]) if found else np.array([], dtype=int)
        out = pd.DataFrame({c: a[c].to_numpy()[i] for c in (left_id, *keep)})
        out[right_id] = b[right_id].to_numpy()[j]
        out["km"] = np.concatenate([f[2] for f in found]) if found else np.array([], dtype=float)
        return out

    return ls.groupBy("_strip").cogroup(rs.groupBy("_strip")).applyInPandas(of_strip, schema).select(left_id, right_id, *keep, "km")
