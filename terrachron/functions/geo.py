"""Geometry on WGS84 degrees as column expressions; nothing here leaves whole-stage code."""

from __future__ import annotations

import math
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius in metres, and the geohash alphabet: fixed values.
EARTH_M = 6371008.8
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"

Ring = list[tuple[float, float]]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_M)


def boxes(lat: float, lon: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """One or two boxes (south, north, west, east) that cover a circle; all longitudes near a pole, two across the antimeridian."""
    if radius_m < 0:
        raise ValueError("a radius can't be negative")
    angle = radius_m / EARTH_M * (1 + 1e-9) + 1e-12
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90 or angle >= math.pi / 2:
        return [(max(south, -90.0), min(north, 90.0), -180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-9
    west, east = lon - wide, lon + wide
    if west < -180:
        return [(south, north, west + 360, 180.0), (south, north, -180.0, east)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def within(lat: float, lon: float, radius_m: float) -> Column:
    """Rows with ``lat`` and ``lon`` in the closed circle. The boxes reach the Parquet scan as range filters; the distance decides."""
    inside = F.lit(False)
    for s, n, w, e in boxes(lat, lon, radius_m):
        inside = inside | (F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return inside & (haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_m)


def in_ring(ring: Ring, lat: Column | None = None, lon: Column | None = None) -> Column:
    """Even-odd ray casting with half-open edges, in plain degrees; behind the ring's box, which the scan can use."""
    if len(ring) < 3:
        raise ValueError("a ring has three corners at least")
    lat, lon = F.col("lat") if lat is None else lat, F.col("lon") if lon is None else lon
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(ring, ring[1:] + ring[:1], strict=True):
        if a_lat != b_lat:
            x = F.lit(a_lon) + (lat - a_lat) * (b_lon - a_lon) / (b_lat - a_lat)
            crossings = crossings + ((F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)).cast("int") * (lon < x).cast("int")
    lats, lons = zip(*ring, strict=True)
    return lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)) & (crossings % 2 == 1)


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash of up to 12 characters: cell numbers of latitude and longitude, bits interleaved."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    number = lambda v, low, span, n: F.greatest(F.least(F.floor((v - low) / span * float(1 << n)).cast("long"), F.lit((1 << n) - 1)), F.lit(0).cast("long"))
    x, y = number(lon, -180.0, 360.0, n_lon), number(lat, -90.0, 180.0, n_lat)
    bit = lambda k: F.shiftright(x, n_lon - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, n_lat - 1 - k // 2).bitwiseAND(F.lit(1))
    letters = []
    for c in range(precision):
        value = sum((bit(5 * c + i) * (1 << (4 - i)) for i in range(1, 5)), bit(5 * c) * 16)
        letters.append(F.substring(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash_box(code: str) -> tuple[float, float, float, float]:
    """(south, north, west, east) of a geohash cell."""
    number, n_lon, n_lat, x, y = 0, 0, 0, 0, 0
    for c in code:
        number = number * 32 + GEOHASH.index(c)
    for k in range(5 * len(code)):
        b = number >> (5 * len(code) - 1 - k) & 1
        if k % 2 == 0:
            x, n_lon = x * 2 + b, n_lon + 1
        else:
            y, n_lat = y * 2 + b, n_lat + 1
    h, w = 180.0 / (1 << n_lat), 360.0 / (1 << n_lon)
    return -90 + y * h, -90 + (y + 1) * h, -180 + x * w, -180 + (x + 1) * w


def metric_cell(lat: Column, lon: Column, cell_m: float) -> tuple[Column, Column]:
    """(row, column) of near-square cells: rows by metres of latitude, in each row as many whole columns as its circle has."""
    step = 180.0 * cell_m / (math.pi * EARTH_M)
    row = F.floor(lat / step)
    around = F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians((row + 0.5) * step)) * (2 * math.pi * EARTH_M / cell_m)))
    return row, F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / around)), around)


def tight_cell(lat: Column, lon: Column, cell_m: float) -> tuple[Column, Column]:
    """(row, column) of cells at most ``cell_m`` high and wide, so any two points of one are at most twice that apart, at any latitude."""
    step = math.degrees(cell_m / EARTH_M)
    row = F.floor(lat / step)
    widest = F.least(F.greatest(row, -(row + 1)) * step, F.lit(90.0))
    columns = F.greatest(F.lit(1).cast("long"), F.ceil(F.cos(F.radians(widest)) * (2 * math.pi * EARTH_M / cell_m)))
    return row, _column(lon, columns)


def seconds(span: timedelta) -> Column:
    """A span of time as an interval, whole microseconds."""
    return F.make_dt_interval(F.lit(span.days), F.lit(0), F.lit(0), F.lit(Decimal(span.seconds) + Decimal(span.microseconds) / 1_000_000).cast("decimal(18,6)"))


def radius_cell(lat: Column, lon: Column, radius_m: float) -> tuple[Column, Column]:
    """(row, column) of cells in which points at most ``radius_m`` apart are neighbours (:func:`spread_cells`).

    Rows are one radius high. Each row has its own number of columns, as wide as two such
    points can lie apart there, so a row near a pole has few and doesn't widen the others.
    """
    row = F.floor(lat / _row_step(radius_m))
    return row, _column(lon, _columns(row, radius_m))


def spread_cells(df: DataFrame, radius_m: float, steps: list[tuple]) -> DataFrame:
    """Rows (lat, lon, ...) once for every cell that can hold points within ``radius_m``: adds row and column.

    ``steps``: (rows up from its own, further values named by the first of them) per row of cells that is asked for.
    """
    names, *steps = steps
    cells = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, step, strict=True)]) for step in steps])
    out = df.select("*", F.inline(cells)).withColumn("row", F.floor(F.col("lat") / _row_step(radius_m)) + F.col(names[0])).drop(names[0])
    # through a generator, so that the number of columns is worked out once
    out = out.select("*", F.inline(F.array(F.struct(_columns(F.col("row"), radius_m).alias("_columns")))))
    at = _column(F.col("lon"), F.col("_columns"))
    out = out.select("*", F.inline(F.array(F.struct(at.alias("_at")))))
    near = F.array_distinct(F.array(*[F.pmod(F.col("_at") + e, F.col("_columns")) for e in (-1, 0, 1)]))
    return out.withColumn("column", F.explode(near)).drop("_columns", "_at")


def _row_step(radius_m: float) -> float:
    return max(math.degrees(min(radius_m / EARTH_M, math.pi)) * (1 + 1e-9), 1e-7)


def _columns(row: Column, radius_m: float) -> Column:
    """Columns of a row: from the largest difference of longitude between a point in it and one at most ``radius_m`` away, in it or the next rows."""
    step = _row_step(radius_m)
    pole_side = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * step, F.lit(90.0))
    apart = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(math.radians(step), math.pi) / 2)) / F.greatest(F.cos(F.radians(pole_side)), F.lit(1e-12))))) * (2 * (1 + 1e-9))
    n = F.floor(F.lit(360.0) / F.greatest(apart, F.lit(1e-7)))
    return F.when(n >= 3, n).otherwise(F.lit(1).cast("long"))


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / columns)), columns)


def xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def variance_m2(uncertainty_m: Column, confidence: Column) -> Column:
    """Positional variance of an observation: at least one metre, wider where confidence is low."""
    return F.pow(F.greatest(uncertainty_m, F.lit(1.0)), 2) / F.greatest(confidence, F.lit(1e-3))
