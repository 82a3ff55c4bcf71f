"""Events by blocks against a plain union of all near pairs."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrachron.functions.geo import EARTH_M
from terrachron.operators import events

T0 = datetime(2026, 10, 4, 9)
ROW = "observation_id string, entity_id string, lat double, lon double, ts timestamp"


def apart(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def brute(rows, radius_m, window):
    up = {r[0]: r[0] for r in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if None not in (*a[2:], *b[2:]) and abs(a[4] - b[4]) <= window and apart(a, b) <= radius_m:
                x, y = sorted((root(a[0]), root(b[0])))
                up[y] = x
    return {(r[0], root(r[0])) for r in rows}


def clouds(rng, lat, lon, n, spread_m, ticks_s):
    """Rows around places some spreads from each other, so many events just touch or just don't."""
    out, metre = [], math.degrees(1 / EARTH_M)
    for i in range(n):
        hub = rng.randrange(6)
        y = lat + (hub % 3 * 2.2 * spread_m + rng.gauss(0, spread_m / 3)) * metre
        x = lon + (hub // 3 * 2.2 * spread_m + rng.gauss(0, spread_m / 3)) * metre / max(0.02, math.cos(math.radians(lat)))
        y = min(90.0, max(-90.0, y))
        x = (x + 180) % 360 - 180 if not -180 <= x <= 180 else x
        out.append((f"o{lat}:{lon}:{i:04d}", "e", y, x, T0 + timedelta(seconds=rng.randrange(ticks_s))))
    return out


@pytest.mark.parametrize("radius_m,seconds", [(100.0, 600), (40.0, 1), (600.0, 100)])
def test_events_equal_brute_force_at_every_latitude(spark, radius_m, seconds):
    rng, rows = random.Random(int(radius_m)), []
    for lat, lon in ((0.0, 0.0), (52.5, 13.4), (-33.0, 179.999), (89.9995, 10.0), (-89.99, -120.0), (71.0, -179.9995)):
        rows += clouds(rng, lat, lon, 90, 100.0, 3000)
    rows += [("null", "e", None, 1.0, T0), ("never", "e", 0.0, 0.0, None), ("west", "e", 10.0, -180.0, T0), ("east", "e", 10.0, 180.0, T0), ("pole", "e", 90.0, 77.0, T0), ("pole2", "e", 90.0, -103.0, T0)]
    window = timedelta(seconds=seconds)
    got = {tuple(r) for r in events.associate(spark.createDataFrame(rows, ROW), radius_m, window).collect()}
    assert got == brute(rows, radius_m, window) and len({e for _, e in got}) > 8


def test_blocks_with_many_places_are_compared_in_parts(spark, monkeypatch):
    """Two clouds whose outermost places are far apart and whose inner ones touch."""
    monkeypatch.setattr(events, "PART", 7)
    rng, metre, rows = random.Random(1), math.degrees(1 / EARTH_M), []
    for side, x0 in ((-1, -60.0), (1, 60.0)):
        # an arc bent to the other cloud: its ends by latitude, longitude and time aren't the nearest places
        for k in range(60):
            a = (k / 59 - 0.5) * 2.4
            rows.append((f"{'a' if side < 0 else 'b'}{k:02d}", "e", math.sin(a) * 20 * metre, (x0 - side * math.cos(a) * 10.5) * metre, T0 + timedelta(seconds=rng.randrange(100))))
    for radius_m in (98.5, 99.0, 99.5, 100.0, 101.0):
        got = {tuple(r) for r in events.associate(spark.createDataFrame(rows, ROW), radius_m, timedelta(seconds=200)).collect()}
        assert got == brute(rows, radius_m, timedelta(seconds=200))
    assert len({e for _, e in brute(rows, 98.5, timedelta(seconds=200))}) == 2 and len({e for _, e in brute(rows, 101.0, timedelta(seconds=200))}) == 1


def test_a_third_of_all_rows_in_one_cell(spark):
    """100,000 rows of one place and moment would make 5,000,000,000 pairs."""
    many = spark.range(100_000).select(F.format_string("m%06d", "id").alias("observation_id"), F.lit("e").alias("entity_id"), (F.lit(10.0) + F.col("id") % 300 * 1e-7).alias("lat"), (F.lit(20.0) + F.col("id") % 7 * 1e-7).alias("lon"), F.timestamp_seconds(F.lit(1_800_000_000) + F.col("id") % 60).alias("ts"))
    far = spark.range(200_000).select(F.format_string("x%06d", "id").alias("observation_id"), F.lit("e").alias("entity_id"), (F.col("id") % 1000 * 0.05 - 20).alias("lat"), (F.floor(F.col("id") / 1000) * 0.5 - 170).alias("lon"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    out = events.associate(many.unionByName(far), 200.0, timedelta(minutes=5)).groupBy("event").count().groupBy("count").agg(F.count("*").alias("n"), F.min("event").alias("e"))
    assert {tuple(r) for r in out.collect()} == {(100_000, 1, "m000000"), (1, 200_000, "x000000")}


def test_edges_of_the_range(spark):
    rows = [("a", "e", 1.0, 1.0, T0), ("b", "e", 1.0, 1.0, T0), ("c", "e", 1.0, 1.0, T0 + timedelta(microseconds=1)), ("d", "e", 1.0, 1.0 + 1e-9, T0)]
    obs = spark.createDataFrame(rows, ROW)
    told = lambda r, w: [x.event for x in events.associate(obs, r, w).orderBy("observation_id").collect()]
    assert told(0.0, timedelta(0)) == ["a", "a", "c", "d"]
    assert told(0.0, timedelta(microseconds=1)) == ["a", "a", "a", "d"] and told(1.0, timedelta(0)) == ["a", "a", "c", "a"]
    assert told(-1.0, timedelta(1)) == told(1.0, timedelta(-1)) == ["a", "b", "c", "d"]
    assert told(3e7, timedelta(1)) == ["a"] * 4
    assert events.associate(obs.limit(0), 5.0, timedelta(1)).count() == 0
