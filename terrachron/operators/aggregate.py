"""Histograms, hotspots and zone counts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators.ranks import at_ranks
from terrachron.operators.search import at, radius_between
from terrachron.plans.tables import written


def activity(obs: DataFrame, lat: float, lon: float, radius_m: float, start: datetime, end: datetime, minutes: float, by: str | None = None, most: int = 5000) -> DataFrame:
    """bucket, bucket_start, n (and ``by``): tumbling counts from ``start`` on, empty buckets as 0."""
    width = max(1, round(minutes * 60_000_000))
    buckets = (end - start) // timedelta(microseconds=1) // width + 1
    if buckets > most:
        raise ValueError(f"more than {most} buckets")
    first = F.unix_micros(at(start))
    hits = radius_between(obs, lat, lon, radius_m, start, end).withColumn("bucket", F.floor((F.unix_micros("ts") - first) / width))
    keys = ["bucket"] + ([by] if by else [])
    counted = hits.groupBy(*keys).agg(F.count("*").alias("n"))
    frame = obs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    if by:
        # one row per bucket and value; at most ``most`` buckets
        frame = counted.select(by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return frame.join(counted, keys, "left").select(*keys, F.timestamp_micros(first + F.col("bucket") * width).alias("bucket_start"), F.coalesce("n", F.lit(0)).alias("n"))


def hotspots(obs: DataFrame, event_type: str, cell_m: float, least: int) -> DataFrame:
    """Cells with at least ``least`` events of a type: cell_row, cell_col, n, entities (distinct)."""
    row, col = geo.metric_cell(F.col("lat"), F.col("lon"), cell_m)
    own = obs.where(F.col("event_type") == event_type).select(row.alias("cell_row"), col.alias("cell_col"), "entity_id")
    return own.groupBy("cell_row", "cell_col").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities")).where(F.col("n") >= least)


def top_hotspots(obs: DataFrame, cell_m: float, top: int = 20, sample: int = 20) -> DataFrame:
    """The ``top`` cells by count: cell_row, cell_col, n, lat and lon (means), sources (counts, "name:n" by name), sample (first ids, joined)."""
    row, col = geo.metric_cell(F.col("lat"), F.col("lon"), cell_m)
    own = obs.withColumn("cell_row", row).withColumn("cell_col", col)
    cell = ["cell_row", "cell_col"]
    part = own.groupBy(*cell, "source_id").agg(F.count("*").alias("c"), F.sum("lat").alias("y"), F.sum("lon").alias("x"))
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source_id", "c"))), ",")
    best = part.groupBy(*cell).agg(F.sum("c").alias("n"), (F.sum("y") / F.sum("c")).alias("lat"), (F.sum("x") / F.sum("c")).alias("lon"), named.alias("sources")).orderBy(F.desc("n"), *cell).limit(top)
    # at most ``top`` rows
    ids = own.select(*cell, "observation_id").join(F.broadcast(best.select(*cell)), cell)
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("observation_id"))).where(F.col("k") <= sample)
    ids = ids.groupBy(*cell).agg(F.array_join(F.array_sort(F.collect_list("observation_id")), ",").alias("sample"))
    return best.join(ids, cell)


def hotspot_evidence(obs: DataFrame, event_type: str, cell_m: float, least: int) -> DataFrame:
    """The observations behind :func:`hotspots`, a row each: cell_row, cell_col, entity_id, observation_id."""
    row, col = geo.metric_cell(F.col("lat"), F.col("lon"), cell_m)
    own = obs.where(F.col("event_type") == event_type).select(row.alias("cell_row"), col.alias("cell_col"), "entity_id", "observation_id")
    cells = own.groupBy("cell_row", "cell_col").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cell_row", "cell_col")
    return own.join(cells, ["cell_row", "cell_col"])


def densest_cells(obs: DataFrame, cell_deg: float, k: int = 5) -> DataFrame:
    """The ``k`` cells of rounded degrees with most observations: cell_row, cell_col, n, and the place of their smallest observation_id."""
    own = obs.select(F.bround(F.col("lat") / cell_deg).cast("long").alias("cell_row"), F.bround(F.col("lon") / cell_deg).cast("long").alias("cell_col"), "observation_id", "lat", "lon")
    best = own.groupBy("cell_row", "cell_col").agg(F.count("*").alias("n"), F.min_by(F.struct("lat", "lon"), "observation_id").alias("p"))
    return best.orderBy(F.desc("n"), "cell_row", "cell_col").limit(k).select("cell_row", "cell_col", "n", "p.lat", "p.lon")


def hour_of_week(obs: DataFrame, cell_deg: float, least: int = 100) -> DataFrame:
    """cell_row, cell_col, hour_of_week (Monday 0 is 0), n: cells with ``least`` observations in all."""
    own = obs.select(F.floor(F.col("lat") / cell_deg).alias("cell_row"), F.floor(F.col("lon") / cell_deg).alias("cell_col"), (F.weekday("ts") * 24 + F.hour("ts")).alias("hour_of_week"))
    part = own.groupBy("cell_row", "cell_col", "hour_of_week").agg(F.count("*").alias("n"))
    return part.withColumn("all", F.sum("n").over(Window.partitionBy("cell_row", "cell_col"))).where(F.col("all") >= least).drop("all")


def typical_week(obs: DataFrame, cell_deg: float, least: int = 100) -> DataFrame:
    """Observations in each hour of a typical week: cell_row, cell_col, hour_of_week, value, weeks.

    ``value`` is ten times the average over the ISO weeks that occur (``weeks``), rounded half to even, 168
    hours for each cell with ``least`` observations. The rows whose cell is null are the whole
    data: averages, not times ten, over all cells.
    """
    weeks = obs.select(F.extract(F.lit("YEAROFWEEK"), "ts").alias("y"), F.weekofyear("ts").alias("w")).distinct().agg(F.count("*").alias("weeks"))
    counted = hour_of_week(obs, cell_deg, least)
    hours = F.explode(F.sequence(F.lit(0), F.lit(167))).alias("hour_of_week")
    frame = counted.select("cell_row", "cell_col").distinct().select("*", hours)
    cells = frame.join(counted, ["cell_row", "cell_col", "hour_of_week"], "left").select("cell_row", "cell_col", "hour_of_week", (F.coalesce("n", F.lit(0)) * 10).alias("n"))
    none = F.lit(None).cast("long")
    city = obs.sparkSession.range(168).select(F.col("id").cast("int").alias("hour_of_week")).join(obs.groupBy((F.weekday("ts") * 24 + F.hour("ts")).alias("hour_of_week")).agg(F.count("*").alias("n")), "hour_of_week", "left")
    city = city.select(none.alias("cell_row"), none.alias("cell_col"), "hour_of_week", F.coalesce("n", F.lit(0)).alias("n"))
    # one row by construction
    return cells.unionByName(city).join(F.broadcast(weeks)).select("cell_row", "cell_col", "hour_of_week", F.bround(F.col("n") / F.col("weeks")).cast("long").alias("value"), "weeks")


@dataclass(frozen=True)
class ZoneGrid:
    """A grid of zones whose south-west corner lies on a multiple of the cell less half a quantum (5e-5 degrees)."""

    lat0: float
    lon0: float
    rows: int
    columns: int
    cell_deg: float

    @staticmethod
    def over(valid: DataFrame, cell_deg: float) -> ZoneGrid | None:
        south, north, west, east = valid.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
        if south is None:
            return None
        corner = lambda v: math.floor(v / cell_deg) * cell_deg - 5e-5
        count = lambda v, low: math.ceil((v - low) / cell_deg) + 1
        return ZoneGrid(corner(south), corner(west), count(north, corner(south)), count(east, corner(west)), cell_deg)

    def zone_id(self) -> Column:
        return (F.floor((F.col("lat") - self.lat0) / self.cell_deg) * self.columns + F.floor((F.col("lon") - self.lon0) / self.cell_deg)).cast("long")

    def corner(self) -> tuple[Column, Column]:
        """(zlat, zlon) of a row's zone_id."""
        row = F.floor(F.col("zone_id") / self.columns)
        return F.lit(self.lat0) + row * self.cell_deg, F.lit(self.lon0) + (F.col("zone_id") - row * self.columns) * self.cell_deg


def valid_places(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("ts").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def zones(obs: DataFrame, cell_deg: float) -> DataFrame:
    """Valid rows with ``zone_id``, zlat and zlon (the zone's south-west corner).

    Zones tile the plane, so the join of points and zones is arithmetic. Data on a lattice of 1e-4
    degrees never lies on an edge; finer data that does belongs to the zone north or east of it.
    """
    ok = valid_places(obs)
    grid = ZoneGrid.over(ok, cell_deg)
    if grid is None:
        return ok.select("*", F.lit(None).cast("long").alias("zone_id"), F.lit(None).cast("double").alias("zlat"), F.lit(None).cast("double").alias("zlon"))
    ok = ok.withColumn("zone_id", grid.zone_id())
    zlat, zlon = grid.corner()
    return ok.withColumns({"zlat": zlat, "zlon": zlon})


def zone_hours(obs: DataFrame, cell_deg: float) -> DataFrame:
    """zone_id, hour, source_id, n."""
    return zones(obs, cell_deg).groupBy("zone_id", F.date_trunc("hour", "ts").alias("hour"), "source_id").agg(F.count("*").alias("n"))


def zone_totals(obs: DataFrame, cell_deg: float) -> DataFrame:
    """zone_id, n, zlat, zlon."""
    return zones(obs, cell_deg).groupBy("zone_id").agg(F.count("*").alias("n"), F.first("zlat").alias("zlat"), F.first("zlon").alias("zlon"))


def zone_report(obs: DataFrame, cell_deg: float, out: str | None = None) -> DataFrame:
    """One row: rows_in, valid, invalid, joined, zones (of the grid), hourly_rows; writes zone_hour_counts and zone_totals below ``out`` if that is given.

    ``joined`` is the sum of the hourly counts, so it equals ``valid`` unless a row was lost.
    """
    ok = valid_places(obs)
    grid = ZoneGrid.over(ok, cell_deg)
    hourly = written(zone_hours(obs, cell_deg), "zone-hours")
    if out:
        hourly.write.mode("overwrite").parquet(f"{out}/zone_hour_counts")
        zone_totals(obs, cell_deg).write.mode("overwrite").parquet(f"{out}/zone_totals")
    good = F.count_if(F.col("ts").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    rows = obs.agg(F.count("*").alias("rows_in"), good.alias("valid"), (F.count("*") - good).alias("invalid"))
    # one row each by construction
    of = hourly.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("joined"), F.count("*").alias("hourly_rows"))
    return rows.join(F.broadcast(of)).select("rows_in", "valid", "invalid", "joined", F.lit(grid.rows * grid.columns if grid else 0).cast("long").alias("zones"), "hourly_rows")


def quantiles(df: DataFrame, value: str, by: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank quantiles: the value at rank min(n - 1, floor(q * n)) of each group; null and NaN values don't count."""
    found = at_ranks(df, by, value, F.array(*[F.least(F.col("n") - 1, F.floor(F.col("n") * q)) for q in qs]))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("slot") == k, F.col("v"))).alias(f"p{round(q * 100)}") for k, q in enumerate(qs)])
