"""Spatial-temporal joins on cell keys: equi-joins with an exact residual, never a nested loop over pairs."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators.search import at

#: Radii of a batch share cells up to the next power of this.
CLASS = 4.0


def _micros(window: timedelta) -> int:
    return window // timedelta(microseconds=1)


def _tick(window: timedelta) -> Column:
    return F.floor(F.unix_micros("ts") / F.lit(max(1, _micros(window))))


def _placed(df: DataFrame, radius_m: float, tick: Column) -> DataFrame:
    row, column = geo.radius_cell(F.col("lat"), F.col("lon"), radius_m)
    return df.withColumns({"row": row, "column": column, "tick": tick})


def _spread(df: DataFrame, radius_m: float, tick: Column, ticks: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    steps = [("_up", "_on"), *((up, on) for up in (-1, 0, 1) for on in ticks)]
    return geo.spread_cells(df, radius_m, steps).withColumn("tick", tick + F.col("_on")).drop("_on")


#: A cell is crowded from so many rows on, and from four times the mean of its hash bucket on, so there are fewer than BUCKETS / 4 crowded buckets.
CROWDED, BUCKETS = 20_000, 1 << 20


def _bucket() -> Column:
    return F.pmod(F.xxhash64("row", "column", "tick"), F.lit(BUCKETS))


def _crowded(placed: DataFrame) -> DataFrame | None:
    """(_bucket, _parts) of the hash buckets that hold a crowded cell; None where there is none. Counts are combined before the shuffle to a row a bucket."""
    counts = placed.groupBy(_bucket().alias("_bucket")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    most = F.greatest(F.lit(float(CROWDED)), F.col("_all") * (4 / BUCKETS))
    found = counts.join(F.broadcast(total)).where(F.col("_n") > most).select("_bucket", F.ceil(F.col("_n") / most).alias("_parts"))
    rows = found.collect()  # fewer than BUCKETS / 4
    return placed.sparkSession.createDataFrame(rows, found.schema) if rows else None


def _dealt(df: DataFrame, crowd: DataFrame, ident: str, own: str, other: str) -> DataFrame:
    """Rows of crowded buckets dealt to parts ``own`` by id and repeated for every part ``other``, so two sides meet once for each pair of parts; all other rows once."""
    out = df.withColumn("_bucket", _bucket()).join(F.broadcast(crowd), "_bucket", "left")  # a row a crowded bucket
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    out = out.withColumn(own, F.pmod(F.xxhash64(ident), parts)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return out.drop("_bucket", "_parts")


#: Half of a neighbourhood: rows of latitude up, ticks on, and whether both rows look for each other.
_AHEAD = [("_up", "_on", "same"), (1, -1, False), (1, 0, False), (1, 1, False), (0, 1, False), (0, 0, True)]


def neighbour_pairs(obs: DataFrame, radius_m: float, window: timedelta, other_entities: bool = True, even: bool = False) -> DataFrame:
    """Pairs of observations at most ``radius_m`` and ``window`` apart, each once: a_/b_ id, entity, ts; a's id is the smaller.

    Cells are as wide as the radius in their own row of latitude, columns wrap at the
    antimeridian, and only rows near a pole have a single column. A row looks for partners in half
    of its neighbourhood: in the next row of latitude, in the next tick of its own row, and
    in its own tick and row those with a larger id. Crowded cells are dealt to parts, and each pair
    of parts is compared on its own; ``even`` says that no cell can be crowded, and saves the count.
    """
    own = obs.select(F.col("observation_id").alias("id"), F.col("entity_id").alias("entity"), "ts", "lat", "lon")
    tick = _tick(window)
    side = lambda df, p, *more: df.select("row", "column", "tick", *more, *[F.col(c).alias(p + c) for c in ("id", "entity", "ts", "lat", "lon")])
    looking = geo.spread_cells(own, radius_m, _AHEAD).withColumn("tick", tick + F.col("_on"))
    placed, looking, key = side(_placed(own, radius_m, tick), "p_"), side(looking, "q_", "same"), ["row", "column", "tick"]
    crowd = None if even else _crowded(placed)
    if crowd is not None:
        placed, looking = _dealt(placed, crowd, "p_id", "_p", "_q"), _dealt(looking, crowd, "q_id", "_q", "_p")
        key += ["_p", "_q"]
    # merged by name: a size told from the file counts none of the rows that a cell's neighbours add, so either side could be taken for one to broadcast
    pairs = placed.hint("merge").join(looking, key)
    apart = F.abs(F.unix_micros("p_ts") - F.unix_micros("q_ts")) <= _micros(window)
    near = geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"))
    pairs = pairs.where(F.when(F.col("same"), F.col("p_id") < F.col("q_id")).otherwise(F.col("p_id") != F.col("q_id")) & apart & (near <= radius_m))
    if other_entities:
        pairs = pairs.where(F.col("p_entity") != F.col("q_entity"))
    first = F.col("p_id") < F.col("q_id")
    pick = lambda c, p, q: F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}"))
    cols = [pick(c, *ends).alias(f"{side_}_{c}") for c in ("id", "entity", "ts") for side_, ends in (("a", "pq"), ("b", "qp"))]
    return pairs.select(*cols, near.alias("distance_m"))


def nearby_entities(obs: DataFrame, entity: str, t: datetime, radius_m: float, window: timedelta) -> DataFrame:
    """Other entities seen within ``radius_m`` and ``window`` of one of the entity's observations around ``t``: entity_id, distance_m (least), own_id, other_id."""
    w = geo.seconds(window)
    close = obs.where(F.col("ts").between(at(t) - w - w, at(t) + w + w)).select(F.col("observation_id").alias("id"), F.col("entity_id").alias("entity"), "ts", "lat", "lon")
    own = close.where((F.col("entity") == entity) & F.col("ts").between(at(t) - w, at(t) + w))
    side = lambda df, p: df.select("row", "column", "tick", *[F.col(c).alias(p + c) for c in ("id", "ts", "lat", "lon", "entity")])
    pairs = side(_placed(close.where(F.col("entity") != entity), radius_m, _tick(window)), "o_").join(side(_spread(own, radius_m, _tick(window)), "e_"), ["row", "column", "tick"])
    d = geo.haversine_m(F.col("e_lat"), F.col("e_lon"), F.col("o_lat"), F.col("o_lon"))
    pairs = pairs.withColumn("d", d).where((F.abs(F.unix_micros("e_ts") - F.unix_micros("o_ts")) <= _micros(window)) & (F.col("d") <= radius_m))
    best = F.min(F.struct("d", "e_id", "o_id")).alias("m")
    return pairs.groupBy(F.col("o_entity").alias("entity_id")).agg(best).select("entity_id", F.col("m.d").alias("distance_m"), F.col("m.e_id").alias("own_id"), F.col("m.o_id").alias("other_id"))


#: Columns that make a place, and a circle.
_PLACE, _CIRCLE = ["lat", "lon"], ["lat", "lon", "radius_m"]


def _hits(points: DataFrame, circles: DataFrame, of_circle: list[str], of_point: list[str]) -> DataFrame:
    """These columns of every circle and point in it. Circles of like radius share one size of cells; points are keyed once for each size asked for, of which there are at most a dozen."""
    size = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col("radius_m"), F.lit(1.0))) / F.lit(math.log(CLASS)))).cast("int")
    asked = circles.where("radius_m >= 0").withColumn("size", size)
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    found, none = None, F.lit(0)
    for (k,) in asked.select("size").distinct().orderBy("size").collect():
        cell = min(CLASS**k, math.pi * geo.EARTH_M)
        own = _placed(points, cell, none).select("row", "column", *of_point, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
        # merged by name: a size told from the file counts none of the cells of a circle
        hits = own.hint("merge").join(_spread(asked.where(F.col("size") == k), cell, none, ticks=(0,)), ["row", "column"]).where(d <= F.col("radius_m")).select(*of_circle, *of_point)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else circles.limit(0).select(*of_circle).join(points.limit(0).select(*of_point))


def batch_radius(obs: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (qi, lat, lon, radius_m) -> qi, n for all queries in one pass, those without a hit included; a repeated qi is one query of several circles.

    Observations at one place are one row with their number, and equal circles are asked once; counts are combined before they shuffle.
    """
    places = obs.groupBy(*_PLACE).agg(F.count("*").alias("_here"))
    hits = _hits(places, queries.select(*_CIRCLE).distinct(), _CIRCLE, ["_here"]).groupBy(*_CIRCLE).agg(F.sum("_here").alias("n"))
    return queries.select("qi", *_CIRCLE).join(hits, _CIRCLE, "left").groupBy("qi").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def batch_radius_ids(obs: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (qi, lat, lon, radius_m) -> qi, observation_id: a row per hit.

    Lists of observations at one place meet lists of equal circles, so a distance is told once for both lists; a hit is made of them only at the end.
    """
    found = _hits(_listed(obs, _PLACE, "observation_id", "_here"), _listed(queries, _CIRCLE, "qi", "_asked"), ["_asked"], ["_here"])
    return found.select("_asked", F.inline("_here")).select(F.inline("_asked"), "observation_id")


#: Rows of a list, on the whole.
LISTED = 1000


def _listed(df: DataFrame, by: list[str], column: str, new: str) -> DataFrame:
    """``by``, ``new``: the values of ``column`` of equal ``by`` as a list of structs, or as several where there are more than LISTED. Null places have none."""
    parts = df.groupBy(*by).agg(F.ceil(F.count("*") / LISTED).alias("_parts"))
    own = df.select(*by, column).hint("merge").join(parts, by).withColumn("_part", F.pmod(F.xxhash64(column), "_parts"))
    return own.groupBy(*by, "_part").agg(F.collect_list(F.struct(column)).alias(new)).drop("_part")
