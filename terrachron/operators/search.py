"""Filters, latest-state and ordered queries over observations.

Order is (ts, observation_id): :func:`ordered` sorts a result so, as most uses of a set
of observations need no order and pay no sort. Ranges are closed at both ends, unless said.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import ordered as ordered_
from terrachron.operators.ranks import medians

ORDER = ("ts", "observation_id")


def at(t: datetime | Column) -> Column:
    """A moment (UTC, where it has no zone) as a timestamp, exact to the microsecond."""
    if isinstance(t, Column):
        return t
    own = t if t.tzinfo else t.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit((own - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)).cast("long"))


def ordered(obs: DataFrame) -> DataFrame:
    """By time, then id."""
    return obs.orderBy(*ORDER)


def radius(obs: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    return obs.where(geo.within(lat, lon, radius_m))


def between(obs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return obs.where(F.col("ts").between(at(start), at(end)))


def radius_between(obs: DataFrame, lat: float, lon: float, radius_m: float, start: datetime, end: datetime) -> DataFrame:
    return between(radius(obs, lat, lon, radius_m), start, end)


def within_polygon(obs: DataFrame, ring: geo.Ring) -> DataFrame:
    return obs.where(geo.in_ring(ring))


def nearest(obs: DataFrame, lat: float, lon: float, k: int, first_m: float = 200.0) -> DataFrame:
    """The k nearest by (distance, id), with distance_m.

    A circle that holds k rows holds the k nearest. One is looked for from ``first_m`` on: a try counts no further than k, and how
    many rows it found says how much wider the next one is, two to sixteen times. All these scans have the circle's box as a range
    of lat and lon, so files and row groups elsewhere aren't opened; only where all data has fewer than k rows is everything read.
    """
    if k <= 0:
        return obs.withColumn("distance_m", F.lit(0.0)).limit(0)
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    near, reach = radius(obs, lat, lon, first_m), first_m
    while (found := near.select(F.lit(1)).limit(k).count()) < k:
        reach *= min(16.0, max(2.0, 1.5 * math.sqrt(k / max(found, 0.01))))
        if reach >= math.pi * geo.EARTH_M:
            near = obs
            break
        near = radius(obs, lat, lon, reach)
    return near.withColumn("distance_m", d).orderBy("distance_m", "observation_id").limit(k)


def entity_history(obs: DataFrame, entity: str) -> DataFrame:
    return obs.where(F.col("entity_id") == entity)


def by_source(obs: DataFrame, source: str) -> DataFrame:
    return obs.where(F.col("source_id") == source)


def before(obs: DataFrame, entity: str, t: datetime | Column, window: timedelta | None = None) -> DataFrame:
    """History of an entity strictly before ``t``, from ``t - window`` on."""
    own = entity_history(obs, entity).where(F.col("ts") < at(t))
    return own if window is None else own.where(F.col("ts") >= at(t) - geo.seconds(window))


def get(obs: DataFrame, observation_id: str) -> DataFrame:
    """The one observation; KeyError if there is none."""
    row = obs.where(F.col("observation_id") == observation_id).limit(1)
    if row.isEmpty():
        raise KeyError(observation_id)
    return row


def events_near(obs: DataFrame, lat: float, lon: float, radius_m: float, start: datetime, end: datetime, event_type: str | None = None, source_id: str | None = None, min_confidence: float | None = None) -> DataFrame:
    out = radius_between(obs, lat, lon, radius_m, start, end)
    for c, v in (("event_type", event_type), ("source_id", source_id)):
        out = out if v is None else out.where(F.col(c) == v)
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def latest(obs: DataFrame) -> DataFrame:
    """Each entity's last observation: an aggregation with map-side combine, no sort."""
    whole = F.struct(*[F.col(c) for c in obs.columns])
    return obs.groupBy("entity_id").agg(F.max_by(whole, F.struct(*ORDER)).alias("o")).select("o.*")


def snapshot(obs: DataFrame, lat: float, lon: float, radius_m: float, t: datetime) -> DataFrame:
    """Last observation in the circle up to ``t`` of each entity (an entity that has left keeps its last one inside)."""
    return latest(radius(obs, lat, lon, radius_m).where(F.col("ts") <= at(t)))


def diff(obs: DataFrame, lat: float, lon: float, radius_m: float, t1: datetime, t2: datetime) -> DataFrame:
    """entity_id, status (appeared, changed, unchanged), moved_m between two snapshots; entities always come to stay."""
    if t2 < t1:
        raise ValueError("the second time is before the first")
    cols = ("observation_id", "event_type", "lat", "lon", "uncertainty_m")
    side = lambda t, p: snapshot(obs, lat, lon, radius_m, t).select("entity_id", *[F.col(c).alias(p + c) for c in cols])
    both = side(t2, "b_").join(side(t1, "a_"), "entity_id", "left")
    moved = geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    changed = (F.col("a_event_type") != F.col("b_event_type")) | (moved > F.greatest(F.col("a_uncertainty_m") + F.col("b_uncertainty_m"), F.lit(1.0)))
    status = F.when(F.col("a_observation_id").isNull(), "appeared").when(F.col("a_observation_id") == F.col("b_observation_id"), "unchanged").when(changed, "changed").otherwise("unchanged")
    return both.select("entity_id", status.alias("status"), moved.alias("moved_m"))


def what_changed(obs: DataFrame, lat: float, lon: float, radius_m: float, start: datetime, end: datetime) -> tuple[DataFrame, DataFrame]:
    """(diff of the snapshots at start and end, events in the circle after start up to end)."""
    return diff(obs, lat, lon, radius_m, start, end), radius_between(obs, lat, lon, radius_m, start, end).where(F.col("ts") > at(start))


def history_before(obs: DataFrame, entity: str, event_type: str, lookback: timedelta) -> DataFrame:
    """What an entity had in the time before its last event of a type, with offset_minutes (negative)."""
    own = entity_history(obs, entity)
    anchor = own.where(F.col("event_type") == event_type).agg(F.max("ts").alias("anchor"))
    # one row by construction
    out = own.join(F.broadcast(anchor), (F.col("ts") < F.col("anchor")) & (F.col("ts") >= F.col("anchor") - geo.seconds(lookback)))
    return out.withColumn("offset_minutes", (F.unix_micros("ts") - F.unix_micros("anchor")) / 6e7).drop("anchor")


def lineage(obs: DataFrame, start: DataFrame) -> DataFrame:
    """``start`` (observation_id) -> origin, observation_id, depth: the chain of parents, the start itself at 0.

    Pointer doubling: the ancestors 1, 2, 4, ... generations up are joined to the rows
    found so far, so a chain of any length takes a logarithmic number of equi-joins. A
    chain ends at a missing parent or where it meets itself: a cycle of n has n rows.
    """
    from terrachron.plans.tables import written

    ids = obs.select(F.col("observation_id").alias("id")).distinct()
    parents = obs.select(F.col("observation_id").alias("id"), F.col("parent_observation").alias("up")).where("up IS NOT NULL")
    jumps = [written(parents.join(ids.withColumnRenamed("id", "up"), "up", "left_semi").select("id", "up").distinct(), "lineage-up")]
    most = jumps[0].count()  # a chain that doesn't repeat has at most one step a row
    while 2 ** len(jumps) <= most:
        at_ = jumps[-1]
        nxt = written(at_.select("id", F.col("up").alias("mid")).join(at_.select(F.col("id").alias("mid"), "up"), "mid").select("id", "up").distinct(), "lineage-up")
        if nxt.isEmpty():
            break
        jumps.append(nxt)
    out = start.select(F.col("observation_id").alias("id")).join(ids, "id", "left_semi").distinct().select(F.col("id").alias("origin"), "id", F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        further = out.join(jumps[k], "id").select("origin", F.col("up").alias("id"), (F.col("depth") + 2**k).alias("depth"))
        # in a cycle an ancestor is met again at a larger depth
        out = written(out.union(further).groupBy("origin", "id").agg(F.min("depth").alias("depth")), "lineage")
    return out.select("origin", F.col("id").alias("observation_id"), F.col("depth").cast("int").alias("depth"))


def evidence(obs: DataFrame) -> DataFrame:
    """One row: count, sorted distinct sources, first and last time. The rows themselves stay a DataFrame."""
    return obs.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def overview(obs: DataFrame) -> DataFrame:
    """One row: counts, distinct entities, types and sources, time range and median place, found by rank."""
    counts = obs.agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("event_type").alias("types"), F.count_distinct("source_id").alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return counts.join(F.broadcast(medians(obs, ["lat", "lon"])))  # one row each


def sample_every(obs: DataFrame, step: int, by: str | None = "entity_id") -> DataFrame:
    """Every ``step``-th observation in time order, the first one included: of each value of ``by``, or (None) of all.

    Of all, rows are numbered within their minute and a running count of the minutes
    before is added, so no task sorts everything.
    """
    if by is not None:
        return ordered_.numbered(obs, by, ORDER, F.unix_micros("ts"), "_n").where(F.col("_n") % step == 0).drop("_n")
    timed = obs.withColumns({"_minute": F.date_trunc("minute", "ts"), "_day": F.to_date("ts")})
    minutes = timed.groupBy("_day", "_minute").agg(F.count("*").alias("_c"))
    days = minutes.groupBy("_day").agg(F.sum("_c").alias("_d"))  # one row a day
    days = days.select("_day", (F.sum("_d").over(Window.orderBy("_day")) - F.col("_d")).alias("_earlier"))
    minutes = minutes.withColumn("_c", F.sum("_c").over(Window.partitionBy("_day").orderBy("_minute")) - F.col("_c")).join(days, "_day").select("_minute", (F.col("_c") + F.col("_earlier")).alias("_before"))
    own = timed.withColumn("_n", F.row_number().over(Window.partitionBy("_minute").orderBy(*ORDER)) - 1).join(minutes, "_minute")
    return own.where((F.col("_before") + F.col("_n")) % step == 0).drop("_day", "_minute", "_n", "_before")


def event_sequence(obs: DataFrame, lat: float, lon: float, radius_m: float, start: datetime, end: datetime) -> DataFrame:
    """What happened in the circle and window, in order, as rows: ts, observation_id, event_type."""
    return ordered(radius_between(obs, lat, lon, radius_m, start, end).select("ts", "observation_id", "event_type"))


def keyword_match(obs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The baseline search: any of entity, type and source equals a term (case ignored); the first ``limit`` by id."""
    terms = [t.lower() for t in terms]
    hit = F.lower("entity_id").isin(terms) | F.lower("event_type").isin(terms) | F.lower("source_id").isin(terms)
    return obs.where(hit).orderBy("observation_id").limit(limit)


def precision_recall(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Two sets of observation_id -> one row: precision, recall (1 where nothing is relevant; precision 1 where both are empty, 0 where only retrieved is)."""
    a = retrieved.select("observation_id").distinct().withColumn("a", F.lit(1))
    b = relevant.select("observation_id").distinct().withColumn("b", F.lit(1))
    n = a.join(b, "observation_id", "full_outer").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    none = lambda c: F.when(F.col("b") == 0, 1.0).otherwise(0.0) if c == "a" else F.lit(1.0)
    return n.select(*[F.when(F.col(c) == 0, none(c)).otherwise(F.col("both") / F.greatest(F.col(c), F.lit(1))).alias(name) for c, name in (("a", "precision"), ("b", "recall"))])
