"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

All run over the whole events table seen as observations. Floating results are rounded
to three decimals (means and fractions to six) on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import aggregate, events, graph, joins, layout, regions, search, trust
from terrachron.sources import observations
from terrachron.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LAT, LON, R = 40.70, -73.95, 4000.0
START, END = datetime(2024, 1, 8), datetime(2024, 1, 20, 12)
RING = [(40.62, -74.08), (40.62, -73.85), (40.78, -73.85), (40.78, -73.93), (40.68, -73.93), (40.68, -74.0), (40.78, -74.0), (40.78, -74.08)]
REGIONS = {"north": [(40.7, -74.1), (40.7, -73.8), (40.81, -73.8), (40.81, -74.1)], "u": RING}
SEVERITY = ["view", "click", "signup", "purchase", "error"]
TREE = layout.Split("lat", 40.7, layout.Split("lon", -73.95, 0, 1), layout.Split("lon", -73.95, 2, 3))

OBS = """obs AS (SELECT concat('obs_', CAST(event_id AS VARCHAR)) observation_id, concat('user_', CAST(user_id AS VARCHAR)) entity_id, event_type,
 (4060000 + ((user_id*37) % 20)*1000 + (event_id*7919) % 1000) / CAST(100000 AS DOUBLE) lat, (-7410000 + ((user_id*53) % 30)*1000 + (event_id*104729) % 1000) / CAST(100000 AS DOUBLE) lon,
 ts, concat('src_', CAST(event_id % 5 AS VARCHAR)) source_id, (50 + (event_id*31) % 51) / CAST(100 AS DOUBLE) confidence,
 CAST(CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 25 END AS DOUBLE) uncertainty_m, CASE WHEN event_id % 10 <> 0 THEN concat('obs_', CAST(event_id-1 AS VARCHAR)) END parent_observation, event_id FROM events)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2*CAST({geo.EARTH_M} AS DOUBLE)*asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2)))))"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_NEAR = f"{_hav('lat', 'lon', _d(LAT), _d(LON))} <= {R}"
_WHEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


def _in_ring(ring: geo.Ring) -> str:
    parts = [f"CASE WHEN ({_d(a)} > lat) <> ({_d(c)} > lat) AND lon < {_d(b)} + (lat - {_d(a)}) * {_d(d - b)} / {_d(c - a)} THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True) if a != c]
    return f"(({' + '.join(parts)}) % 2 = 1)"


def query(sql: str | None = None, ctes: str = "") -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a function of the observations under its name; ``sql`` follows the obs CTE."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(observations.from_events(spark, sf_dir))
            return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in ctes else ''}{OBS}{ctes.replace('RECURSIVE', '')} {sql}"
        return run

    return register


def _r(c: str, n: int = 3):
    return F.round(c, n).alias(c)


_IDS = "SELECT observation_id, entity_id, ts FROM obs WHERE"
_ids = lambda df: df.select("observation_id", "entity_id", "ts")


@query(f"{_IDS} {_NEAR}")
def radius(obs):
    return _ids(search.radius(obs, LAT, LON, R))


@query(f"{_IDS} {_WHEN}")
def between(obs):
    return _ids(search.between(obs, START, END))


@query(f"{_IDS} {_NEAR} AND {_WHEN}")
def radius_between(obs):
    return _ids(search.radius_between(obs, LAT, LON, R, START, END))


@query(f"{_IDS} source_id = 'src_2'")
def by_source(obs):
    return _ids(search.by_source(obs, "src_2"))


@query(f"{_IDS} entity_id = 'user_7'")
def entity_history(obs):
    return _ids(search.entity_history(obs, "user_7"))


@query(f"{_IDS} entity_id = 'user_7' AND ts < TIMESTAMP '{END}' AND ts >= TIMESTAMP '{END - timedelta(days=5)}'")
def before(obs):
    return _ids(search.before(obs, "user_7", END, timedelta(days=5)))


@query(f"{_IDS} {_in_ring(RING)}")
def within_polygon(obs):
    return _ids(search.within_polygon(obs, RING))


@query(f"{_IDS} {_NEAR} AND {_WHEN} AND event_type = 'error' AND confidence >= {_d(0.6)}")
def events_near(obs):
    return _ids(search.events_near(obs, LAT, LON, R, START, END, "error", None, 0.6))


@query(f"SELECT observation_id, round(d, 3) distance_m FROM (SELECT observation_id, {_hav('lat', 'lon', _d(LAT), _d(LON))} d FROM obs) ORDER BY d, observation_id LIMIT 25")
def nearest_k(obs):
    return search.nearest(obs, LAT, LON, 25).select("observation_id", _r("distance_m"))


_LAST = "row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, observation_id DESC) = 1"


@query(f"SELECT entity_id, observation_id, ts FROM obs QUALIFY {_LAST}")
def latest_per_entity(obs):
    return search.latest(obs).select("entity_id", "observation_id", "ts")


@query(f"SELECT entity_id, observation_id, ts FROM obs WHERE {_NEAR} AND ts <= TIMESTAMP '{START}' QUALIFY {_LAST}")
def snapshot(obs):
    return search.snapshot(obs, LAT, LON, R, START).select("entity_id", "observation_id", "ts")


_SNAPS = ", ".join([""] + [f"{n} AS (SELECT * FROM obs WHERE {_NEAR} AND ts <= TIMESTAMP '{t}' QUALIFY {_LAST})" for n, t in (("s1", START), ("s2", END))])


@query(
    f"SELECT b.entity_id, CASE WHEN a.observation_id IS NULL THEN 'appeared' WHEN a.observation_id = b.observation_id THEN 'unchanged' WHEN a.event_type <> b.event_type OR {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > greatest(a.uncertainty_m + b.uncertainty_m, 1) THEN 'changed' ELSE 'unchanged' END status,"
    f" round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) moved_m FROM s2 b LEFT JOIN s1 a ON a.entity_id = b.entity_id",
    _SNAPS,
)
def snapshot_diff(obs):
    return search.diff(obs, LAT, LON, R, START, END).select("entity_id", "status", _r("moved_m"))


@query(f"{_IDS} {_NEAR} AND {_WHEN} AND ts > TIMESTAMP '{START}'")
def what_changed(obs):
    return _ids(search.what_changed(obs, LAT, LON, R, START, END)[1])


@query("SELECT observation_id, event_type, round((epoch_us(ts) - epoch_us(anchor)) / 60000000.0, 3) offset_minutes FROM obs, (SELECT max(ts) anchor FROM obs WHERE entity_id = 'user_7' AND event_type = 'error') WHERE entity_id = 'user_7' AND ts < anchor AND ts >= anchor - INTERVAL 3 DAY")
def history_before(obs):
    return search.history_before(obs, "user_7", "error", timedelta(days=3)).select("observation_id", "event_type", _r("offset_minutes"))


_CHAIN = ", RECURSIVE chain AS (SELECT observation_id origin, observation_id, parent_observation, 0 depth FROM obs UNION ALL SELECT c.origin, o.observation_id, o.parent_observation, c.depth + 1 FROM chain c JOIN obs o ON o.observation_id = c.parent_observation)"


@query("SELECT origin, observation_id, depth FROM chain WHERE origin = 'obs_38'", _CHAIN.replace("FROM obs UNION", "FROM obs WHERE observation_id = 'obs_38' UNION"))
def lineage(obs):
    return search.lineage(obs, obs.where("observation_id = 'obs_38'"))


@query("SELECT origin, max(depth) generations FROM chain GROUP BY origin", _CHAIN)
def lineage_all(obs):
    return search.lineage(obs, obs).groupBy("origin").agg(F.max("depth").alias("generations"))


@query(f"SELECT count(*) \"count\", string_agg(DISTINCT source_id, ',' ORDER BY source_id) sources, min(ts) first_ts, max(ts) last_ts FROM obs WHERE {_NEAR}")
def evidence_bundle(obs):
    return search.evidence(search.radius(obs, LAT, LON, R)).withColumn("sources", F.array_join("sources", ","))


@query("SELECT DISTINCT entity_id FROM obs")
def distinct_entities(obs):
    return obs.select("entity_id").distinct()


@query("SELECT count(*) n, count(DISTINCT entity_id) entities, count(DISTINCT event_type) types, count(DISTINCT source_id) sources, min(ts) first_ts, max(ts) last_ts, round(median(lat), 6) lat, round(median(lon), 6) lon FROM obs")
def overview(obs):
    return search.overview(obs).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("SELECT observation_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, observation_id) - 1 k FROM obs) WHERE k % 10 = 0")
def systematic_sample(obs):
    return search.sample_every(obs, 10).select("observation_id", "entity_id")


_WORDS = "(entity_id = 'user_3' OR event_type = 'error' OR source_id = 'src_4')"


@query(f"SELECT observation_id FROM obs WHERE {_WORDS} ORDER BY observation_id LIMIT 200")
def keyword_baseline(obs):
    return search.keyword_match(obs, ["USER_3", "error", "src_4"], 200).select("observation_id")


@query(f"SELECT round(sum(a * b) / CAST(sum(a) AS DOUBLE), 6) \"precision\", round(sum(a * b) / CAST(sum(b) AS DOUBLE), 6) recall FROM (SELECT CASE WHEN {_WORDS} THEN 1 ELSE 0 END a, CASE WHEN {_NEAR} AND {_WHEN} THEN 1 ELSE 0 END b FROM obs)")
def precision_recall(obs):
    out = search.precision_recall(search.keyword_match(obs, ["user_3", "error", "src_4"], 2**31 - 1), search.radius_between(obs, LAT, LON, R, START, END))
    return out.select(_r("precision", 6), _r("recall", 6))


@query("SELECT ts, observation_id, event_type FROM obs WHERE " + f"{_NEAR} AND {_WHEN}")
def event_sequence(obs):
    return search.event_sequence(obs, LAT, LON, R, START, END)


@query("SELECT observation_id, entity_id FROM (SELECT *, row_number() OVER (ORDER BY ts, observation_id) - 1 k FROM obs) WHERE k % 30 = 0")
def systematic_sample_of_all(obs):
    return search.sample_every(obs, 30, None).select("observation_id", "entity_id")


@query(
    f"SELECT o.entity_id, round(min({_hav('e.lat', 'e.lon', 'o.lat', 'o.lon')}), 3) distance_m FROM obs e JOIN obs o ON e.entity_id = 'user_7' AND o.entity_id <> 'user_7' AND e.ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-17' AND abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 172800000000 AND {_hav('e.lat', 'e.lon', 'o.lat', 'o.lon')} <= 1500 GROUP BY 1"
)
def nearby_entities(obs):
    return joins.nearby_entities(obs, "user_7", datetime(2024, 1, 15), 1500.0, timedelta(days=2)).select("entity_id", _r("distance_m"))


_MIN = 360
_BUCKETS = int((END - START).total_seconds() // (_MIN * 60)) + 1
_FRAME = f", frame AS (SELECT unnest(range({_BUCKETS})) bucket), hits AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // {_MIN * 60_000_000} bucket FROM obs WHERE {_NEAR} AND {_WHEN})"


def _activity_sql(by: str) -> str:
    b, g = (f"k.{by}, ", f" CROSS JOIN (SELECT DISTINCT {by} FROM hits) k") if by else ("", "")
    on = f" AND h.{by} = k.{by}" if by else ""
    return f"SELECT f.bucket, {b}TIMESTAMP '{START}' + to_minutes(CAST(f.bucket * {_MIN} AS BIGINT)) bucket_start, count(h.observation_id) n FROM frame f{g} LEFT JOIN hits h ON h.bucket = f.bucket{on} GROUP BY ALL"


@query(_activity_sql(""), _FRAME)
def activity(obs):
    return aggregate.activity(obs, LAT, LON, R, START, END, _MIN)


@query(_activity_sql("source_id"), _FRAME)
def activity_by_source(obs):
    return aggregate.activity(obs, LAT, LON, R, START, END, _MIN, "source_id")


@query(_activity_sql("event_type"), _FRAME)
def activity_by_type(obs):
    return aggregate.activity(obs, LAT, LON, R, START, END, _MIN, "event_type")


_STEP, _ROUND = 180.0 * 500.0 / (math.pi * geo.EARTH_M), 2 * math.pi * geo.EARTH_M / 500.0
_CELLS = f", rows_ AS (SELECT *, CAST(floor(lat / {_d(_STEP)}) AS BIGINT) cell_row FROM obs), around AS (SELECT *, greatest(1, CAST(floor(cos(radians((cell_row + 0.5) * {_d(_STEP)})) * {_d(_ROUND)}) AS BIGINT)) a FROM rows_), cells AS (SELECT *, CAST(floor((lon + 180) / (CAST(360 AS DOUBLE) / a)) AS BIGINT) % a cell_col FROM around)"


@query("SELECT cell_row, cell_col, count(*) n, count(DISTINCT entity_id) entities FROM cells WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2", _CELLS)
def hotspots(obs):
    return aggregate.hotspots(obs, "error", 500.0, 2)


@query(
    "SELECT b.cell_row, b.cell_col, b.n, round(b.lat, 6) lat, round(b.lon, 6) lon, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT concat(source_id, ':', CAST(count(*) AS VARCHAR)) s FROM cells c WHERE c.cell_row = b.cell_row AND c.cell_col = b.cell_col GROUP BY source_id)) sources,"
    " (SELECT string_agg(observation_id, ',' ORDER BY observation_id) FROM (SELECT observation_id FROM cells c WHERE c.cell_row = b.cell_row AND c.cell_col = b.cell_col ORDER BY 1 LIMIT 20)) sample"
    " FROM (SELECT cell_row, cell_col, count(*) n, avg(lat) lat, avg(lon) lon FROM cells GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20) b",
    _CELLS,
)
def hotspots_top(obs):
    return aggregate.top_hotspots(obs, 500.0).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("SELECT * FROM (SELECT cell_row, cell_col, hour_of_week, n FROM (SELECT *, sum(n) OVER (PARTITION BY cell_row, cell_col) a FROM (SELECT CAST(floor(lat / CAST(0.02 AS DOUBLE)) AS BIGINT) cell_row, CAST(floor(lon / CAST(0.02 AS DOUBLE)) AS BIGINT) cell_col, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) hour_of_week, count(*) n FROM obs GROUP BY 1, 2, 3)) WHERE a >= 50)")
def hour_of_week_grid(obs):
    return aggregate.hour_of_week(obs, 0.02, 50)


_ZONES = """, c AS (SELECT floor(min(lat) / CAST(0.01 AS DOUBLE)) * CAST(0.01 AS DOUBLE) - CAST(0.00005 AS DOUBLE) y, floor(min(lon) / CAST(0.01 AS DOUBLE)) * CAST(0.01 AS DOUBLE) - CAST(0.00005 AS DOUBLE) x, max(lat) n, max(lon) e FROM obs),
 b AS (SELECT y, x, CAST(ceil((e - x) / CAST(0.01 AS DOUBLE)) AS BIGINT) + 1 cols, CAST(ceil((n - y) / CAST(0.01 AS DOUBLE)) AS BIGINT) + 1 rows_ FROM c),
 zones AS (SELECT obs.*, y, x, cols, rows_, CAST(floor((lat - y) / CAST(0.01 AS DOUBLE)) * cols + floor((lon - x) / CAST(0.01 AS DOUBLE)) AS BIGINT) zone_id FROM obs, b)"""
_CORNER = "round(y + (zone_id // cols) * CAST(0.01 AS DOUBLE), 6) zlat, round(x + (zone_id % cols) * CAST(0.01 AS DOUBLE), 6) zlon"


@query("SELECT zone_id, date_trunc('hour', ts) AS \"hour\", source_id, count(*) n FROM zones GROUP BY ALL", _ZONES)
def zone_hour_counts(obs):
    return aggregate.zone_hours(obs, 0.01)


def _totals(obs: DataFrame) -> DataFrame:
    return aggregate.zone_totals(obs, 0.01).select("zone_id", "n", _r("zlat", 6), _r("zlon", 6))


@query(f"SELECT zone_id, CAST(count(*) AS BIGINT) n, {_CORNER} FROM zones GROUP BY ALL", _ZONES)
def zone_totals(obs):
    return _totals(obs)


@query(f"SELECT zone_id, CAST(count(*) AS BIGINT) n, {_CORNER} FROM zones GROUP BY ALL ORDER BY n DESC, zone_id LIMIT 10", _ZONES)
def zone_top10(obs):
    return _totals(obs).orderBy(F.desc("n"), "zone_id").limit(10)


@query("SELECT (SELECT count(*) FROM events) rows_in, count(*) valid, (SELECT count(*) FROM events) - count(*) invalid, CAST(count(*) AS BIGINT) joined, max(rows_ * cols) zones, count(DISTINCT concat(zone_id, '/', date_trunc('hour', ts), '/', source_id)) hourly_rows FROM zones", _ZONES.replace(", c AS", ", whole AS (SELECT * FROM obs WHERE event_id % 97 <> 0), c AS").replace("FROM obs)", "FROM whole)").replace("SELECT obs.*", "SELECT whole.*").replace("FROM obs, b", "FROM whole, b").replace("(SELECT * FROM whole", "(SELECT * FROM obs"))
def zone_report(obs):
    odd = F.substring_index("observation_id", "_", -1).cast("long") % 97 == 0
    return aggregate.zone_report(obs.withColumn("lat", F.when(odd, F.lit(95.0)).otherwise(F.col("lat"))), 0.01)


_WEEK = "SELECT CAST(floor(lat / CAST(0.02 AS DOUBLE)) AS BIGINT) cell_row, CAST(floor(lon / CAST(0.02 AS DOUBLE)) AS BIGINT) cell_col, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) hour_of_week FROM obs"


@query(
    "SELECT f.cell_row, f.cell_col, f.hour_of_week, CAST(round_even(count(o.hour_of_week) * 10 / CAST((SELECT n FROM weeks) AS DOUBLE), 0) AS BIGINT) \"value\", (SELECT n FROM weeks) AS weeks FROM frame f LEFT JOIN o ON o.cell_row = f.cell_row AND o.cell_col = f.cell_col AND o.hour_of_week = f.hour_of_week GROUP BY 1, 2, 3"
    " UNION ALL SELECT -9999, -9999, h.hour_of_week, CAST(round_even(count(o.hour_of_week) / CAST((SELECT n FROM weeks) AS DOUBLE), 0) AS BIGINT), (SELECT n FROM weeks) FROM hours h LEFT JOIN o ON o.hour_of_week = h.hour_of_week GROUP BY 3",
    f", o AS ({_WEEK}), weeks AS (SELECT count(*) n FROM (SELECT DISTINCT isoyear(ts), week(ts) FROM obs)), hours AS (SELECT CAST(unnest(range(168)) AS INTEGER) hour_of_week), frame AS (SELECT * FROM (SELECT cell_row, cell_col FROM o GROUP BY 1, 2 HAVING count(*) >= 50), hours)",
)
def typical_week(obs):
    none = lambda c: F.coalesce(c, F.lit(-9999).cast("long")).alias(c)
    return aggregate.typical_week(obs, 0.02, 50).select(none("cell_row"), none("cell_col"), "hour_of_week", "value", "weeks")


@query("SELECT cell_row, cell_col, count(*) n, round(arg_min(lat, observation_id), 6) lat, round(arg_min(lon, observation_id), 6) lon FROM (SELECT *, CAST(round_even(lat / CAST(0.02 AS DOUBLE), 0) AS BIGINT) cell_row, CAST(round_even(lon / CAST(0.02 AS DOUBLE), 0) AS BIGINT) cell_col FROM obs) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8")
def densest_cells(obs):
    return aggregate.densest_cells(obs, 0.02, 8).select("cell_row", "cell_col", "n", _r("lat", 6), _r("lon", 6))


@query("SELECT cell_row, cell_col, entity_id, observation_id FROM cells WHERE event_type = 'error' QUALIFY count(*) OVER (PARTITION BY cell_row, cell_col) >= 2", _CELLS)
def hotspot_evidence(obs):
    return aggregate.hotspot_evidence(obs, "error", 500.0, 2)


@query("SELECT event_type, max(CASE WHEN r = least(n - 1, floor(n * 0.5)) THEN uncertainty_m END) p50, max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN uncertainty_m END) p95, max(CASE WHEN r = least(n - 1, floor(n * 0.99)) THEN uncertainty_m END) p99 FROM (SELECT event_type, uncertainty_m, row_number() OVER (PARTITION BY event_type ORDER BY uncertainty_m) - 1 r, count(*) OVER (PARTITION BY event_type) n FROM obs) GROUP BY 1")
def nearest_rank_quantiles(obs):
    return aggregate.quantiles(obs, "uncertainty_m", "event_type")


_STEPS = ", steps AS (SELECT *, lag(observation_id) OVER w prev, lag(event_type) OVER w prev_type FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY ts, observation_id))"
_PAIRS = f", near AS (SELECT a.observation_id a_id, b.observation_id b_id, a.entity_id a_entity, b.entity_id b_entity, a.ts a_ts, b.ts b_ts FROM obs a JOIN obs b ON a.ts BETWEEN b.ts - INTERVAL 30 MINUTE AND b.ts + INTERVAL 30 MINUTE AND a.observation_id < b.observation_id AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500)"
_BY = "SELECT entity_id src, 'OBSERVED_BY' rel, source_id dst, ts first_seen, ts last_seen, observation_id FROM obs"
_NEARS = "SELECT least(a_entity, b_entity) src, 'NEAR' rel, greatest(a_entity, b_entity) dst, least(a_ts, b_ts) first_seen, greatest(a_ts, b_ts) last_seen, unnest([a_id, b_id]) observation_id FROM near WHERE a_entity <> b_entity"
_IN = " UNION ALL ".join(f"SELECT entity_id src, 'INSIDE' rel, '{n}' dst, ts first_seen, ts last_seen, observation_id FROM obs WHERE {_in_ring(r)}" for n, r in REGIONS.items())
_BEFORE = "SELECT concat('obs:', prev) src, 'BEFORE' rel, concat('obs:', observation_id) dst, ts first_seen, ts last_seen, observation_id FROM steps WHERE prev IS NOT NULL"
_CHANGED = "SELECT concat('obs:', observation_id) src, 'CHANGED_FROM' rel, concat('obs:', prev) dst, ts first_seen, ts last_seen, observation_id FROM steps WHERE prev IS NOT NULL AND event_type <> prev_type"
_WIDE = {"radius_m": 500.0, "window": timedelta(minutes=30)}


def _edges_sql(rows: str) -> str:
    return f"SELECT src, rel, dst, min(first_seen) first_seen, max(last_seen) last_seen, count(DISTINCT observation_id) n_evidence FROM ({rows}) GROUP BY 1, 2, 3"


@query(_edges_sql(_BY))
def edges_observed_by(obs):
    return graph.edges(graph.observed_by(obs))


@query(_edges_sql(_NEARS), _PAIRS)
def edges_near(obs):
    return graph.edges(graph.near(obs, **_WIDE))


@query(_edges_sql(_IN))
def edges_inside(obs):
    return graph.edges(graph.inside_regions(obs, regions.region_table(obs.sparkSession, REGIONS)))


#: Corners of a concave ring around a place, in parts of its half height.
_DART = [(1.0, 0.0), (-1.0, 1.0), (-0.25, 0.125), (-1.0, -1.0)]
_DARTS = "darts AS (SELECT observation_id region, lat y, lon x, CAST(50 + event_id % 4000 AS DOUBLE) / CAST(100000 AS DOUBLE) h FROM obs WHERE event_id % 25 = 0)"


def _dart_sql() -> str:
    at = lambda c, v: f"({c} + h * {_d(v)})"
    sides = [(at("y", a), at("x", b), at("y", c), at("x", d)) for (a, b), (c, d) in zip(_DART, _DART[1:] + _DART[:1], strict=True)]
    return " + ".join(f"CASE WHEN ({a} > lat) <> ({c} > lat) AND lon < {b} + (lat - {a}) * ({d} - {b}) / ({c} - {a}) THEN 1 ELSE 0 END" for a, b, c, d in sides)


@query(f"SELECT region, count(*) n, min(observation_id) first_id FROM darts JOIN obs ON lat BETWEEN y - h AND y + h AND ({_dart_sql()}) % 2 = 1 GROUP BY 1", f", {_DARTS}")
def inside_many_regions(obs):
    k, h = F.substring_index("observation_id", "_", -1).cast("long"), F.col("h")
    own = obs.where(k % 25 == 0).select(F.col("observation_id").alias("region"), "lat", "lon", ((50 + k % 4000).cast("double") / F.lit(100000.0)).alias("h"))
    ring = F.array(*[F.struct((F.col("lat") + h * a).alias("lat"), (F.col("lon") + h * b).alias("lon")) for a, b in _DART])
    return regions.counts_inside(obs, own.select("region", ring.alias("ring")))


@query(_edges_sql(_BEFORE), _STEPS)
def edges_before(obs):
    return graph.edges(graph.before(obs))


@query(_edges_sql(_CHANGED), _STEPS)
def edges_changed_from(obs):
    return graph.edges(graph.changed_from(obs))


_ALL = f"{_PAIRS}{_STEPS}, g AS ({_edges_sql(' UNION ALL '.join((_BY, _NEARS, _IN, _BEFORE, _CHANGED)))})"


def _graph(obs: DataFrame) -> DataFrame:
    return graph.edges(graph.evidence_rows(obs, regions.region_table(obs.sparkSession, REGIONS), **_WIDE))


@query("SELECT rel, count(*) n FROM g GROUP BY 1", _ALL)
def graph_counts(obs):
    return _graph(obs).groupBy("rel").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT CASE WHEN src = 'user_7' THEN dst ELSE src END node FROM g WHERE 'user_7' IN (src, dst) AND TIMESTAMP '{END}' BETWEEN first_seen - INTERVAL 1 DAY AND last_seen + INTERVAL 1 DAY", _ALL)
def neighbors_at(obs):
    return graph.neighbors(_graph(obs), "user_7", t=search.at(END), slack=timedelta(days=1))


@query("SELECT DISTINCT e.observation_id, rel, CASE WHEN src = 'user_7' THEN dst ELSE src END node FROM obs e JOIN g ON e.entity_id = 'user_7' AND e.event_type = 'error' AND 'user_7' IN (src, dst) AND e.ts BETWEEN first_seen AND last_seen", _ALL)
def connected_when(obs):
    return graph.connected_when(_graph(obs), obs, "user_7", "error")


_ENDS = "SELECT rel, src entity, dst node, first_seen, last_seen FROM g UNION ALL SELECT rel, dst, src, first_seen, last_seen FROM g"


@query(f"SELECT e.rel, count(DISTINCT concat(o.observation_id, '/', e.node)) n, count(DISTINCT o.observation_id) events FROM obs o JOIN ({_ENDS}) e ON e.entity = o.entity_id AND o.ts BETWEEN e.first_seen - INTERVAL 1 HOUR AND e.last_seen + INTERVAL 1 HOUR GROUP BY 1", _ALL)
def connected_all(obs):
    return graph.connected_when(_graph(obs), obs, slack=timedelta(hours=1)).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("observation_id").alias("events"))


@query(
    "SELECT node, min(depth) depth FROM walk GROUP BY 1",
    _PAIRS.replace(", near", ", RECURSIVE near") + f", both_ AS (SELECT src, dst FROM ({_BY} UNION ALL {_NEARS}) UNION SELECT dst, src FROM ({_BY} UNION ALL {_NEARS})), walk AS (SELECT 'user_7' node, 0 depth UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN both_ b ON b.src = w.node WHERE w.depth < 6)",
)
def shortest_paths(obs):
    return graph.distances(graph.edges(graph.observed_by(obs).union(graph.near(obs, **_WIDE))), "user_7", 6)


_BOTH = f", both_ AS (SELECT src, dst FROM ({_BY} UNION ALL {_NEARS}) UNION SELECT dst, src FROM ({_BY} UNION ALL {_NEARS}))"


@query(
    "SELECT depth step, node FROM back",
    _PAIRS.replace(", near", ", RECURSIVE near") + _BOTH + ", walk AS (SELECT 'user_7' node, 0 depth UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN both_ b ON b.src = w.node WHERE w.depth < 6), d AS (SELECT node, min(depth) depth FROM walk GROUP BY 1),"
    " via AS (SELECT a.node, a.depth, min(p.node) via FROM d a JOIN both_ b ON b.dst = a.node JOIN d p ON p.node = b.src AND p.depth = a.depth - 1 GROUP BY 1, 2), back AS (SELECT node, depth, via FROM via WHERE node = 'user_3' UNION ALL SELECT d.node, d.depth, via.via FROM back JOIN d ON d.node = back.via LEFT JOIN via ON via.node = d.node)",
)
def shortest_path(obs):
    return graph.path(graph.edges(graph.observed_by(obs).union(graph.near(obs, **_WIDE))), "user_7", "user_3")


@query(
    "SELECT a observation_id, min(b) event FROM reach GROUP BY 1",
    _PAIRS.replace(", near", ", RECURSIVE near") + ", both_ AS (SELECT a_id a, b_id b FROM near UNION SELECT b_id, a_id FROM near), reach AS (SELECT observation_id a, observation_id b FROM obs UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b)",
)
def associate(obs):
    return events.associate(obs, 500.0, timedelta(minutes=30))


_V = "(pow(greatest(uncertainty_m, 1), 2) / greatest(confidence, CAST(0.001 AS DOUBLE)))"


@query(
    f"SELECT entity_id, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) lat, round(degrees(atan2(y, x)), 6) lon, round(sqrt(1 / w), 6) sigma_m, n FROM (SELECT entity_id, sum(cos(radians(lat)) * cos(radians(lon)) / {_V}) x, sum(cos(radians(lat)) * sin(radians(lon)) / {_V}) y, sum(sin(radians(lat)) / {_V}) z, sum(1 / {_V}) w, count(*) n FROM obs GROUP BY 1)"
)
def weighted_mean_location(obs):
    return trust.weighted_mean(obs).select("entity_id", _r("lat", 6), _r("lon", 6), _r("sigma_m", 6), "n")


def _fusion_sql(rounds: int = 10, k_sigma: float = 3.0) -> str:
    """Medoids, then rounds of flags (k) and centres (c); a round that changes no flag gives what the one before gave."""
    apart = lambda a, b: f"2 * {_d(geo.EARTH_M)} * asin(least({_d(1.0)}, sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2) + pow({a}z - {b}z, 2)) / 2))"
    steps = [
        f"o AS MATERIALIZED (SELECT entity_id, observation_id, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z, {_V} v, confidence FROM obs)",
        f"costs AS (SELECT a.entity_id, a.observation_id, any_value(a.x) x, any_value(a.y) y, any_value(a.z) z, any_value(a.v) v, round(sum({apart('a.', 'b.')} / sqrt(b.v)), 6) c FROM o a JOIN o b ON a.entity_id = b.entity_id GROUP BY 1, 2)",
        "c0 AS MATERIALIZED (SELECT entity_id, x, y, z, sqrt(v) sigma FROM costs QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY c, observation_id) = 1)",
    ]
    for t in range(rounds):
        steps.append(f"k{t} AS MATERIALIZED (SELECT entity_id, observation_id, x, y, z, v, confidence, far AND count(*) OVER w > 2 AND 2 * count(*) FILTER (far) OVER w < count(*) OVER w flag FROM (SELECT o.*, coalesce({apart('o.', 'c.')} > {_d(k_sigma)} * sqrt(o.v + c.sigma * c.sigma), false) far FROM o LEFT JOIN c{t} c ON c.entity_id = o.entity_id) WINDOW w AS (PARTITION BY entity_id))")
        steps.append(f"c{t + 1} AS MATERIALIZED (SELECT entity_id, CASE WHEN len > w * 1e-12 THEN sx / len END x, CASE WHEN len > w * 1e-12 THEN sy / len END y, CASE WHEN len > w * 1e-12 THEN sz / len END z, sqrt(1 / w) sigma, confidence, kept FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) len FROM (SELECT entity_id, sum(x / v) sx, sum(y / v) sy, sum(z / v) sz, sum(1 / v) w, 1 - product(1 - confidence) confidence, count(*) kept FROM k{t} WHERE NOT flag GROUP BY 1)))")
    return ", " + ", ".join(steps)


_FUSED = _fusion_sql()


@query("SELECT c.entity_id, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) lat, round(degrees(atan2(y, x)), 6) lon, round(sigma, 6) sigma_m, round(confidence, 6) confidence, n, n - kept n_outliers FROM c10 c JOIN (SELECT entity_id, count(*) n FROM o GROUP BY 1) a ON a.entity_id = c.entity_id", _FUSED)
def fused_location(obs):
    return trust.fuse_locations(obs).select("entity_id", _r("lat", 6), _r("lon", 6), _r("sigma_m", 6), _r("confidence", 6), "n", "n_outliers")


@query("SELECT entity_id, observation_id, flag outlier FROM k9", _FUSED)
def fused_evidence(obs):
    return trust.fusion(obs)[1]


_LEVEL = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITY[1:])) + " END"


@query(
    "SELECT entity_id, arg_min(level, k) first_level, arg_max(level, k) last_level, count(*) n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, observation_id) k, lag(level) OVER (PARTITION BY entity_id ORDER BY ts, observation_id) prev FROM lev) GROUP BY 1 HAVING bool_and(coalesce(level >= prev, true)) AND count(*) > 1 AND arg_max(level, k) > arg_min(level, k)",
    f", lev AS (SELECT concat(entity_id, '/', CAST(CAST(ts AS DATE) AS VARCHAR)) entity_id, ts, observation_id, CAST({_LEVEL} AS INTEGER) level FROM obs WHERE event_type IN ({', '.join(repr(s) for s in SEVERITY[1:])}))",
)
def deteriorating(obs):
    daily = obs.withColumn("entity_id", F.concat_ws("/", "entity_id", F.to_date("ts").cast("string")))
    return trust.deteriorating(daily, SEVERITY[1:])


@query("SELECT event_type, round(count(DISTINCT goal) / CAST((SELECT count(*) FROM obs WHERE event_type = 'error') AS DOUBLE), 6) fraction FROM (SELECT o.event_type, t.observation_id goal FROM obs t JOIN obs o ON t.event_type = 'error' AND o.entity_id = t.entity_id AND o.ts < t.ts AND o.ts >= t.ts - INTERVAL 1 DAY) GROUP BY 1")
def precursors(obs):
    return trust.precursors(obs, "error", timedelta(days=1)).select("event_type", _r("fraction", 6))


_ASKED = [f"user_{i}" for i in range(0, 15, 2)]


@query(
    "SELECT p.entity_id a, q.entity_id b, round(count(DISTINCT CASE WHEN p.gram = q.gram THEN p.gram END) / CAST((SELECT count(DISTINCT gram) FROM grams WHERE entity_id IN (p.entity_id, q.entity_id)) AS DOUBLE), 6) similarity FROM grams p JOIN grams q ON p.entity_id < q.entity_id GROUP BY 1, 2",
    f", grams AS (SELECT DISTINCT entity_id, gram FROM (SELECT entity_id, concat_ws('>', event_type, lead(event_type) OVER w, lead(event_type, 2) OVER w) gram, row_number() OVER w k, count(*) OVER (PARTITION BY entity_id) n FROM obs WHERE entity_id IN ({', '.join(repr(a) for a in _ASKED)}) WINDOW w AS (PARTITION BY entity_id ORDER BY ts, observation_id)) WHERE k <= n - 2 OR (n < 3 AND k = 1))",
)
def sequence_similarity(obs):
    return trust.sequence_similarity(obs, _ASKED, 3).select("a", "b", _r("similarity", 6))


_QS = "q AS (SELECT event_id qi, lat, lon, CAST(200 + event_id % 800 AS DOUBLE) radius_m FROM obs WHERE event_id % 50 = 0)"


@query(f"SELECT q.qi, count(o.observation_id) n FROM q LEFT JOIN obs o ON {_hav('q.lat', 'q.lon', 'o.lat', 'o.lon')} <= q.radius_m GROUP BY 1", f", {_QS}")
def batch_radius_counts(obs):
    qi = F.substring_index("observation_id", "_", -1).cast("long")
    asked = obs.select(qi.alias("qi"), "lat", "lon", (200 + qi % 800).cast("double").alias("radius_m")).where("qi % 50 = 0")
    return joins.batch_radius(obs, asked)


@query(f"SELECT q.qi, o.observation_id FROM q JOIN obs o ON {_hav('q.lat', 'q.lon', 'o.lat', 'o.lon')} <= q.radius_m", f", {_QS}")
def batch_radius_ids(obs):
    qi = F.substring_index("observation_id", "_", -1).cast("long")
    return joins.batch_radius_ids(obs, obs.select(qi.alias("qi"), "lat", "lon", (200 + qi % 800).cast("double").alias("radius_m")).where("qi % 50 = 0"))


@query("SELECT 2 * CAST(lat >= 40.7 AS INTEGER) + CAST(lon >= -73.95 AS INTEGER) AS pid, count(*) n FROM obs GROUP BY 1".replace("40.7", _d(40.7)).replace("-73.95", f"({_d(-73.95)})").replace("SELECT 2 * CAST(", "SELECT CAST(2 * CAST(", 1).replace(" AS pid", " AS BIGINT) pid", 1))
def partition_sizes_kd(obs):
    return layout.partition_sizes(obs, layout.kd_partition(TREE), 4)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, by the table that follows from the polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = f"xor(acc >> 8, {table}[CAST(xor(acc & 255, b) AS INTEGER) + 1])"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: {step}))"


@query(f"SELECT p.pid, count(o.pid) n FROM (SELECT unnest(range(16)) pid) p LEFT JOIN (SELECT CAST({_crc32_sql('cell')} % 16 AS BIGINT) pid FROM (SELECT concat(CAST(floor((lat + 90) / {_d(0.05)}) AS BIGINT), ':', CAST(floor((lon + 180) / {_d(0.05)}) AS BIGINT)) cell FROM obs)) o ON o.pid = p.pid GROUP BY 1")
def partition_sizes_grid(obs):
    return layout.partition_sizes(obs, layout.grid_partition(0.05, 16), 16)


_DEEP = 1 << layout.DEPTH
_QUADS = f", fine AS (SELECT CAST(least(floor((lat + 90) / 180 * {_DEEP}), {_DEEP - 1}) AS BIGINT) y, CAST(least(floor((lon + 180) / 360 * {_DEEP}), {_DEEP - 1}) AS BIGINT) x FROM obs), cell AS (SELECT level, y >> ({layout.DEPTH} - level) y, x >> ({layout.DEPTH} - level) x, count(*) n FROM fine, (SELECT unnest(range({layout.DEPTH + 1})) level) GROUP BY 1, 2, 3)"


@query(f"SELECT CAST(c.level AS INTEGER) level, count(*) cells, CAST(sum(c.n) AS BIGINT) n, max(c.n) largest FROM cell c LEFT JOIN cell p ON p.level = c.level - 1 AND p.y = c.y >> 1 AND p.x = c.x >> 1 WHERE (c.n <= 100 OR c.level = {layout.DEPTH}) AND (c.level = 0 OR p.n > 100) GROUP BY 1", _QUADS)
def quadtree_cells(obs):
    return layout.quadtree(obs, 100).groupBy("level").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.max("n").alias("largest"))


def _kd_sql(levels: int = 4) -> str:
    """Each level cuts a node where half of its rows lie below, latitudes and longitudes in turn."""
    steps = ["k0 AS (SELECT lat, lon, 0 node FROM obs)"]
    for t in range(levels):
        c = ("lat", "lon")[t % 2]
        steps.append(f"k{t + 1} AS MATERIALIZED (SELECT lat, lon, 2 * node + CAST({c} >= cut AS INTEGER) node FROM (SELECT *, max(CASE WHEN r = n // 2 THEN {c} END) OVER (PARTITION BY node) cut FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {c}) - 1 r, count(*) OVER (PARTITION BY node) n FROM k{t})))")
    return ", " + ", ".join(steps)


@query("SELECT max(n) largest, min(n) smallest, count(*) FILTER (n = 0) empty, round(max(n) / avg(n), 6) imbalance FROM (SELECT p.node, count(k.node) n FROM (SELECT CAST(unnest(range(16)) AS INTEGER) node) p LEFT JOIN k4 k ON k.node = p.node GROUP BY 1)", _kd_sql())
def partition_imbalance(obs):
    tree = layout.kd_tree(obs, 16, exact=True)
    return layout.imbalance(layout.partition_sizes(obs, layout.kd_partition(tree), 16)).withColumn("imbalance", F.round("imbalance", 6))


@query(f"SELECT count(*) n, CAST(sum(CASE WHEN lat >= {_d(40.7)} AND lon < {_d(-73.95)} THEN 0 ELSE 1 END) AS BIGINT) survive FROM obs WHERE {_NEAR}")
def crash_what_if(obs):
    return layout.without_node(search.radius(obs, LAT, LON, R), layout.kd_partition(TREE), 4, 2, 1)


def _raw(obs: DataFrame) -> DataFrame:
    """JSON lines of the observations; one in 20 has one of five faults."""
    k = F.substring_index("observation_id", "_", -1).cast("long")
    fault = k % 100
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.struct(
        "observation_id", "entity_id", "event_type", F.when(fault == 20, "abc").otherwise(F.col("lat").cast("string")).alias("lat"), "lon",
        F.when(fault == 40, stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"), "source_id", F.when(fault == 60, 2.0).otherwise(F.col("confidence")).alias("confidence"),
    )
    return obs.select(k.alias("k"), F.when(fault == 80, "{not json").when(fault == 0, "[]").otherwise(F.to_json(line)).alias("value"))


@query("SELECT observation_id, entity_id, date_trunc('second', ts) ts, lat, lon, confidence FROM obs WHERE event_id % 100 NOT IN (0, 20, 40, 60, 80)")
def normalize_valid(obs):
    return ingest.normalised(_raw(obs)).where("reason IS NULL").select("observation_id", "entity_id", "ts", "lat", "lon", "confidence")


@query("SELECT CASE event_id % 100 WHEN 20 THEN 'bad coordinates: missing or not a number' WHEN 40 THEN 'bad timestamp: missing, unreadable or without time zone' WHEN 60 THEN 'bad confidence' WHEN 80 THEN 'not JSON' ELSE 'record is not an object' END reason, count(*) n FROM obs WHERE event_id % 100 IN (0, 20, 40, 60, 80) GROUP BY 1")
def normalize_dead_letters(obs):
    return ingest.normalised(_raw(obs)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT concat('obs_', CAST(event_id // 3 AS VARCHAR)) observation_id, min(event_id) k FROM obs GROUP BY 1 HAVING min(event_id) // 3 % 4 <> 0")
def dedup_ingest(obs):
    k = F.substring_index("observation_id", "_", -1).cast("long")
    batch = obs.withColumn("k", k).withColumn("observation_id", F.concat(F.lit("obs_"), F.floor(k / 3).cast("string")))
    known = batch.where(F.floor(F.col("k") / 3) % 4 == 0)
    return ingest.absent(ingest.first_writes(batch, F.col("k")), known).select("observation_id", "k")


@query("SELECT observation_id FROM (SELECT *, max(ts) OVER (PARTITION BY entity_id ORDER BY event_id * 7919 % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM obs) WHERE ts < m")
def out_of_order(obs):
    late = ingest.out_of_order(obs.withColumn("k", F.substring_index("observation_id", "_", -1).cast("long") * 7919 % 1000003), "k")
    return late.select("observation_id")


def _geohash_sql(letters: int) -> str:
    """Geohash of lat and lon: the bits of both cell numbers in turn, five to a letter."""
    bits = 5 * letters
    n = {"lon": (bits + 1) // 2, "lat": bits // 2}
    low = {"lon": 180, "lat": 90}
    cell = {c: f"CAST(least(floor(({c} + {low[c]}) / {_d(2.0 * low[c])} * {_d(float(1 << n[c]))}), {(1 << n[c]) - 1}) AS BIGINT)" for c in n}
    bit = lambda k: f"(({cell['lat' if k % 2 else 'lon']} >> {n['lat' if k % 2 else 'lon'] - 1 - k // 2}) & 1)"
    return "concat(" + ", ".join(f"substr('{geo.GEOHASH}', CAST({' + '.join(f'{bit(5 * c + i)} * {1 << 4 - i}' for i in range(5))} AS INTEGER) + 1, 1)" for c in range(letters)) + ")"


@query(f"SELECT {_geohash_sql(6)} cell, count(*) n FROM obs GROUP BY 1")
def geohash_cells(obs):
    return obs.groupBy(geo.geohash(F.col("lat"), F.col("lon"), 6).alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT observation_id, event_type, min(entity_id) entity_id FROM (SELECT CASE WHEN event_id % 4 = 0 THEN concat('obs_', CAST(event_id + 1 AS VARCHAR)) ELSE observation_id END observation_id, CASE WHEN event_id % 4 = 0 AND event_id + 1 < (SELECT count(*) FROM events) THEN NULL ELSE event_type END event_type, CASE WHEN event_id % 4 = 0 AND event_id + 1 < (SELECT count(*) FROM events) THEN NULL ELSE entity_id END entity_id FROM obs) WHERE event_type IS NOT NULL GROUP BY 1, 2")
def assembled(obs):
    k = F.substring_index("observation_id", "_", -1).cast("long")
    again = obs.where(k % 4 == 0).withColumn("observation_id", F.concat(F.lit("obs_"), (k + 1).cast("string")))
    return observations.assembled([obs.where(k % 4 != 0), again]).select("observation_id", "event_type", "entity_id")


@query("SELECT observation_id, ts, lat, lon FROM obs")
def delta_round_trip(obs):
    return observations.delta_unpacked(observations.delta_packed(obs)).select("observation_id", "ts", "lat", "lon")
