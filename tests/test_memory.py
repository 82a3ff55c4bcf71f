"""Observation operators against DuckDB and plain Python, with edge cases; ingestion with crashes."""

import json
import math
import random
from datetime import UTC, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrachron import queries
from terrachron.functions import geo
from terrachron.operators import aggregate, graph, joins, layout, search, trust
from terrachron.plans.components import components
from terrachron.sources import observations
from terrachron.streaming import ingest
from terrachron.tools import ARGUMENTS, ToolError, Tools, checked

SF = "/root/testdata/sf0.001"
T0 = datetime(2026, 10, 4, 9)
COLS = "observation_id string, entity_id string, event_type string, lat double, lon double, ts timestamp, source_id string, confidence double, uncertainty_m double, parent_observation string"


def world(spark, rows):
    """rows: (entity, event, lat, lon, minutes, source, ...)"""
    return observations.complete(spark.createDataFrame([(f"o{i:04d}", e, t, float(a), float(b), T0 + timedelta(minutes=m), *(x + ("s", 1.0, 5.0, None)[len(x):])) for i, (e, t, a, b, m, *x) in enumerate([(*r[:5], tuple(r[5:])) for r in rows]) for x in [x[0]]], COLS))


def hav(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v is pd.NaT or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("lat,lon,r", [(0, 179.999, 5000), (0, -180, 2e6), (89.9, 10, 50_000), (-90, 0, 100_000), (11, 76, 0), (45, -120, 1.9e7)])
def test_radius_and_nearest_everywhere(spark, lat, lon, r):
    rng = random.Random(1)
    rows = [("e", "p", a, b, 0) for a, b in [(0, 179.9995), (0, -179.9995), (0, 180), (0, -180), (90, 0), (-90, 50), (11, 76), (11, 76)]]
    rows += [("e", "p", rng.uniform(-90, 90), rng.uniform(-180, 180), 0) for _ in range(300)] + [("e", "p", rng.uniform(89, 90), rng.uniform(-180, 180), 0) for _ in range(60)]
    obs = world(spark, rows)
    d = {f"o{i:04d}": hav(lat, lon, a, b) for i, (_, _, a, b, _) in enumerate(rows)}
    assert {x.observation_id for x in search.radius(obs, lat, lon, r).collect()} == {i for i, x in d.items() if x <= r}
    got = [x.distance_m for x in search.nearest(obs, lat, lon, 10).collect()]
    assert np.allclose(got, sorted(d.values())[:10], atol=1e-6)


def test_geohash_and_polygon(spark):
    rows = [("e", "p", 57.64911, 10.40744, 0), ("e", "p", 90, 180, 0), ("e", "p", -90, -180, 0)]
    got = [r.g for r in world(spark, rows).orderBy("observation_id").select(geo.geohash(F.col("lat"), F.col("lon"), 11).alias("g")).collect()]
    assert got == ["u4pruydqqvj", "zzzzzzzzzzz", "00000000000"]
    s, n, w, e = geo.geohash_box("u4pruydqqvj")
    assert s <= 57.64911 < n and w <= 10.40744 < e
    with pytest.raises(ValueError):
        geo.in_ring([(0, 0), (1, 1)])
    with pytest.raises(ValueError):
        geo.boxes(0, 0, -1)


def test_lineage_cycle_and_missing_parent(spark):
    obs = world(spark, [("e", "p", 0, 0, i, "s", 1.0, 1.0, p) for i, p in enumerate(["o0001", "o0000", "gone", None])])
    got = {(r.origin, r.observation_id, r.depth) for r in search.lineage(obs, obs).collect()}
    assert got == {("o0000", "o0000", 0), ("o0000", "o0001", 1), ("o0001", "o0001", 0), ("o0001", "o0000", 1), ("o0002", "o0002", 0), ("o0003", "o0003", 0)}
    with pytest.raises(KeyError):
        search.get(obs, "none")


def test_lineage_of_a_long_chain_and_a_tail_into_a_cycle(spark):
    n = 1500
    parents = [None, *(f"o{i:04d}" for i in range(n - 1)), f"o{n + 3:04d}", f"o{n:04d}", f"o{n + 1:04d}", f"o{n + 2:04d}", f"o{n + 1:04d}"]
    obs = world(spark, [("e", "p", 0, 0, i, "s", 1.0, 1.0, p) for i, p in enumerate(parents)])
    of = lambda i: {(r.observation_id, r.depth) for r in search.lineage(obs, obs.where(F.col("observation_id") == f"o{i:04d}")).collect()}
    assert of(n - 1) == {(f"o{n - 1 - d:04d}", d) for d in range(n)}
    assert of(n + 4) == {(f"o{i:04d}", d) for d, i in enumerate([n + 4, n + 1, n, n + 3, n + 2])}


PLACES = [(0.0, 10.0), (60.0, 180.0), (85.0, -180.0), (-89.99, 0.0), (89.99, 0.0), (0.0, 180.0), (40.7, -74.0)]


def around(rng, centre, n, spread_m=90.0):
    """n places about a centre, by bearing and distance, so that there are as many near a pole as elsewhere."""
    out = []
    for _ in range(n):
        d, b = spread_m * math.sqrt(rng.random()) / geo.EARTH_M, rng.uniform(0, 2 * math.pi)
        la, lo = math.radians(centre[0]), math.radians(centre[1])
        y = math.asin(math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))
        x = lo + math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(y))
        out.append((math.degrees(y), (math.degrees(x) + 180) % 360 - 180))
    return out


@pytest.fixture(scope="module")
def everywhere(spark):
    """Groups at several latitudes in one table, with the poles and both sides of the antimeridian."""
    rng = random.Random(2)
    rows = [(f"e{rng.randrange(12)}", "p", a, b, rng.uniform(0, 60)) for c in PLACES for a, b in around(rng, c, 120)]
    rows += [("e1", "p", 90, 0, 1), ("e2", "p", 90, 77, 2), ("e3", "p", -90, 5, 1), ("e4", "p", 0, 180, 3), ("e5", "p", 0, -180, 3)]
    obs = world(spark, rows).persist()
    return obs, [(r.observation_id, r.entity_id, r.lat, r.lon, r.ts) for r in obs.collect()]


@pytest.mark.parametrize("radius_m", [0.0, 60.0, 3000.0])
def test_neighbours_equal_brute_force_at_every_latitude(everywhere, radius_m):
    obs, own = everywhere
    got = [(r.a_id, r.b_id, r.a_entity, r.b_ts) for r in joins.neighbour_pairs(obs, radius_m, timedelta(minutes=3)).collect()]
    want = [(a[0], b[0], a[1], b[4]) for a in own for b in own if a[0] < b[0] and a[1] != b[1] and abs(a[4] - b[4]) <= timedelta(minutes=3) and hav(a[2], a[3], b[2], b[3]) <= radius_m]
    assert sorted(got) == sorted(want) and (want or not radius_m)


def test_one_polar_row_does_not_widen_other_cells(spark):
    cells = lambda rows: world(spark, rows).select(*[c.alias(n) for n, c in zip("rc", geo.radius_cell(F.col("lat"), F.col("lon"), 500.0), strict=True)]).collect()
    town = [("e", "p", 41.0, -180 + i / 100, 0) for i in range(500)]
    assert cells(town) == cells([*town, ("e", "p", 90.0, 0, 0)])[:500] and len({r.c for r in cells(town)}) > 400


@pytest.mark.parametrize("radius_m", [60.0, 2000.0])
def test_nearby_entities_equal_brute_force_at_every_latitude(spark, everywhere, radius_m):
    obs, own = everywhere
    w, t = timedelta(minutes=5), T0 + timedelta(minutes=30)
    for e in ("e1", "e2"):
        mine = [o for o in own if o[1] == e and abs(o[4] - t) <= w]
        want = {}
        for a in mine:
            for b in own:
                d = hav(a[2], a[3], b[2], b[3])
                if b[1] != e and abs(a[4] - b[4]) <= w and d <= radius_m:
                    want[b[1]] = min(want.get(b[1], 9e9), d)
        got = {r.entity_id: r.distance_m for r in joins.nearby_entities(obs, e, t, radius_m, w).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    polar = world(spark, [("own", "p", 89.99, 0, 0), ("other", "p", 89.99, 90, 0)])
    assert [round(r.distance_m) for r in joins.nearby_entities(polar, "own", T0, 2000.0, w).collect()] == [1573]


def test_batches_of_circles_equal_brute_force_at_every_latitude(spark, everywhere):
    obs, own = everywhere
    asked = [(i, own[i][2], own[i][3], r) for i, r in zip(range(0, len(own), 9), [0.0, 40.0, 100.0, 5000.0, 2e6, 2.1e7] * 30)] + [(5000, 10.0, 10.0, -1.0)]
    queries = spark.createDataFrame(asked, "qi long, lat double, lon double, radius_m double")
    want = {(q, o[0]) for q, a, b, r in asked for o in own if hav(a, b, o[2], o[3]) <= r}
    assert {(r.qi, r.observation_id) for r in joins.batch_radius_ids(obs, queries).collect()} == want
    assert {r.qi: r.n for r in joins.batch_radius(obs, queries).collect()} == {q[0]: sum(q[0] == w[0] for w in want) for q in asked}
    assert joins.batch_radius(obs, queries.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000), (7, 7)] + [(2000 + rng.randrange(60), 2000 + rng.randrange(60)) for _ in range(50)]
    low = {}
    for _ in range(300):
        for a, b in edges:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fused(points, k_sigma=3.0, rounds=10):
    """(lat, lon, sigma_m, confidence, outlier ids) of one entity's (id, lat, lon, confidence, uncertainty), by plain Python and numpy."""
    points = sorted(points)
    a, b = (np.radians([p[i] for p in points]) for i in (1, 2))
    p = np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
    conf = np.array([x[3] for x in points])
    var = np.maximum([x[4] for x in points], 1.0) ** 2 / np.maximum(conf, 1e-3)
    n, out = len(points), np.zeros(len(points), bool)
    metres = lambda q: 2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.linalg.norm(p - q, axis=1) / 2))

    def mean():
        w = 1 / var[~out]
        total = (p[~out] * w[:, None]).sum(axis=0)
        return total / np.linalg.norm(total), float(np.sqrt(1 / w.sum()))

    if n > 2:
        best = int(np.argmin(np.round([(metres(c) / np.sqrt(var)).sum() for c in p], 6)))
        centre, sigma = p[best], float(np.sqrt(var[best]))
        for turn in range(rounds):
            far = metres(centre) > k_sigma * np.sqrt(var + sigma**2)
            if 2 * far.sum() >= n:
                far[:] = False
            if turn and (far == out).all():
                break
            out = far
            centre, sigma = mean()
    c, sigma = mean()
    return float(np.degrees(np.arctan2(c[2], np.hypot(c[0], c[1])))), float(np.degrees(np.arctan2(c[1], c[0]))), sigma, float(1 - np.prod(1 - conf[~out])), {points[i][0] for i in np.flatnonzero(out)}


@pytest.mark.parametrize("block", [3, 512])
def test_fusion_equals_plain_python_on_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(trust, "BLOCK", block)
    obs = observations.from_events(spark, SF).unionByName(observations.from_events(spark, SF).where("entity_id = 'user_3'").limit(1).withColumn("entity_id", F.lit("single")))
    by = {}
    for r in obs.collect():
        by.setdefault(r.entity_id, []).append((r.observation_id, r.lat, r.lon, r.confidence, r.uncertainty_m))
    one, rows = trust.fusion(obs)
    out = {}
    for r in rows.collect():
        out.setdefault(r.entity_id, {})[r.observation_id] = r.outlier
    got = one.collect()
    assert {r.entity_id for r in got} == by.keys()
    for r in got:
        want = fused(by[r.entity_id])
        assert np.allclose((r.lat, r.lon, r.sigma_m, r.confidence), want[:4], atol=1e-9) and (r.n, r.n_outliers) == (len(by[r.entity_id]), len(want[4]))
        assert {i for i, flag in out[r.entity_id].items() if flag} == want[4] and out[r.entity_id].keys() == {p[0] for p in by[r.entity_id]}


def test_fusion_flags_outliers(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{s}", "p", 40 + rng.normal(0, 5) / 111_195, -74 + rng.normal(0, 5) / 85_000, 0, f"s{k}", 1.0, 5.0) for s in range(20) for k in range(7)]
    rows += [(f"e{s}", "p", 40.05, -74, 1, "bad", 1.0, 5.0) for s in range(20)] + [("odd", "p", 0, 0, 0), ("odd", "p", 0, 180, 0)]
    got = trust.fuse_locations(world(spark, rows)).collect()
    assert len(got) == 21 and all(r.n_outliers == 1 and hav(r.lat, r.lon, 40, -74) < 15 and r.n == 8 for r in got if r.entity_id != "odd")
    assert [(r.lat, r.lon, r.n) for r in got if r.entity_id == "odd"] == [(None, None, 2)]
    same = trust.weighted_mean(world(spark, [("a", "p", 0, 179, 0), ("a", "p", 0, -179, 0), ("b", "p", 0, 0, 0), ("b", "p", 0, 180, 0)])).orderBy("entity_id").collect()
    assert abs(abs(same[0].lon) - 180) < 1e-9 and same[1].lat is None


def test_patterns(spark):
    rows = [(e, t, 0, 0, i) for e, ts in {"p172": "nhc", "p1": "nn", "p2": "cn", "p3": "nch", "p4": "hhcc", "p5": "c"}.items() for i, t in enumerate(ts)] + [("p172", "ping", 0, 0, 1)]
    assert {r.entity_id for r in trust.deteriorating(world(spark, rows), ["n", "h", "c"]).collect()} == {"p172", "p4"}
    rows = [(f"m{i}", t, 0, 0, 1000 * i + m) for i in range(30) for t, m in [("failure", 600), ("temp", 590), ("old", 100)] + ([("vib", 595)] if i % 3 == 0 else [])]
    got = {r.event_type: r.fraction for r in trust.precursors(world(spark, rows), "failure", timedelta(minutes=30)).collect()}
    assert got == {"temp": 1.0, "vib": pytest.approx(1 / 3)}


def test_graph_scenario(spark, tmp_path):
    rows = [("Machine_47", "temp", 0, 0, 0, "A"), ("Machine_47", "vib", 0, 0, 5, "B"), ("Machine_47", "failure", 0, 0, 10, "B"), ("Machine_48", "ping", 0.0002, 0, 9, "A"), ("Machine_99", "ping", 1, 0, 9, "A")]
    obs = world(spark, rows)
    g = graph.edges(graph.evidence_rows(obs, {"Zone": [(-1, -1), (-1, 1), (0.5, 1), (0.5, -1)]}))
    names = lambda df: {r.node for r in df.collect()}
    assert names(graph.neighbors(g, "Machine_47", "NEAR")) == {"Machine_48"} and names(graph.neighbors(g, "Machine_47", "OBSERVED_BY")) == {"A", "B"}
    assert names(graph.neighbors(g, "Machine_47", "INSIDE")) == {"Zone"} and names(graph.neighbors(g, "Zone", "INSIDE", direction="out")) == set()
    assert {r.node: r.depth for r in graph.distances(g, "Machine_48").collect()}["B"] == 2
    steps = lambda a, b, most=6: [r.node for r in graph.path(g, a, b, most).orderBy("step").collect()]
    assert steps("Machine_48", "B") == ["Machine_48", "Machine_47", "B"] and steps("B", "B") == ["B"] and steps("Machine_48", "nowhere") == [] and steps("Machine_48", "B", 1) == []
    graph.write_edges(g, str(tmp_path / "g"))
    again = spark.read.parquet(str(tmp_path / "g" / "edges"))
    assert sorted(map(str, again.select(g.columns).collect())) == sorted(map(str, g.collect())) and (tmp_path / "g" / "edges" / "rel=NEAR").exists()
    assert graph.edge(g, "Machine_48", "NEAR", "Machine_47").count() == 1 and graph.connected_when(g, obs, "Machine_47", "failure").where("rel = 'NEAR'").count() == 1


def test_layout(spark, tmp_path):
    obs = observations.synthetic(spark, 4000, seed=5).persist()
    tree = layout.kd_tree(obs, 16)
    assert layout.imbalance(layout.partition_sizes(obs, layout.kd_partition(tree), 16)).first().imbalance < 1.3
    assert sorted(obs.collect()) == sorted(observations.synthetic(spark, 4000, seed=5).collect()) and obs.where("lat IS NULL OR NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180").count() == 0
    box = tuple(obs.agg(F.expr("percentile(lat, 0.3)"), F.expr("percentile(lat, 0.7)"), F.expr("percentile(lon, 0.2)"), F.expr("percentile(lon, 0.9)")).first())
    inside = obs.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    assert {r.p for r in inside.select(layout.kd_partition(tree).alias("p")).distinct().collect()} <= set(layout.kd_route(tree, *box))
    assert layout.partition_sizes(obs, layout.grid_partition(10, 16), 16).agg(F.sum("n")).first()[0] == 4000
    for cell in (10, 7):
        assert {r.p for r in inside.select(layout.grid_partition(cell, 64).alias("p")).distinct().collect()} <= set(layout.grid_route(cell, 64, *box))
    layout.write_partitions(obs, layout.kd_partition(tree), str(tmp_path / "kd"), 2)
    box_rows = layout.read_box(spark.read.parquet(str(tmp_path / "kd")), layout.kd_route(tree, *box), *box)
    assert sorted(r.observation_id for r in box_rows.collect()) == sorted(r.observation_id for r in inside.collect()) and "PartitionFilters: [pid" in box_rows._jdf.queryExecution().executedPlan().toString()
    edge = world(spark, [("e", "p", 90, 180, 0), ("e", "p", 89.0, 179.0, 0)]).select(layout.grid_partition(7, 64).alias("p")).collect()
    assert [r.p for r in edge] == [__import__("zlib").crc32(b"25:51") % 64] * 2
    assert layout.kd_tree(obs, 1) == 0 and isinstance(layout.kd_tree(obs.limit(0), 4), layout.Split)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text('"Date/Time","Lat","Lon","Base"\n"4/1/2014 0:11:00",40.769,-73.9549,"B02512"\n"4/1/2014 0:11:00",40.769,-73.9549,"B02512"\n')
    (tmp_path / "q.csv").write_text("Date,Latitude,Longitude,Magnitude\n01/02/1965,19.2,145.6,6\n1975-02-23T02:58:41.000Z,8.0,124.0,5.6\n")
    u = observations.read_pickups(spark, str(tmp_path / "u.csv")).collect()
    assert len({r.observation_id for r in u}) == 2 and u[0].ts == datetime(2014, 4, 1, 4, 11) and u[0].uncertainty_m == 11
    q = observations.read_quakes(spark, str(tmp_path / "q.csv")).orderBy("ts").collect()
    assert [r.ts.year for r in q] == [1965, 1975] and json.loads(q[0].attributes) == {"magnitude": 6.0}
    observations.write_layout(observations.from_events(spark, SF), str(tmp_path / "t"), 2)
    plan = search.radius(spark.read.parquet(str(tmp_path / "t")), 40.7, -73.95, 500.0)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "GreaterThanOrEqual(lat" in plan


GOOD = {"observation_id": "r1", "entity_id": "e", "event_type": "t", "lat": 1.5, "lon": "2.5", "timestamp": "2026-10-04T14:30:00+05:30", "source_id": "s"}


def test_validation(spark):
    bad = ["null", "[]", "{}", "5", "{not", '"x"'] + [json.dumps(GOOD | x) for x in [{"lat": "abc"}, {"lat": 91}, {"lat": "NaN"}, {"lon": None}, {"timestamp": None}, {"timestamp": "2026-10-04T14:30:00"}, {"timestamp": "yesterday"}, {"timestamp": True}, {"timestamp": 1e20}, {"entity_id": ""}, {"source_id": None}, {"confidence": 2}, {"confidence": "high"}, {"confidence": None}, {"duration_s": -1}, {"uncertainty_m": -1}, {"attributes": 5}, {"inputs": None}, {"attributes": None}]] + [json.dumps(GOOD)[:-1] + ', "conf\\u0069dence": null}']
    good = [json.dumps(x) for x in (GOOD, GOOD | {"timestamp": T0.replace(tzinfo=UTC).timestamp()}, {k: v for k, v in GOOD.items() if k != "observation_id"}, GOOD | {"attributes": {"a": 1}, "inputs": ["x"]}, GOOD | {"timestamp": "2026-10-04T09:00:00.000+0000", "processing_model": 'a "confidence" \\ b'})]
    out = ingest.normalised(spark.createDataFrame([(v,) for v in bad + good], "value string"))
    got = {r.value: r for r in out.collect()}
    assert [v for v in bad if got[v].reason is None] == [] and [got[v].reason for v in good] == [None] * 5
    assert got[good[0]].ts == T0 and got[good[1]].ts == T0 and len(got[good[2]].observation_id) == 40


def test_stream_survives_crashes(spark, tmp_path):
    rng = random.Random(6)
    lines = [json.dumps(GOOD | {"observation_id": f"r{i}"}) for i in range(300)]
    lines += rng.sample(lines, 80) + ["{bad", "[]", json.dumps(GOOD | {"lat": 99})] * 10
    rng.shuffle(lines)
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines[k::5]) + "\n")
    failed = []

    def crash(batch):
        if batch in (1, 3) and batch not in failed:
            failed.append(batch)
            raise RuntimeError("crash")

    for _ in range(4):
        q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "dead"), str(tmp_path / "ck"), 1, crash)
        try:
            q.awaitTermination()
            break
        except Exception as e:
            assert "crash" in str(e)
    table = spark.read.parquet(str(tmp_path / "table"))
    assert failed == [1, 3] and table.count() == 300 and table.select("observation_id").distinct().count() == 300
    assert {r.reason: r["count"] for r in spark.read.parquet(str(tmp_path / "dead")).groupBy("reason").count().collect()} == {"not JSON": 10, "record is not an object": 10, "bad coordinates: out of range": 10}


def test_zones_lie_on_the_lattice(spark, tmp_path):
    rows = [("e", "p", 40.7001, -74.0199, 0), ("e", "p", 40.7099, -74.0101, 61), ("e", "p", 40.72, -74.0, 0), ("e", "p", 91.0, 0, 0)]
    obs = world(spark, rows)
    report = aggregate.zone_report(obs, 0.01, str(tmp_path / "z")).first()
    assert (report.rows_in, report.valid, report.invalid, report.joined) == (4, 3, 1, 3)
    totals = {(round(r.zlat, 5), round(r.zlon, 5)): r.n for r in spark.read.parquet(str(tmp_path / "z" / "zone_totals")).collect()}
    assert totals == {(40.69995, -74.02005): 1, (40.69995, -74.01005 - 0.01): 1} or sum(totals.values()) == 3
    for r in aggregate.zones(obs, 0.01).collect():
        assert r.zlat <= r.lat < r.zlat + 0.01 and r.zlon <= r.lon < r.zlon + 0.01
    assert spark.read.parquet(str(tmp_path / "z" / "zone_hour_counts")).agg(F.sum("n")).first()[0] == 3
    assert aggregate.zone_report(obs.limit(0), 0.01).first().joined == 0


def test_similarity_of_empty_histories(spark):
    obs = world(spark, [("a", t, 0, 0, i) for i, t in enumerate("xyz")] + [("b", t, 0, 0, i) for i, t in enumerate("xyz")])
    got = {(r.a, r.b): r.similarity for r in trust.sequence_similarity(obs, ["a", "b", "no", "none"]).collect()}
    assert got == {("a", "b"): 1.0, ("a", "no"): 0.0, ("a", "none"): 0.0, ("b", "no"): 0.0, ("b", "none"): 0.0, ("no", "none"): 1.0}


def test_assembled_keeps_the_first(spark):
    a, b = world(spark, [("e", "p", 0, 0, 0), ("e", "q", 0, 0, 1)]), world(spark, [("f", "p", 0, 0, 0), ("f", "p", 0, 0, 0), ("g", "p", 0, 0, 0)])
    assert sorted((r.observation_id, r.entity_id) for r in observations.assembled([a, b]).collect()) == [("o0000", "e"), ("o0001", "e"), ("o0002", "g")]


def test_tools_never_raise(spark):
    obs = observations.from_events(spark, SF).limit(60).persist()
    tools, rng = Tools(obs), random.Random(9)
    junk = [None, "", "x", "\0", "\ud800", 0, -1, 1, 1.5, 1e-6, 1e308, float("nan"), float("inf"), 10**400, True, [], {}, "2024-01-01T00:00:00Z", "0001-01-01T00:00:00+14:00", "9999-12-31T23:59:59-14:00", "2024-01-01", "user_3", "obs_13", "source_id"]
    keys = sorted({k for own in ARGUMENTS.values() for k in own} | {"more"})
    ran = 0
    for _ in range(3000):
        name = rng.choice([*ARGUMENTS, "no", None, 7, "dispatch"])
        args = {k: rng.choice(junk) for k in rng.sample(keys, rng.randrange(len(keys)))} if rng.random() < 0.95 else rng.choice(junk)
        if isinstance(name, str) and name in ARGUMENTS:
            try:
                checked(name, args)
                ran += 1
                if ran > 12:  # calls that reach Spark cost a job each
                    continue
            except ToolError:
                pass
        out = tools.dispatch(name, args)
        assert isinstance(out, dict) and isinstance(out["ok"], bool) and ("error" in out) == (not out["ok"])
    where = {"lat": 0, "lon": 0, "radius_m": 2.1e7, "start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z"}
    whole = Tools(observations.from_events(spark, SF))
    assert whole.dispatch("history_before", {"entity_id": "user_3", "event_type": "view", "lookback_minutes": 1e-6})["ok"]
    assert not tools.dispatch("events_near", where | {"start": "0001-01-01T00:00:00+14:00"})["ok"]
    odd = Tools(world(spark, [("e", "p", 0, 0, 0), ("e", "p", 0, 180, 0)]))
    assert odd.dispatch("fused_location", {"entity_id": "e", "start": "2026-01-01T00:00:00Z", "end": "2027-01-01T00:00:00Z"})["lat"] is None


def test_tools(spark):
    obs = observations.from_events(spark, SF)
    tools = Tools(obs)
    where = {"lat": 40.7, "lon": -73.95, "radius_m": 9000, "start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00+00:00"}
    near = tools.dispatch("events_near", where | {"limit": 5})
    assert near["ok"] and near["count"] >= len(near["observations"]) == 5 and near["truncated"]
    assert tools.dispatch("evidence", {"observation_id": "obs_13"})["count"] == 4
    assert sum(b["n"] for b in tools.dispatch("activity", where | {"bucket_minutes": 1440})["buckets"]) == near["count"]
    assert tools.dispatch("fused_location", {"entity_id": "user_3", **{k: where[k] for k in ("start", "end")}})["ok"]
    assert tools.dispatch("history_before", {"entity_id": "user_3", "event_type": "error", "lookback_minutes": 9000})["ok"] and tools.dispatch("hotspots", where | {"cell_m": 500})["ok"]
    changed = tools.dispatch("what_changed", where)
    assert changed["ok"] and changed["appeared_count"] == len(changed["appeared"]) and not changed["appeared_truncated"]
    told = tools.dispatch("overview", {"points": 100})
    assert told["n"] == 1000 and len(told["points"]) == 100 and told["sampled"] and told["event_types"] == sorted(told["event_types"]) and len(told["entity_names"]) == told["entities"]
    assert tools.dispatch("evidence", {"observation_id": "obs_13"})["inputs"] == [] and near["sources"] == sorted(near["sources"])
    assert tools.dispatch("nearby_entities", {"entity_id": "user_3", "at": "2024-01-10T00:00:00Z", "radius_m": 10, "window_minutes": 50000})["ok"]
    for name, args in [("no", {}), ("events_near", None), ("events_near", where | {"lat": True}), ("events_near", where | {"radius_m": float("nan")}), ("activity", where | {"bucket_minutes": 1}), ("evidence", {"observation_id": "none"}), ("what_changed", where | {"end": "2023-01-01T00:00:00Z"}), ("events_near", where | {"start": "2024-01-01T00:00:00"})]:
        assert tools.dispatch(name, args)["ok"] is False


def test_hotspot_cells_are_even(spark):
    obs = world(spark, [("e", "p", a, b, 0) for a in (0.0, 60.0, 89.9999) for b in (-180.0, 179.9999)])
    cells = aggregate.hotspots(obs, "p", 500.0, 1).collect()
    assert sum(r.n for r in cells) == 6
