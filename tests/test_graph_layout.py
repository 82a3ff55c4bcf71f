"""Interval join, search from both ends, quadtree layout."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrachron.operators import graph, layout
from terrachron.sources import observations

T0 = datetime(2026, 10, 4, 9)
EDGES = "src string, rel string, dst string, first_seen timestamp, last_seen timestamp, n_evidence long"


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(2)
    edges = []
    for _ in range(400):
        a, first = rng.randrange(6), rng.randrange(10**6)
        edges.append((f"e{a}", rng.choice(["NEAR", "OBSERVED_BY"]), f"n{rng.randrange(8)}", T0 + timedelta(seconds=first), T0 + timedelta(seconds=first + int(10 ** rng.uniform(-1, 6))), 1))
    events = [(f"o{i}", rng.choice([f"e{k}" for k in range(6)] + ["n1"]), rng.choice("xy"), T0 + timedelta(seconds=rng.randrange(10**6))) for i in range(300)]
    events += [("first", edges[0][0], "x", edges[0][3]), ("last", edges[0][0], "x", edges[0][4]), ("slack", edges[0][0], "x", edges[0][4] + timedelta(seconds=7))]
    g, obs = spark.createDataFrame(edges, EDGES), spark.createDataFrame(events, "observation_id string, entity_id string, event_type string, ts timestamp")
    for entity, kind, slack in ((None, None, timedelta(seconds=7)), ("e1", "x", timedelta(0)), (None, "y", timedelta(days=3))):
        out = graph.connected_when(g, obs, entity, kind, slack)
        want = {(o, r, d if s == e else s) for o, e, k, t in events for s, r, d, a, b, _ in edges if e in (s, d) and a - slack <= t <= b + slack and entity in (None, e) and kind in (None, k)}
        assert {tuple(r) for r in out.collect()} == want and want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert graph.connected_when(g.limit(0), obs).count() == 0


def test_search_from_both_ends(spark):
    pairs = [("a", "hub"), ("hub", "x0"), ("x0", "y"), ("y", "b"), ("a", "p"), ("p", "q"), ("q", "r"), ("r", "b")] + [("hub", f"h{i}") for i in range(500)] + [(f"h{i}", f"k{i}") for i in range(500)] + [("c", "d")]
    g = spark.createDataFrame([(s, "NEAR", d, T0, T0, 1) for s, d in pairs], EDGES)
    sizes: list[int] = []
    told = [r.node for r in graph.path(g, "a", "b", sizes=sizes).orderBy("step").collect()]
    assert told == ["a", "p", "q", "r", "b"]  # of two paths the one whose nodes are smaller, from b on
    assert sum(sizes) < 20 < graph.distances(g, "a", 3).count()
    assert [tuple(r) for r in graph.path(g, "a", "a").collect()] == [(0, "a")]
    assert graph.path(g, "a", "c").count() == graph.path(g, "a", "b", most=3).count() == graph.path(g, "a", "none").count() == 0
    assert [r.node for r in graph.path(g, "k7", "k8").orderBy("step").collect()] == ["k7", "h7", "hub", "h8", "k8"]
    assert [r.node for r in graph.path(g, "c", "d", most=1).orderBy("step").collect()] == ["c", "d"]


def test_paths_are_shortest_and_equal_from_any_side(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted((f"v{rng.randrange(40):02d}", f"v{rng.randrange(40):02d}"))) for _ in range(55)})
    near = {}
    for s, d in pairs:
        if s != d:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    g = spark.createDataFrame([(s, "NEAR", d, T0, T0, 1) for s, d in pairs if s != d], EDGES).persist()
    depth = {"v00": 0}
    queue = ["v00"]
    for n in queue:
        for m in sorted(near.get(n, ())):
            if m not in depth:
                depth[m] = depth[n] + 1
                queue.append(m)
    for goal in ("v01", "v07", "v23"):
        want = [goal] if depth.get(goal, 9) <= 6 else []
        while want and want[-1] != "v00":
            want.append(min(m for m in near[want[-1]] if depth[m] == depth[want[-1]] - 1))
        assert [r.node for r in graph.path(g, "v00", goal).orderBy("step").collect()] == want[::-1]
    g.unpersist()


def test_quadtree(spark, tmp_path):
    obs = observations.synthetic(spark, 6000, towns=5).unionByName(observations.synthetic(spark, 50, seed=1).withColumns({"observation_id": F.concat(F.lit("s"), "observation_id"), "lat": F.lit(12.5), "lon": F.lit(180.0)}))
    path = str(tmp_path / "t")
    layout.write_quadtree(obs, path, 200)
    tree = layout.read_tree(spark, path)
    told = tree.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert told[0] == 6050 and told[1] <= 200 and tree.select("level").distinct().count() > 2
    for south, north, west, east in ((-90, 90, -180, 180), (12, 13, 179, 180), (0, 30, -60, 60), (89, 90, 0, 1)):
        got = layout.read_quadtree(spark, path, south, north, west, east)
        assert got.count() == obs.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).count()
    one = layout.read_quadtree(spark, path, 12.4, 12.6, 179.9, 180.0)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "leaf#" in plan.split("PartitionFilters: [")[1].split("]")[0] and one.count() == 50
    sizes = layout.even_partitions(layout.quadtree(obs, 100), 8).groupBy("pid").agg(F.sum("n").alias("n"))
    grid = layout.imbalance(layout.partition_sizes(obs, layout.grid_partition(2.0, 8), 8)).first().imbalance
    assert layout.imbalance(sizes).first().imbalance < 1.3 < grid and sizes.count() == 8
    assert layout.quadtree(obs.limit(0), 10).count() == 0
