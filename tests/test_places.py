"""Work by places and shapes: rows that share them are counted, not compared one by one."""

import random

from pyspark.sql import functions as F

from terrachron import queries
from terrachron.operators import joins, regions

SF = "/root/testdata/sf0.001"


def nodes(plan):
    """All nodes of a plan that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for node in below:
        yield from nodes(node)


def joined(out):
    """Rows of a result, and of all its joins together."""
    rows = [tuple(r) for r in out.collect()]
    made = [n.metrics().apply("numOutputRows").value() for n in nodes(out._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
    return rows, sum(made)


def copied(spark, folder, times):
    """The events with each row so many times, under shifted ids: so many times more circles and regions, and as many times more hits in each."""
    own, k = spark.read.parquet(f"{SF}/events.parquet"), F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    own = own.withColumn("k", k).withColumn("event_id", F.col("event_id") + F.col("k") * 4_000_000).drop("k")
    own.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_many_regions_of_few_shapes(spark, monkeypatch, tmp_path):
    plain = lambda obs, table: regions.inside(obs, table).groupBy("region").agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id"))
    query, big = queries.QUERIES["inside_many_regions"], copied(spark, tmp_path, 10)
    (one, few), (ten, many) = joined(query(spark, SF)), joined(query(spark, big))
    assert len(ten) == 10 * len(one) and sum(r[1] for r in ten) == 100 * sum(r[1] for r in one) > 0 and many < 3 * few + len(ten)
    with monkeypatch.context() as m:
        m.setattr(regions, "counts_inside", plain)
        assert sorted(map(tuple, query(spark, big).collect())) == sorted(ten)


def test_counts_of_odd_regions(spark):
    rng = random.Random(5)
    rows = [(f"o{i}" if i % 11 else None, rng.choice([0.0, -0.0, 1.0, 2.5]), rng.choice([0.0, 1.5, 3.0])) for i in range(60)] + [("nowhere", None, 1.0), ("in", 1.25, 2.25)]
    obs = spark.createDataFrame(rows, "observation_id string, lat double, lon double")
    square = lambda y, x, h: [(y - h, x - h), (y - h, x + h), (y + h, x + h), (y + h, x - h)]
    table = [("a", square(1.0, 1.0, 2.0)), ("b", square(1.0, 1.0, 2.0)), ("twice", square(1.0, 1.0, 2.0)), ("twice", square(1.0, 1.0, 2.0)), ("two", square(0.0, 0.0, 0.5)), ("two", square(2.0, 2.0, 1.0)), ("null", None), ("far", square(60.0, 60.0, 1.0))]
    table = spark.createDataFrame(table, regions._RING)
    want = regions.inside(obs, table).groupBy("region").agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id"))
    got = regions.counts_inside(obs, table)
    assert got.schema["n"].dataType == want.schema["n"].dataType and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert regions.counts_inside(obs, table.limit(0)).count() == regions.counts_inside(obs.limit(0), table).count() == 0


def test_many_circles_of_few_kinds(spark, tmp_path):
    query = queries.QUERIES["batch_radius_counts"]
    (one, few), (ten, many) = joined(query(spark, SF)), joined(query(spark, copied(spark, tmp_path, 10)))
    assert len(ten) == 10 * len(one) and sum(r[1] for r in ten) == 100 * sum(r[1] for r in one) > 0 and many < 3 * few + len(ten)


CIRCLES, PLACES = "qi long, lat double, lon double, radius_m double", "observation_id string, lat double, lon double"


def test_counts_of_odd_circles(spark):
    """Repeated numbers are one row, as the SQL groups them; circles and places may be equal, null or nowhere."""
    obs = spark.createDataFrame([("a", 0.0, 1.0), ("b", -0.0, 1.0), ("b", 0.0, 1.0), (None, 0.0, 1.0), ("c", 0.001, 1.0), ("d", None, 1.0), ("e", 40.0, 1.0)], PLACES)
    asked = spark.createDataFrame([(1, 0.0, 1.0, 10.0), (1, 0.001, 1.0, 10.0), (2, -0.0, 1.0, 10.0), (3, 0.0, 1.0, 200.0), (4, None, 1.0, 10.0), (5, 0.0, 1.0, None), (6, 0.0, 1.0, -1.0), (7, -40.0, 1.0, 5.0)], CIRCLES)
    out = joins.batch_radius(obs, asked)
    assert dict(out.dtypes) == {"qi": "bigint", "n": "bigint"} and sorted(map(tuple, out.collect())) == [(1, 5), (2, 4), (3, 5), (4, 0), (5, 0), (6, 0), (7, 0)]


def test_hits_are_made_of_lists(spark, monkeypatch):
    """Equal circles and places are compared once for a list of each, and every hit is still a row."""
    rng = random.Random(6)
    obs = [(f"o{i // 2}" if i % 13 else None, rng.choice([0.0, -0.0, 0.001, 40.0, None]), rng.choice([1.0, 1.001])) for i in range(200)]
    asked = [(i // 3, rng.choice([0.0, -0.0, 0.001, None]), 1.0, rng.choice([0.0, 130.0, 900.0, -1.0, None])) for i in range(150)]
    out = lambda: joins.batch_radius_ids(spark.createDataFrame(obs, PLACES), spark.createDataFrame(asked, CIRCLES))
    plain = joins._hits(spark.createDataFrame(obs, PLACES), spark.createDataFrame(asked, CIRCLES), ["qi"], ["observation_id"])
    want = sorted(map(str, plain.collect()))
    got, made = joined(out())
    assert dict(out().dtypes) == {"qi": "bigint", "observation_id": "string"} and sorted(map(str, out().collect())) == want
    assert len(got) == len(want) > 2000 and made < 600
    monkeypatch.setattr(joins, "LISTED", 4)
    lists = joins._listed(spark.createDataFrame(obs, PLACES), ["lat", "lon"], "observation_id", "ids").collect()
    assert len(lists) > 16 and max(len(r.ids) for r in lists) < 30 and sorted(map(str, out().collect())) == want
