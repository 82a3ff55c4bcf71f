"""Medoids of large entities: bounds leave few candidates, and the same medoid as all comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import trust


def rows(spark, n, seed=0, spread=0.002):
    rng = np.random.default_rng(seed)
    made = [(e, f"{e}{i:05d}", float(40 + a), float(-74 + b), float(u)) for e, m, s in (("big", n, spread), ("wide", n // 2, 30.0), ("same", n // 3, 0.0), ("small", 5, spread)) for i, (a, b, u) in enumerate(zip(rng.normal(0, s, m), rng.normal(0, s, m), rng.choice([5.0, 10.0, 25.0], m), strict=True))]
    obs = spark.createDataFrame(made, "entity_id string, observation_id string, lat double, lon double, u double")
    x, y, z = geo.xyz(F.col("lat"), F.col("lon"))
    return obs.select("entity_id", "observation_id", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("u") * F.col("u")).alias("var"))


def brute(table):
    out = {}
    for e, own in table.toPandas().groupby("entity_id"):
        v = own[["x", "y", "z"]].to_numpy()
        far = 2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.linalg.norm(v[:, None] - v[None], axis=2) / 2))
        cost = np.round((far / np.sqrt(own["var"].to_numpy())).sum(1), 5)
        k = min(range(len(own)), key=lambda i: (cost[i], own["observation_id"].iloc[i]))
        out[e] = v[k]
    return out


@pytest.mark.parametrize("large", [1, 2048])
def test_bounds_keep_the_medoid(spark, monkeypatch, large):
    monkeypatch.setattr(trust, "LARGE", large)
    table = rows(spark, 400)
    want, got = brute(table), {r.entity_id: (r.cx, r.cy, r.cz) for r in trust._medoids(table).collect()}
    assert set(got) == set(want) and all(np.allclose(got[e], want[e], atol=1e-12) for e in want)


def test_few_candidates_and_blocks_in_many_tasks(spark, monkeypatch):
    table = rows(spark, 6000).where("entity_id = 'big'")
    counted, real = [], trust._costs
    monkeypatch.setattr(trust, "_costs", lambda some, packed: counted.append(some.count()) or real(some, packed))
    assert trust._medoids(table).count() == 1
    assert sum(counted) < 0.05 * 6000
    own = table.withColumn("n", F.lit(6000).cast("long"))
    packed = own.groupBy("entity_id", F.pmod(F.xxhash64("observation_id"), F.lit(12)).cast("long").alias("block")).agg(F.collect_list(F.struct("x", "y", "z", "var")).alias("others"))
    plan = real(own, packed.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(entity_id#") >= 2 and ", block#" in plan.split("SortMergeJoin [")[1].split("]")[0]
