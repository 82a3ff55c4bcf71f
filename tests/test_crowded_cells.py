"""Neighbour pairs where cells are crowded."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrachron.operators import joins

T0 = datetime(2026, 10, 4, 9)
ROW = "observation_id string, entity_id string, lat double, lon double, ts timestamp"


def test_dealt_cells_give_the_same_pairs(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(400):  # a third of all rows in one place and moment, the others around it and elsewhere
        spread = (0, 1e-3, 1.0)[i % 3]
        rows.append((f"o{i:03d}", f"e{i % 7}", 48.0 + rng.gauss(0, 1) * spread, 11.0 + rng.gauss(0, 1) * spread, T0 + timedelta(seconds=rng.randrange(600) * (i % 3))))
    obs = spark.createDataFrame(rows, ROW)
    found = lambda **more: sorted(tuple(r) for r in joins.neighbour_pairs(obs, 150.0, timedelta(minutes=3), **more).collect())
    plain, at_all = found(), found(other_entities=False)
    assert len(plain) > 5000 and found(even=True) == plain
    monkeypatch.setattr(joins, "CROWDED", 10)
    for buckets in (1 << 20, 64):  # few buckets: calm cells are dealt with crowded ones
        monkeypatch.setattr(joins, "BUCKETS", buckets)
        assert found() == plain and found(other_entities=False) == at_all


def test_no_task_has_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(joins, "CROWDED", 50)
    obs = spark.range(1500).select(F.lit(1).alias("row"), F.lit(2).alias("column"), F.lit(3).alias("tick"), F.col("id").cast("string").alias("p_id"))
    crowd = joins._crowded(obs)
    assert [r._parts for r in crowd.collect()] == [30]
    dealt = [(r._p, r._q) for r in joins._dealt(obs, crowd, "p_id", "_p", "_q").collect()]
    sizes = Counter(dealt)
    assert len(dealt) == 1500 * 30 and len(sizes) == 900 and max(sizes.values()) < 90
    assert joins._crowded(obs.limit(40)) is None and joins._crowded(obs.limit(0)) is None
