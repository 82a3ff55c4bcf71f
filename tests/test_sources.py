"""Files with ids by row, and made worlds."""

import json
from datetime import datetime

import pytest

from terrachron.operators import layout
from terrachron.sources import observations

HEAD = '"Date/Time","Lat","Lon","Base"\n'


def test_pickups_are_numbered_by_file_whatever_the_splits(spark, tmp_path):
    for month, n in (("apr14", 900), ("may14", 3), ("jun14", 0)):
        lines = [f'"4/{1 + k % 28}/2014 {k % 24}:11:00",{40 + k / 1000},-73.9549,"{"B02512" if k % 2 else "B09999"}"\n' for k in range(n)]
        (tmp_path / f"uber-raw-data-{month}.csv").write_text(HEAD + "".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits a file
    try:
        rows = observations.read_monthly_pickups(spark, str(tmp_path), ("apr14", "may14", "jun14")).collect()
        first = observations.read_monthly_pickups(spark, str(tmp_path), ("may14", "apr14"), 5).collect()
        assert observations.numbered_lines(spark, str(tmp_path)).select("file").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {r.observation_id: r for r in rows}
    assert len(rows) == len(by) == 903 and {f"uber_apr14_{k}" for k in range(900)} | {f"uber_may14_{k}" for k in range(3)} == set(by)
    assert all(abs(by[f"uber_apr14_{k}"].lat - (40 + k / 1000)) < 1e-12 for k in range(900))
    one, other = by["uber_apr14_1"], by["uber_apr14_2"]
    assert one.ts == datetime(2014, 4, 2, 5, 11) and one.entity_id == "B02512_trip_apr14_1" and one.processing_model == "TLC FOIL 2014" and one.uncertainty_m == 11
    assert json.loads(one.attributes) == {"base_name": "Unter"} and json.loads(other.attributes) == {"base_name": "B09999"}
    assert [r.observation_id for r in first] == ["uber_may14_0", "uber_may14_1", "uber_may14_2", "uber_apr14_0", "uber_apr14_1"]
    assert observations.read_monthly_pickups(spark, str(tmp_path), ()).count() == 0


def test_quakes_are_numbered(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Date,Latitude,Longitude,Magnitude\n01/02/1965,19.2,145.6,6\n1975-02-23T02:58:41.000Z,8.0,124.0,5.6\nnever,x,124.0,\n")
    q = observations.read_numbered_quakes(spark, str(tmp_path / "q.csv")).orderBy("observation_id").collect()
    assert [(r.observation_id, r.entity_id, r.source_id, r.uncertainty_m) for r in q] == [(f"quake_{k}", f"quake_{k}", "USGS", 5000.0) for k in range(3)]
    assert [r.ts for r in q] == [datetime(1965, 1, 2), datetime(1975, 2, 23, 2, 58, 41), None] and q[2].lat is None and json.loads(q[1].attributes) == {"magnitude": 5.6}
    assert observations.read_numbered_quakes(spark, str(tmp_path / "q.csv"), 2).count() == 2


@pytest.mark.parametrize("world,least,most", [("uniform", 0.0, 1.25), ("mixed", 1.5, 3.6), ("hotspot", 2.0, 6.0)])
def test_worlds(spark, world, least, most):
    obs = observations.synthetic(spark, 8000, towns=5, world=world)
    sizes = layout.partition_sizes(obs, layout.grid_partition(2.0, 8), 8)
    assert least <= layout.imbalance(sizes).first().imbalance <= most
    north = obs.where("lat > 30").count() / 8000  # a quarter of a sphere lies north of 30 degrees
    assert world != "uniform" or abs(north - 0.25) < 0.02
