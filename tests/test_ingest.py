"""Ingestion: time forms, insert-if-absent across writers, crashes, per-entity state, metrics."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrachron.sources import observations
from terrachron.streaming import ingest

T0 = datetime(2026, 10, 4, 9, tzinfo=UTC)
GOOD = {"observation_id": "r1", "entity_id": "e", "event_type": "t", "lat": 1.5, "lon": "2.5", "timestamp": "2026-10-04T14:30:00+05:30", "source_id": "s"}


def written_lines(folder, files):
    """``files``: lists of lines, in order of age."""
    folder.mkdir(exist_ok=True)
    for k, lines in enumerate(files):
        (folder / f"{k:03d}.txt").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{k:03d}.txt", (1e9 + k, 1e9 + k))
    return str(folder)


def record(k, **more):
    return json.dumps(GOOD | {"observation_id": f"r{k}"} | more)


def run(spark, tmp_path, source, ck="ck", **more):
    ingest.ingest(spark, source, str(tmp_path / "table"), str(tmp_path / "dead"), str(tmp_path / ck), 1, **more).awaitTermination()
    return spark.read.parquet(str(tmp_path / "table"))


def python_time(v):
    """The rule: numbers are epoch seconds, texts ISO with an offset."""
    try:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return datetime.fromtimestamp(float(v), tz=UTC)
        t = datetime.fromisoformat(v.replace("Z", "+00:00"))
        return t.astimezone(UTC) if t.tzinfo else None
    except (ValueError, OverflowError, OSError, AttributeError):
        return None


def test_time_forms_equal_python(spark):
    forms = [
        "2024-01-01T00Z", "20240101T000000Z", "2024-01-01T00:00:00.123456789Z", "2024-01-01 05:00+05", "2024-01-01x05:00:01,5+05:30:15", "2024-W01-1T00:00Z", "2020W537T1200-0330", "2021-W53-1T00:00Z", "2024-01-01T0000+0000",
        "2024-13-01T00Z", "2024-02-30T00:00:00Z", "20240230T000000Z", "2024-01-01", "2024-01-01T00:00:00", "2024-01-01Z", "1700000000", 1700000000.25, 1700000000, 1700000000.0, 12345678.5, -1.5, 0, 1e20, True, "yesterday", "", "2024-0101T00Z",
        "2024-01-01T25:00Z", float("nan"), None, {"a": 1}, [], T0.timestamp(), T0.isoformat(), "0001-01-01T00:00:00Z", "2024-02-29T23:59:59.9-11:30", "2024-W09T01Z",
    ]
    rows = [(k, json.dumps(GOOD | {"timestamp": v})) for k, v in enumerate(forms)]
    got = {r.k: r for r in ingest.normalised(spark.createDataFrame(rows, "k int, value string")).select("k", "reason", F.unix_micros("ts").alias("us")).collect()}
    for k, v in enumerate(forms):
        want = python_time(v)
        assert got[k].us == (None if want is None else round((want - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))), v
        assert (got[k].reason is None) == (want is not None), v


def test_ids_that_say_nothing_are_made(spark):
    given = [0, "0", False, "", None, [], {}, 0.0, 7, 1.5, "x"]
    got = [r.observation_id for r in ingest.normalised(spark.createDataFrame([(json.dumps(GOOD | {"observation_id": v}),) for v in given], "value string")).collect()]
    assert [len(i) == 40 for i in got] == [not v for v in given] and got[1] == "0" and got[8:] == ["7", "1.5", "x"] and len(set(got)) == 5


def test_two_checkpoints_share_a_table(spark, tmp_path):
    a = written_lines(tmp_path / "a", [[record(i, event_type="a") for i in range(0, 30)], [record(i, event_type="a") for i in range(20, 40)]])
    b = written_lines(tmp_path / "b", [[record(i, event_type="b") for i in range(35, 60)]])
    assert run(spark, tmp_path, a, "one").count() == 40
    got = {r.observation_id: r.event_type for r in run(spark, tmp_path, b, "two").collect()}
    assert got == {f"r{i}": "a" if i < 40 else "b" for i in range(60)}
    assert ingest.insert(run(spark, tmp_path, a, "three").select(*[c.split(" ")[0] for c in observations.SCHEMA.split(", ")]), str(tmp_path / "table")) == 0
    assert spark.read.parquet(str(tmp_path / "table")).count() == 60
    told = ingest.stream_metrics(spark, str(tmp_path / "table"))
    assert (told["processed"], told["stored"], told["duplicates"], told["dead_lettered"]) == (125, 60, 65, 0) and told["p95_s"] >= told["p50_s"] > 0


def test_first_write_of_a_batch_wins(spark, tmp_path):
    lines = [record(i % 20, event_type=f"t{i}") for i in range(100)]
    got = {r.observation_id: r.event_type for r in run(spark, tmp_path, written_lines(tmp_path / "in", [lines])).collect()}
    assert got == {f"r{i}": f"t{i}" for i in range(20)}


@pytest.mark.parametrize("between", [False, True])
def test_crash_before_commit_counts_once(spark, tmp_path, between):
    files = [[record(i) for i in range(k * 50, k * 50 + 60)] + ["{bad"] for k in range(4)]
    source, failed = written_lines(tmp_path / "in", files), []

    def crash(number):
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        run(spark, tmp_path, source, fail_after_write=crash)
    if between:  # another stream has the same records while this one is down
        run(spark, tmp_path, source, "other")
    table = run(spark, tmp_path, source)
    assert failed == [2] and table.count() == table.select("observation_id").distinct().count() == 210
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert dead.where("reason = 'not JSON'").count() == (8 if between else 4)


def test_insert(spark, tmp_path):
    obs = observations.synthetic(spark, 2000)
    path = str(tmp_path / "t")
    assert ingest.insert(obs.unionByName(obs), path) == 2000 and ingest.insert(obs, path) == 0
    assert ingest.insert(obs.limit(3).withColumn("observation_id", F.concat(F.lit("n"), "observation_id")), path) == 3
    assert spark.read.parquet(path).count() == 2003 and ingest.insert(obs.limit(0), path) == 0


def test_a_small_batch_opens_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.insert(observations.synthetic(spark, 5000), path)
    table = spark.read.parquet(path)
    one = table.limit(1).select("observation_id", "bucket")
    known = ingest._known(spark, path, one)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert known.count() == 1 and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(observation_id" in plan + plan.replace("In(observation_id", "EqualTo(observation_id")
    assert ingest._known(spark, path, table.select("observation_id", "bucket")).count() == 5000


def test_late_rows_equal_a_sequential_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"e{rng.choice([0, 0, 0, 1, 2, 3])}", rng.randrange(1000), i) for i in range(600)]
    rows += rng.sample(rows, 60)
    files = [[record(i, entity_id=e, timestamp=(T0 + timedelta(minutes=m)).isoformat()) for e, m, i in rows[k : k + 165]] + ["[]"] for k in range(0, 660, 165)]
    source, latest, want = written_lines(tmp_path / "in", files), {}, 0
    for e, m, _ in rows:
        if m < latest.get(e, -1):
            want += 1
        else:
            latest[e] = m
    for _ in range(2):  # the second start finds nothing new
        ingest.watch_order(spark, source, str(tmp_path / "late"), str(tmp_path / "order"), 1).awaitTermination()
    run(spark, tmp_path, source)
    got = ingest.stream_metrics(spark, str(tmp_path / "table"), str(tmp_path / "late"))
    assert want > 100 and {k: got[k] for k in ("processed", "stored", "duplicates", "dead_lettered", "out_of_order")} == {"processed": 664, "stored": 600, "duplicates": 60, "dead_lettered": 4, "out_of_order": want}
