"""From raw JSON lines to stored observations: validation, dead letters, insert-if-absent, out-of-order counts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from terrachron.operators.ordered import running_max
from terrachron.sources.observations import complete

_RAW = "observation_id variant, entity_id string, event_type string, lat string, lon string, timestamp variant, source_id string, confidence string, uncertainty_m string, duration_s string, attributes string, inputs array<string>, processing_model string, parent_observation string"
_OPTIONAL = ("confidence", "uncertainty_m", "duration_s", "attributes", "inputs")


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator, below which no filter or projection is pushed: each is evaluated once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


_CALENDAR, _WEEK = r"(\d{4})(-?)(\d\d)\2(\d\d)", r"(\d{4})-?W(\d\d)(?:-?([1-7]))?"
_CLOCK = r"[^0-9](\d\d)(?:(:?)(\d\d)(?:\%d(\d\d)(?:[.,](\d+))?)?)?(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)$"


def _moment(given: Column) -> Column:
    """A JSON timestamp (variant) as a time, null where it is none: a number is epoch seconds, a text ISO with an offset; the common form is read without a pattern of groups."""
    t = F.try_variant_get(given, "$", "string")
    kind = F.schema_of_variant(given)
    seconds = F.try_variant_get(given, "$", "double")
    epoch = F.when((seconds >= -62135596800.0) & (seconds < 253402300800.0), F.timestamp_micros(F.rint(seconds * 1e6).cast("long")))
    usual = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)$"

    def other(date: str, day: Callable[[Callable[[int], Column]], Column], groups: int) -> Column:
        """By pattern: ``day`` makes the date from the date's groups; the clock's follow."""
        pattern = f"^{date}{_CLOCK % (groups + 2)}"
        g = lambda k: F.regexp_extract(t, pattern, k)
        two = lambda k: F.when(g(k) == "", "00").otherwise(g(k))
        digits = F.regexp_replace(g(groups + 6), ":", "")
        zone = F.when(digits == "Z", "Z").otherwise(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0"), F.when(F.length(digits) > 5, F.concat(F.lit(":"), F.substring(digits, 6, 2))).otherwise("")))
        clock = F.concat(g(groups + 1), F.lit(":"), two(groups + 3), F.lit(":"), two(groups + 4), F.lit("."), F.rpad(F.substring(g(groups + 5), 1, 6), 6, "0"))
        return F.when(t.rlike(pattern), F.try_to_timestamp(F.concat(day(g), F.lit("T"), clock, zone)))

    monday = lambda g: F.date_trunc("week", F.concat(g(1), F.lit("-01-04")).try_cast("date")).cast("date")
    on = lambda g: F.date_add(monday(g), (g(2).try_cast("int") * 7 + F.coalesce(g(3).try_cast("int"), F.lit(1)) - 8))
    in_year = lambda g: F.when(F.extract(F.lit("YEAROFWEEK"), on(g)) == g(1).try_cast("int"), on(g).cast("string"))
    iso = F.when(t.rlike(usual), F.try_to_timestamp(t)).otherwise(F.coalesce(other(_CALENDAR, lambda g: F.concat_ws("-", g(1), g(3), g(4)), 4), other(_WEEK, in_year, 3)))
    return F.when(kind == "STRING", iso).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), epoch)


def normalised(raw: DataFrame) -> DataFrame:
    """``value`` (a JSON text per row, any further columns stay) -> observation columns and ``reason`` (null: valid).

    Numbers may be strings; a timestamp is a number of epoch seconds or an ISO text with an offset or Z, basic, extended or by week.
    Defaults hold only where a key is absent; an explicit null is invalid. A record without an
    id gets a hash of what it says. Never fails on input, whatever it holds. A line is
    parsed once; whether it is JSON at all and which keys it has is asked again only where that can matter.
    """
    v = F.col("value")
    d = _stage(raw, _j=F.from_json("value", _RAW + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}), _object=F.coalesce(F.trim("value").startswith("{"), F.lit(False)))
    # a null of an optional key whose name stands in the line may be an explicit one
    unsure = reduce(lambda a, b: a | b, [F.col(f"_j.{k}").isNull() & ((F.instr(v, f'"{k}"') > 0) | (F.instr(v, "\\") > 0)) for k in _OPTIONAL])
    none = F.array().cast("array<string>")
    d = _stage(d, _keys=F.when(F.coalesce(unsure, F.lit(True)), F.coalesce(F.json_object_keys("value"), none)).otherwise(none))
    has = lambda k: F.col(f"_j.{k}").isNotNull() | F.array_contains("_keys", k)
    num = lambda k: F.col(f"_j.{k}").try_cast("double")
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ts = _moment(F.col("_j.timestamp"))
    optional = lambda k, default: F.when(has(k), num(k)).otherwise(F.lit(default))
    clean = F.col("_object") & F.col("_j").isNotNull() & F.col("_j._bad").isNull()
    d = _stage(d, _json=F.when(clean, True).otherwise(F.try_parse_json("value").isNotNull()), _lat=num("lat"), _lon=num("lon"), _ts=ts, _conf=optional("confidence", 1.0), _unc=optional("uncertainty_m", 0.0), _dur=optional("duration_s", 0.0))
    bad = lambda c: F.coalesce(~c, F.lit(True))
    empty = lambda k: F.coalesce(F.col(f"_j.{k}") == "", F.lit(True))
    c = F.col
    reason = (
        F.when(~c("_json"), "not JSON").when(~c("_object"), "record is not an object")
        .when(bad(real(c("_lat")) & real(c("_lon"))), "bad coordinates: missing or not a number").when(bad(c("_lat").between(-90, 90) & c("_lon").between(-180, 180)), "bad coordinates: out of range")
        .when(c("_ts").isNull(), "bad timestamp: missing, unreadable or without time zone")
        .when(empty("entity_id") | empty("event_type") | empty("source_id"), "missing entity_id, event_type or source_id")
        .when(bad(real(c("_conf")) & c("_conf").between(0, 1)), "bad confidence").when(bad(real(c("_unc")) & (c("_unc") >= 0)), "bad uncertainty_m").when(bad(real(c("_dur")) & (c("_dur") >= 0)), "bad duration_s")
        .when(has("attributes") & bad(F.col("_j.attributes").startswith("{")), "attributes is not an object").when(has("inputs") & F.col("_j.inputs").isNull(), "inputs is not a list")
    )
    said = F.sha1(F.to_json(F.array(F.col("_j.entity_id"), F.col("_j.event_type"), c("_lat").cast("string"), c("_lon").cast("string"), F.unix_micros("_ts").cast("string"), F.col("_j.source_id"))))
    given = F.try_variant_get("_j.observation_id", "$", "string")
    # nothing, zero, false and empty values are no ids
    none_given = given.isNull() | given.isin("", "[]", "{}") | (~F.schema_of_variant("_j.observation_id").eqNullSafe("STRING") & ((given == "false") | F.coalesce(given.try_cast("double") == 0, F.lit(False))))
    ident = F.when(none_given, said).otherwise(given)
    d = _stage(d, _reason=reason, _id=ident)
    own = {
        "observation_id": c("_id"), "entity_id": F.col("_j.entity_id"), "event_type": F.col("_j.event_type"), "lat": c("_lat"), "lon": c("_lon"), "ts": c("_ts"), "duration_s": c("_dur"), "source_id": F.col("_j.source_id"), "processing_model": F.col("_j.processing_model"),
        "inputs": F.coalesce(F.col("_j.inputs"), F.array().cast("array<string>")), "confidence": c("_conf"), "uncertainty_m": c("_unc"), "attributes": F.coalesce("_j.attributes", F.lit("{}")), "parent_observation": F.col("_j.parent_observation"),
    }
    return d.select(*raw.columns, c("_reason").alias("reason"), *[e.alias(k) for k, e in own.items()])


def first_writes(batch: DataFrame, order: Column) -> DataFrame:
    """The first row of each observation_id by ``order``."""
    whole = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy("observation_id").agg(F.min_by(whole, order).alias("_o")).select("_o.*")


def absent(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose id the table doesn't have."""
    return batch.join(table.select("observation_id"), "observation_id", "left_anti")


def out_of_order(obs: DataFrame, arrival: str) -> DataFrame:
    """Rows that come, in order of ``arrival`` (a number), after a later one of their entity."""
    return running_max(obs, "entity_id", (arrival,), F.col(arrival), "ts", "_seen").where(F.col("ts") < F.col("_seen")).drop("_seen")


#: Parts by hash of the id into which a table is dealt; up to so many ids are looked for by name.
BUCKETS, FEW = 64, 500


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("observation_id"), F.lit(buckets)).cast("int")


def _told(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _known(spark: SparkSession, table: str, ids: DataFrame) -> DataFrame:
    """Rows (observation_id, run, batch, bucket) of a table that can have one of the ids (observation_id, bucket): in their buckets, and where they are few by name."""
    met = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most as many as there are buckets
    few = [r.observation_id for r in ids.select("observation_id").limit(FEW + 1).collect()]
    known = spark.read.schema("observation_id string, run string, batch int, bucket int").parquet(table).where(F.col("bucket").isin(met))
    return known.where(F.col("observation_id").isin(few)) if len(few) <= FEW else known


def _add(batch: DataFrame, table: str, run: str, number: int, order: Column, buckets: int) -> int:
    """Writes the first rows of ids that the table doesn't have as batch ``number`` of ``run``, and says how many.

    What the same batch of the same run wrote before is not counted as there, and written again. Of the table only
    the ids of the buckets that the batch has are read; files hold one bucket, in order of id and with
    Bloom filters, so the ids of a small batch skip row groups too.
    """
    spark = batch.sparkSession
    first = first_writes(batch, order)
    fresh = complete(first).withColumn("ingested_at", F.current_timestamp()).withColumn("bucket", _bucket(buckets))
    if _told(spark, table):
        fresh = absent(fresh, _known(spark, table, first.select("observation_id", _bucket(buckets).alias("bucket"))).where((F.col("run") != run) | (F.col("batch") != number)))
    dealt = fresh.repartition("bucket", F.pmod(F.xxhash64("observation_id", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket", "observation_id")
    writer = dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#observation_id", "true")
    path = f"{table}/run={run}/batch={number}"
    writer.parquet(path)
    return spark.read.schema("observation_id string").parquet(path).count()  # from the files' footers


def insert(obs: DataFrame, table: str, buckets: int = BUCKETS) -> int:
    """Adds the observations whose ids the table doesn't have, the first by (ts, entity_id) of several rows with one id; returns how many are new. One writer at a time."""
    return _add(obs, table, uuid.uuid4().hex, 0, F.struct("ts", "entity_id"), buckets)


#: Where a line comes from, in order of arrival but for its number.
_FILE = ("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")


def ingest(spark: SparkSession, source: str, table: str, dead: str, checkpoint: str, files_per_batch: int = 10, fail_after_write: Callable[[int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a stream over a folder of text files with a JSON record a line; it ends when all is read.

    A row is stored if the table doesn't have its id, whoever wrote it: :func:`insert` or a stream
    with another checkpoint. Of rows with one id in a batch the first one stays, by the time and name of the file and the line.
    Each batch goes to folders of its own, ``run=<id of the checkpoint>/batch=<number>``, in the table and below
    ``dead``; a batch that is replayed after a crash overwrites those alone, so every record counts once. One writer at a time.

    The table's ids are the state, so nothing is kept in memory from batch to batch. What each batch did is a line in
    ``<table>/_log``, which :func:`stream_metrics` adds up; rows that come out of order are counted by :func:`watch_order`.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    checked = normalised(lines.select("value", F.struct(*_FILE).alias("_file")))
    valid = F.col("reason").isNull()

    def one(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        own = batch.sparkSession
        run = own.read.json(f"{checkpoint}/metadata").first()["id"]
        rows = batch.withColumn("_place", F.struct("_file", F.monotonically_increasing_id())).persist()
        try:
            rows.where(~valid).select("value", "reason").write.mode("overwrite").parquet(f"{dead}/run={run}/batch={number}")
            n = rows.agg(F.count(F.lit(1)), F.count_if(valid)).first()
            stored = _add(rows.where(valid), table, run, number, F.col("_place"), buckets)
        finally:
            rows.unpersist()
        if fail_after_write:
            fail_after_write(number)
        line = [(run, number, n[0], stored, n[1] - stored, n[0] - n[1], time.monotonic() - began)]
        own.createDataFrame(line, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{table}/_log/{run}-{number}")

    return checked.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LOG = "run string, batch long, processed long, stored long, duplicates long, dead_lettered long, seconds double"


def stream_metrics(spark: SparkSession, table: str, late: str | None = None) -> dict[str, float]:
    """What all streams into a table did: processed, stored, duplicates, dead_lettered, nearest-rank p50 and p95 of seconds a batch; out_of_order from the folder of :func:`watch_order`."""
    log = spark.read.schema(_LOG).parquet(f"{table}/_log/*").where("processed > 0")
    ranked = log.select("*", F.row_number().over(Window.orderBy("seconds")).alias("k"), F.count("*").over(Window.partitionBy()).alias("m"))  # a row a batch
    rank = lambda q: F.coalesce(F.max(F.when(F.col("k") == F.least(F.col("m"), F.floor(F.col("m") * q) + 1), F.col("seconds"))), F.lit(0.0))
    sums = ("processed", "stored", "duplicates", "dead_lettered")
    out = ranked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], rank(0.5).alias("p50_s"), rank(0.95).alias("p95_s")).first().asDict()
    if late is not None:
        out["out_of_order"] = spark.read.schema("entity_id string, late long").parquet(f"{late}/batch=*").agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]
    return out


class _Latest(StatefulProcessor):
    """Per entity: the latest time so far; counts rows that come after a later one, in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["place", "line"])
        before = self.latest.get()[0] if self.latest.exists() else np.iinfo(np.int64).min
        us = own["us"].to_numpy(np.int64)
        top = np.maximum.accumulate(np.concatenate([[before], us]))
        self.latest.update((int(top[-1]),))
        yield pd.DataFrame({"entity_id": [key[0]], "late": [int((us < top[:-1]).sum())]})

    def close(self) -> None:
        pass


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number in the task, as read."""
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "line"])
        n += b.num_rows


def watch_order(spark: SparkSession, source: str, late: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Starts a stream over the same folder that counts rows out of order: entity_id, late, a row for each entity of a batch, below ``late``.

    A valid row is late if a row of its entity came earlier with a later time, duplicates included. An entity's
    latest time is state of the stream (RocksDB), so nothing is rewritten from batch to batch; of a batch only
    entity, time and place go to the state's tasks, an entity's rows of one batch to one of them.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    at = F.concat_ws("|", F.date_format(_FILE[0], "yyyyMMddHHmmssSSS"), _FILE[1], F.lpad(_FILE[2], 20, "0"))
    rows = normalised(lines.select("value", at.alias("place"))).where("reason IS NULL").select("entity_id", F.unix_micros("ts").alias("us"), "place")
    rows = rows.mapInArrow(_numbered, "entity_id string, us long, place string, line long")
    told = rows.groupBy("entity_id").transformWithStateInPandas(_Latest(), "entity_id string, late long", "Update", "None")

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{late}/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return told.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)


def windowed_activity(stream: DataFrame, minutes: int, late_minutes: int) -> DataFrame:
    """For streams: counts by event type in tumbling windows, closed ``late_minutes`` after their end."""
    return stream.withWatermark("ts", f"{late_minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))
