"""Observations: schema, readers and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "observation_id string, entity_id string, event_type string, lat double, lon double, ts timestamp, duration_s double, source_id string, "
    "processing_model string, inputs array<string>, ingested_at timestamp, confidence double, uncertainty_m double, attributes string, parent_observation string"
)


def complete(df: DataFrame) -> DataFrame:
    """Columns of the schema in order; those missing get their defaults."""
    default = {"duration_s": F.lit(0.0), "inputs": F.array().cast("array<string>"), "confidence": F.lit(1.0), "uncertainty_m": F.lit(0.0), "attributes": F.lit("{}")}
    cols = []
    for part in SCHEMA.split(", "):
        name, kind = part.split(" ", 1)
        cols.append((F.col(name) if name in df.columns else default.get(name, F.lit(None))).cast(kind).alias(name))
    return df.select(*cols)


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table seen as observations; integer arithmetic and one division, so every engine gets the same doubles."""
    e, u = F.col("event_id"), F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("obs_"), e.cast("string")).alias("observation_id"),
        F.concat(F.lit("user_"), u.cast("string")).alias("entity_id"),
        "event_type",
        ((4060000 + (u * 37) % 20 * 1000 + (e * 7919) % 1000) / F.lit(100000.0)).alias("lat"),
        ((-7410000 + (u * 53) % 30 * 1000 + (e * 104729) % 1000) / F.lit(100000.0)).alias("lon"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("src_"), (e % 5).cast("string")).alias("source_id"),
        ((50 + (e * 31) % 51) / F.lit(100.0)).alias("confidence"),
        F.when(e % 3 == 0, 5.0).when(e % 3 == 1, 10.0).otherwise(25.0).alias("uncertainty_m"),
        F.when(e % 10 != 0, F.concat(F.lit("obs_"), (e - 1).cast("string"))).alias("parent_observation"),
    )


def read_pickups(spark: SparkSession, path: str, name: str = "uber") -> DataFrame:
    """CSV of ``Date/Time`` (New York local, M/d/yyyy H:mm:ss), Lat, Lon, Base. Ids follow from the row's content and its copy number; what can't be read is null."""
    raw = spark.read.csv(path, header=True, schema="when string, lat double, lon double, base string")
    copy = F.row_number().over(Window.partitionBy("when", "lat", "lon", "base").orderBy("base"))
    raw = raw.withColumn("copy", copy)
    ident = F.sha1(F.to_json(F.struct("when", "lat", "lon", "base", "copy")))
    ts = F.to_utc_timestamp(F.try_to_timestamp("when", F.lit("M/d/yyyy H:mm:ss")), "America/New_York")
    return complete(raw.select(F.concat(F.lit(f"{name}_"), ident).alias("observation_id"), F.concat(F.lit("trip_"), ident).alias("entity_id"), F.lit("pickup").alias("event_type"), "lat", "lon", ts.alias("ts"), F.col("base").alias("source_id"), F.lit(11.0).alias("uncertainty_m")))


def read_quakes(spark: SparkSession, path: str) -> DataFrame:
    """CSV of Date (MM/dd/yyyy or ISO), Latitude, Longitude, Magnitude; the magnitude goes into attributes."""
    raw = spark.read.csv(path, header=True, schema="day string, lat double, lon double, magnitude double")
    ident = F.sha1(F.to_json(F.struct("day", "lat", "lon", "magnitude")))
    ts = F.coalesce(F.try_to_timestamp("day", F.lit("MM/dd/yyyy")), F.try_to_timestamp("day"))
    return complete(raw.select(F.concat(F.lit("quake_"), ident).alias("observation_id"), F.concat(F.lit("quake_"), ident).alias("entity_id"), F.lit("earthquake").alias("event_type"), "lat", "lon", ts.alias("ts"), F.lit("catalogue").alias("source_id"), F.to_json(F.struct("magnitude")).alias("attributes")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (name without folders), row (from 0, the first line left out), value: the lines of text files below ``path``, numbered per file.

    A split's lines are numbered where they are read; how many lines the earlier splits of a file have is added, a row a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"), "value")
    splits = raw.groupBy("_path", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    earlier = F.coalesce(F.sum("_lines").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.col("_n") - F.col("_first") + F.col("_earlier") - 1
    out = raw.join(splits.select("_path", "_block", "_first", earlier.alias("_earlier")), ["_path", "_block"])
    return out.select(F.element_at(F.split("_path", "/"), -1).alias("file"), row.alias("row"), "value").where("row >= 0")


def _fields(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select("file", "row", F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("c")).select("file", "row", "c.*")


#: Names of the dispatchers by licence number, fixed values of the published release.
BASES = {"B02512": "Unter", "B02598": "Hinter", "B02617": "Weiter", "B02682": "Schmecken", "B02764": "Danach-NY"}


def read_monthly_pickups(spark: SparkSession, folder: str, months: tuple[str, ...] = ("apr14", "may14", "jun14", "jul14", "aug14", "sep14"), limit: int | None = None) -> DataFrame:
    """Files ``uber-raw-data-<month>.csv`` of a folder, ids by month and row: ``uber_<month>_<row>``, entity ``<base>_trip_<month>_<row>``.

    ``limit``: so many rows, in order of the months as given and of rows. What can't be read is null.
    """
    if not months:
        return spark.createDataFrame([], SCHEMA)
    own = _fields(numbered_lines(spark, f"{folder}/uber-raw-data-{{{','.join(months)}}}.csv"), "when string, lat double, lon double, base string")
    own = own.withColumn("month", F.regexp_extract("file", r"uber-raw-data-(.*)\.csv$", 1))
    if limit is not None:
        own = own.orderBy(F.array_position(F.array(*map(F.lit, months)), F.col("month")), "row").limit(limit)
    ts = F.to_utc_timestamp(F.try_to_timestamp("when", F.lit("M/d/yyyy H:mm:ss")), "America/New_York")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in BASES.items() for v in kv]), F.col("base")), F.col("base"))
    place = F.concat_ws("_", "month", "row")
    return complete(own.select(
        F.concat(F.lit("uber_"), place).alias("observation_id"), F.concat("base", F.lit("_trip_"), place).alias("entity_id"), F.lit("pickup").alias("event_type"), "lat", "lon", ts.alias("ts"), F.col("base").alias("source_id"),
        F.lit("TLC FOIL 2014").alias("processing_model"), F.lit(11.0).alias("uncertainty_m"), F.to_json(F.struct(name.alias("base_name"))).alias("attributes"),
    ))


def read_numbered_quakes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """As :func:`read_quakes`, with ids by row, ``quake_<row>``, the catalogue's names and an uncertainty of 5 km; ``limit``: the first so many rows."""
    own = _fields(numbered_lines(spark, path), "day string, lat double, lon double, magnitude double")
    own = own if limit is None else own.where(F.col("row") < limit)
    ts = F.coalesce(F.try_to_timestamp(F.trim("day"), F.lit("MM/dd/yyyy")), F.try_to_timestamp(F.trim("day")))
    ident = F.concat(F.lit("quake_"), F.col("row").cast("string"))
    return complete(own.select(
        ident.alias("observation_id"), ident.alias("entity_id"), F.lit("earthquake").alias("event_type"), "lat", "lon", ts.alias("ts"), F.lit("USGS").alias("source_id"),
        F.lit("significant-earthquakes").alias("processing_model"), F.lit(5000.0).alias("uncertainty_m"), F.to_json(F.struct("magnitude")).alias("attributes"),
    ))


LOADERS = {"pickups": read_pickups, "quakes": read_quakes, "events": from_events, "monthly_pickups": read_monthly_pickups, "numbered_quakes": read_numbered_quakes}

#: Parts of made rows that lie anywhere on the sphere and not in a town.
WORLDS = {"uniform": 1.0, "mixed": 0.5, "hotspot": 0.1, "towns": 0.0}


def assembled(parts: list[DataFrame]) -> DataFrame:
    """One table of several: of rows with the same observation_id the one of the earliest part stays, by its time and entity."""
    out = None
    for number, part in enumerate(parts):
        own = complete(part).withColumn("_part", F.lit(number))
        out = own if out is None else out.unionByName(own)
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    whole = F.min_by(F.struct(*columns), F.struct("_part", "ts", "entity_id", "lat", "lon", "event_type", "source_id"))
    return out.groupBy("observation_id").agg(whole.alias("_o")).select("_o.*")


def synthetic(spark: SparkSession, n: int, seed: int = 0, towns: int = 40, spread_deg: float = 0.03, world: str = "towns") -> DataFrame:
    """``n`` made observations for benches and tests; the same seed gives the same rows.

    Entities live in one of ``towns`` places, drawn evenly from the sphere; town k
    has a share of about 1/k of them, so there is skew. An entity's rows lie around its town, one a quarter of an hour
    over and over; every tenth observation derives from the row before it. ``world`` names in :data:`WORLDS`
    which part of the rows leaves its town for a place drawn evenly from the sphere.
    """
    draw = lambda k, *of: F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    crew = max(1, n // 64)
    df = spark.range(n).withColumn("crew", F.floor(draw(1, "id") * crew)).withColumn("town", F.floor(F.pow(F.lit(float(towns)), draw(2, "crew"))))
    bell = lambda k: (draw(k, "id") + draw(k + 1, "id") + draw(k + 2, "id") - 1.5) * (2 * spread_deg)
    kinds = F.array(*map(F.lit, ("arrive", "depart", "measure", "repair", "alarm")))
    lat, lon = F.degrees(F.asin(draw(3, "town") * 2 - 1)) + bell(5), draw(4, "town") * 360 - 180 + bell(8)
    if WORLDS[world]:
        away = draw(16, "id") < WORLDS[world]
        lat, lon = F.when(away, F.degrees(F.asin(draw(17, "id") * 2 - 1))).otherwise(lat), F.when(away, draw(18, "id") * 360 - 180).otherwise(lon)
    return complete(df.select(
        F.concat(F.lit("made_"), F.col("id").cast("string")).alias("observation_id"), F.concat(F.lit("unit_"), F.col("crew").cast("string")).alias("entity_id"), F.get(kinds, F.floor(draw(11, "id") * 5).cast("int")).alias("event_type"),
        F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)).alias("lat"), (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"),
        F.timestamp_seconds(F.lit(1_735_689_600) + F.pmod("id", F.lit(90 * 96)) * 900).alias("ts"), F.concat(F.lit("probe_"), F.floor(draw(12, "crew") * 12).cast("string")).alias("source_id"),
        F.round(1 - draw(13, "id") * draw(14, "id"), 2).alias("confidence"), (F.floor(draw(15, "id") * 20) + 2).cast("double").alias("uncertainty_m"),
        F.when((F.col("id") % 10 == 9), F.concat(F.lit("made_"), (F.col("id") - 1).cast("string"))).alias("parent_observation"),
    ))


#: Parts of a day that are packed on their own.
PARTS = 16


def delta_packed(obs: DataFrame) -> DataFrame:
    """Observations in time order as differences of microseconds and of 1e-5 degrees, each part of a day on its own; sums inside a part give them back (:func:`delta_unpacked`)."""
    w = Window.partitionBy("day", "part").orderBy("ts", "observation_id")
    part = F.floor((F.unix_micros("ts") - F.unix_micros(F.to_date("ts").cast("timestamp"))) / F.lit(86_400_000_000 // PARTS))
    own = obs.select(F.to_date("ts").alias("day"), part.alias("part"), "ts", "observation_id", F.unix_micros("ts").alias("us"), F.bround(F.col("lat") * 100000).cast("long").alias("y"), F.bround(F.col("lon") * 100000).cast("long").alias("x"))
    step = lambda c: (F.col(c) - F.lag(c, 1, 0).over(w)).alias(f"d_{c}")
    return own.select("day", "part", F.row_number().over(w).alias("row"), "observation_id", step("us"), step("y"), step("x"))


def delta_unpacked(packed: DataFrame) -> DataFrame:
    w = Window.partitionBy("day", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(f"d_{c}").over(w)
    return packed.select("observation_id", F.timestamp_micros(total("us")).alias("ts"), (total("y") / 100000.0).alias("lat"), (total("x") / 100000.0).alias("lon"))


def write_layout(obs: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Parquet partitioned by day, sorted by geohash inside files, so day, lat and lon prune partitions and row groups."""
    from terrachron.functions.geo import geohash

    dated = obs.withColumn("day", F.to_date("ts")).withColumn("cell", geohash(F.col("lat"), F.col("lon"), 6))
    dated.repartitionByRange(files_per_day, "day", "cell").sortWithinPartitions("day", "cell", "ts").write.partitionBy("day").parquet(path)
