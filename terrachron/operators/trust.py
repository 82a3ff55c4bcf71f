"""Fusion and patterns."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators.ordered import lagged
from terrachron.operators.search import ORDER
from terrachron.plans.tables import drop, written


def weighted_mean(obs: DataFrame) -> DataFrame:
    """entity_id, lat, lon, sigma_m, n: inverse-variance mean on the sphere; opposite points that cancel out give null places."""
    w = 1 / geo.variance_m2(F.col("uncertainty_m"), F.col("confidence"))
    own = obs.select("entity_id", w.alias("w"), *[v.alias(k) for k, v in zip("xyz", geo.xyz(F.col("lat"), F.col("lon")), strict=True)])
    s = own.groupBy("entity_id").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in "xyz"], F.sum("w").alias("w"), F.count("*").alias("n"))
    flat = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    real = F.sqrt(flat * flat + F.col("z") * F.col("z")) > F.col("w") * 1e-12
    return s.select("entity_id", F.when(real, F.degrees(F.atan2("z", flat))).alias("lat"), F.when(real, F.degrees(F.atan2("y", "x"))).alias("lon"), F.sqrt(1 / F.col("w")).alias("sigma_m"), "n")


#: Observations of an entity in one block, when each is compared with all others; from how many on bounds come first; cells along an entity's extent.
BLOCK, LARGE, ACROSS = 512, 2048, 16


def _apart(p: str, q: str) -> Column:
    """Metres between unit vectors p(x, y, z) and q(x, y, z), from their chord."""
    d = lambda k: F.col(p + k) - F.col(q + k)
    return F.asin(F.least(F.lit(1.0), F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z")) / 2)) * (2 * geo.EARTH_M)


def _chord(o: Column) -> Column:
    """From a row's unit vector to another's."""
    d = [F.col(k) - o[k] for k in "xyz"]
    return F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0]))


def _costs(some: DataFrame, packed: DataFrame) -> DataFrame:
    """Rows of ``some`` with ``cost``: metres to all observations of their entity, in deviations of those.

    A row goes to each block of its entity and adds up its distances there. The join is by entity and block, so the comparisons
    of a large entity are dealt by block; the number of parts is given, as few bytes are much work here and would be merged.
    """
    parts = max(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), some.sparkSession.sparkContext.defaultParallelism)
    add = lambda total, o: total + F.asin(F.least(F.lit(1.0), _chord(o) / 2)) * (2 * geo.EARTH_M) / F.sqrt(o["var"])
    each = some.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK)))).repartition(parts, "entity_id", "block")
    met = each.join(packed, ["entity_id", "block"]).select("entity_id", "observation_id", "x", "y", "z", "var", F.aggregate("others", F.lit(0.0), add).alias("cost"))
    return met.groupBy("entity_id", "observation_id").agg(*[F.first(c).alias(c) for c in ("x", "y", "z", "var")], F.sum("cost").alias("cost"))


def _bounded(large: DataFrame) -> DataFrame:
    """Rows of large entities with ``least``, which their cost can't be under.

    An entity's observations stand in cells; from a row to those of a cell it is at least as far as to their weighted mean, taken
    so many times as they weigh (a distance is convex, and a chord isn't longer than its arc). Cells of an entity are some
    hundreds; they are handed to as many parts of its rows as it has ten thousands.
    """
    w = 1 / F.sqrt("var")
    own = large.select("entity_id", "observation_id", "x", "y", "z", "var", "n", F.floor(F.col("n") / 10_000).alias("parts"))
    box = own.groupBy("entity_id").agg(F.first("parts").alias("parts"), *[f(k).alias(f"{p}{k}") for k in "xyz" for p, f in (("lo", F.min), ("hi", F.max))])
    step = F.greatest(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz"], F.lit(1e-12)) / ACROSS
    placed = own.join(box.select("entity_id", "lox", "loy", "loz", step.alias("step")), "entity_id")
    cell = [F.floor((F.col(k) - F.col(f"lo{k}")) / F.col("step")).alias(f"c{k}") for k in "xyz"]
    cells = placed.groupBy("entity_id", *cell).agg(F.sum(w).alias("w"), *[(F.sum(w * F.col(k)) / F.sum(w)).alias(k) for k in "xyz"], F.first("parts").alias("parts"))
    packed = cells.groupBy("entity_id").agg(F.collect_list(F.struct("x", "y", "z", "w")).alias("cells"), F.first("parts").alias("parts"))
    packed = packed.select("entity_id", "cells", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("part"))
    own = own.withColumn("part", F.pmod(F.xxhash64("observation_id"), F.col("parts") + 1))
    least = F.aggregate("cells", F.lit(0.0), lambda total, c: total + _chord(c) * c["w"]) * geo.EARTH_M
    return own.join(packed, ["entity_id", "part"]).select("entity_id", "observation_id", "x", "y", "z", "var", "n", least.alias("least"))


def _medoids(own: DataFrame) -> DataFrame:
    """entity_id, cx, cy, cz, sigma: of each entity's observations the one nearest to all, in deviations; the smallest id of several.

    In an entity with more than LARGE observations only those are compared with all others whose bound isn't above the cost of
    the one with the least bound, which is a cost that the medoid can't exceed.
    """
    counts = own.groupBy("entity_id").agg(F.count("*").alias("n"))
    crowded = not counts.where(F.col("n") > LARGE).isEmpty()
    own = own.join(counts, "entity_id").select("entity_id", "observation_id", "x", "y", "z", "var", "n")
    own = written(own, "medoid-rows") if crowded else own
    block = F.pmod(F.xxhash64("observation_id"), F.floor(F.col("n") / BLOCK) + 1).alias("block")
    packed = own.groupBy("entity_id", block).agg(F.collect_list(F.struct("x", "y", "z", "var")).alias("others"))
    some, held = own.where(F.col("n") <= LARGE), []
    if crowded:
        packed = written(packed, "medoid-blocks")
        bound = written(_bounded(own.where(F.col("n") > LARGE)), "medoid-bounds")
        first = bound.groupBy("entity_id").agg(F.min_by(F.struct("observation_id", "x", "y", "z", "var", "n"), F.struct("least", "observation_id")).alias("m")).select("entity_id", "m.*")
        most = _costs(first, packed).groupBy("entity_id").agg(F.min("cost").alias("most"))
        some = some.unionByName(bound.join(most, "entity_id").where(F.col("least") <= F.col("most") * (1 + 1e-9) + 1e-3).drop("least", "most"))
        held = [own, packed, bound]
    best = _costs(some, packed).groupBy("entity_id").agg(F.min_by(F.struct("x", "y", "z", "var"), F.struct(F.round("cost", 6), "observation_id")).alias("m"))
    out = written(best.select("entity_id", *[F.col(f"m.{k}").alias(f"c{k}") for k in "xyz"], F.sqrt("m.var").alias("sigma")), "fusion-centres")
    for table in held:
        drop(table)
    return out


def _means(kept: DataFrame, *more: Column) -> DataFrame:
    """entity_id, centre (null where places cancel out), sigma and ``more``: inverse-variance means."""
    w = 1 / F.col("var")
    s = kept.groupBy("entity_id").agg(*[F.sum(w * F.col(k)).alias(f"s{k}") for k in "xyz"], F.sum(w).alias("sw"), *more)
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    centre = [F.when(size > F.col("sw") * 1e-12, F.col(f"s{k}") / size).alias(f"c{k}") for k in "xyz"]
    return s.select("entity_id", *centre, F.sqrt(1 / F.col("sw")).alias("sigma"), *[c for c in s.columns if c not in ("entity_id", "sx", "sy", "sz", "sw")])


def fusion(obs: DataFrame, k_sigma: float = 3.0, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(entity_id, lat, lon, sigma_m, confidence, n, n_outliers; entity_id, observation_id, outlier: a row per observation).

    From the weighted medoid outwards: observations farther than ``k_sigma`` combined
    deviations are outliers, unless that would be half of all; then the weighted mean of
    the others, until no flag changes. One or two observations have no outliers. Places
    that cancel out give null coordinates. A round is two aggregations and two joins by entity; centres are a row per entity.
    """
    var = geo.variance_m2(F.col("uncertainty_m"), F.col("confidence"))
    places = zip("xyz", geo.xyz(F.col("lat"), F.col("lon")), strict=True)
    rows = written(obs.select("entity_id", "observation_id", *[v.alias(k) for k, v in places], var.alias("var"), "confidence", F.lit(False).alias("out")), "fusion-rows")
    centres = _medoids(rows)
    for turn in range(rounds):
        far = _apart("", "c") > k_sigma * F.sqrt(F.col("var") + F.col("sigma") * F.col("sigma"))
        seen = rows.join(centres, "entity_id", "left").withColumn("far", F.coalesce(far, F.lit(False)))
        per = seen.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far"))
        some = per.select("entity_id", ((F.col("n") > 2) & (2 * F.col("n_far") < F.col("n"))).alias("some"))
        marked = written(seen.join(some, "entity_id").select(*rows.columns[:-1], (F.col("far") & F.col("some")).alias("out"), (F.col("out") != (F.col("far") & F.col("some"))).alias("moved")), "fusion-rows")
        drop(rows)
        drop(centres)
        rows, moved = marked.drop("moved"), not marked.where("moved").isEmpty()
        rows._terrachron_path = marked._terrachron_path
        if turn and not moved:
            break
        centres = written(_means(rows.where(~F.col("out"))), "fusion-centres")
    one = _means(rows.where(~F.col("out")), (1 - F.product(1 - F.col("confidence"))).alias("confidence"), F.count("*").alias("kept"))
    n = rows.groupBy("entity_id").agg(F.count("*").alias("n"))
    lat, lon = F.degrees(F.atan2("cz", F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")))), F.degrees(F.atan2("cy", "cx"))
    fused = one.join(n, "entity_id").select("entity_id", lat.alias("lat"), lon.alias("lon"), F.col("sigma").alias("sigma_m"), "confidence", "n", (F.col("n") - F.col("kept")).alias("n_outliers"))
    return fused, rows.select("entity_id", "observation_id", F.col("out").alias("outlier"))


def fuse_locations(obs: DataFrame, k_sigma: float = 3.0, rounds: int = 10) -> DataFrame:
    """The first of :func:`fusion`."""
    return fusion(obs, k_sigma, rounds)[0]


def precursors(obs: DataFrame, target: str, lookback: timedelta) -> DataFrame:
    """event_type, fraction: of all target events, those that the same entity's event of the type preceded within the lookback."""
    goals = obs.where(F.col("event_type") == target).select("entity_id", F.col("observation_id").alias("goal"), F.col("ts").alias("goal_ts"))
    width = F.lit(max(1, round(lookback.total_seconds() * 1e6)))
    tick = lambda c: F.floor(F.unix_micros(c) / width)
    goals = goals.withColumn("tick", F.explode(F.array(tick("goal_ts") - 1, tick("goal_ts"))))
    met = obs.withColumn("tick", tick("ts")).join(goals, ["entity_id", "tick"])
    met = met.where((F.col("ts") < F.col("goal_ts")) & (F.unix_micros("goal_ts") - F.unix_micros("ts") <= width))
    n = obs.where(F.col("event_type") == target).agg(F.count("*").alias("all"))
    # one row by construction
    return met.select("goal", "event_type").distinct().groupBy("event_type").agg(F.count("*").alias("c")).join(F.broadcast(n)).select("event_type", (F.col("c") / F.col("all")).alias("fraction"))


def deteriorating(obs: DataFrame, severity: list[str]) -> DataFrame:
    """entity_id, first_level, last_level, n: entities whose events of the listed types never get milder and end worse than they began."""
    level = F.array_position(F.array(*map(F.lit, severity)), F.col("event_type")).cast("int") - 1
    own = obs.withColumn("level", level).where(F.col("level") >= 0)
    own = lagged(own, "entity_id", ORDER, F.unix_micros("ts"), {"prev": "level"})
    out = own.groupBy("entity_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("level") >= F.col("prev"), F.lit(True))).alias("ok"), F.min_by("level", F.struct("ts", "observation_id")).alias("first_level"), F.max_by("level", F.struct("ts", "observation_id")).alias("last_level"))
    return out.where("ok AND n > 1 AND last_level > first_level").select("entity_id", "first_level", "last_level", "n")


def grams(obs: DataFrame, n: int = 2) -> DataFrame:
    """entity_id, gram: distinct runs of n event types in time order; a shorter history is one run."""
    own = obs.select("entity_id", "event_type", "ts", "observation_id", F.col("event_type").alias("run"))
    for _ in range(n - 1):  # a run of one more is the run of the row before and the own type; null where that has none
        own = lagged(own, "entity_id", ORDER, F.unix_micros("ts"), {"run": "run"}).withColumn("run", F.concat("run", F.lit(">"), "event_type"))
    short = obs.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") < n).select("entity_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ts", "observation_id", "event_type"))), lambda x: x["event_type"])
    whole = obs.join(short, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_join(parts, ">").alias("gram"))  # fewer than n rows each
    return own.where(F.col("run").isNotNull()).select("entity_id", F.col("run").alias("gram")).unionByName(whole).distinct()


def sequence_similarity(obs: DataFrame, entities: list[str], n: int = 2) -> DataFrame:
    """a, b, similarity: Jaccard of the runs of each pair among the asked entities; 1 where neither has events, 0 where one has none."""
    g = grams(obs.where(F.col("entity_id").isin(entities)), n)
    asked = obs.sparkSession.createDataFrame([(e,) for e in sorted(set(entities))], "entity_id string")
    size = asked.join(g.groupBy("entity_id").agg(F.count("*").alias("c")), "entity_id", "left").select("entity_id", F.coalesce("c", F.lit(0)).alias("c"))
    both = g.select("gram", F.col("entity_id").alias("a")).join(g.select("gram", F.col("entity_id").alias("b")), "gram").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    # pairs of the entities asked for, not of the data
    pairs = size.select(F.col("entity_id").alias("a"), F.col("c").alias("ca")).join(size.select(F.col("entity_id").alias("b"), F.col("c").alias("cb")), F.col("a") < F.col("b"))
    i = F.coalesce("i", F.lit(0))
    union = F.col("ca") + F.col("cb") - i
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.when(union > 0, i / union).otherwise(1.0).alias("similarity"))
