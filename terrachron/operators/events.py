"""Events: observations that chains of near ones join.

Rows of a block, cells about half a radius wide in one tick of the window, are all near one another. So a block is
one node however many rows it has, and what has to be found is which blocks hold a near pair, not the pairs.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrachron.functions import geo
from terrachron.operators import joins
from terrachron.plans.components import components
from terrachron.plans.tables import drop, written

#: Side of a block as part of the radius (under a half, so rounding can't matter); places a part in which two blocks are compared.
SIDE, PART = 0.49, 1024
_KEY = ("_row", "_column", "_tick")


def _keyed(obs: DataFrame, radius_m: float, window: timedelta) -> DataFrame:
    """observation_id, lat, lon, ts and the block's key, null where place or time is unknown."""
    known = F.col("ts").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    row, column = geo.tight_cell(F.col("lat"), F.col("lon"), max(radius_m, 0.01) * SIDE)
    if radius_m < 0.01:  # a block is one place
        row, column = F.xxhash64("lat", "lon"), F.to_json(F.struct("lat", "lon"))
    key = dict(zip(_KEY, (row, column, joins._tick(window)), strict=True))
    return obs.select("observation_id", "lat", "lon", "ts", *[F.when(known, v).alias(k) for k, v in key.items()])


def _blocks(keyed: DataFrame) -> DataFrame:
    """A row per block: node (its smallest id), its box, up to six of its rows, the outermost by place and time, and whether it has more than those (thick)."""
    lon = F.when(F.col("lon") == 180, -180.0).otherwise(F.col("lon"))  # of one column with -180
    row = F.struct("lat", "lon", "ts")
    ends = [f(row, by) for by in ("lat", "lon", "ts") for f in (F.min_by, F.max_by)]
    box = [F.min("lat").alias("south"), F.max("lat").alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east")]
    out = keyed.where(F.col("_tick").isNotNull()).groupBy(*_KEY).agg(F.min("observation_id").alias("node"), F.count("*").alias("_n"), *box, F.array_distinct(F.array(*ends)).alias("ends"))
    return out.withColumn("thick", F.col("_n") > F.size("ends")).drop("_n")


def _linked_by_ends(blocks: DataFrame, radius_m: float, window: timedelta) -> DataFrame:
    """(a, b) nodes of blocks of which outermost rows are near; a cell of the join holds a bounded number of them. Exact for blocks without further rows."""
    ends = blocks.select("node", F.explode("ends").alias("e")).select(F.col("node").alias("observation_id"), F.col("node").alias("entity_id"), "e.lat", "e.lon", "e.ts")
    return joins.neighbour_pairs(ends, radius_m, window, other_entities=False, even=True).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _undecided(blocks: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of neighbouring blocks (a_, b_ columns) in different events, of which one has rows beyond its ends and whose latitudes don't rule a link out."""
    corner = [F.struct(F.col(y).alias("lat"), F.col(x).alias("lon")) for y in ("south", "north") for x in ("west", "east")]
    facts = ("node", "label", "south", "north")
    tick = F.col("_tick")

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("row", "column", "tick", *[F.col(c).alias(p + c) for c in facts]).distinct()

    # a block is narrower than the cells of the join, so its corners lie in all cells that it meets
    at_corners = blocks.select(*facts, "_tick", "thick", F.explode(F.array_distinct(F.array(*corner))).alias("c")).select(*facts, "_tick", "thick", "c.lat", "c.lon")
    placed = side(joins._placed(at_corners, radius_m, tick), "b_")
    looking = side(joins._spread(at_corners.where("thick"), radius_m, tick), "a_")
    gap = F.greatest(F.col("a_south") - F.col("b_north"), F.col("b_south") - F.col("a_north"))
    pairs = placed.join(looking, ["row", "column", "tick"]).where((F.col("a_label") != F.col("b_label")) & (gap <= geo._row_step(radius_m)))
    return pairs.drop("row", "column", "tick").distinct()


def _places(keyed: DataFrame, blocks: DataFrame, undecided: DataFrame) -> DataFrame:
    """node, lat, lon, first, last: the places of undecided blocks with their first and last time; repeated rows are combined before the shuffle."""
    asked = undecided.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
    keys = blocks.select(*_KEY, "node").join(asked, "node", "left_semi")
    return keyed.join(keys, list(_KEY)).groupBy("node", "lat", "lon").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def _linked_by_places(pairs: DataFrame, places: DataFrame, radius_m: float, window: timedelta) -> DataFrame:
    """(a, b) labels of the undecided pairs that hold a near pair of places. A block's places are dealt to parts, and parts compared, so no task has a whole block."""
    reach = geo._row_step(radius_m)
    n = places.groupBy("node").agg(F.count("*").alias("n"))
    for p in "ab":
        pairs = pairs.join(n.select(F.col("node").alias(f"{p}_node"), F.col("n").alias(f"{p}_n")), f"{p}_node")

    def side(p: str, o: str) -> DataFrame:
        own = places.select(F.col("node").alias(f"{p}_node"), *[F.col(c).alias(f"{p}_{c}_") for c in ("lat", "lon", "first", "last")])
        parts = lambda q: F.ceil(F.col(f"{q}_n") / PART)
        met = pairs.select("a_node", "b_node", "a_label", "b_label", "a_n", "b_n", F.col(f"{o}_south").alias("s"), F.col(f"{o}_north").alias("t")).join(own, f"{p}_node")
        met = met.where(F.col(f"{p}_lat_").between(F.col("s") - reach, F.col("t") + reach))
        met = met.withColumn(f"{p}_part", F.pmod(F.xxhash64(f"{p}_lat_", f"{p}_lon_"), parts(p))).withColumn(f"{o}_part", F.explode(F.sequence(F.lit(0).cast("long"), parts(o) - 1)))
        return met.select("a_node", "b_node", "a_part", "b_part", *(("a_label", "b_label") if p == "a" else ()), *[f"{p}_{c}_" for c in ("lat", "lon", "first", "last")])

    met = side("a", "b").join(side("b", "a"), ["a_node", "b_node", "a_part", "b_part"])
    us: Column = F.greatest(F.unix_micros("b_first_") - F.unix_micros("a_last_"), F.unix_micros("a_first_") - F.unix_micros("b_last_"))
    near = geo.haversine_m(F.col("a_lat_"), F.col("a_lon_"), F.col("b_lat_"), F.col("b_lon_")) <= radius_m
    return met.where((us <= joins._micros(window)) & near).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def associate(obs: DataFrame, radius_m: float, window: timedelta) -> DataFrame:
    """observation_id, event: observations joined by chains of rows at most ``radius_m`` and ``window`` apart; an event is named by its smallest id.

    Ids are unique, as in a table of observations. Rows of unknown place or time are events of their own; a negative radius or window joins nothing.
    Blocks are linked by their outermost places first. Where a block has more places and a neighbour belongs to another
    event after that, their places are compared: of one place only the first and last time matter, so rows that repeat cost nothing,
    and no crowded cell is ever expanded into its pairs.
    """
    alone = obs.select("observation_id", F.col("observation_id").alias("event"))
    if radius_m < 0 or window < timedelta(0):
        return alone
    keyed = _keyed(obs, radius_m, window)
    blocks = written(_blocks(keyed), "event-blocks")
    label = components(_linked_by_ends(blocks, radius_m, window), "event-labels")
    named = blocks.drop("ends").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if not blocks.where("thick").isEmpty():
        named = written(named, "event-blocks")
        drop(blocks)
        undecided = written(_undecided(named, radius_m), "event-undecided")
        if not undecided.isEmpty():
            places = written(_places(keyed, named, undecided), "event-places")
            further = components(_linked_by_places(undecided, places, radius_m, window), "event-labels").select(F.col("node").alias("label"), F.col("label").alias("wider"))
            named = named.join(further, "label", "left").withColumn("label", F.coalesce("wider", "label"))
            drop(places)
        drop(undecided)
    return keyed.join(named.select(*_KEY, "label"), list(_KEY), "left").select("observation_id", F.coalesce("label", "observation_id").alias("event"))
