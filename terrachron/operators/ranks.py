"""Exact values at given ranks, without sorting a group in one task.

A value is looked for in a range that holds its rank. While a range holds many rows they are
counted in bins, an aggregation that combines before it shuffles, and the bin with the rank becomes the next
range; what is left, a bounded number of rows for each value looked for, is sorted. A bin's own least and greatest
values are the next range, so equal values, however many, end the search at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.plans.tables import drop, written

#: Rows of a group, or of a range, that are sorted; bins of a range.
SORTED, BINS = 1_000_000, 2048


def at_ranks(df: DataFrame, by: str, value: str, wanted: Column) -> DataFrame:
    """(by, slot, v): of each group the value at each rank, from 0; ``wanted`` is an array of ranks made of n, the group's number of rows.

    ``slot`` is the rank's place in the array. Null values aren't counted; groups without a value have no rows, nor have ranks outside the group.
    """
    own = df.select(F.col(by), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = own.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = n.select(F.col(by).alias("_by"), "lo", "hi", F.col("n").alias("size"), F.posexplode(wanted).alias("slot", "rank")).where("rank >= 0 AND rank < size")
    ranges = written(asked, "ranks")
    while not ranges.where((F.col("size") > SORTED) & (F.col("lo") < F.col("hi"))).isEmpty():
        inside = _inside(own, by, ranges.where((F.col("size") > SORTED) & (F.col("lo") < F.col("hi"))))
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("_by", "slot", "rank", part.alias("bin")).agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = F.sum("size").over(Window.partitionBy("_by", "slot").orderBy("bin")) - F.col("size")  # at most BINS rows
        met = bins.withColumn("below", below).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size")))
        done = ranges.where((F.col("size") <= SORTED) | (F.col("lo") == F.col("hi")))
        after = written(done.unionByName(met.select("_by", "lo", "hi", "size", "slot", (F.col("rank") - F.col("below")).alias("rank"))), "ranks")
        drop(ranges)
        ranges = after
    same = ranges.where("lo = hi").select(F.col("_by").alias(by), "slot", F.col("lo").alias("v"))
    left = _inside(own, by, ranges.where("lo < hi"))
    k = F.row_number().over(Window.partitionBy("_by", "slot").orderBy("v")) - 1  # at most SORTED rows
    return same.unionByName(left.withColumn("k", k).where("k = rank").select(F.col("_by").alias(by), "slot", "v"))


def _inside(own: DataFrame, by: str, ranges: DataFrame) -> DataFrame:
    return own.join(ranges, F.col(by).eqNullSafe(F.col("_by")) & F.col("v").between(F.col("lo"), F.col("hi")))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the median of each column, the mean of the two in the middle; null without a value."""
    told = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_e")).select("_e.*")
    middle = at_ranks(told, "c", "v", F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    return middle.agg(*[F.avg(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])
