"""Sharding by jump consistent hashing (operator 9), with DataFrame functions only.

A 64-bit key walks from bucket to bucket by a linear congruential generator until it
would leave the last shard; no ring table is kept, and when shards are appended a key
either stays or goes to a new shard. The generator needs products modulo 2^64; they
are made from halves that stay inside a signed long, since SQL arithmetic checks overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.plans.tables import written

#: Fixed multiplier of the published algorithm, by halves of 32 bits.
_HI, _LO = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def _times(a: Column, b: int) -> tuple[Column, Column]:
    """Low and high 32 bits of a 32-bit ``a`` times a 32-bit ``b``."""
    low = (a.bitwiseAND(F.lit(0xFFFF))) * F.lit(b)
    high = F.shiftright(a, 16) * F.lit(b)
    t = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return t.bitwiseAND(F.lit(_MASK)), F.shiftright(t, 32) + F.shiftright(high, 16)


def _step(s: Column) -> Column:
    """One jump of the state (hi, lo: the generator's halves; b: the last bucket inside; j: where the next jump leads)."""
    low, carry = _times(s["lo"], _LO)
    cross = _times(s["hi"], _LO)[0] + _times(s["lo"], _HI)[0]
    low = low + 1
    hi = (carry + cross + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK))
    lo = low.bitwiseAND(F.lit(_MASK))
    far = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
    return F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), far.cast("long").alias("j"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key (null: as key 0).

    A key needs at most ``shards`` jumps and about ln(shards) on average; jumps run in
    blocks of 32, and a block that starts after the last jump does nothing.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    hi = F.shiftrightunsigned(key, 32)
    first = F.struct(hi.alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"), F.lit(-1).cast("long").alias("b"), zero.alias("j"))
    jump = lambda s, _: F.when(s["j"] < shards, _step(s)).otherwise(s)
    block = lambda s, _: F.when(s["j"] < shards, F.aggregate(F.sequence(F.lit(1), F.lit(32)), s, jump)).otherwise(s)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(-(-(shards + 1) // 32))), first, block)
    return done["b"].cast("int")


def assigned(docs: DataFrame, shards: int = 40, per_bucket: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key is a hash of doc_id, so equal ids share a shard; null ids share one. Size:
    UTF-8 bytes plus 16 (null text: 16, CRC of nothing). Slots are gapless from 0 in
    each shard: rows are numbered inside salt buckets of about ``per_bucket`` rows (the root of the largest shard's count) and
    the counts of earlier buckets are added, so no window holds a whole shard. Equal
    rows take slots of their own; further columns are ignored, whatever their names; no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"))
    rows = written(rows, "sharding-rows")
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // per_bucket) if per_bucket else math.isqrt(most))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    out = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("uid")) - 1).join(starts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 40, files: int = 8) -> None:
    """Writes all rows and columns, partitioned by ``shard``; each shard is dealt to ``files`` tasks, so a hot key does not make one file."""
    dealt = docs.withColumn("shard", jump_hash(F.xxhash64(F.col(key)), shards)).withColumn("_deal", F.floor(F.rand(7) * files))
    dealt.repartition(shards * files, "shard", "_deal").drop("_deal").write.partitionBy("shard").parquet(path)
