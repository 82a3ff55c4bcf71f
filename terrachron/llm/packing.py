"""Best-fit packing planned on the length histogram (operator 4).

Pieces of at most ``length`` tokens are counted by length; the histogram has at most
``length`` rows, whatever the corpus. Best-fit decreasing runs on those counts: all
bins that are filled alike are one group, so a step places thousands of pieces at once.
The plan says, for each length and range of ranks, in which sequence and at which
offset a piece goes; pieces take their places by joining on length and rank within length.
Ranks come from counts per length and salt bucket, so no window holds all pieces of a length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrachron.plans.tables import written

#: Ranks in a block of the plan; a piece joins on (length, rank block).
BLOCK = 1024


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """{length: pieces} -> (length, first rank, past last rank, first sequence, offset).

    Lengths go from long to short; a piece goes into the fullest sequence that still
    has room. Sequences filled alike are handled together as ranges of sequence ids.
    """
    plan, room, free, following = [], {}, [], 0
    def put_back(left: int, ranges: list[tuple[int, int]]) -> None:
        if left > 0 and ranges:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left] += ranges

    for size in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[size]
        while todo:
            i = bisect.bisect_left(free, size)
            if i < len(free):
                left = free[i]
                lo, hi = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(i)
            else:
                left, lo, hi = capacity, following, following + -(-todo // (capacity // size))
                following = hi
            each = left // size
            full = min(hi - lo, todo // each)
            for k in range(each if full else 0):
                plan.append((size, rank, rank + full, lo, capacity - left + k * size))
                rank += full
            todo -= full * each
            put_back(left - each * size, [(lo, lo + full)] if full else [])
            lo += full
            if lo < hi and todo:
                some = min(todo, each)
                for k in range(some):
                    plan.append((size, rank, rank + 1, lo, capacity - left + k * size))
                    rank += 1
                todo -= some
                put_back(left - some * size, [(lo, lo + 1)])
                lo += 1
            put_back(left, [(lo, hi)] if lo < hi else [])
    return plan


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of ``n`` tokens: all of ``length`` but the first, which takes the rest."""
    first = n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


class Ids:
    """Token ids of a text under the byte-level BPE vocabulary, then id 0.

    tiktoken runs the same merges from the same vocabulary about four times as fast as
    the tokenizers library (equal ids: tests/llm/test_other_operators.py); a text that
    holds the string of a special token goes through tokenizers itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(0)
        return np.array(ids, "<u4")


def _pieces(tokenizer: str, ranks: str, length: int):
    """Arrow batches (doc_id, text) -> a row per piece, with the id bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer, ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = ids_of((text.as_py() or b"").decode("utf-8", "replace"))
                    rows += [(doc, k, start, size, zlib.crc32(ids[start : start + size].tobytes())) for k, (start, size) in enumerate(cut(len(ids), length))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str, length: int = 2048) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: one row per piece.

    Null text is empty: one piece of one token, id 0. Bytes that are not UTF-8 are read as
    U+FFFD. Repeated rows and repeated or null ids have pieces of their own; other columns
    are ignored, whatever their names; no rows give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(_pieces(tokenizer, ranks, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048, per_bucket: int | None = None) -> DataFrame:
    """Rows with a ``length`` from 1 to ``capacity`` -> the same rows with sequence_id and offset.

    Every row gets one place; places of a sequence are gapless from 0. Equal rows get
    places of their own. No rows give no rows. A length is numbered in salt buckets of
    ``per_bucket`` rows; without it, as many buckets as rows in each for the commonest length.
    """
    pieces = written(pieces.withColumn("_uid", F.monotonically_increasing_id()), "packing-pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.collect()}  # at most ``capacity`` rows
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"a piece is not of 1 to {capacity} tokens")
    commonest = max(histogram.values(), default=0)
    buckets = max(1, -(-commonest // per_bucket) if per_bucket else math.isqrt(commonest))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(buckets)))
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    starts = starts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_first"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_uid")) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    plan = best_fit(histogram, capacity)
    spark = pieces.sparkSession
    slots = spark.createDataFrame(pa.table([pa.array([p[i] for p in plan], pa.int64()) for i in range(5)], ["length", "_lo", "_hi", "_seq", "offset"]))
    slots = slots.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_lo") / BLOCK), F.floor((F.col("_hi") - 1) / BLOCK))))
    out = ranked.join(slots, ["length", "_block"]).where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return out.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_lo")).select(*[c for c in pieces.columns if c != "_uid"], "sequence_id", "offset")
