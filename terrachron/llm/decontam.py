"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 2).

Test strings are windows of ``window`` consecutive words of a benchmark item; a shorter
item is one window. Windows of one length form one searcher. A block is two adjacent
words. The searcher looks at the block at the end of its window on the text: the shift
table says how far the window may jump (over every position at which no test string can
end), and where the shift is zero, the block's bucket of test strings with that suffix
is compared word by word. Long stretches of ordinary text are skipped nine words at a time.

The benchmark is read in blocks of at most ``block_bytes`` of text, one searcher set and
one pass over the documents for each. Of several sets each is built, broadcast, used and
destroyed before the next, so what the driver and the executors hold is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm.words import pieces
from terrachron.plans.tables import drop, written

#: The words of the contract: A-Z to lower case; 0-9, a-z and bytes of other scripts stay; the rest of ASCII separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class WuManber:
    """Searcher for windows of one length, which stand in one list of words.

    Shifts are kept by a hash of the block; blocks that collide take the smaller shift,
    which is safe. Positions of windows are sorted by a hash of suffix block and first
    word; ``marks`` says which hashes occur. Per window some 50 bytes are kept.
    """

    def __init__(self, known: list[bytes], windows: list[tuple[int, str]], length: int):
        """``windows``: (first word's place in ``known``, item)."""
        self.length, self.known = length, known
        self.block = b = min(2, length)
        self.far = min(length - b + 1, 255)
        size = 1 << max(10, (8 * len(known)).bit_length())
        self.mask = mask = size - 1
        self.shift, self.marks = bytearray([self.far]) * size, bytearray(size)
        self.names = sorted({item for _, item in windows})
        number = {item: i for i, item in enumerate(self.names)}
        shift, keyed = self.shift, []
        for at, item in windows:
            for end in range(at + b, at + length + 1):
                h = crc32(known[end - 1], crc32(known[end - 2])) if b == 2 else crc32(known[end - 1])
                shift[h & mask] = min(shift[h & mask], at + length - end)
            key = crc32(known[at], h)
            self.marks[key & mask] = 1
            keyed.append((key, at, number[item]))
        keyed.sort()
        self.keys, self.places, self.owners = (array(kind, [x[i] for x in keyed]) for i, kind in enumerate("IQQ"))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence, by start."""
        m, shift, marks, mask, keys, known, n = self.length, self.shift, self.marks, self.mask, self.keys, self.known, len(words)
        i, one = m - 1, self.block == 1
        while i < n:
            h = crc32(words[i]) if one else crc32(words[i], crc32(words[i - 1]))
            jump = shift[h & mask]
            if jump:
                i += jump
                continue
            start = i - m + 1
            key = crc32(words[start], h)
            if marks[key & mask]:
                lo, here = bisect_left(keys, key), words[start : i + 1]
                same = [self.names[self.owners[x]] for x in range(lo, bisect_right(keys, key, lo)) if known[self.places[x] : self.places[x] + m] == here]
                if same:
                    yield start, same
            i += 1


def searchers(items: list[tuple[str, bytes | None]], window: int = 10) -> list[WuManber]:
    """One searcher for each window length; an item without words has no window."""
    by_length: dict[int, tuple[list[bytes], list[tuple[int, str]]]] = defaultdict(lambda: ([], []))
    interned: dict[bytes, bytes] = {}
    for item, text in items:
        words = [interned.setdefault(w, w) for w in (text or b"").translate(TABLE).split()]
        size = min(window, len(words))
        known, windows = by_length[size]
        once = {tuple(words[i : i + size]): i for i in range(len(words) - size, -1, -1)} if size else {}
        windows += [(len(known) + i, item) for i in once.values()]
        known += words
    return [WuManber(known, windows, size) for size, (known, windows) in sorted(by_length.items()) if size]


def scan(data: bytes | None, found_by: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged [start, end) ranges of hit words, items with an occurring window."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    back = max((s.length for s in found_by), default=1) - 1
    kept: list[bytes] = []
    base = 0
    for piece in pieces(data.translate(TABLE), b" ") if data else ():
        words = kept + piece.split()
        for s in found_by:
            for start, own in s.find(words):
                spans.append((base + start, base + start + s.length))
                items.update(own)
        kept = words[len(words) - back :] if 0 < back < len(words) else words if back else []
        base += len(words) - len(kept)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return base + len(kept), merged, items


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = 8 << 20) -> list[DataFrame]:
    """The items (item, text) in blocks of about ``block_bytes`` of text, each item with the same text once.

    Rows of one item_id may repeat; a null item_id is listed as an empty string; a null text has no window.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def sent_searchers(block: DataFrame, window: int) -> Broadcast:
    """One block's searchers, broadcast."""
    return block.sparkSession.sparkContext.broadcast(searchers([(r.item, r.text) for r in block.collect()], window))


def _pass(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [scan(t.as_py(), sent.value) for t in b.column(2)]
            spans = pa.array([[{"lo": lo, "hi": hi} for lo, hi in s] for _, s, _ in x], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _, _ in x], pa.int64()), spans, pa.array([sorted(i) for _, _, i in x], pa.list_(pa.string()))], ["uid", "doc_id", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A document word inside any occurrence of a window is hit; spans are the ranges of hit
    words. Null and empty texts have no words. Rows with equal or null ids each have a
    result of their own; other columns are ignored. An empty benchmark hits nothing.
    Texts are compared as bytes, so they need not be valid UTF-8.
    """
    blocks = benchmark_blocks(benchmark, block_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "uid long, doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
    if len(blocks) == 1:
        out = rows.mapInArrow(_pass(sent_searchers(blocks[0], window)), schema)
    else:
        rows, parts = written(rows, "decontam-rows"), []
        for block in blocks:
            sent = sent_searchers(block, window)
            parts.append(written(rows.mapInArrow(_pass(sent), schema), "decontam-part"))
            sent.destroy()
        drop(rows)
        out = reduce(DataFrame.unionAll, parts).groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
        step = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("hit"), F.greatest(s["hi"], a["end"]).alias("end"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]) if len(blocks) == 1 else F.aggregate("spans", start, step)["hit"]
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), "spans", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names, in which no window of the benchmark occurs.

    Null and empty texts stay; repeated rows all stay or all go; an empty benchmark takes
    nothing; no rows give no rows. Of several benchmark blocks each has its own pass over
    the rows that are left.
    """
    at, blocks, before = docs.columns.index(text), benchmark_blocks(benchmark, block_bytes), None
    for block in blocks:
        sent = sent_searchers(block, window)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not scan(t.as_py(), sent.value)[1] for t in b.column(at).cast(pa.binary())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            docs = written(docs, "decontam-left")
            sent.destroy()
            if before is not None:
                drop(before)
            before = docs
    return docs


def items_digest(items: list[str]) -> str:
    """The digest of the contract, for tests: ids sorted as strings, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
