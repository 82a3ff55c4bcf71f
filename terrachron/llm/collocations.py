"""Phrases that stand together more often than their parts would (operator 13).

Texts are read a shard at a time: some MB of one language's texts in a task. A shard gets a generalised
suffix automaton of its pieces (runs of words between punctuation) cut at ``longest`` words. Of an automaton
the counting needs its states, their suffix links and their endpos counts, and these are the trie of the
reversed phrases: a state of k words is the state of its last k - 1 words, its suffix link, and the word before
them. So all ends of a shard move from length to length together by sorting, and the size of a state's group is
its endpos count. Shards emit phrases with counts, which are added up over the corpus.

Counts go by length. A phrase can have ``least`` occurrences only if both phrases of one word less
inside it have as many, so each length after the first reads the texts again and follows only ends whose
shorter phrases pass a filter: a bitmap of the hashes of all phrases that are frequent in the whole corpus, of
a fixed size. A bit that two phrases share lets a phrase through that the count then drops: a
crowded bitmap costs time and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrachron.plans.tables import written

#: Bytes of text in a shard, bits of a filter (16 MB) as a power of two, salts of a language's best phrases.
SHARD, FILTER_BITS, SALTS = 4 << 20, 27, 32
#: Marks between pieces become a line feed, white space inside them a blank, A-Z lower case.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BREAK = b"\n"
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def longer(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all but its last word and all but its first."""
    return _mixed(first * _ODD[0] + last * _ODD[1])


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class _Numbers(dict):
    """Word -> its number, in order of appearance; the empty word between two blanks doesn't count."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class Shard:
    """Word numbers of a shard's texts in order, a break (0) between pieces, and their words."""

    def __init__(self, lang: str, texts: list[bytes]):
        said = b"\n".join(texts).translate(_TABLE).replace(_BREAK, b" \n ")
        seen = _Numbers({_BREAK: 0, b"": -1})
        split = said.split(b" ")
        ids = np.fromiter(map(seen.__getitem__, split), np.int64, len(split))
        self.lang, self.ids = lang, ids[ids >= 0]
        del seen[b""]
        self.words = list(seen)

    def grown(self, size: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(state of each end that is left, the ends): of ``size`` words, all of whose shorter phrases pass ``filters`` (by length, from one word on).

        States of one length are numbered from 0; a state's suffix link is the state of the same ends one round earlier.
        """
        hashes = word_hashes(self.lang, self.words)[self.ids]
        alive = self.ids > 0
        for k in range(size - 1):
            passed = alive & _passes(filters[k], hashes) if k < len(filters) else alive
            # a longer phrase ends where one that passes ends, just behind another that passes
            hashes = longer(np.concatenate([hashes[:1], hashes[:-1]]), hashes)
            alive = passed & np.concatenate([[False], passed])[:-1]
        ends = np.flatnonzero(alive)
        state = self.ids[ends]
        for k in range(1, size):
            _, state = np.unique(state << 32 | self.ids[ends - k], return_inverse=True)
        return state, ends

    def phrases(self, size: int, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of ``size`` words and their endpos counts."""
        state, ends = self.grown(size, filters)
        count = np.bincount(state)
        some = np.zeros(len(count), np.int64)
        some[state] = ends  # any end shows the words of its state
        some, count = some[count > 0], count[count > 0]
        table = pa.array(self.words, pa.large_binary())
        words = [table.take(pa.array(self.ids[some - k])) for k in range(size - 1, -1, -1)]
        return reduce(lambda a, b: pc.binary_join_element_wise(a, b, pa.scalar(b" ", pa.large_binary())), words), count


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Arrow batches (lang, text) -> shards; a very long text is one of its own."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or b"").decode("utf-8", "replace").encode()
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            total += len(raw)
            if total >= SHARD:
                most = max(size, key=size.get)
                total -= size.pop(most)
                yield Shard(most, held.pop(most))
    for lang, raws in held.items():
        yield Shard(lang, raws)


def _counted(docs: DataFrame, size: int, filters: list, least: int) -> DataFrame:
    """lang, phrase, n: phrases of ``size`` words with ``least`` occurrences; of one word also a null phrase, the count of all words."""
    sent = [docs.sparkSession.sparkContext.broadcast(f) for f in filters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [s.value for s in sent]
        for shard in _shards(batches):
            phrases, count = shard.phrases(size, bits)
            if size == 1:
                phrases, count = pa.concat_arrays([phrases, pa.array([None], phrases.type)]), np.append(count, count.sum())
            for at in range(0, len(count), 100_000):
                part = phrases.slice(at, 100_000).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(part), pa.string()), part, pa.array(count[at : at + 100_000])], ["lang", "phrase", "n"])

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    out = own.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = written(out.where((F.col("n") >= least) | F.col("phrase").isNull()), f"collocations-{size}")
    for s in sent:
        s.destroy()
    return out


def _filter(frequent: DataFrame) -> np.ndarray:
    """The bitmap of written frequent phrases: at most 2 ** (FILTER_BITS - 6) rows of two numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes(lang, phrase.as_py().encode().split(b" "))
                while len(h) > 1:
                    h = longer(h[:-1], h[1:])
                at.append(h[0])
            at = np.array(at, np.uint64) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    got = frequent.where(F.col("phrase").isNotNull()).select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> list[DataFrame]:
    """docs (lang, text) -> by length from one word on: lang, phrase, n of phrases with at least ``least`` occurrences; the first also has a null phrase with the count of all words."""
    out, filters = [], []
    for size in range(1, longest + 1):
        out.append(_counted(docs, size, filters, least))
        if size < longest:
            filters.append(_filter(out[-1]))
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, held_share: int = 50, top: int = 2000) -> DataFrame:
    """docs (lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    A phrase of ``a`` occurrences scores floor(1000000 a a / (l r)) at its worst cut (the earliest of several), l and r the occurrences
    of both parts. It goes if a longer candidate with at least ``held_share`` percent of its occurrences holds it: as counts only
    fall with length, a candidate of one word more decides, which names the two phrases it holds, the target of its suffix link and
    the one without its last word. Order is score, a (both falling), phrase by UTF-8 bytes, so there are no ties.

    Null text is empty, null lang ``und``; bytes that aren't UTF-8 are read as U+FFFD. Equal rows all count. Further columns are
    ignored, whatever their names; no rows give no rows. Products are decimals of 38 digits: exact up to 10**16 occurrences.
    """
    return ranked(frequent_phrases(docs, longest, least), held_share, top)


def ranked(by_size: list[DataFrame], held_share: int = 50, top: int = 2000) -> DataFrame:
    """Tables of :func:`frequent_phrases` -> rows of :func:`collocations`."""
    total = by_size[0].where(F.col("phrase").isNull()).select("lang", "n")
    known = reduce(DataFrame.unionByName, (t.where(F.col("phrase").isNotNull()) for t in by_size))
    cand = reduce(DataFrame.unionByName, (t.withColumn("size", F.lit(k)) for k, t in enumerate(by_size[1:], 2))).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    score = F.expr("{a} * {a} * 1000000BD div ({l} * {r})".format(**{c: f"cast({c} as decimal(16, 0))" for c in "alr"}))
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    inside = cand.where("size > 2").select("lang", F.explode(F.array(part(F.lit(2), F.col("size") - 1), part(F.lit(1), F.col("size") - 1))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held_share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top).drop("_salt", "rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # at most SALTS * top rows a language
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
