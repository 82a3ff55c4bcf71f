"""MinHash near duplicates by bottom-k sketches (operator 8).

One hash function orders the shingles; a document's sketch is the k smallest
values of its set. Steps, each a DataFrame job:

1. One Arrow pass gives every row its set size, a 128-bit fingerprint of the whole
   set and its sketch. Rows with equal sets form one class; only its first row goes on.
2. Inverted lists over retained values. Two sets with a Jaccard of 0.75 share about
   three quarters of the k smallest values of their union, and each shared one of
   those lies in both sketches; a share far below that has a chance under 1e-11. So a
   document is listed only under its rarest values, as many as it takes to meet every
   document that shares enough with it: values of passages that many documents share
   are seldom listed. Lists with the same members count once.
3. Short lists become pairs. Documents in longer lists are indexed again by up to 1024
   values, where the bound is much closer: documents that merely share a passage no
   longer meet. What is left are groups of near copies. Every member's exact overlap
   with one hub of its list is taken, a linear number of pairs. Once components are
   known, only members outside a list's largest component meet members of other
   components, and only where their overlaps with the hub still allow a link. No pair
   that could join two components is left out, so components are complete.
4. The union-sketch estimate drops pairs; the rest is verified on full sets, which are
   built again from the texts of the documents concerned.

Which way a list takes, by its length (``SHORT``), changes the cost and never the result.
Rows of a value or list that very many documents share don't meet in one task: facts
about such keys are broadcast (there are few, as each takes a fixed share of all rows), and the
pairs of such a list are dealt by salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.words import WordHashes, shingle_set, word_hashes
from terrachron.plans.components import components
from terrachron.plans.tables import drop, written

#: Retained values, and the share of them below which the union estimate rules a pair out.
SKETCH, FLOOR_SHARE = 96, 0.40625
#: Values that are indexed, the share of them that linked documents have in common, and the longest list whose pairs are all taken.
INDEXED, INDEX_SHARE, SHORT = 64, 0.3125, 16
#: The same for documents that stand in longer lists.
WIDE, WIDE_SHARE = 1024, 0.65
#: A key is hot from this part of all rows on, so there are at most so many hot keys; and the rows of a list in one salt bucket.
HOT_PART, SALTED = 4096, 512


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sets(column: pa.Array, memo: WordHashes, size: int) -> Iterator[np.ndarray]:
    for data in column:
        raw = data.as_py()
        yield shingle_set(word_hashes(raw.lower() if raw else b"", memo), size)


def _pass(size: int, k: int | None, at_once: int = 500):
    """Arrow batches (uid, doc_id, text, text_hash) -> (uid, doc_id, text_hash, n, fp, values); values: the sketch, or the whole set if k is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                b = whole.slice(start, at_once)
                sets = list(_sets(b.column(2), memo, size))
                fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), _lists(sets if k is None else [s[:k] for s in sets])],
                    ["uid", "doc_id", "text_hash", "n", "fp", "values"],
                )

    return run


_SCHEMA = "uid long, doc_id long, text_hash long, n long, fp binary, values array<long>"


def _least_overlap(k: int, share: float):
    """Of its k smallest values, those that a document must share with any document linked to it.

    Where a document and all that can be linked to it have at most k values, exactly
    three quarters of its set; else ``share`` of k, which holds but for one pair in 10^11.
    """
    n = F.col("n")
    return F.greatest(F.lit(1), F.when(n <= F.floor(F.lit(k) * 0.75), F.ceil(n * 0.75)).otherwise(F.floor(F.least(n, F.lit(k)) * F.lit(share))))


def _met(rows: DataFrame, facts: DataFrame, hot: int | None) -> DataFrame:
    """rows (v, df, ...) with facts (v, df, ...; one row a value): an equi-join in which values with a df over ``hot`` (None: there are none) are broadcast."""
    if hot is None:
        return rows.join(facts.drop("df"), "v")
    cold = rows.where(F.col("df") <= hot).join(facts.where(F.col("df") <= hot).drop("df"), "v")
    return cold.unionByName(rows.where(F.col("df") > hot).join(F.broadcast(facts.where(F.col("df") > hot).drop("df")), "v"))


def _lists_of(rows: DataFrame, k: int, share: float) -> tuple[DataFrame, int | None]:
    """(uid, n, values) -> (v, df, uid, n, own, all), and the df from which a value is hot (None where no value is).

    Each document stands under its rarest retained values; lists of one member and
    repeated lists go. ``df``: documents that retain v; ``own``: retained values that no
    other document retains; ``all``: members of the list.
    """
    post = rows.select("uid", "n", F.explode(F.slice("values", 1, k)).alias("v"))
    shared = written(post.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "neardup-df")
    total, most = (x or 0 for x in shared.agg(F.sum("df"), F.max("df")).first())
    hot = max(SALTED, total // HOT_PART)
    hot = hot if most > hot else None
    if hot is None:
        met = post.join(shared, "v")
    else:
        often = F.broadcast(shared.where(F.col("df") > hot))  # at most HOT_PART rows
        met = post.join(often, "v").unionByName(post.join(often, "v", "left_anti").join(shared.where(F.col("df") <= hot), "v"))
    per = Window.partitionBy("uid")
    met = met.withColumn("rank", F.row_number().over(per.orderBy("df", "v"))).withColumn("met", F.count("*").over(per))
    lists = written(met.where(F.col("rank") <= F.col("met") - _least_overlap(k, share) + 1).select("v", "df", "uid", "n", (F.least("n", F.lit(k)) - F.col("met")).alias("own")), "neardup-lists")
    same = lists.groupBy("v").agg(F.first("df").alias("df"), F.count("*").alias("all"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y")).where("all > 1")
    same = same.groupBy("all", "x", "y").agg(F.min(F.struct("v", "df")).alias("v")).select("v.*", "all")
    return _met(lists, same, hot), hot


def _sized(na: str, nb: str, share: tuple[int, int]):
    return (F.col(na) * share[1] >= F.col(nb) * share[0]) & (F.col(nb) * share[1] >= F.col(na) * share[0])


def _full_sets(ends: DataFrame, docs: DataFrame, size: int, tag: str) -> DataFrame:
    """ends (uid, doc_id, fp) -> written (uid, n, values): whole sets, built again from the texts concerned."""
    zero = F.lit(0).cast("long")
    texts = docs.join(ends.select("doc_id").distinct(), "doc_id", "left_semi").select(zero.alias("uid"), "doc_id", "text", zero.alias("text_hash"))
    full = texts.mapInArrow(_pass(size, None), _SCHEMA).drop("uid", "text_hash").join(ends, ["doc_id", "fp"])
    return written(full.select("uid", "n", "values"), tag)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b; a written table) with the values of both ends, sa and sb, from ``sets`` (uid, values).

    An end a that very many pairs have is dealt: its pairs by a salt, its set once for each salt.
    """
    of = lambda c: sets.select(F.col("uid").alias(c), F.col("values").alias(f"s{c}"))
    total, most = (x or 0 for x in pairs.groupBy("a").agg(F.count("*").alias("c")).agg(F.sum("c"), F.max("c")).first())
    hot = max(SALTED, total // HOT_PART)
    if most <= hot:
        return pairs.join(of("a"), "a").join(of("b"), "b")
    often = pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("a", (F.floor(F.col("c") / hot) + 1).alias("salts"))
    often = F.broadcast(often)  # at most HOT_PART rows
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = pairs.join(often, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("salts")
    left = of("a").join(often, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return dealt.join(left, ["a", "salt"]).drop("salt").join(of("b"), "b")


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Written pairs (a, b) -> (a, b, i, na, nb): exact sizes of intersections of whole sets."""
    return _with_sets(pairs, full).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb"))


def _enough(i, na, nb, share: tuple[int, int]):
    return i * share[1] >= (na + nb - i) * share[0]


def _linked(pairs: DataFrame, sketches: DataFrame, k: int, share: tuple[int, int], full_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have 100 * intersection >= 75 * union (``share``); ``full_of`` gives the whole sets of their ends."""
    p = _with_sets(pairs, sketches.select("uid", F.slice("values", 1, k).alias("values")))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    p = written(p.where(both >= F.floor(F.size(union) * F.lit(FLOOR_SHARE))).select("a", "b"), "neardup-pairs")
    out = written(_overlaps(p, full_of(p)).where(_enough(F.col("i"), F.col("na"), F.col("nb"), share)).select("a", "b").distinct(), "neardup-links")
    drop(p)
    return out


def _open(lists: DataFrame, hot: int | None) -> DataFrame:
    """Of written lists with each member's component so far, those that don't lie in one component."""
    open_ = lists.groupBy("v").agg(F.first("df").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("v", "df")
    return _met(lists, open_, hot)


def near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (75, 100), k: int = SKETCH) -> DataFrame:
    """(doc_id long, text string, ...) -> doc_id, n_shingles, component_id, kept, text_hash: one row per input row.

    Words are split at ASCII white space after lower-casing A-Z. Texts that are null
    or without words have an empty set and no link; fewer than ``size`` words form one
    shingle. Rows with equal sets belong together; component_id is the smallest doc_id
    reachable over links. Repeated rows and repeated doc_ids are allowed: every row gets
    its own result. A null doc_id takes part in no link (component_id null, kept true).
    Further columns are ignored, whatever their names. No rows give no rows. Texts are
    read as bytes, so they need not be valid UTF-8. ``text_hash`` is xxhash64 of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sketched = written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_pass(size, k), _SCHEMA), "neardup-sketched")
    rows = written(sketched.select("uid", "doc_id", "text_hash", "n", "fp"), "neardup-rows")
    classes = written(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("uid").alias("lead")), "neardup-classes")
    leads = written(sketched.select("uid", "n", "values").join(classes.select(F.col("lead").alias("uid")), "uid", "left_semi"), "neardup-leads")
    drop(sketched)

    lists = written(_lists_of(leads, INDEXED, INDEX_SHARE)[0], "neardup-lists")
    few = lists.where(F.col("all") <= SHORT)
    pairs = few.select("v", F.col("uid").alias("a"), F.col("n").alias("na")).join(few.select("v", F.col("uid").alias("b"), F.col("n").alias("nb")), "v")
    pairs = written(pairs.where((F.col("a") < F.col("b")) & _sized("na", "nb", share)).select("a", "b").distinct(), "neardup-cand")
    made = []

    def full_of(p: DataFrame) -> DataFrame:
        ends = written(p.select(F.col("a").alias("uid")).union(p.select("b")).distinct().join(rows.select("uid", "doc_id", "fp"), "uid"), "neardup-ends")
        made.append(_full_sets(ends, docs, size, "neardup-sets"))
        return made[0]

    links, tested = _linked(pairs, leads, k, share, full_of), pairs
    drop(made[0])

    wide = lists.where(F.col("all") > SHORT).select("uid").distinct().join(rows.select("uid", "doc_id", "fp"), "uid")
    full = _full_sets(written(wide, "neardup-wide"), docs, size, "neardup-full")
    full = full.dropDuplicates(["uid"])
    lists, hot = _lists_of(full, WIDE, WIDE_SHARE)
    lists = written(lists, "neardup-lists")
    # the hub of a list: the member with the smallest part of its own
    hubs = lists.groupBy("v").agg(F.first("df").alias("df"), F.min_by(F.struct(F.col("uid").alias("hub"), F.col("n").alias("hub_n")), F.struct(F.col("own") / F.col("n"), F.xxhash64("uid"))).alias("h")).select("v", "df", "h.*")
    lists = written(_met(lists, hubs, hot), "neardup-hubs")
    rays = written(lists.select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), "neardup-rays")
    star = written(_overlaps(rays, full), "neardup-star")
    drop(rays)
    links = links.union(star.where((F.col("a") != F.col("b")) & _enough(F.col("i"), F.col("na"), F.col("nb"), share)).select("a", "b"))

    # each step that reads its rows twice or oftener reads a written table: one plan of all of them would be several hundred operators in the driver
    labels = components(links, "neardup-cc").select(F.col("node").alias("uid"), "label")
    labelled = written(lists.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid")), "neardup-labelled")
    drop(lists)
    at = _open(labelled, hot).join(star.select(F.col("a").alias("hub"), F.col("b").alias("uid"), "i"), ["hub", "uid"])
    # a value that the hub has but doesn't retain may seem a member's own
    rest = written(at.select("v", "df", "all", "uid", "label", "n", "i", F.when(F.col("hub_n") <= WIDE, F.col("own")).otherwise(0).alias("own")), "neardup-at")
    drop(labelled)
    main = rest.groupBy("v", "label").agg(F.first("df").alias("df"), F.count("*").alias("c")).groupBy("v").agg(F.first("df").alias("df"), F.max_by("label", F.struct("c", "label")).alias("main"))
    mains = written(_met(rest, main, hot), "neardup-mains")
    # a pair is taken in the first of the lists that both stand in
    at = written(mains.join(mains.groupBy("uid").agg(F.array_sort(F.collect_set("v")).alias("vs")), "uid"), "neardup-open")
    drop(rest)
    drop(mains)
    # what two members have in common lies in the hub or outside it; outside, what is a member's own isn't shared with one that retains its whole set
    salts = F.floor(F.col("all") / SALTED) + 1
    side = lambda p, salt: at.select("v", "main", salt.alias("salt"), *[F.col(c).alias(p + c) for c in ("uid", "label", "n", "i", "own", "vs")])
    out_of = lambda p, q: F.col(p + "n") - F.col(p + "i") - F.when(F.col(q + "n") <= WIDE, F.col(p + "own")).otherwise(0)
    most = F.least("x_i", "y_i") + F.least(out_of("x_", "y_"), out_of("y_", "x_"))
    first = F.array_min(F.array_intersect("x_vs", "y_vs")) == F.col("v")
    cross = (F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("y_main")) | (F.col("x_uid") < F.col("y_uid")))
    outside = side("x_", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).where(F.col("x_label") != F.col("main")).drop("main")
    pairs = outside.join(side("y_", F.pmod(F.xxhash64("uid"), salts)).withColumnRenamed("main", "y_main"), ["v", "salt"]).where(cross & _sized("x_n", "y_n", share) & _enough(most, F.col("x_n"), F.col("y_n"), share) & first)
    pairs = pairs.select(F.least("x_uid", "y_uid").alias("a"), F.greatest("x_uid", "y_uid").alias("b")).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "neardup-cand")
    links = written(links.union(_linked(pairs, full, k, share, lambda _: full)), "neardup-all-links")
    out = rows.join(classes, "fp", "left")
    labels = components(links, "neardup-cc").withColumnRenamed("node", "lead").join(classes.select("lead", "rep"), "lead")
    least = labels.groupBy("label").agg(F.min("rep").alias("low"))
    out = out.join(labels.select("lead", "label").join(least, "label").select("lead", "low"), "lead", "left")
    low = F.coalesce("low", "rep")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), low).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")
