"""Toxicity by class-conditional Kneser-Ney models (operator 7).

A text is lower-cased, everything but letters and digits becomes one space, and each
class has a Kneser-Ney model of its bytes in contexts of up to four bytes, across word
ends: expressions are runs of five bytes. Order 5 has the class's counts, orders 4 and 3
its continuation counts (in how many different contexts of the class an expression
stands), and both classes back off to one order-2 model of continuation counts over all
documents, labelled or not. What absolute discounting takes from rare expressions goes to the shorter
ones, so at every context the probabilities of a class add up to 1. A text's toxic and
ordinary log-likelihoods are compared per byte, and a logistic curve makes a
probability of the difference.

Labels enter only through the fit: a bounded sample of labelled rows of each class
(``per_class`` rows, chosen by a hash of the id, and of those at most ``most_bytes`` of text), the held-out
fold left out. Only the sample's expression counts come to the driver; there are no more of them than
``most_bytes`` a class. The curve is fitted on log-likelihoods of rows by models that did
not count them (``folds`` parts of the sample).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.llm.words import pieces
from terrachron.plans.tables import drop, written

#: Digits, a-z and bytes of other scripts stay; all else separates words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of an expression; orders up to SHARED are common to both classes; parts of a natural logarithm that scores are added up in.
ORDER, SHARED, UNIT = 5, 2, 1e6
#: A text of fewer bytes is compared as if it had so many: a word or two are little evidence.
LEAST = 64
_AT_ONCE = 1 << 19
#: Rows that are read at once, and expressions whose values a worker keeps.
_ROWS, _KEPT = 200, 500_000


def normal(raw: bytes | None) -> bytes:
    """Words in lower case with one space between; bytes that aren't UTF-8 are read as U+FFFD."""
    lower = (raw or b"").decode("utf-8", "replace").lower().encode().translate(TABLE)
    return b" ".join(filter(None, (b" ".join(p.split()) for p in pieces(lower, b" "))))


def blocks(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Normal texts -> (expressions as numbers, text numbers, first, past last) of about half a MB each.

    A text is read with four spaces before it and one after it; a longer one comes in
    several stretches, each with the four bytes before it, so every byte is counted once.
    """
    held, rows, size = [], [], 0

    def flush() -> tuple:
        a = np.frombuffer(b"".join(held), np.uint8)
        g = np.zeros(max(len(a) - ORDER + 1, 0), np.int64)
        for k in range(ORDER):
            g = g << 8 | a[k : k + len(g)]
        ends = np.cumsum([len(h) for h in held])
        return g, np.array(rows), np.concatenate([[0], ends[:-1]]), ends - ORDER + 1

    for row, text in enumerate(texts):
        padded = b" " * (ORDER - 1) + text + b" "
        for start in range(0, len(padded) - ORDER + 1, _AT_ONCE):
            held.append(padded[start : start + _AT_ONCE + ORDER - 1])
            rows.append(row)
            size += len(held[-1])
            if size >= _AT_ONCE:
                yield flush()
                held, rows, size = [], [], 0
    if held:
        yield flush()


def _level(keys: np.ndarray, counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expressions of one order with their counts -> (expressions, discounted shares, contexts, masses that the contexts hand down)."""
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    total = np.bincount(at, counts, len(contexts))
    return keys, np.maximum(counts - discount, 0) / total[at], contexts, np.bincount(at, np.minimum(counts, discount), len(contexts)) / total


def shared_table(trigrams: np.ndarray, discount: float) -> np.ndarray:
    """Distinct runs of three bytes in all documents -> the order-2 model, dense: 65,536 probabilities of a byte after a byte."""
    pairs, n = np.unique(trigrams & 0xFFFF, return_counts=True)
    single, m = np.unique(pairs & 0xFF, return_counts=True)
    low = np.full(256, 1 / 256)
    if len(pairs):
        low *= np.minimum(m, discount).sum() / m.sum()
        low[single] += np.maximum(m - discount, 0) / m.sum()
    table = np.tile(low, (256, 1))
    keys, share, contexts, mass = _level(pairs, n.astype(float), discount)
    table[contexts] *= mass[:, None]
    table.reshape(-1)[keys] += share
    return table.reshape(-1)


def class_levels(keys: np.ndarray, counts: np.ndarray, discount: float) -> list[tuple]:
    """Counted expressions of a class -> its levels from order SHARED + 1 up to ORDER."""
    levels = []
    for order in range(ORDER, SHARED, -1):
        levels.append(_level(keys, counts, discount))
        keys, n = np.unique(keys & (1 << 8 * (order - 1)) - 1, return_counts=True)
        counts = n.astype(float)
    return levels[::-1]


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), missing)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


@dataclass
class Model:
    """What the executors need: the shared table, both classes' levels, and the curve (intercept, slope)."""

    shared: np.ndarray = field(default_factory=lambda: np.full(1 << 16, 1 / 256))
    classes: tuple[list, list] = ([], [])
    curve: tuple[float, float] = (-20.0, 0.0)
    empty: float = 0.0

    def probability(self, asked: np.ndarray, label: int) -> np.ndarray:
        """Of each expression's last byte after its first four, under a class."""
        p = self.shared[asked & 0xFFFF]
        for order, (keys, share, contexts, mass) in enumerate(self.classes[label], SHARED + 1):
            q = asked & (1 << 8 * order) - 1
            p = _find(keys, share, q, 0.0) + _find(contexts, mass, q >> 8, 1.0) * p
        return p

    def values(self, kinds: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of distinct sorted expressions in whole parts; those met before are remembered."""
        keys, known = self.__dict__.get("_memo", (np.empty(0, np.int64), np.empty(0, np.int64)))
        at = np.minimum(np.searchsorted(keys, kinds), max(len(keys) - 1, 0))
        new = kinds[keys[at] != kinds] if len(keys) else kinds
        if len(new):
            fresh = np.rint((np.log(self.probability(new, 1)) - np.log(self.probability(new, 0))) * UNIT).astype(np.int64)
            if len(keys) + len(new) > _KEPT:  # start again from what this block needs
                held = np.isin(keys, kinds)
                keys, known = keys[held], known[held]
            keys, known = np.concatenate([keys, new]), np.concatenate([known, fresh])
            order = np.argsort(keys)
            self.__dict__["_memo"] = keys, known = keys[order], known[order]
        return known[np.searchsorted(keys, kinds)]

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of normal texts, per byte. Sums are of whole numbers, so equal texts have equal results."""
        total, n = np.zeros(len(texts), np.int64), np.array([len(t) + 1 for t in texts])
        for grams, rows, lo, hi in blocks(texts):
            kinds, at = np.unique(grams, return_inverse=True)
            sums = np.concatenate([[0], np.cumsum(self.values(kinds)[at])])
            np.add.at(total, rows, sums[hi] - sums[lo])
        return total / UNIT / np.maximum(n, LEAST)

    def scores(self, raw: pa.Array) -> np.ndarray:
        texts = [normal(t.as_py()) for t in raw]
        z = self.curve[0] + self.curve[1] * self.differences(texts)
        return np.where([len(t) > 0 for t in texts], 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.empty)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that a worker holds few texts in several forms."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text, part) -> (gram, part, n)."""
    for b in batches:
        part = np.array(b.column(1))
        for grams, rows, lo, hi in blocks(map(normal, (t.as_py() for t in b.column(0)))):
            for p in np.unique(part[rows]):
                own = np.concatenate([grams[x:y] for x, y, r in zip(lo, hi, rows, strict=True) if part[r] == p])
                keys, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), p, np.int32)), pa.array(n)], ["gram", "part", "n"])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text) -> the distinct runs of three bytes, once a task (16 MB of marks)."""
    seen = np.zeros(1 << 24, bool)
    for b in _slices(batches):
        for grams, _, lo, hi in blocks(map(normal, (t.as_py() for t in b.column(0)))):
            inside = np.zeros(len(grams) + 1, np.int8)
            np.add.at(inside, lo, 1)
            np.add.at(inside, hi, -1)
            seen[grams[np.cumsum(inside[:-1]) > 0] & 0xFFFFFF] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["gram"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge."""
    scale = max(np.abs(x).max(initial=0.0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    b, ridge = np.zeros(2), np.array([1e-6, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (y - p)) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1] / scale)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int, folds: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(written table text, label, fold; labelled rows by class)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    share = dict(known.groupBy("label").count().collect())
    if set(share) != {0, 1}:
        return None, share
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # broadcast: at most 2 * per_class rows of two numbers
    own = _texts(docs).join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    own = own.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("h", F.xxhash64("text"))
    by = Window.partitionBy("label").orderBy(F.greatest("size", F.lit(most_bytes // 16)), "h", "text")  # at most per_class rows; very long texts last
    own = own.withColumn("to", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("to") <= most_bytes)
    return written(own.select("text", "label", F.pmod("h", F.lit(folds)).cast("int").alias("fold")), "toxicity-fit"), share


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, most_bytes: int = 16 << 20, discount: float = 0.75, folds: int = 3) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic) -> Model.

    Labels other than 0 and 1 and null ids are no labels; of several labels of a
    doc_id, or of equal texts, the larger holds. Equal texts count once, null texts and
    texts without words say nothing. Without labelled rows of both classes every score is close to 0.
    """
    own, share = _sample(docs, labels, per_class, most_bytes, folds)
    n = dict(own.groupBy("label").count().collect()) if own is not None else {}
    if set(n) != {0, 1}:
        return Model()
    everywhere = _texts(docs).select("text").mapInArrow(_trigrams, "gram long").distinct().toArrow()["gram"].to_numpy()  # at most 165^3 rows
    shared = shared_table(everywhere, discount)
    cells = own.select("text", (F.col("label") * folds + F.col("fold")).alias("part")).mapInArrow(_counts, "gram long, part int, n long").groupBy("gram", "part").agg(F.sum("n").alias("n")).toArrow()
    grams, parts, times = (cells[c].to_numpy() for c in ("gram", "part", "n"))

    def model(left_out: int | None) -> Model:
        both = []
        for c in (0, 1):
            used = (parts // folds == c) & (parts % folds != (-1 if left_out is None else left_out))
            keys, at = np.unique(grams[used], return_inverse=True)
            both.append(class_levels(keys, np.bincount(at, times[used], len(keys)), discount))
        return Model(shared, tuple(both))

    def apart(fold: int) -> pa.Table:
        """(x, label) of one fold's rows by the model of the others: at most 2 * per_class rows in all."""
        sent = docs.sparkSession.sparkContext.broadcast(model(fold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.differences([normal(t.as_py()) for t in b.column(0)])), b.column(1)], ["x", "label"])

        out = own.where(F.col("fold") == fold).select("text", "label").mapInArrow(run, "x double, label int").toArrow()
        sent.destroy()
        return out

    seen = pa.concat_tables([apart(f) for f in range(folds)])
    out = model(None)
    del grams, parts, times, cells
    pa.default_memory_pool().release_unused()
    y = seen["label"].to_numpy().astype(float)
    # between the labelled shares and equal shares: a missed toxic text costs more than its rarity says, a wrong label not as much
    weight = np.where(y == 1, share[1] ** 0.5 / n[1], share[0] ** 0.5 / n[0])
    out.curve = logistic(seen["x"].to_numpy(), y, weight / weight.mean())
    out.empty = min(share[1] / (share[0] + share[1]), 0.49)
    drop(own)
    return out


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id, held_out, score, predicted, from its whole text.

    Null and empty texts, and texts without words, score as the labelled share of toxic
    rows (under 0.5). The score depends on the text alone, so equal texts and repeated rows have equal
    scores. Bytes that are not UTF-8 are read as U+FFFD. Other columns are ignored, no rows give no rows. The
    model is broadcast; it grows with the fit's sample alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1)))], ["doc_id", "score"])

    scored = _texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names, with a score under 0.5.

    Rows with a null or empty text stay; repeated rows all stay or all go; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array(sent.value.scores(b.column(at).cast(pa.binary())) < 0.5))

    return docs.mapInArrow(run, docs.schema)
