"""Alignment of two tokenizers over the same bytes (operator 12).

Tokenizer A is a byte-level BPE over space + text, tokenizer B a SentencePiece model that puts its
own marker before the text. Every byte of the text gets a label: nothing ends here, a
token of A ends, a token of B ends, or both. A regular expression takes the label string
apart behind each both-label; how many ends of A and of B a span holds says which tokens are one group.

Neither tokenizer goes across a space between two visible characters, so a both-label stands before each,
and the texts of a slice are aligned by their distinct chunks (:mod:`piecewise`): the label string of all new chunks
is scanned once, and groups and links are put back by position.

A group's last tokens of A and B are a link. Of two linked tokens one is a suffix of the other,
so the pairs that can ever be linked are known from the vocabularies alone (about two hundred thousand,
whatever the corpus), each has a number, and the table of their counts is small enough to be broadcast.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.llm import piecewise
from terrachron.plans.tables import written

_NONE, _A, _B, _BOTH = b".AB*"
_GROUP = re.compile(rb"[^*]*\*")
_KINDS = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


class Pairs:
    """The pairs of tokens that can end together, numbered from 0 in order of (A, B)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        by_a, by_b = {t: i for i, t in enumerate(a) if t}, {}
        for i, t in enumerate(b):
            by_b.setdefault(t, []).append(i)
        self.width = len(b)
        ends = [(i, j) for i, t in enumerate(a) for k in range(len(t)) for j in by_b.get(t[k:], ())]
        ends += [(by_a[t[k:]], j) for j, t in enumerate(b) for k in range(1, len(t)) if t[k:] in by_a]
        self.keys = np.unique(np.array(ends, np.int64).reshape(-1, 2) @ np.array([self.width, 1]))

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b).astype("<u4")


class Aligned(piecewise.Table):
    """Chunk -> (tokens of A, tokens of B, groups, their text, links as pair numbers of four bytes), or None where the bytes differ."""

    def __init__(self, ranks: str, model: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.b = piecewise.load(model)
        sp = self.b.sp
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(piecewise.MARK, " ").encode() for i, n in enumerate(self.b.names)]
        self.a_size, self.b_size = (np.array(list(map(len, v))) for v in (self.a_bytes, self.b_bytes))
        # a token's id and what stands behind it: a comma inside a group, then a bar or a semicolon
        self.a_text = np.array([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))], object)

    @functools.cached_property
    def pairs(self) -> Pairs:
        control = [self.b.sp.is_control(i) or self.b.sp.is_unknown(i) for i in range(len(self.b_bytes))]
        return Pairs(self.a_bytes, [b"" if c else t for c, t in zip(control, self.b_bytes, strict=True)])

    def made(self, new: list[str]) -> list[tuple | None]:
        said = [b" " + w.encode() for w in new]
        a = list(map(self.a.encode_ordinary, (f" {w}" for w in new)))
        b = self.b.sp.encode(new, num_threads=1)
        same = [b"".join(map(self.b_bytes.__getitem__, y)) == s == b"".join(map(self.a_bytes.__getitem__, x)) for x, y, s in zip(a, b, said, strict=True)]
        rows = [k for k, ok in enumerate(same) if ok]
        found = iter(self._grouped([a[k] for k in rows], [b[k] for k in rows], [len(said[k]) for k in rows]))
        return [next(found) if ok else None for ok in same]

    def _grouped(self, a: list[list[int]], b: list[list[int]], sizes: list[int]) -> list[tuple]:
        """Chunks of the same bytes under both tokenizers: their label strings are one, and each ends in a both-label."""
        if not sizes:
            return []
        na, nb = np.array(list(map(len, a))), np.array(list(map(len, b)))
        ia, ib = (np.fromiter(itertools.chain.from_iterable(v), np.int64) for v in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[ia]) - 1, np.cumsum(self.b_size[ib]) - 1
        labels = np.full(sum(sizes), _NONE, np.uint8)
        labels[ends_a] = _A
        both = labels[ends_b] == _A
        labels[ends_b] = np.where(both, _BOTH, _B)
        spans = np.cumsum(np.fromiter(map(len, _GROUP.findall(labels.tobytes())), np.int64))  # past the both-label of each group
        is_a, is_b = (labels == _A) | (labels == _BOTH), (labels == _B) | (labels == _BOTH)
        to_a, to_b = np.cumsum(is_a)[spans - 1], np.cumsum(is_b)[spans - 1]  # tokens up to each group's end
        # ids in the order of the text: a group's tokens of A, then its tokens of B
        last_a, last_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        last_a[to_a - 1] = last_b[to_b - 1] = 1
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # group of each token
        text = np.empty(len(ia) + len(ib), object)
        text[np.arange(len(ia)) + np.concatenate([[0], to_b])[of_a]] = self.a_text[ia + last_a * len(self.a_bytes)]
        text[np.arange(len(ib)) + to_a[of_b]] = self.b_text[ib + last_b * len(self.b_bytes)]
        links = self.pairs.number(ia[to_a - 1], ib[to_b - 1])
        groups = np.searchsorted(spans, np.cumsum(sizes), "right")
        out, told, at, g = [], text.tolist(), 0, 0
        for x, y, end in zip(na.tolist(), nb.tolist(), groups.tolist(), strict=True):
            out.append((x, y, end - g, "".join(told[at : at + x + y]), links[g:end].tobytes()))
            at, g = at + x + y, end
        return out

    def align(self, texts: list[str]) -> list[tuple]:
        """For whole texts: tokens of A, tokens of B, groups, their text, links; zeros and empty where there are none or the bytes differ."""
        if len(texts) == 1:
            return [self._whole([v for b in piecewise.blocks(texts[0]) for v in self.rows([piecewise.chunks(b)])[0]])]
        return list(map(self._whole, self.rows([piecewise.chunks(t) for t in texts])))

    @staticmethod
    def _whole(parts: list[tuple | None]) -> tuple:
        if not parts or None in parts:
            return 0, 0, 0, "", b""
        a, b, n, text, links = zip(*parts, strict=True)
        return sum(a), sum(b), sum(n), "".join(text)[:-1], b"".join(links)


@functools.lru_cache(1)
def load(ranks: str, model: str, pattern: str) -> Aligned:
    """One for each worker, which later tasks use again."""
    return Aligned(ranks, model, pattern)


def aligned(docs: DataFrame, ranks: str, model: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), links (pair numbers, four bytes each).

    Null and empty texts, and those whose joined bytes differ between the tokenizers (a text that holds the marker itself),
    have zeros, an empty ``groups`` and no links. Bytes that aren't UTF-8 are read as U+FFFD; strings of special
    tokens are plain text. Very long texts are aligned in blocks. Repeated rows and null ids have rows of their own, further
    columns are ignored, whatever their names; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(ranks, model, pattern)
        for b in piecewise.slices(batches, 1, piecewise.AT_ONCE // 4):
            a, p, n, text, links = zip(*table.align([piecewise.readable(t.as_py()) for t in b.column(1)]), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(links, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return piecewise.texts(docs).mapInArrow(run, _KINDS)


def pair_counts(rows: DataFrame, ranks: str, model: str, pattern: str) -> DataFrame:
    """Rows with ``links`` -> pair, n: how many links of the corpus hold each pair; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(load(ranks, model, pattern).pairs), np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(n, np.frombuffer(x.as_buffer(), "<u4"), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(rows: DataFrame, ranks: str, model: str, pattern: str) -> DataFrame:
    """Written rows of :func:`aligned` -> the same with n_links, n_best, count_sum for ``links``.

    ``count_sum`` adds up the corpus-wide counts of a row's links; ``n_best`` counts the links whose count is
    the highest of their token of B, ties included. The counts of all possible pairs, of which the vocabularies allow
    so many and no more, come to the driver and go to every worker.
    """
    told = pair_counts(rows, ranks, model, pattern).toArrow()
    pairs = Aligned(ranks, model, pattern).pairs
    n, most = np.zeros(len(pairs), np.int64), np.zeros(pairs.width, np.int64)
    n[told["pair"].to_numpy()] = told["n"].to_numpy()
    of = pairs.keys % pairs.width
    np.maximum.at(most, of, n)
    sent = rows.sparkSession.sparkContext.broadcast((n, n == most[of]))
    kinds = [(c, t) for c, t in rows.dtypes if c != "links"]
    at = rows.columns.index("links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column(at)]
            more = [pa.array(v, pa.int64()) for v in ([len(x) for x in own], [int(best[x].sum()) for x in own], [int(count[x].sum()) for x in own])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c, _ in kinds), *more], [*(c for c, _ in kinds), "n_links", "n_best", "count_sum"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds) + ", n_links long, n_best long, count_sum long")


def alignment(docs: DataFrame, ranks: str, model: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (empty where there are no tokens), as :func:`aligned` says.

    Texts are tokenized once: counts, digests and links are written, and both passes over the links read that table.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    rows = written(aligned(docs, ranks, model, pattern).select("doc_id", "n_a", "n_b", "n_groups", digest, "links"), "alignment", "zstd")
    return scored(rows, ranks, model, pattern).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
