"""SentencePiece encoding and decoding through tables of distinct chunks (operator 11).

A text is marked as the library marks it: one marker before it and one for every space.
No piece of the model has a marker after another character, so no merge crosses a space
between two visible characters, and a text's ids are those of its chunks (the marked words
between such spaces) one after the other. Texts come in slices of some MB; a slice's chunks make one table
of distinct ones, of which those not met before are segmented, each once, and ids are put back
by position. A worker remembers a bounded number of chunks from slice to slice; when that is full
it starts again, which costs time and changes no id. A corpus-wide table would have to be joined with
every word of every text, a shuffle of several times the corpus (README).

The texts of a model whose pieces cross markers, or that rewrites texts, are one chunk each.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: U+2581: the marker of the library's models.
MARK = "▁"
#: Chunks that a worker remembers, and characters of the longest of them: some 60 MB.
KEEP, LONGEST = 300_000, 64
#: Characters of a block of a very long text, and bytes of text in a slice.
BLOCK, AT_ONCE = 1 << 20, 4 << 20
#: A space where no token starts earlier and goes on: not beside other white space, nor behind a marker that is part of the text.
_CUT = re.compile(f"(?<=[^\\s{MARK}]) (?=\\S)")


def blocks(text: str, size: int | None = None) -> Iterator[str]:
    """``text`` in blocks of about ``size`` characters; the spaces at which it was cut are left out, as each block stands behind a marker."""
    start, size = 0, size or BLOCK
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def chunks(text: str) -> list[str]:
    """The marked words of a block, without their first markers; an empty block has none."""
    return _CUT.split(text) if text else []


class Table:
    """What is known of the distinct chunks of a slice; ``made`` works out those that aren't remembered."""

    def __init__(self) -> None:
        self.kept: dict[str, object] = {}

    def made(self, new: list[str]) -> list:
        raise NotImplementedError

    def rows(self, parts: list[list[str]]) -> list[list]:
        """For each list of chunks their values by position."""
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(parts)) if w not in self.kept]
        self.kept.update(zip(new, self.made(new), strict=True))
        out = [list(map(self.kept.__getitem__, p)) for p in parts]
        if len(self.kept) > KEEP:
            self.kept.clear()
        for w in new:
            if len(w) > LONGEST:
                self.kept.pop(w, None)
        return out


class Pieces(Table):
    """Chunk -> bytes of its ids (unsigned, 32 bits, little-endian)."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        own = [p for i, p in enumerate(self.names) if not sp.is_control(i) and not sp.is_unknown(i)]
        odd = " ﬁ  é\t　 x "
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in own) and self.names[sp.encode("a")[0]].startswith(MARK) and sp.decode(sp.encode(odd)) == odd

    def made(self, new: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self.sp.encode(new, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, without begin and end."""
        if not self.splits:
            return self.made(texts)
        if len(texts) == 1:
            return [b"".join(self._block([b])[0] for b in blocks(texts[0]))]
        return self._block(texts)

    def _block(self, texts: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self.rows([chunks(t) for t in texts])]


@functools.lru_cache(1)
def load(model: str) -> Pieces:
    """One for each worker, which later tasks use again."""
    return Pieces(model)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a binary column, a row at least."""
    for b in batches:
        sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in b.column(column)], np.int64)
        start, held = 0, 0
        for k, size in enumerate(sizes):
            if k > start and held + size > most:
                yield b.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < b.num_rows:
            yield b.slice(start)


def readable(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids: the text's ids with begin and end, four bytes each, little-endian.

    Null text is empty: begin and end alone. Bytes that aren't UTF-8 are read as U+FFFD. Very long
    texts are segmented in blocks. Repeated rows and null ids have rows of their own, further
    columns are ignored, whatever their names; no rows give no rows. There are no ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        first, last = (np.array([i], "<u4").tobytes() for i in (table.sp.bos_id(), table.sp.eos_id()))
        for b in slices(batches, 1):
            ids = pa.array([first + ids + last for ids in table.encode([readable(t.as_py()) for t in b.column(1)])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids as :func:`encoded` makes them) -> doc_id, ids, text, by the library's decode; null ids are none, and have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model).sp
        for b in slices(batches, 1):
            told = [sp.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(rows: DataFrame) -> DataFrame:
    """Rows of :func:`decoded` -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
