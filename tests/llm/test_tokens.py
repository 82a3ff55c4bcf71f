"""SentencePiece ids and tokenizer alignment against the libraries themselves, text by text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from terrachron.llm import alignment, piecewise, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, links int, groups string"
PARTS = ["a", "b", " ", " ", "  ", "▁", "é", "\n", "\t", "漢", "ﬁ", "the", " the", "\x00", "�", "xxxxx", "😀", "　", " ", "\x1c", "<|endoftext|>", "</s>", "'s", "123", "<0x41>", "\r\n", " ▁", "▁ x"]
SP = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(300)]
    return [None, "", " ", "▁", "same text twice", "same text twice", "long " * 3000 + "word" * 3000, *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None, None, None), (4, "same text twice", "en", "s", 0, "clash", 1, "x")], DOCS).repartition(3)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_pieces(spark, docs, monkeypatch):
    got = piecewise.digests(piecewise.decoded(piecewise.encoded(docs, queries.PIECES), queries.PIECES)).collect()
    want = []
    for r in docs.collect():
        ids = SP.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(SP.decode(ids).encode())))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert piecewise.encoded(docs.limit(0), queries.PIECES).count() == 0


def test_blocks_and_full_tables_change_no_id(monkeypatch):
    monkeypatch.setattr(piecewise, "BLOCK", 9)
    monkeypatch.setattr(piecewise, "KEEP", 3)
    table = piecewise.Pieces(queries.PIECES)
    for t in filter(None, texts()[3:]):
        assert table.encode([t])[0] == np.array(SP.encode(t), "<u4").tobytes() and len(table.kept) <= 3


def test_bytes_that_are_no_utf8(spark):
    odd = spark.sql("SELECT 1L doc_id, cast(X'61FF20622021' AS string) text")
    assert [r.text for r in piecewise.decoded(piecewise.encoded(odd, queries.PIECES), queries.PIECES).collect()] == ["a� b !"]


def brute(rows):
    """Contract of the alignment, straight from the libraries' tokens."""
    plain = Tokenizer.from_file(queries.TOKENIZER)
    plain.encode_special_tokens = True
    back = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in back.values())}
    out, count = [], Counter()
    for doc_id, text in rows:
        said = f" {text}".encode()
        a = plain.encode(f" {text or ''}", add_special_tokens=False)
        b = SP.encode(text or "")
        a_bytes = [bytes(back[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(SP.id_to_piece(i)[3:5], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != said or b"".join(b_bytes) != said:
            out.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes))
        links, groups, i, j = [], [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a.ids[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a.ids[k - 1], b[m - 1]))
            i, j = k, m
        count.update(links)
        out.append((doc_id, len(a.ids), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(d, a, b, len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha(g.encode()) if g else "") for d, a, b, x, g in out]


def test_alignment(spark, docs, monkeypatch):
    got = alignment.alignment(docs, queries.RANKS, queries.PIECES, public_tokenizers.PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_best < r.n_links for r in got) > 20
    assert alignment.alignment(docs.limit(0), queries.RANKS, queries.PIECES, public_tokenizers.PATTERN).count() == 0


def test_aligned_blocks(monkeypatch):
    table = alignment.load(queries.RANKS, queries.PIECES, public_tokenizers.PATTERN)
    all_ = [t for t in texts() if t]
    whole = table.align(all_)
    monkeypatch.setattr(piecewise, "BLOCK", 9)
    assert [table.align([t])[0] for t in all_] == whole


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, sf).collect())) == sorted(brute(rows))
    got = {r.doc_id: r for r in queries.op11_pieces(spark, sf).collect()}
    for d, t in rows:
        ids = SP.encode(t or "", add_bos=True, add_eos=True)
        assert tuple(got[d]) == (d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(SP.decode(ids).encode()))
