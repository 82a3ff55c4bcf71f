"""The pipeline's rows, stage by stage, against plain-Python versions of the five decisions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from test_text_operators import brute_components, brute_contamination
from tokenizers import Tokenizer

from terrachron.llm import queries, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, uid string, _gone long"


def fixture_rows():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu", "ne", "sor") for b in ("da", "fi", "gul", "hem", "ja") for c in ("n", "rt", "x", "ve", "s")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bad = ["vileword", "nastyword", "grimword"]
    item = prose(25)
    rows, labels = [], []
    for i in range(260):
        words = prose(rng.randrange(8, 90)).split()
        if i % 4 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(i % 4 == 0)))
    base = prose(120)
    rows += [(300, base), (301, base), (302, base.upper()), (303, base + " one more"), (304, base.replace(base.split()[60], "other", 1))]
    rows += [(310, prose(10) + " " + item + " " + prose(4)), (311, " ".join(item.split()[7:17])), (312, " ".join(item.split()[:9]))]
    copied, own, key = "Copied0Example0Key1234567", "Own9Live8Secret7654321abc", "0123456789abcdef" * 2
    rows += [(320 + k, f"{prose(30)} {copied} {prose(3)}") for k in range(6)]
    rows += [(330, f"{prose(20)} {own} {prose(9)}"), (331, f"é password={key}, {key} tokens: short"), (332, "AKIA" + "B7" * 9 + " secret='abcdef'")]
    rows += [(340, None), (341, ""), (342, " \n "), (343, "one"), (None, "no id at all here today"), (None, None), (344, "twice in a row"), (344, "twice in a row"), (345, prose(6000)), (346, "<|endoftext|> inside")]
    docs = [(i, t, ("en", "de")[(i or 0) % 2], f"s{(i or 0) % 5}" if i != 340 else None, len(t or ""), "u", 7) for i, t in rows]
    return docs, labels, [(1, item), (2, None), (3, "!")]


def told(text):
    return b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower().encode()))


def runs(text, n=5):
    padded = b" " * (n - 1) + told(text) + b" "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Plain:
    """Kneser-Ney by its definition: counts of order 5, continuation counts below, two shared orders."""

    def __init__(self, texts, everywhere, discount=0.75):
        top, at = Counter(g for t in texts for g in runs(t)), {}
        for n in (5, 4, 3):
            at[n] = top
            top = Counter(g[1:] for g in top)
        low = {g[-3:] for t in everywhere for g in runs(t)}
        for n in (2, 1):
            low = Counter(g[1:] for g in low)
            at[n] = low
        self.discount, self.at, self.totals = discount, at, {}
        for n, counts in at.items():
            self.totals[n] = defaultdict(lambda: [0, 0])
            for g, c in counts.items():
                own = self.totals[n][g[:-1]]
                own[0] += c
                own[1] += min(c, discount)

    def probability(self, g):
        if not g:
            return 1 / 256
        lower = self.probability(g[1:])
        total, handed = self.totals[len(g)].get(g[:-1], (0, 0))
        return (max(self.at[len(g)][g] - self.discount, 0) + handed * lower) / total if total else lower


def brute_scores(docs, labels, folds=3):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = {i: toxic for i, _, toxic in labels if fold(i)}
    texts = {}
    for i, t, *_ in docs:
        if i in known:
            texts[t] = max(texts.get(t, 0), known[i])
    share, everywhere = Counter(known.values()), [t for _, t, *_ in docs]
    part = {t: (xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)) % folds for t in texts}

    def differences(own):
        m = [Plain([t for t, c in own.items() if c == k], everywhere) for k in (0, 1)]
        return lambda t: sum(round((math.log(m[1].probability(g)) - math.log(m[0].probability(g))) * 1e6) for g in runs(t)) / 1e6 / max(len(runs(t)), 64)

    apart = [differences({t: c for t, c in texts.items() if part[t] != f}) for f in range(folds)]
    y = np.array(list(texts.values()), float)
    weight = np.where(y == 1, share[1] ** 0.5 / y.sum(), share[0] ** 0.5 / (len(y) - y.sum()))
    a, b = toxicity.logistic(np.array([apart[part[t]](t) for t in texts]), y, weight / weight.mean())
    of = differences(texts)
    return [1 / (1 + math.exp(-a - b * of(t))) if told(t) else share[1] / (share[0] + share[1]) for _, t, *_ in docs]


def brute_not_toxic(docs, labels):
    return [d for d, s in zip(docs, brute_scores(docs, labels), strict=True) if s < 0.5]


def brute_near_duplicates(docs):
    gone = {i for i, _, _, kept in brute_components([d[:2] for d in docs]) if not kept}
    return [d for d in docs if d[0] not in gone]


def brute_redacted(docs):
    kinds, holders, spans = secrets.BASE + secrets.FURTHER, defaultdict(set), []
    for d in docs:
        found = []
        for rank, (_, pattern, group, least) in enumerate(kinds):
            found += [(m.start(), m.end(), rank, m[group]) for m in re.finditer(pattern, d[1] or "", re.ASCII) if len(m[group]) >= least]
        spans.append(found)
        for *_, value in found:
            holders[value].add((d[3] or "", f"{d[3] or ''}/{d[2] or ''}"))
    out = []
    for d, found in zip(docs, spans, strict=True):
        text, new, at = d[1], "", 0
        for start, end, rank, value in sorted(found):
            owners, repos = {o for o, _ in holders[value]}, {r for _, r in holders[value]}
            if rank < len(secrets.BASE) or (len(owners) <= 1 and len(repos) <= 4 and len(set(value)) >= 8 and re.search("[0-9]", value)):
                if start >= at:
                    new += text[at:start] + "[SECRET]"
                at = max(at, end)
        new = new + text[at:] if at else text
        out.append((d[0], new, *d[2:4], d[4] if new == text else len(new), *d[5:]))
    return out


def brute_pieces(docs, length=2048):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    out = []
    for d in docs:
        ids = np.array([*plain.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % length or length
        for k, (a, b) in enumerate([(0, first)] + [(s, s + length) for s in range(first, len(ids), length)]):
            out.append((d[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return out


def best_fit_sequences(lengths, capacity=2048):
    """How many sequences best-fit decreasing fills, piece by piece."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def kept(docs):
    return sorted(map(repr, docs))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels, items = fixture_rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, labels, items


def test_every_stage_equals_brute_force(spark, tables):
    sf, docs, labels, items = tables
    now = spark.read.parquet(f"{sf}/documents.parquet")
    brute = [
        lambda d: brute_not_toxic(d, labels),
        brute_near_duplicates,
        lambda d: [x for x in d if not brute_contamination(x[1], items)[1]],
        brute_redacted,
    ]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], brute, strict=True):
        before = docs
        docs = plain(docs)
        now = corpus_pipeline.written(stage(spark, now, sf), "test-stage")
        assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert kept(tuple(r) for r in now.collect()) == kept(docs), name
        assert kept(docs) != kept(before), name
    ids = {d[0] for d in docs}
    assert not ids & {0, 4, 8, 301, 302, 303, 310, 311} and {1, 2, 3, 300, 312, 320, 325, 330, 340, 341, 343, 344, 345, None} <= ids
    packed = corpus_pipeline.run(spark, sf).collect()
    assert kept((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == kept(brute_pieces(docs))
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = [0, *(a + b for a, b in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) == best_fit_sequences([r.length for r in packed])


def test_toxicity_scores_equal_the_definition(spark, tables):
    sf, docs, labels, _ = tables
    now = spark.read.parquet(f"{sf}/documents.parquet")
    got = toxicity.toxicity_scores(now, toxicity.fit(now, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((d[0], s) for d, s in zip(docs, brute_scores(docs, labels), strict=True)), key=key)
    got = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcde "), 60)) for _ in range(40)]
    keys, n = np.unique(np.concatenate([g for g, *_ in toxicity.blocks(texts)]), return_counts=True)
    model = toxicity.Model(toxicity.shared_table(np.unique(keys & 0xFFFFFF), 0.75), ([], toxicity.class_levels(keys, n.astype(float), 0.75)))
    for context in (b"abcd", b"zzab", b"e a ", b"zzzz"):
        assert math.isclose(model.probability(int.from_bytes(context, "big") * 256 + np.arange(256), 1).sum(), 1.0)


def test_long_texts_are_counted_once_in_stretches(monkeypatch):
    texts = [b"", b"abc def", b"x" * 41, b"the quick brown fox " * 9]
    whole = [np.concatenate([g[a:b] for g, r, lo, hi in toxicity.blocks(texts) for a, b, k in zip(lo, hi, r, strict=True) if k == i]).tolist() for i in range(4)]
    monkeypatch.setattr(toxicity, "_AT_ONCE", 10)
    assert whole == [np.concatenate([g[a:b] for g, r, lo, hi in toxicity.blocks(texts) for a, b, k in zip(lo, hi, r, strict=True) if k == i]).tolist() for i in range(4)]
    assert [len(w) for w in whole] == [len(t) + 1 for t in texts]


def test_empty_documents(spark, tables, tmp_path):
    sf, *_ = tables
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0
