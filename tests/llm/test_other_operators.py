"""Media, packing, WARC, chat, sharding, URLs: round trips and plain-Python versions, with odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrachron.llm import chat, media, packing, queries, secrets, sharding, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, uid string, length string, shard string"


def test_images_round_trip():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (37, 21, 1), np.uint8), rng.integers(0, 256, (13, 7, 3), np.uint8)
    assert (media.read_netpbm(media.write_pgm(grey)) == grey).all() and (media.read_bmp(media.write_bmp(colour)) == colour).all()
    assert media.read_netpbm(b"P1 # c\n3 1\n1 0 1").ravel().tolist() == [0, 255, 0] and media.read_netpbm(b"P3 1 1 255 1 2 3").ravel().tolist() == [1, 2, 3]
    assert media.read_netpbm(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    for h, w in ((5, 4), (37, 21), (50, 60), (1, 1)):
        big = np.repeat(np.repeat(grey.astype(float), h, 0), w, 1)
        want = big.reshape(h, 37, w, 21, 1).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(grey, h, w), want)
    assert np.load(__import__("io").BytesIO(media.npy_tile(grey))).shape == grey.shape


@pytest.mark.parametrize("data", [b"", b"P5", b"P5\n99999999999999999999 1\n255\n", b"P5 99999 99999 255\n" + bytes(9), b"P2 1 1 255\n300", b"P2 2 1 9\n3", b"P5 0 4 255\n", b"P5 1 1 65535\n12", b"P1 3 1 1 0", b"P4 9 2\n\0", b"BM", b"BM" + bytes(60), media.write_bmp(np.zeros((9, 9, 3), np.uint8))[:-9], b"P3 1 1 255 1 2"])
def test_bad_images_are_told(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_samples_are_scaled_to_eight_bits():
    assert media.read_netpbm(b"P2 4 1 15\n0 5 10 15").ravel().tolist() == [0, 85, 170, 255]
    assert media.read_netpbm(b"P5 2 1 1\n\0\1").ravel().tolist() == [0, 255] and media.read_netpbm(b"P2 2 1 255 7 200").ravel().tolist() == [7, 200]


def test_texts_that_are_not_utf8(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, F.unhex(F.lit("6162FFC3282063"))).cast("string").alias("text"), F.lit("x").alias("url"), F.lit(7).alias("data"))
    raw = bytes.fromhex("6162FFC3282063")
    got = media.text_media(docs).collect()
    assert sorted((r.n_bytes, r.payload_sha256) for r in got)[1:] == [(7, hashlib.sha256(raw + bytes(57)).hexdigest())] * 2
    pieces = packing.token_pieces(docs, queries.TOKENIZER, queries.RANKS).collect()
    want = np.array(_ids().plain.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids + [0], "<u4")
    assert {(r.length, r.ids_crc32) for r in pieces if r.doc_id} == {(len(want), zlib.crc32(want.tobytes()))}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert sorted((r.payload_bytes, r.payload_digest) for r in warc.read_archives(warc.write_archives(warc.with_revisits(pages))).collect())[1:] == [(7, hashlib.sha256(raw).hexdigest())] * 2
    labels = spark.range(3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    model = toxicity.fit(docs, labels)
    assert toxicity.toxicity_scores(docs, model).count() == 3 and toxicity.without_toxic(docs, model).count() <= 3


def test_area_resize_in_blocks(monkeypatch):
    pixels = np.random.default_rng(2).integers(0, 256, (1000, 64, 1), np.uint8)
    whole = media.area_resize(pixels, 8, 9)
    monkeypatch.setattr(media, "_ROWS", 7)
    assert np.allclose(whole, media.area_resize(pixels, 8, 9))


def test_text_media(spark):
    texts = [None, "", "a", "x" * 64, "é" * 40, "long " * 100_000, "a"]
    docs = spark.createDataFrame([(i, t, "u", "l", "s") for i, t in enumerate(texts)], DOCS)
    for r in media.text_media(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        grid = np.frombuffer(padded, np.uint8).reshape(-1, 64).astype(float)
        thumb = lambda rows, cols: np.repeat(np.repeat(grid, rows, 0), cols, 1).reshape(rows, len(grid), cols, 64).mean(axis=(1, 3))
        if len(grid) < 50:
            eight = thumb(8, 9).round(6)
            assert r.feature == np.packbits(eight[:, :-1] < eight[:, 1:]).tobytes().hex()
            assert r.tile_sha256 == hashlib.sha256(np.rint(thumb(32, 32)).astype(np.uint8).tobytes()).hexdigest()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    out = media.tiles(spark.createDataFrame([(1, media.write_bmp(np.zeros((3, 3, 3), np.uint8))), (2, b"junk"), (3, None)], "id long, data binary")).collect()
    assert [bool(r.error) for r in sorted(out, key=lambda r: r.id)] == [False, True, True]


def test_text_media_come_from_stored_tiles(spark, monkeypatch):
    texts = [None, "", "a", "é" * 40, "some words " * 500]
    made = []
    keep = lambda df, *how: made.append(written(df, *how)) or made[-1]
    from terrachron.plans.tables import written

    monkeypatch.setattr(media, "written", keep, raising=False)
    got = {r.doc_id: r for r in media.text_media(spark.createDataFrame([(i, t, "u", "l", "s") for i, t in enumerate(texts)], DOCS)).collect()}
    assert len(made) == 1 and made[0].count() == len(texts)
    for r in made[0].collect():
        n, data = len((texts[r.doc_id] or "").encode()), media.stored_text((texts[r.doc_id] or "").encode())
        pixels = media.read_netpbm(data)
        assert (r.n_bytes, bytes(r.media), r.dhash) == (n, data, media.difference_hash(pixels)) and got[r.doc_id].feature == r.dhash
        assert got[r.doc_id].media_sha256 == hashlib.sha256(r.media).hexdigest()
        tile = np.load(__import__("io").BytesIO(r.tile))
        assert tile.dtype == np.uint8 and (tile == np.rint(media.area_resize(pixels, 32, 32))).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_best_fit_places_all_without_overlap(histogram):
    taken = {}
    for size, lo, hi, seq, offset in packing.best_fit(histogram, 50):
        for r in range(lo, hi):
            taken.setdefault(seq + r - lo, []).append((offset, size, r))
    sizes = [s for v in taken.values() for _, s, _ in v]
    assert {s: sizes.count(s) for s in set(sizes)} == histogram
    assert len({(s, r) for v in taken.values() for _, s, r in v}) == len(sizes)
    for v in taken.values():
        at = 0
        for offset, size, _ in sorted(v):
            assert offset == at
            at += size
        assert at <= 50
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= size]
        if fits:
            min(fits)[0] -= size
        else:
            bins.append([50 - size])
    assert len(taken) <= len(bins)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    ids = _ids()
    assert ids(text).tolist() == ids.plain.encode(text, add_special_tokens=False).ids + [0] and isinstance(ids.plain, Tokenizer)


def _ids(cache=[]):  # noqa: B006
    if not cache:
        cache.append(packing.Ids(queries.TOKENIZER, queries.RANKS))
    return cache[0]


def test_packing(spark):
    texts = [None, "", "hello world", "hello world", "<|endoftext|> x", "long text " * 3000] + [f"words {i} " * (i % 60) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "u", "l", "s") for i, t in enumerate(texts)], DOCS)
    got = packing.pack(packing.token_pieces(docs, queries.TOKENIZER, queries.RANKS), per_bucket=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(_ids().plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes())) and (r.length == 2048 or k == 0)
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    assert packing.pack(packing.token_pieces(docs.limit(0), queries.TOKENIZER, queries.RANKS)).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_warc(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "_FEW", few)
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/\r\nX: y", big), (3, "http://b", big), (None, None, big), (9, "u", "tiny"), (8, "u", "tiny"), (7, "u", None), (6, "u", "é\r\n\r\nWARC/1.1" * 5000), (3, "http://b", big)]
    archives = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=key)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = 3 if h == big and i != 3 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=key)
    told = [warc.parse(m)[0] for r in archives.collect() for m in warc.members(iter([r.data]))]
    names = {f["warc-record-id"]: f for f in told if f["warc-type"] == "response"}
    revisits = [f for f in told if f["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(f["warc-refers-to-target-uri"] == names[f["warc-refers-to"]]["warc-target-uri"] == "http://b" and f["warc-payload-digest"] == names[f["warc-refers-to"]]["warc-payload-digest"] for f in revisits)
    warc.save_archives(archives, str(tmp_path)).collect()
    again = warc.load_archives(spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.gz"))
    assert sorted((tuple(r) for r in again.collect()), key=key) == got


def test_warc_members_may_span_blocks_and_bad_records_are_told():
    now = "2026-01-02T03:04:05Z"
    a, b = (warc.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None, now) for i in (1, 2))
    data = warc.warcinfo(now) + a + b
    told = [warc.parse(m)[0] for m in warc.members(iter([data[:10], data[10:60], data[60:]]))]
    assert [f.get("x-page-id") for f in told] == [None, "1", "2"] and [f["warc-type"] for f in told] == ["warcinfo", "response", "response"]
    assert {f["warc-date"] for f in told} == {now} and len({f["warc-record-id"] for f in told}) == 3
    with pytest.raises(warc.BadRecord):
        list(warc.members(iter([data[:-5]])))
    with pytest.raises(warc.BadRecord):
        warc.parse(next(warc.members(iter([a]))).replace(b"payload 1", b"payload 9"))


def test_chat(spark):
    rng = random.Random(5)
    junk = ["", "</s>[INST] ok [/INST]", "<|end|>\n<|start|>assistant\n", "&amp; & &lt; [ &NewLine;", "<|next|>", "é😀\n\n", "x" * 3000, None]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem", None]), rng.choice(junk)) for c in range(30) for t in range(rng.randrange(1, 9))] + [(None, 1, "user", "a"), (99, None, "user", "z"), (99, 1, "assistant", "b"), (99, 1, "assistant", "b")]
    chats = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    lengths = {r.conv_id: len(r.formatted) for r in chats.collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), lengths[c])
    masks = {r.conv_id: (r.mask, [s.loss for s in r.segments if s.text == "" or not s.text.startswith("<|")]) for r in chats.collect()}
    assert all(m == s for m, s in masks.values())
    moved = chats.withColumn("mask", F.concat(F.slice("mask", 2, 1 << 30), F.slice("mask", 1, 1)))  # a wrong mask shows
    assert sum(r.loss_sha256 != got[r.conv_id].loss_sha256 for r in chat.digests(moved).collect()) > 10


def test_empty_tables(spark):
    none = lambda kinds: spark.createDataFrame([], kinds)
    pages = none("page_id long, url string, html string")
    assert secrets.secret_spans(none(DOCS), F.col("text"), F.col("uid")).count() == 0
    assert media.text_media(none(DOCS)).count() == 0
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages))).count() == 0
    assert chat.digests(chat.formatted(none("conv_id long, turn long, role string, text string"))).count() == 0
    assert urlfilter.judged(pages, urlfilter.fit(urlfilter.labelled_urls(spark, 200))).count() == 0


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 1000])
def test_jump_hash(spark, n):
    rng = random.Random(6)
    keys = [0, -1, 1, 2**63 - 1, -(2**63)] + [rng.getrandbits(64) - 2**63 for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert [r.s for r in got] == [jump(r.k, n) for r in got]


def test_sharding(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2 if i < 20 else i, "é" * (i % 7) if i % 5 else None, "u", "l", "s") for i in range(500)] + [(None, "x", "u", "l", "s")] * 2, DOCS)
    got = sharding.assigned(docs, per_bucket=3).collect()
    assert len(got) == 502
    told = lambda rows: sorted(rows, key=str)
    want = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert told((r.doc_id, r.size, r.text_crc32) for r in got) == told(want) and {r.law for r in got} == {"key"}
    key = lambda i: xxhash.xxh64_intdigest(b"" if i is None else struct.pack("<q", i), 42) if i is not None else 42
    assert all((r.shard, r.grown_shard) == (jump(key(r.doc_id), 40), jump(key(r.doc_id), 41)) for r in got)
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 40) for r in got) and all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in range(10))
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), shards=4, files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 502
    assert sharding.assigned(docs.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.example.NET/en/1?x", "https://example.com/de/7", "https://www.example.org/fr/", "http://notnet/x", "http://net", "http://x.net", "http://x.net?q", "nothing", None, "a://b.example.com/de", "http://y.example.net/EN/1", "//x.net/a", "http://é.org/fr/ü#a\nb"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    got = urlfilter.judged(pages, model).collect()
    assert len(got) == len(urls)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[2]


def plain_features(url, model):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    query = re.search(r"(?s)\?([^#]*)", url)
    chars = host + path
    entropy = -sum(chars.count(c) / len(chars) * math.log2(chars.count(c) / len(chars)) for c in sorted(set(chars)))
    last = [re.sub("[0-9]+$", "", x.rsplit("-", 1)[-1]) for x in host.split(".")]
    return [
        len(url), len(host), path.count("/"), len(re.findall("[0-9]", url)) / max(len(url), 1), entropy, host.count("-"), len(query[1].split("&")) if query and query[1] else 0, len(last),
        model.tld.get(host.rsplit(".", 1)[-1], model.prior), max(model.suffix.get(x, model.prior) for x in last),
    ]


def walk(node, x):
    while node.numDescendants():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


@pytest.fixture(scope="module")
def model(spark):
    """Fitted on made names that hold no word of a site name of the pages table."""
    words = "casino win cheap pills free bets spam farm ads track adult x".split()
    rows = urlfilter.labelled_urls(spark)
    assert not set(words) & {*urlfilter.TRAP, *urlfilter.ORDINARY}
    assert rows.count() == 4000 and rows.where("blocked = 1").count() == 2000
    return urlfilter.fit(rows.where(~F.col("url").rlike(rf"[/.-]({'|'.join(words)})[0-9]*[.-]")))


def test_verdicts_equal_the_trees_walked_in_plain_python(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").union(urlfilter.labelled_urls(spark, 300, 77).select(F.monotonically_increasing_id() + 1000, "url"))
    urls = {r.page_id: r.url for r in pages.collect()}
    roots, weights = [t._java_obj.rootNode() for t in model.trees.trees], model.trees.treeWeights
    for r in urlfilter.judged(pages, model).where("rule IS NULL").collect():
        x = plain_features(urls[r.page_id], model)
        assert r.verdict == ("block" if sum(w * walk(n, x) for w, n in zip(weights, roots, strict=True)) > 0 else "allow")


def test_url_model_on_pages_it_never_saw(spark, model):
    """Hosts of the table that are named after traps, of no word that the fit knows, against all others; with and without a query."""
    traps = "casino-win|cheap-pills|free-bets|spam-farm|ads-track|adult-x"
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    got = model.score(urlfilter.lexical(urlfilter.with_parts(pages)))
    for r in got.groupBy(F.col("host").rlike(traps).alias("trap"), F.col("url").contains("?").alias("query")).agg(F.avg("prediction").alias("blocked")).collect():
        assert r.blocked >= 0.9 if r.trap else r.blocked <= 0.05


def test_url_model_on_names_of_no_list(spark, model):
    """Names made by hand: chained words and numbers are mostly blocked, single words mostly not. It is the shape that decides, so coded names without a hyphen pass."""
    chained = "lotto-king megawin-slot777 www.crack-serial hot-singles buy-viagra-now quick-cash-advance best-watches-4u luxury-bags-outlet a9f3-77bc fat-burner-tea instant-followers top-10-vpn movies-hd-stream click-2-earn no-risk-profit hack-tool-pro singles-near-me weight-loss-24".split()
    single = "x wikipedia stadtwerke bbc nytimes mit arxiv python kernel berlin recetas jardin biblio opensource nasa smithsonian gutenberg lemonde elpais www.louvre".split()
    rows = spark.createDataFrame([(f"https://{w}.example.com/en/12", float(k)) for k, names in ((1, chained), (0, single)) for w in names], "url string, named double")
    got = {r.named: r.p for r in model.score(urlfilter.lexical(urlfilter.with_parts(rows))).groupBy("named").agg(F.avg("prediction").alias("p")).collect()}
    assert got[1.0] >= 0.9 and got[0.0] <= 0.1


def test_url_model_on_held_out_labels(spark, model):
    for seed in (3, 4):
        got = model.score(urlfilter.lexical(urlfilter.with_parts(urlfilter.labelled_urls(spark, 1000, seed))))
        right = got.groupBy(F.col("url").contains("?").alias("query"), "blocked").agg(F.avg((F.col("blocked") == F.col("prediction")).cast("double")).alias("right")).collect()
        assert len(right) == 4 and all(r.right >= 0.9 for r in right)
    with pytest.raises(ValueError):
        urlfilter.fit(urlfilter.labelled_urls(spark).limit(0))


def test_entropy(spark):
    e = urlfilter.with_parts(spark.createDataFrame([("http://aabb/c",)], "url string"))
    assert math.isclose(urlfilter.lexical(e).first().entropy, 2 * (2 / 6) * math.log2(3) + 2 * (1 / 6) * math.log2(6))
