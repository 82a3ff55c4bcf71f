"""Collocations against DuckDB SQL on odd rows and against plain Python."""

import random
import re
from collections import Counter

import pytest

from terrachron.llm import collocations, queries, sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, n int, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], DOCS)


def odd_rows():
    rng = random.Random(5)
    words = ["new", "York", "NEW", "city\tof", "é", "É", "\x00", "a-b", "it's", "漢", "x\x1cy", "the"]
    rows = [("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ",", "?!"]) for w in rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(120)]
    return [*rows, (None, "en"), ("", None), ("   .\n", "fr"), ("twice the same", "es"), ("twice the same", "es"), ("very long words " * 5000, "long"), ("one" * 40000, "long")]


def brute(rows, longest=3, least=10, share=50, top=2000):
    f, out = {}, []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            own = f.setdefault(lang or ("" if lang == "" else "und"), Counter())
            own.update(tuple(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    for lang, own in f.items():
        n, cand = sum(v for p, v in own.items() if len(p) == 1), {p: v for p, v in own.items() if len(p) > 1 and v >= least}
        held = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and held(p, q) for q, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_equals_brute_force(spark, longest):
    rows = odd_rows()
    want = brute(rows, longest, top=40)
    assert rows_of(collocations.collocations(docs_of(spark, rows).repartition(5), longest, top=40)) == want and len({w[0] for w in want}) > 3


def test_small_shards_and_a_crowded_filter_change_nothing(spark, monkeypatch):
    rows = odd_rows()
    shard = collocations.Shard("en", [b"a b. a b a\nb", b"", b"a b"])
    phrases, n = shard.phrases(2, [])
    assert dict(zip(phrases.to_pylist(), n.tolist(), strict=True)) == {b"a b": 3, b"b a": 1}
    state, ends = shard.grown(2, [])
    assert len(set(state.tolist())) == 2 and len(ends) == 4
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    assert collocations._passes(collocations._filter(docs_of(spark, rows[:3]).selectExpr("'en' lang", "phrase")), collocations.word_hashes("en", [b"clash"])).all()


def test_whole_words_and_ties(spark):
    rows = [("red hot. red hot. blue sea. blue sea", "en")] * 5 + [("york city", "en")] * 20 + [("new york city", "en")] * 12
    got = {r[2]: r for r in rows_of(collocations.collocations(docs_of(spark, rows)))}
    assert got["blue sea"][1] + 1 == got["red hot"][1]  # equal scores and counts: by bytes
    assert "new york city" in got and "york city" in got and "new york" not in got


def test_products_past_64_bits(spark):
    a = 7 * 10**14 + 1
    one = spark.createDataFrame([("en", None, 10**16 - 1), ("en", "x", a), ("en", "y", 9 * 10**15)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "x y", a - 1)], "lang string, phrase string, n long")
    assert rows_of(collocations.ranked([one, two])) == [("en", 1, "x y", a - 1, a, 9 * 10**15, 10**16 - 1, 10**6 * (a - 1) ** 2 // (a * 9 * 10**15))]


def test_no_rows(spark):
    assert collocations.collocations(docs_of(spark, [("x", "en")]).limit(0)).count() == 0


def test_odd_rows_equal_sql(spark, tmp_path):
    import duckdb

    docs_of(spark, odd_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(sql.SQL["op13_collocations"])
    columns = [d[0] for d in want.description]
    got = queries.op13_collocations(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    want = sorted(want.fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and want
