"""Queries against their DuckDB SQL over whole tables, and over odd rows."""

import duckdb
import pytest

from terrachron.llm import queries, sql

TABLES = "documents pages benchmark labels conversations".split()


def both(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'/*.parquet' if sf.startswith('/tmp') else ''}')")
    want = db.execute(sql.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda all_: sorted(map(repr, all_))
    return rows(tuple(r) for r in got.select(*columns).collect()), rows(want.fetchall())


@pytest.mark.parametrize("name", sql.SQL)
def test_queries_equal_sql(spark, name):
    got, want = both(spark, "/root/testdata/sf0.001", name)
    assert got == want and got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd", numbered=True))
    key, base = "0123456789abcdef" * 2, "these are the words of one text that others copy almost word for word here and there again"
    texts = [
        None, "", " \n ", "one", "four words and no", base, base, base.upper(), base + " More", f"é PASSWORD = '{key}' ∂ {key}\n", f"x{key}", "AKIA" + "B7" * 9, "tokKen: abcdefgh token: abcdef", "a1" * 15 + " Copied0Example0Key1234567",
        "Copied0Example0Key1234567", "Own9Live8Secret7654321abc it's", "before Alpha-beta gamma after", "i0 i1 i2 i3 i4 i5 i6 i7 i8 i9 i10 i11 x i0 i1 i2 i3 i4 i5 i6 i7 i8 i9",
    ]
    body, shared = "\n".join(f"Ab{i}cD+/eF{i * 7}gH9" * 3 for i in range(9)), "\\n".join(["Qw3+" * 16] * 3)
    pem = lambda s, head="": f"k -----BEGIN RSA PRIVATE KEY-----{head}\n{s}\n-----END RSA PRIVATE KEY----- z"
    texts += [pem(body), pem(body[:60], "\nProc-Type: 4,ENCRYPTED\n"), pem(shared), pem(shared), pem(shared), "ghp_" + "Zz9x" * 10 + " eyJabcdefghij.klmnopqrst0.x"]
    docs = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)] + [(None, base, None, None, None), (5, base, "en", "s2", 0), (None, None, "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    items = [(1, " ".join(f"i{i}" for i in range(14))), (2, "alpha BETA gamma"), (10, "Beta gamma"), (3, None), (4, "..."), (None, "one"), (2, "words of one text that others copy almost word for word here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    html = [(3, "é" * 60), (1, "é" * 60), (2, "é" * 60), (4, "short"), (5, "short"), (6, None), (None, "é" * 60), (7, "z" * 100), (7, "z" * 100)]
    spark.createDataFrame([(i, None, h) for i, h in html], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    turns = [(1, 1, "user", "a<|next|>b &amp; [x]"), (1, 2, "user", None), (1, 3, "assistant", "<|end|>\n"), (1, 3, "assistant", "<|end|>\n"), (2, None, None, ""), (2, 0, "a\nb<", "&lt;"), (None, 1, "assistant", "é😀")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.mark.parametrize("name", [n for n in sql.SQL if n != "op13_collocations"])  # its own odd rows: test_collocations.py
def test_odd_rows_equal_sql(spark, odd, name):
    got, want = both(spark, odd, name)
    assert got == want and got
