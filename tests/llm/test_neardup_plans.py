"""The plans of near duplicates, which the driver holds, stay small; components of random graphs."""

import random

import pytest
from test_text_operators import brute_components, odd_docs

from terrachron.llm import neardup
from terrachron.plans import components as plan
from terrachron.plans.tables import written


@pytest.mark.parametrize("salted", [512, 3])
def test_no_table_comes_from_a_plan_of_many_scans(spark, monkeypatch, salted):
    scans = []

    def counted(df, tag, *more):
        scans.append((df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), tag))
        return written(df, tag, *more)

    monkeypatch.setattr(neardup, "written", counted)
    monkeypatch.setattr(plan, "written", counted)
    monkeypatch.setattr(neardup, "SHORT", 0)
    monkeypatch.setattr(neardup, "SALTED", salted)  # 3: hot values are broadcast
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i:]])) for i in range(20)] + [(100 + i, " ".join(base[: 40 + i] + [f"x{i}y{k}" for k in range(60)])) for i in range(9)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd_docs(spark, rows)).collect())
    assert got == brute_components(rows)
    assert {"neardup-cc", "neardup-open", "neardup-all-links"} <= {tag for _, tag in scans}
    assert max(scans)[0] <= 12, sorted(scans)[-8:]


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    edges = [(graph * 1000 + rng.randrange(n), graph * 1000 + rng.randrange(n)) for graph, n in enumerate((3, 10, 40, 90, 200)) for _ in range(n * 9 // 10)]
    low = {}
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    rows = plan.components(spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in edges], "a string, b string")).collect()
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.node, r.label) for r in rows) == sorted((f"{x:05}", f"{low[x]:05}") for x in joined)
