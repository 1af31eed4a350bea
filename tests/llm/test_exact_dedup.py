import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import exact_dedup as ed


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((r[0], best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize(("name", "keep"), [("min", min), ("max", max)])
@pytest.mark.parametrize("floor", [64, 1])
def test_against_brute_force(edge, edge_rows, name, keep, floor, monkeypatch):
    monkeypatch.setattr(ed, "HEAVY_FLOOR", floor)  # 1: several texts are heavy
    assert Counter(tuple(r) for r in ed.exact_dedup(edge, keep=name).collect()) == brute(edge_rows, keep)


@pytest.mark.parametrize("floor", [64, 1])
def test_drop_copies(edge, edge_rows, floor, monkeypatch):
    monkeypatch.setattr(ed, "HEAVY_FLOOR", floor)
    out = ed.drop_copies(edge)
    assert out.columns == edge.columns
    kept = Counter((r.doc_id, r.text or "") for r in out.collect())
    best = {}
    for r in edge_rows:
        t = r[1] or ""
        best[t] = min((x for x in (best.get(t), r[0]) if x is not None), default=None)
    assert kept == Counter((i, t) for t, i in best.items())


def test_empty(nothing):
    assert ed.exact_dedup(nothing).count() == 0 and ed.drop_copies(nothing).count() == 0


def test_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in ed.exact_dedup(df, normalise=F.lower).collect()} == {1: 1, 2: 1, 3: 3}


def test_one_exchange_and_no_python(edge):
    plan = ed.exact_dedup(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("hashpartitioning(body") == 0
