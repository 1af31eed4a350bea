import numpy as np
import pytest

from tidegraph.llm import near_vectors as nv


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(0)
    base = draw.normal(size=(300, 16))
    near = [base[k] + draw.normal(scale=0.03, size=16) for k in range(40) for _ in range(2)]
    dense = [base[299] + draw.normal(scale=0.02, size=16) for _ in range(60)]
    rows = [(k, v.tolist(), 1, 2.0) for k, v in enumerate([*base, *near, *dense])]
    n = len(rows)
    rows += [(n, None, 1, 2.0), (n + 1, [0.0] * 16, 1, 2.0), (n + 2, [float("nan")] + [1.0] * 15, 1, 2.0), (n + 3, [None] + [1.0] * 15, 1, 2.0), (n + 4, [float("inf")] * 16, 1, 2.0), (n + 5, [1.0, 2.0], 1, 2.0), (n + 6, [], 1, 2.0)]
    rows += [(n + 10 + k, base[3].tolist(), 1, 2.0) for k in range(20)] + [(3, base[3].tolist(), 1, 2.0), (None, base[5].tolist(), 1, 2.0)]
    return rows


def brute(rows):
    out, usable = [], []
    for k, (_, v, *_) in enumerate(rows):
        ok = v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, "f4")).all() and np.any(v)
        if ok:
            usable.append((k, np.array(v, "f4").astype("f8")))
    x = np.array([v / np.linalg.norm(v) for _, v in usable])
    close = x @ x.T >= 0.95
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[c].min() for c in close])
    where = {k: i for i, (k, _) in enumerate(usable)}
    for k, (vec_id, *_) in enumerate(rows):
        if k not in where:
            out.append((vec_id, 0, vec_id))
            continue
        i = where[k]
        ids = [rows[usable[j][0]][0] for j in np.flatnonzero(label == label[i])]
        out.append((vec_id, int(close[i].sum()) - 1, min(x for x in ids if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1024, 16])
def test_against_brute_force(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(nv, "TILE", tile)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, n_links int, component_id double").repartition(3)
    got = nv.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nv.near_vectors(df).collect()] == [(1, 0, 1, True)] and nv.near_vectors(df.where("false")).count() == 0


def test_links_between_groups_larger_than_a_list(spark):
    draw = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a = unit(draw.normal(size=(12, 64)))
    b = unit(draw.normal(size=(12, 64)))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    twins = np.concatenate([a, 0.97 * a + np.sqrt(1 - 0.97**2) * b])
    x = np.concatenate([twins.repeat(20, axis=0) + draw.normal(scale=0.004, size=(480, 64)), draw.normal(size=(800, 64))])
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype("f4"))]
    u = unit(x.astype("f4").astype("f8"))
    n_links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert n_links[:480].min() == 39
    got = {r.vec_id: r for r in nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert [got[k].n_links for k in range(len(x))] == n_links.tolist()
    assert all(got[k].component_id == k % 240 // 20 * 20 for k in range(480))


def test_audit_counts_by_vector(spark):
    draw = np.random.default_rng(4)
    pairs = draw.normal(size=(50, 64)).repeat(2, axis=0) + draw.normal(scale=0.02, size=(100, 64))
    hot = draw.normal(size=64) + draw.normal(scale=0.02, size=(200, 64))
    x = np.concatenate([pairs, hot])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "v long, exact binary")
    linked = spark.createDataFrame([(k, 100) for k in range(100, 300)], "node long, root long")
    assert nv.audited_recall(units, linked, 0.95) == 0.0
    linked = linked.union(spark.createDataFrame([(k, k // 2 * 2) for k in range(50)], "node long, root long"))
    assert nv.audited_recall(units, linked, 0.95) == 0.5


def test_vectors_of_every_length(spark):
    """Any length is searched, not only the commonest; vectors of different lengths never link."""
    draw = np.random.default_rng(6)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(50)]
    for n in (1, 2, 3, 16):
        base = draw.normal(size=n)
        rows += [(len(rows) + k, (base + draw.normal(scale=0.001, size=n)).tolist()) for k in range(4)] + [(len(rows) + 4 + k, (base * 2).tolist()) for k in range(2)]
    got = {r.vec_id: r for r in nv.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert len(got) == 74 and all(got[k].n_links == 5 and got[k].component_id == 50 + (k - 50) // 6 * 6 for k in range(50, 74))


def test_saturated_lists_grow(spark, monkeypatch):
    """A list with nothing below the threshold goes on past K entries; others stay at K."""
    monkeypatch.setattr(nv, "K", 3)
    draw = np.random.default_rng(8)
    tight = draw.normal(size=32) + draw.normal(scale=0.01, size=(12, 32))
    x = np.concatenate([tight, draw.normal(size=(30, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(k, k, bytearray(v.astype("f2").tobytes())) for k, v in enumerate(x)], "v long, root long, small binary")
    lists = None
    for turn in range(4):
        groups = nv.with_bars(units, lists, 0.95).withColumn("g", nv.F.lit(1).cast("long"))
        lists = nv.cut(nv.best_lists(nv.propose(groups.select("g", "v", "root", "small", "bar"), 2), lists, 0.95))
    sizes = {r.v: r["count"] for r in lists.groupBy("v").count().collect()}
    bars = {r.v: r.bar for r in nv.with_bars(units, lists, 0.95).collect()}
    assert all(sizes[k] >= 5 and bars[k] < 0.95 for k in range(12)) and all(sizes[k] == 3 and bars[k] < 0.9 for k in range(12, 42))


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(nv, "SPLIT", 8)
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(size=24) + draw.normal(scale=0.02, size=(150, 24)), draw.normal(size=(60, 24))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    audit = {}
    got = {r.vec_id: r for r in nv.near_vectors(df, audit=audit).collect()}
    assert all(got[k].n_links == 149 and got[k].component_id == 0 for k in range(150)) and all(got[k].n_links == 0 for k in range(150, 210))
    assert audit["recall"] >= nv.RECALL and audit["starts"] >= 1


def test_failed_audit_is_never_returned(spark, monkeypatch):
    monkeypatch.setattr(nv, "RESTARTS", 2)
    monkeypatch.setattr(nv, "audited_recall", lambda *a: 0.9)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="0.900"):
        nv.near_vectors(df)


def test_more_vectors_get_more_tables():
    assert nv.tables_for(100, 0.95) <= nv.tables_for(20_000, 0.95) < nv.tables_for(100_000, 0.95) < nv.tables_for(10**7, 0.95)
