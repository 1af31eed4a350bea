import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidegraph.llm import simhash
from tidegraph.llm.components import connected_components


def brute_print(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, most):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(prints)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ks}


def test_golay_code_covers_every_word_once():
    low, high, near, four = simhash.golay_tables()
    assert len(set(near.tolist())) == 2048 and max(int(e).bit_count() for e in near) == 3
    assert all((low[e & 4095] ^ high[e >> 12]) == s for s, e in enumerate(near.tolist()))
    assert Counter((row[0] >= 0) for row in four.tolist())[True] == sum(int(e).bit_count() == 3 for e in near)


def test_anchors_lose_no_link():
    draw = np.random.default_rng(1)
    plan = simhash.blocks_of(1, 2, 32)
    x = draw.integers(0, 2**64, 3000, "u8")
    flips = np.zeros(3000, "u8")
    for _ in range(3):
        flips |= np.uint64(1) << draw.integers(0, 64, 3000, "u8")
    both = [dict() for _ in range(2)]
    for side, prints in enumerate((x, x ^ flips)):
        rows, codes = simhash.anchors(prints.reshape(-1, 1), plan, 1)
        for r, c in zip(rows.tolist(), codes.tolist()):
            both[side].setdefault(r, []).append(c)
    for r in range(3000):
        home = {c >> 1 for c in both[0][r] if not c & 1}
        assert home & {c >> 1 for c in both[1][r]}


@pytest.mark.parametrize(("small", "crowd"), [(48, 1024), (1, 1024), (1, 8)])
def test_links_join_what_brute_force_joins(small, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = np.random.default_rng(2)
    centre = draw.integers(0, 2**64, 5, "u8")
    prints = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << draw.integers(0, 64, 5, "u8")) for _ in range(20)]))
    draw.shuffle(prints)
    i, j = simhash.links(np.zeros(len(prints), "i8"), np.zeros(len(prints), bool), prints.reshape(-1, 1), 3)
    got = brute_groups({k: 0 for k in range(0)}, 3)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = brute_groups({k: int(p) for k, p in enumerate(prints.tolist())}, 3)
    assert {k: find(k) for k in range(len(prints))} == want and got == {}
    if small == 1:
        assert len(i) < 3 * len(prints)


def test_links_of_nodes_joined_beforehand():
    """Rows of one node count as joined, each node is named once, and anchors do not mix."""
    x = np.array([0, 1, 0xFFFF, 0xFFFE, 0, 1, 3], "u8").reshape(-1, 1)
    anchor, node = np.array([5, 5, 5, 5, 9, 9, 9]), np.array([40, 30, 30, 20, 40, 30, 10])
    i, j = simhash.links(anchor, np.zeros(7, bool), x, 1, node)
    assert sorted(zip(anchor[i].tolist(), node[i].tolist(), node[j].tolist())) == [(5, 30, 20), (5, 40, 20), (9, 30, 10), (9, 40, 10)]
    assert all(len(k) == 0 for k in simhash.links(anchor[:0], np.zeros(0, bool), x[:0], 1, node[:0]))


@pytest.mark.parametrize("early", [16, 1])
def test_against_brute_force(spark, edge, edge_rows, early, monkeypatch):
    monkeypatch.setattr(simhash, "EARLY", early)
    rows = simhash.near_groups(edge, words=3, width=1, most=3, blocks=2, block_bits=32).collect()
    prints = {k: brute_print(r[1], 3) for k, r in enumerate(edge_rows)}
    groups = brute_groups(prints, 3)
    least = {}
    for k, g in groups.items():
        if edge_rows[k][0] is not None:
            least[g] = min(least.get(g, edge_rows[k][0]), edge_rows[k][0])
    want = Counter((edge_rows[k][0], prints[k], least.get(groups[k])) for k in prints)
    assert Counter((r.doc_id, r.f0 % 2**64, r.component_id) for r in rows) == want


def test_near_copies_go_and_others_stay(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows = []
    for k in range(60):
        base = draw.choices(words, k=400)
        near = list(base)
        near[draw.randrange(400)] = "zzz"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near) if k % 2 else " ".join(draw.choices(words, k=400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept == {i for i, _ in rows} - {2 * k + 1 for k in range(1, 60, 2)}


def test_rows_go_by_identifier_and_text(spark):
    """A repeated identifier does not take unrelated texts along, and null identifiers yield to others."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    base, other, third = (draw.choices(words, k=300) for _ in range(3))
    near = lambda t: " ".join(t[:150] + ["zzz"] + t[151:])
    rows = [(1, " ".join(base)), (2, near(base)), (2, " ".join(other)), (None, " ".join(base[:200] + ["q"] + base[201:])), (None, " ".join(third)), (None, near(third)), (None, "alone"), (7, None), (8, ""), (None, None)]
    got = Counter((r.doc_id, r.text) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    kept = [rows[k] for k in (0, 2, 6, 7)]
    assert all(got[r] == 1 for r in kept) and sum(got.values()) == 5 and got[rows[4]] + got[rows[5]] == 1


def test_blocks_grow_with_the_number_of_fingerprints():
    small, large = simhash.plan_for(10**6), simhash.plan_for(10**9)
    assert (small["blocks"], small["block_bits"]) == (80, 23) and large["block_bits"] == 29
    load = lambda n: n / 2 ** (simhash.plan_for(n)["block_bits"] - 11)  # noqa: E731  fingerprints per anchor
    assert all(load(10**k) <= simhash.LOAD for k in range(5, 13))
    # two random bits in 0.15 differ: the chance to meet in some block stays as high
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**64, (1500, 4), "u8")
    flip = np.packbits(draw.random((1500, 256)) < 39 / 256, axis=1, bitorder="little").view("u8")
    for plan in (small, large):
        bits = simhash.blocks_of(4, plan["blocks"], plan["block_bits"])
        (_, a), (_, b) = (simhash.anchors(s, bits, 0) for s in (x, x ^ flip))
        assert (a.reshape(len(bits), -1) == b.reshape(len(bits), -1)).any(axis=0).mean() > 0.98


def test_empty(nothing):
    assert simhash.near_groups(nothing).count() == 0 and simhash.near_dedup(nothing).columns == nothing.columns


def test_components(spark):
    draw = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, x) for x in range(1001, 1100)] + [(draw.randrange(50), draw.randrange(50)) for _ in range(30)] + [(None, 3), (7, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_dedup_decides_by_shingles(spark):
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows = []
    for k in range(60):
        base = draw.choices(words, k=9 if k % 3 == 2 else 200)
        tail = {0: 24, 1: 33, 2: 1}[k % 3]  # similarity 0.77, 0.71, and 4 of 5 shingles
        near = base[: len(base) - tail] + (draw.choices(words, k=tail) if tail > 1 else [])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    rows += [(500, "x " * 50 + " ".join(words[:60])), (501, "x " * 900 + " ".join(words[:60]))]  # one set of shingles
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    gone = {i for i, _ in rows if i % 2 and alike(i - 1, i)}
    assert gone == {2 * k + 1 for k in range(2, 60, 3)} | {501}
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert not {i for i, _ in rows} - kept - gone and 501 not in kept


def test_tiles_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    draw = random.Random(8)
    text = draw.choices("abcdefghijklmnopqrstuvwxyz", k=60)
    rows = []
    for k in range(30):
        rows.append((1, k, " ".join(text), 30))
        text[draw.randrange(60)] = f"w{k}"
    got = simhash.verified_links(spark.createDataFrame(rows, "group long, node long, body string, size long"), 5, 0.8, 4)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, _, t, _ in rows]
    root = list(range(30))
    for _ in range(30):
        root = [min(root[j] for j in range(30) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(30)]
    found = {r.node: r.root for r in connected_components(got).collect()}
    assert [found.get(k, k) for k in range(30)] == root and len(set(root)) < 30


@pytest.mark.parametrize("shared, added, least", [(4, 1, 0.97), (8, 2, 0.995), (200, 50, 0.995)])
def test_candidates_hold_nearly_all_pairs_at_the_similarity(shared, added, least):
    draw = np.random.default_rng(7)
    n, sides = 1000, ([], [])
    for _ in range(n):
        h = draw.integers(0, 2**64, shared + added, "u8")
        for side, own in zip(sides, (h[: shared + added // 2], np.r_[h[:shared], h[shared + added // 2 :]])):
            side.append([simhash.majority(simhash.remix(own, k)) for k in range(4)])
    x, y = (np.array(s, "u8") for s in sides)
    plan = simhash.blocks_of(4, simhash.CANDIDATES["blocks"], simhash.CANDIDATES["block_bits"])
    (_, a), (_, b) = (simhash.anchors(s, plan, 0) for s in (x, y))
    meet = (a.reshape(len(plan), n) == b.reshape(len(plan), n)).any(axis=0)
    assert (meet & (simhash.differing(x, y) <= simhash.CANDIDATES["most"])).mean() >= least
