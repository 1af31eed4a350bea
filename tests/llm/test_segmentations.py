import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidegraph.llm import segmentations as sg

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lat():
    return sg.Lattices(MODEL)


def brute(lat, text):
    """Log probability of every segmentation."""

    def ways(w):
        if not w:
            yield (), 0.0
        for j in range(1, len(w) + 1):
            k = lat.pieces.get(w[:j])
            k = lat.in_bytes(w[0]) if k is None and j == 1 else k
            if k is not None:
                for rest, x in ways(w[j:]):
                    yield (k, *rest), x + lat.weights[k]

    every = [((), 0.0)]
    for u in lat.units(text):
        every = [(a + b, x + y) for a, x in every for b, y in ways(u)]
    total = np.logaddexp.reduce([x for _, x in every])
    return {a: x - total for a, x in every}


def test_probabilities_and_order(lat):
    want = brute(lat, "the cat")
    n = 6000
    got = [tuple((tuple(p.tolist()), lp, li) for p, lp, li in r) for r in sg.sample(lat, ["the cat"] * n, np.arange(n), 2)]
    assert all(len({p for p, *_ in r}) == 2 for r in got) and max(abs(want[p] - lp) for r in got for p, lp, _ in r) < 1e-9
    firsts = Counter(r[0][0] for r in got)
    for p, lp in want.items():
        assert abs(firsts[p] / n - math.exp(lp)) < 0.03
    pairs = Counter((r[0][0], r[1][0]) for r in got)
    for (a, b), c in pairs.items():
        pa, pb = math.exp(want[a]), math.exp(want[b])
        assert abs(c / n - pa * pb / (1 - pa)) < 0.03
    assert abs(np.mean([sum(math.exp(lp - li) for _, lp, li in r) for r in got]) - 1) < 0.05


def test_all_when_fewer(lat):
    text = "日é"
    want = brute(lat, text)
    (found,) = sg.sample(lat, [text], np.array([3]), 50)
    assert {tuple(p.tolist()) for p, *_ in found} == set(want) and all(abs(li) < 1e-9 for *_, li in found)


def test_samples_depend_on_the_key_only(lat):
    alone = sg.sample(lat, ["some words here"], np.array([8]), 3)[0]
    among = sg.sample(sg.Lattices(MODEL), ["other text", "some words here", ""], np.array([1, 8, 2]), 3)
    assert [p.tolist() for p, *_ in alone] == [p.tolist() for p, *_ in among[1]] and [len(p) for p, *_ in among[2]] == [0]


def test_query(spark, edge, edge_rows, nothing):
    got = sg.sample_segmentations(edge, MODEL, k=2, with_ids=True).collect()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r[0]: r[1] or "" for r in edge_rows if r[0] not in (5, None)}
    for r in got:
        assert r.round_trip and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id in texts and len(texts[r.doc_id]) < 5000:
            assert model.decode(list(r.ids)) == texts[r.doc_id]
    assert {r.doc_id for r in got} == {r[0] for r in edge_rows} and sg.sample_segmentations(nothing, MODEL).count() == 0


def test_four_without_replacement(lat):
    """The k-th path follows the law of drawing without replacement, and scores are inclusion probabilities at the next maximum."""
    want = brute(lat, "a cat")
    n = 8000
    got = sg.sample(lat, ["a cat"] * n, np.arange(n), 4)
    assert all(len({tuple(p.tolist()) for p, *_ in r}) == 4 for r in got)
    thirds = Counter(tuple(r[2][0].tolist()) for r in got)
    p = {a: math.exp(x) for a, x in want.items()}
    for c, pc in p.items():
        law = sum(pa * pb / (1 - pa) * pc / (1 - pa - pb) for a, pa in p.items() for b, pb in p.items() if len({a, b, c}) == 3)
        assert abs(thirds[c] / n - law) < 0.03
    # an unbiased estimate of any sum over all paths, here of 1 and of the number of pieces
    for f in (lambda a: 1, len):
        assert abs(np.mean([sum(math.exp(lp - li) * f(a) for a, lp, li in r) for r in got]) / sum(x * f(a) for a, x in p.items()) - 1) < 0.05


def test_long_unbroken_run(lat):
    """Places within a word have no bound: a run of over 2^19 characters scores like a shorter one."""
    ends = {}
    for n in (60_000, 530_000):
        (found,) = sg.sample(lat, ["a" * n], np.array([4]), 2)
        assert len({a.tobytes() for a, *_ in found}) == 2 and all(lat.decode(a) == "a" * n for a, *_ in found)
        ends[n] = found[0][1] / n
    assert abs(ends[530_000] / ends[60_000] - 1) < 0.2  # a sample each


def test_query_draws_four(spark):
    """The registered query resumes its search more than once: four distinct segmentations of each text that has them."""
    from tidegraph.llm import queries

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for r in queries.op3_segmentations(spark, "/root/testdata/sf0.001").collect():
        assert r.round_trip
        found.setdefault(r.doc_id, []).append((r["rank"], r.ids_crc32))
    assert set(found) == set(docs)
    for i, t in docs.items():
        ranks, sums = zip(*sorted(found[i]))
        assert ranks == tuple(range(4 if len(t) >= 20 else len(ranks))) and len(set(sums)) == len(sums)


def test_calls_per_text(lat):
    """Texts are searched together: the calls made for one more text stay few, since their cost was most of the time of usual texts."""
    texts = [f"some words of text number {i} here, and a few more of them." for i in range(400)]
    sg.sample(lat, texts, np.arange(400), 4)  # knows the words then
    calls = 0

    def count(_, event, __):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = sg.sample(lat, texts, np.arange(400), 4)
    finally:
        sys.setprofile(None)
    assert all(len(f) == 4 for f in found) and calls / len(texts) < 100  # 221 when each text was searched alone


def test_parts(lat):
    """Units cut all at once are those of the pattern, and no part's end is crossed by a piece that fits there."""
    draw = random.Random(9)
    texts = ["".join(draw.choices("ab é²日_.,'\n  ▁0-", k=draw.randint(0, 30))) for _ in range(500)] + ["", " ", "▁", "\n\n"]
    parts, bounds = lat.split(texts)
    parts = [p.decode("utf-32-le") for p in parts.to_pylist()]
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        whole = "".join(parts[a:b])
        assert whole == "".join(lat.units(t))
        ends = set(np.cumsum([len(p) for p in parts[a:b]]).tolist())
        units = [0, *np.cumsum([len(u) for u in lat.units(t)]).tolist()]
        assert ends | {0} >= set(units)
        for x, y in zip(units[:-1], units[1:]):
            for e in ends & set(range(x + 1, y)):
                assert not any(whole[i:j] in lat.pieces for i in range(x, e) for j in range(e + 1, y + 1))


def test_many_texts_like_one(lat):
    """What a text's search looks at later (few likely ways on, many paths) does not depend on the texts searched with it."""
    texts = ["the " * 2000, "", "of", "a b" * 40, "the cat. " * 300, "日é"]
    among = sg.sample(lat, texts, np.arange(6), 12)
    for i, t in enumerate(texts):
        (alone,) = sg.sample(lat, [t], np.array([i]), 12)
        assert [p.tolist() for p, *_ in alone] == [p.tolist() for p, *_ in among[i]]
        assert np.allclose([x for _, *x in alone], [x for _, *x in among[i]], rtol=1e-9, atol=1e-9)
        assert lat.round_trips([p for p, *_ in alone], t) == [True] * len(alone) and len({p.tobytes() for p, *_ in alone}) == len(alone)


def test_marks_joined_to_signs(lat):
    """No segmentation is lost where a piece joins a mark to a character that is no letter, though a word's."""
    assert "²." in lat.pieces
    want = brute(lat, "².")
    (found,) = sg.sample(lat, ["²."], np.array([3]), 50)
    assert {lat.ids_of(p) for p, *_ in found} == {b"".join(lat.ids[k] for k in a) for a in want} and all(abs(want[tuple(p.tolist())] - lp) < 1e-9 for p, lp, _ in found)
