import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import language_id as li

STEMS = {"aa": ["tion", "the", "ing", "and"], "bb": ["ung", "sch", "keit", "ein"], "cc": ["eau", "oui", "elle", "aux"]}


def text(lang, draw, n=80):
    return " ".join("".join(draw.choices(STEMS[lang], k=draw.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    rows = [(k, text(lang := list(STEMS)[k % 3], draw), lang, 0.5) for k in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(corpus):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = li.identify(corpus, learn_from=~held).join(corpus.select("doc_id", "lang"), "doc_id")
    assert out.where("lang <> lang_pred").count() == 0 and out.where("score < 0 or score > 1 or not accepted").count() == 0


def test_edges(spark, corpus):
    model = li.fit(li.training_sample(corpus, F.lit(True), "doc_id", "text", "lang"))
    draw = random.Random(2)
    rows = [(1, None, 1), (2, "", 1), (3, "12 !! ²", 1), (None, text("bb", draw), 1), (4, text("cc", draw, 20_000), 1), (4, text("aa", draw), 1), (5, "Ждзб фыва " * 40, 1), (6, text("aa", draw).upper(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entropy int")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.accepted) for r in li.identify(df, identifier=model).collect()))
    assert got == [(0, "bb", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "aa", True), (4, "cc", True), (5, got[6][1], False), (6, "aa", True)]
    assert sorted(r.doc_id or 0 for r in li.keep_accepted(df, model).collect()) == [0, 4, 4, 6]


def plain_kneser_ney(counts, order):
    """Interpolated Kneser-Ney from its definition, on dictionaries of character tuples: p(character, context)."""
    tables = [Counter() for _ in range(order)]
    for word, n in counts.items():
        padded = "\0" * (order - 1) + word + "\0"
        for k in range(order - 1, len(padded)):
            tables[-1][padded[k - order + 1 : k + 1]] += n
    for n in range(order - 1, 0, -1):  # lower orders count in how many contexts one longer a gram occurs
        for gram in tables[n]:
            tables[n - 1][gram[1:]] += 1
    discounts = []
    for t in tables:
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)

    def p(char, context):
        below = p(char, context[1:]) if context else 1 / (len(tables[0]) + 1)
        t, d = tables[len(context)], discounts[len(context)]
        follow = [c for g, c in t.items() if g[:-1] == context]
        if not follow:
            return below
        return max(t.get(context + char, 0) - d, 0) / sum(follow) + sum(min(c, d) for c in follow) / sum(follow) * below

    return p


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_model_against_plain_kneser_ney(seed):
    draw = random.Random(seed)
    counts = Counter({"".join(draw.choices("abcdé", k=draw.randint(1, 6))): draw.randint(1, 4) for _ in range(40)})
    m, p = li.Model(counts), plain_kneser_ney(counts, li.ORDER)
    words = [*list(counts)[:15], "abcab", "zz", "azb", "e", "ddddddd"]
    found = li.Identifier(["x"], [m])
    found.learn(words)
    for w in words:
        padded = "\0" * (li.ORDER - 1) + w + "\0"
        want = sum(math.log(p(padded[k], padded[k - li.ORDER + 1 : k])) for k in range(li.ORDER - 1, len(padded)))
        assert abs(found.table[found.known[w], 0] - want) < 1e-9


def test_probabilities_sum_to_one():
    m = li.Model(Counter({"abba": 3, "abc": 2, "cab": 1}))
    for context in ("", "a", "ab", "cab"):
        total = m.floor  # the share of one unknown character
        for c in ["a", "b", "c", "\0"]:
            codes = np.array([0] * (li.ORDER - 1) + [ord(x) for x in context + c], "u8")
            at = [len(codes) - li.ORDER]
            hashed = [li.grams(codes, n)[at] for n in range(1, li.ORDER + 1)]
            shorter = [np.zeros(1, "u8"), *[li.grams(np.r_[np.uint64(0), codes[:-1]], n)[at] for n in range(1, li.ORDER)]]
            total += float(np.exp(m.log_probs(hashed, shorter))[0])
        assert 0.9 < total <= 1.0 + m.floor


def test_rejection_on_the_corpus():
    """Clean documents stay; texts in no learnt language, or without order among their letters, go."""
    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist() if r["text"]]
    model = li.fit([(r["lang"], r["text"]) for r in rows if r["doc_id"] % 2 and r["lang"]])
    clean = model.identify([r["text"] for r in rows if not r["doc_id"] % 2])["accepted"]
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [r["text"] for r in rows if len(r["text"].split()) >= 30][:150]
    foreign = {
        "letters": [" ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(60)) for _ in texts],
        "shuffled": [" ".join("".join(draw.sample(w, len(w))) for w in t.split()[:60]) for t in texts],
        "italian": [" ".join(draw.choices("il la che di per non sono questo della molto anche quando città giorno tempo bene fare casa strada uomo acqua".split(), k=60)) for _ in texts],
        "finnish": [" ".join(draw.choices("minä olen hyvin väsynyt tänään koska työskentelin myöhään yöllä kirjastossa kaupungissa talossa".split(), k=60)) for _ in texts],
        "cyrillic": ["это был очень хороший день когда мы пошли гулять " * 5 for _ in texts],
    }
    assert clean.mean() > 0.995
    for kind, of in foreign.items():
        assert model.identify(of)["accepted"].mean() <= 0.01, kind


def test_a_language_of_few_or_long_texts_is_learnt(spark):
    draw = random.Random(3)
    rows = [(k, text("aa", draw), "aa") for k in range(60)] + [(100, text("bb", draw), "bb"), (101, text("cc", draw, 20_000), "cc"), (None, text("bb", draw), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(rows[-2][1]) > li.SAMPLE_CHARS
    got = [(r.doc_id, r.lang_pred) for r in li.identify(docs).where("doc_id >= 100 OR doc_id IS NULL").collect()]
    assert Counter(got) == Counter([(100, "bb"), (101, "cc"), (None, "bb")])


def test_nothing_to_learn(spark, corpus):
    assert [r.lang_pred for r in li.identify(corpus.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"]
    assert li.identify(corpus.where("false")).count() == 0


def test_common_words_are_scored_once_and_batches_are_bounded(monkeypatch):
    """Rare words push out no common ones, and texts scored together are bounded by their characters."""
    draw = random.Random(4)
    model = li.fit([(lang, text(lang, draw)) for lang in STEMS for _ in range(20)])
    common = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(30)]
    rare = lambda: " ".join("".join(draw.choices("stuvwxyz", k=9)) for _ in range(40))
    monkeypatch.setattr(li, "CACHE_WORDS", 100)
    scored, learn = Counter(), li.Identifier.learn
    monkeypatch.setattr(li.Identifier, "learn", lambda self, words: (scored.update(words), learn(self, words))[1])
    model.clear()
    texts = [f"{' '.join(common)} {rare()} {' '.join(common)}" for _ in range(20)]
    each = [model.identify([t]).iloc[0] for t in texts]
    assert max(scored[w] for w in common) == 1 and len(model.known) <= 100 + 70
    monkeypatch.setattr(li, "CACHE_WORDS", 10_000)
    model.clear()
    assert np.allclose([r.entropy for r in each], model.identify(texts)["entropy"], atol=1e-9)
    assert max(b - a for a, b in li.batches_of(["x" * 400_000] * 9)) == 2 and list(li.batches_of([None, "x" * 3_000_000, ""])) == [(0, 1), (1, 2), (2, 3)]
