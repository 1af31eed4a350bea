import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tidegraph.llm import language_id

SF = "/root/testdata/sf0.001"


def stay_by_shingles(texts):
    """The smallest identifier of each group joined by pairs at 0.8 or more, found by comparing every pair that shares a shingle."""
    sets, holders, shared = {}, defaultdict(list), Counter()
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for s in sets[i]:
            holders[s].append(i)
    for ids in holders.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in texts if find(i) == i}


def test_near_copies_of_a_corpus(spark):
    """On a table with near copies the stage finds at least 0.9 of what comparing all pairs removes, and removes nothing else."""
    docs = corpus_pipeline.without_copies(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 4000"), SF).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = set(texts) - stay_by_shingles(texts)
    got = set(texts) - {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()}
    assert len(gone) >= 20 and len(got & gone) >= 0.9 * len(gone) and not got - gone


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]
    held = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        held.append(docs.cache())
    first, second, third, fourth, pieces = ([r.asDict() for r in d.collect()] for d in held)
    assert all(tuple(r) == corpus_pipeline.COLUMNS for d in (first, second, third, fourth) for r in d)

    every = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = language_id.fit(language_id.training_sample(spark.read.parquet(f"{SF}/documents.parquet"), __import__("pyspark").sql.functions.lit(True), "doc_id", "text", "lang"))
    accepted = model.identify(list(every.values()))["accepted"]
    assert {r["doc_id"] for r in first} == {i for i, ok in zip(every, accepted) if ok} and len(first) > 0.95 * len(every)

    best = {}
    for r in first:
        best[r["text"]] = min(best.get(r["text"], r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in second} == set(best.values())

    assert {r["doc_id"] for r in third} == stay_by_shingles({r["doc_id"]: r["text"] for r in second})

    assert len(fourth) == len(third) and sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    changed = [r for r, o in zip(sorted(fourth, key=lambda r: r["doc_id"]), sorted(third, key=lambda r: r["doc_id"])) if r["text"] != o["text"]]
    assert all("[SECRET]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    assert hashlib.sha256(b"").hexdigest()


def test_run_writes_each_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_workers_give_back_what_an_operator_held(spark):
    """The next operator finds neither the language stage's words nor memory that is only free within the allocator."""
    import copy
    import gc

    import psutil

    from tidegraph.llm import common, language_id

    held = lambda: psutil.Process().memory_info().rss
    common.remembered(("one",), lambda: [bytes(3000) for _ in range(100_000)])
    pins = common._kept[("one",)][::50]
    before = held()
    common.remembered(("two",))
    assert len(pins) == 2000 and before - held() > 150e6

    words = ["".join(chr(97 + (k * p) % 26) for p in (1, 3, 5, 7, 11, 17)) for k in range(500)]
    model = language_id.fit([("aa", " ".join(words))] * 5)
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").coalesce(1)
    assert language_id.keep_accepted(docs, model).count() == 1

    def known(batches):
        common.remembered(("another operator",))
        for pdf in batches:
            yield pdf.assign(doc_id=sum(len(getattr(x, "known", ())) for x in gc.get_objects() if type(x).__name__ == "Identifier"))

    assert docs.mapInPandas(known, docs.schema).collect()[0].doc_id == 0
    assert copy.copy(model).known == {}


def test_stages_hand_small_batches_to_workers(spark):
    from tidegraph.llm import common

    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(k, "some words " * 50_000, "en", "s", 1) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    before = spark.conf.get(name)
    try:
        corpus_pipeline.packed(spark, docs, "")
        sizes = docs.select("doc_id", "text").mapInPandas(lambda batches: (pdf.iloc[:1].assign(doc_id=int(pdf["text"].str.len().sum())) for pdf in batches), "doc_id long, text string")
        assert max(r.doc_id for r in sizes.select("doc_id").collect()) <= 2 * common.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
