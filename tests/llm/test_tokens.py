import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidegraph.llm import packing, token_cache, token_files
from tidegraph.llm.common import scratch
from tidegraph.llm.token_cache import Encoder, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", " a  b", "x \n y", "x\n \n  y  ", "don't I'll we've", "a\x1cb \x1d c", "tab\t\tx", "é ñ", "日本 語。", "<|endoftext|> a", "İstanbul STRASSE ẞ", "é x́", "12 345.67", "trail  ", "x y", "x  y", "word.... x", "a'b 's 'tis", "The end.\nNew Line! ok?"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cache_gives_the_library_s_ids(path, edge_rows):
    e = Encoder(path)
    for t in ODD + [r[1] or "" for r in edge_rows]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("chars", [50, 2_000_000])
def test_bulk_gives_the_library_s_ids(path, chars, edge_rows, monkeypatch):
    monkeypatch.setattr(token_cache, "BULK_CHARS", chars)
    draw = random.Random(4)
    parts = ["a", "the", *"  '' '\n", "  ", "\t", "\x1c", "\x85", "\xa0", *"stmd", "re", "ve", "ll", "l", "r", ".", "é", "ñ", "ß", "²", "ɏ", "ɐ", "日本", "1", "23", "$", "_", "A", "\r", "<|endoftext|>"]
    plain = [x for x in parts if max(x) < "ɐ" and x not in ("\x85", "\xa0", "<|endoftext|>")]
    texts = ODD + [r[1] or "" for r in edge_rows] + ["".join(draw.choices(p, k=draw.randint(0, 10))) for p in (parts, plain) for _ in range(4000)]
    e = Encoder(path)
    for t, ids in zip(texts, e.many(iter(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:50]
    assert list(e.many([])) == [] and list(e.many(["", ""])) == [b"", b""]


def test_bulk_goes_around_other_characters(monkeypatch):
    e, text = Encoder(BYTE), "plain words é stand here, and " * 20 + "“two marks” — here \xa0 x"
    pieces = e._pieces(text)
    assert "".join(p for p, _ in pieces) == text and sum(len(p) for p, plain in pieces if not plain) < 25
    monkeypatch.setattr(token_cache, "MANY_UNPLAIN", 0)
    draw, parts = random.Random(7), ["a", "the", *"     '\n\t", "  ", "\x1c", "\x85", "\xa0", "\u3000", "é", "1", ".", "ɐ", "—", "日本"]
    texts = [text, *("".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(4000))]
    for t, ids in zip(texts, e.many(texts), strict=True):
        assert ids == e.whole(t), t[:50]


def test_bulk_forgets_as_much_as_it_may(monkeypatch):
    monkeypatch.setattr(token_cache, "CACHE_UNITS", 20)
    monkeypatch.setattr(token_cache, "BULK_CHARS", 100)
    draw, e = random.Random(6), Encoder(BYTE)
    texts = [" ".join(draw.choices("abcdefgh", k=3)) + f" {k} {k % 7}" for k in range(200)]
    assert list(e.many(texts)) == [e.whole(t) for t in texts]
    assert len(e.word) <= 20 and len(e.word.old) <= 20


def test_bulk_looks_a_word_up_once():
    """Once an occurrence, op7_token_files took 408 CPU seconds a GB of 400."""
    e, looked = Encoder(BYTE), []

    class Counted(token_cache._Kept):
        def get(self, key):
            looked.append(key)
            return super().get(key)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    e.word, e.first, e.rest = (Counted(kept.compute) for kept in (e.word, e.first, e.rest))
    text = "the same words, don't they\nstand in é all of these texts. " * 50 + "x"
    assert list(e.many([text] * 100)) == [e.whole(text)] * 100
    assert len(looked) == len(set(looked)) > 10


def ids_of(path, text):
    encode = encoder(path)
    return np.array([*np.frombuffer(encode(text or ""), "<u4").tolist(), 2], "<u4")


def test_files_round_trip(spark, edge, edge_rows):
    folder = scratch(spark, "t")
    manifest = token_files.write_tokens(edge, folder, BYTE)
    rows = sorted(token_files.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for got, want in zip(rows, order, strict=True):
        ids = ids_of(BYTE, want[1])
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (want[0], at, len(ids), zlib.crc32(ids.tobytes())) and list(got.ids) == ids.tolist()
        at += len(ids)
    assert sum(m["tokens"] for m in manifest) == at


def test_short_document_access_and_damage(spark, edge):
    folder = scratch(spark, "t")
    (first, *_) = token_files.write_tokens(edge, folder, BYTE, num_partitions=1)
    dictionary = token_files.files.get(f"{folder}/dictionary.zdict")
    reader = token_files.TokenReader(f"{folder}/{first['file']}", dictionary)
    assert reader.ids(len(reader.doc_ids) - 1)[-1] == 2
    with pytest.raises(ValueError, match="dictionary"):
        token_files.TokenReader(f"{folder}/{first['file']}", dictionary + b"x")


def test_empty_files(spark, nothing):
    folder = scratch(spark, "t")
    assert token_files.write_tokens(nothing, folder, BYTE) == [] and token_files.read_tokens(spark, folder).count() == 0


def test_packing_covers_every_id_once(spark, edge, edge_rows):
    rows = packing.pack(edge, WORD, window=128).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == np.cumsum([0, *[r.length for r in seq]])[:-1].tolist() and sum(r.length for r in seq) <= 128
    unique = {r[0]: r[1] for r in edge_rows if sum(x[0] == r[0] for x in edge_rows) == 1}
    for doc_id, text in unique.items():
        ids, at = ids_of(WORD, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(ids_of(WORD, r[1])) for r in edge_rows)


def test_packing_empty(nothing):
    assert packing.pack(nothing, WORD).count() == 0


def brute_cost(ends, pens, window):
    pos = [0, *ends]
    best = [0] + [float("inf")] * len(ends)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= window:
                pad = 0 if n in packing.UNPADDED and n < window else window - n
                best[j] = min(best[j], best[i] + pad + pens[j - 1])
    return best[-1]


def test_cuts_are_optimal():
    draw = np.random.default_rng(3)
    for _ in range(60):
        gaps = draw.integers(1, 900, draw.integers(1, 40))
        ends = np.cumsum(gaps)
        pens = draw.choice([0, 8, 256], len(ends))
        pens[-1] = 0
        window = int(draw.choice([1000, 2048, 4096]))
        cuts = packing.choose_cuts(ends, pens, window)
        pos = dict(zip(ends.tolist(), pens.tolist()))
        cost = sum((0 if b - a in packing.UNPADDED and b - a < window else window - (b - a)) + pos[b] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == ends[-1] and cost == brute_cost(ends.tolist(), pens.tolist(), window)
