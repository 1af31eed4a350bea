"""Token ids from the ``tokenizers`` library, remembered by text unit.

The pre-tokenizers never look across certain spaces, so a text may be cut there and
each distinct unit encoded once per worker; a unit's words are remembered as well,
because most new units only join known words and marks anew.  Ids are kept as bytes
of little-endian unsigned 32-bit integers, which makes a document one ``join``.

``Encoder.many`` encodes texts in bulk where the pre-tokenizer is the byte-level one: words
are cut by the classes of neighbouring bytes, Arrow tells them apart and joins their ids,
and only a distinct word is looked up, or merged if it is new.

Words are merged by the library's own model; texts that hold characters for which
Unicode tables may differ, or strings of added tokens, go through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex

from tidegraph.llm.common import remembered

#: Entries of a cache generation; two generations are held, about 200 bytes an entry.
CACHE_UNITS = 400_000
#: Characters of texts that are cut into words together; a longer text goes by itself.
BULK_CHARS = 2_000_000
#: Marks that end a word without changing how it is split.
MARKS = ".,!?;:"
#: Characters below this one are told apart alike by all Unicode versions in use, and are NFC.
PLAIN_BELOW = "ɐ"
_SPACE = re.compile(r" (?=\S)")
_ODD = re.compile(r" \s| $")
#: Characters that are not cut in bulk, white space of two bytes among them, and how many characters
#: there have to be for each of them if a text shall be taken apart around them.
_UNPLAIN = re.compile(f"[\x85\xa0{PLAIN_BELOW}-\U0010ffff]")
MANY_UNPLAIN = 32


class _Kept(dict):
    """Computed values by key; what the last generation did not use is forgotten."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.old.get(key)) is None:
            found = self.compute(key)
        if len(self) >= CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: list[str], compute_all) -> list[bytes]:
        """Values of distinct keys, those not known worked out together."""
        found = list(map(self.get, keys))
        absent = [k for k, value in enumerate(found) if value is None]
        for k in absent:
            found[k] = self.old.get(keys[k])
        new = [k for k in absent if found[k] is None]
        for k, value in zip(new, compute_all([keys[k] for k in new])):
            found[k] = value
        if len(self) + len(absent) > CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        self.update((keys[k], found[k]) for k in islice(absent, CACHE_UNITS))
        return found


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character below PLAIN_BELOW (0 white space, 1 letter, 2 number, 3 other), and of each byte of ASCII."""
    kinds = [regex.compile(p).match for p in (r"\s", r"\p{L}", r"\p{N}", "(?s:.)")]
    of = np.array([next(k for k, match in enumerate(kinds) if match(chr(c))) for c in range(ord(PLAIN_BELOW))], "u1")
    return of, np.r_[of[:128], np.full(128, 3, "u1")]


def word_starts(data: np.ndarray, first: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the words of the byte-level pre-tokenizer start in texts laid end to end.

    ``data`` has their bytes (UTF-8, of characters below PLAIN_BELOW, white space in ASCII)
    and ``first`` tells the first byte of each text.
    """
    kind = classes[1][data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = classes[0][(data[lead].astype("i4") & 31) << 6 | data[lead + 1] & 63]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of some white space before something visible stands apart; a space joins what follows
    last = np.zeros(len(data), bool)
    last[:-1] = start[1:] & ~first[1:] & (kind[:-1] == 0)
    start |= last
    start[1:] &= ~(last & (data == 32))[:-1]
    # contractions, where no other mark or space stands before the apostrophe
    quote = np.flatnonzero((data == 39) & start)
    one, two = (np.where((quote + k < len(data)) & ~first[(quote + k) % len(data)], data[(quote + k) % len(data)], 0) for k in (1, 2))
    short = np.isin(one, list(b"stmd"))
    long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    ends = np.r_[quote[short] + 2, quote[long] + 3]
    start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


class Encoder:
    """``encode(text)`` gives the ids as ``<u4`` bytes, those of the library itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [told["pre_tokenizer"]])
        self.added = [a["content"] for a in told["added_tokens"]]
        self.lower = told["normalizer"] is not None
        self.drops_space = bool(steps[0].get("invert"))
        self.in_bulk = not (self.drops_space or self.lower)
        if self.drops_space:
            pattern = steps[0]["pattern"]["Regex"]
        else:  # the byte-level pre-tokenizer's own pattern (fixed value)
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.words = regex.compile(pattern).findall
        plain = pattern.replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]").replace(" ?\\p{L}", " ?[A-Za-z]").replace(" ?\\p{N}", " ?[0-9]")
        self.ascii_words = re.compile(plain.replace("\\p{L}", "A-Za-z").replace("\\p{N}", "0-9"), re.ASCII).findall
        self.letters = byte_letters()
        self.classes = byte_classes()
        self.word = _Kept(self._word)
        self.first = _Kept(lambda unit: self._unit(unit, "", self.first))
        self.rest = _Kept(lambda unit: self._unit(unit, " ", self.rest))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        seen = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _new_words(self, words: list[str]) -> list[bytes]:
        """``_word`` of each word, of characters below PLAIN_BELOW."""
        if not words:
            return []
        raw = PLAIN_BELOW.join(words).encode().replace(PLAIN_BELOW.encode(), b"\xff")  # a byte that UTF-8 never has
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in raw.decode("latin-1").translate(self.letters | {255: "\n"}).split("\n")]

    def _unit(self, unit: str, before: str, known: _Kept) -> bytes:
        """Ids of ``before + unit``; ``known`` has those of other units."""
        if not unit.isascii() and max(unit) >= PLAIN_BELOW:
            return self.whole(before + unit)
        if self.lower and (low := unit.lower()) != unit:
            return known[low]
        if unit.isalpha():
            return self._word(before + unit)
        if (stem := unit.rstrip(MARKS)).isalpha():
            return known[stem] + self.word[unit[len(stem) :]]
        return b"".join(map(self.word.__getitem__, (self.ascii_words if unit.isascii() else self.words)(before + unit)))

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.drops_space:  # white space separates words and leaves no ids
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        # a space before a visible character starts a word whatever stands before it
        head, *rest = _SPACE.split(text) if _ODD.search(text) else text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, rest))

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text in pieces that are encoded by themselves, and whether ``_bulk`` may cut them."""
        if not self.in_bulk or len(text) > BULK_CHARS or any(a in text for a in self.added):
            return [(text, False)]
        if text.isascii() or not (odd := [m.start() for m in _UNPLAIN.finditer(text)]):
            return [(text, True)]
        if len(odd) * MANY_UNPLAIN > len(text):
            return [(text, False)]
        found, done = [], 0  # a space before a visible character starts a word whatever stands before it
        for at in odd:
            if at < done:
                continue
            a = at
            while (a := text.rfind(" ", done, a)) >= 0 and text[a + 1].isspace():
                pass
            b = at
            while (b := text.find(" ", b + 1)) >= 0 and text[b + 1 : b + 2].strip() == "":
                pass
            a, b = max(a, done), b if b >= 0 else len(text)
            found += [(text[done:a], True), (text[a:b], False)]
            done = b
        return [(piece, plain) for piece, plain in [*found, (text[done:], True)] if piece]

    def _bulk(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        if not any(texts):
            return [b""] * len(texts)
        _, at, data = pa.array(texts, pa.string()).buffers()
        at = np.frombuffer(at, "i4", len(texts) + 1)
        raw = np.frombuffer(data, "u1", at[-1])
        first = np.zeros(len(raw), bool)
        first[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.r_[word_starts(raw, first, self.classes), len(raw)].astype("i4")
        told = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data).dictionary_encode()
        distinct = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        joined = pa.array(self.word.all(distinct, self._new_words), pa.binary()).take(told.indices)
        _, ends, ids = joined.buffers()
        cuts = np.frombuffer(ends, "i4", len(joined) + 1)[np.searchsorted(starts, at)].tolist()
        ids = memoryview(ids or b"")
        return [bytes(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _many(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._pieces(t) for t in texts]
        found = iter(self._bulk([piece for pieces in cut for piece, plain in pieces if plain]))
        for pieces in cut:
            yield b"".join([next(found) if plain else self(piece) for piece, plain in pieces])

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``self(text)`` of each text."""
        held, chars = [], 0
        for text in texts:
            if held and chars + len(text) > BULK_CHARS:
                yield from self._many(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        yield from self._many(held)


def encoder(path: str) -> Encoder:
    return remembered(("encoder", path), lambda: Encoder(path))
