"""SentencePiece encoding and decoding with sampled segmentations.

Every way to cut a text into pieces is a path through its lattice; a path's
probability is the product of its pieces' weights over the sum of all paths.
Gumbel top-k draws k distinct paths without replacement: each path gets its log
probability plus Gumbel noise, and the k largest are found by A-star search from the
root, where the bound of a set of paths is its exact perturbed maximum.  A node's
children share its maximum: one child keeps it, the others' maxima are drawn given
that they are smaller.

Following the child that keeps the maximum is ancestral sampling, done for all words
of many texts at once with numpy, as is all else that each text needs.  The siblings passed by on a path all have maxima
below the path's own, so the largest of them is one draw for the mass of them all, and
which sibling has it is a second draw by their masses; no sibling needs noise of its
own.  Each path of a text offers its largest sibling not taken yet, and the next path
resumes at the largest offer.  Noise is a hash of the row key and the place in the
search, so samples depend on nothing else.

No piece crosses a word's start or a line's end, or joins a letter to certain marks,
so the lattice of each distinct part of a word is built once per worker.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, body, remembered

SPACE = "▁"
#: Texts sampled together hold about this many words; lattices are kept up to this many
#: places (some 100 bytes each) and parts of words.
CHUNK_WORDS, KEPT_PLACES, KEPT_PARTS = 60_000, 4_000_000, 700_000
#: Siblings that weigh less than exp(-DEEP) of the others together are beyond double precision.
DEEP = 40.0
_HALF = np.log(0.5)
_UNITS = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
#: What characters are to the places where words and their parts begin.
_LETTER, _MARK, _SPACE, _LINE = 1, 2, 3, 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: Keeps the draws of one turn of the search apart: of offers (new path, its parent) and of the sibling taken (place, arc).
_USES = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) by hashing 64-bit keys."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = x ^ (x >> np.uint64(shift))
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(12)
    out = x.astype("f8")
    out += 0.5
    out /= 2.0**52
    return out


def below(limit: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of Gumbel draws whose log masses add up to ``mass``, given that it is below ``limit``."""
    return mass - np.logaddexp(mass - limit, np.log(-np.log(u)))


#: Per place its first arc, and there the log probability of all arcs but the first, which is the likeliest.
_PLACES = {"start": "i4", "others": "f8"}
#: Per arc the sum of probabilities up to it (2 at the last of its place), its log probability there, the first
#: arc of the place it leads to (-1: the end), its piece, its place and the number of arcs there.  What a draw
#: reads of an arc lies together, half a line of cache.
_ARC = np.dtype([("cum", "f8"), ("logp", "f8"), ("next", "i4"), ("piece", "i4"), ("place", "i4"), ("count", "i4")])
_ARCS = {"arcs": _ARC}


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def sums_within(x: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each head."""
    sums = np.cumsum(x)
    return sums - np.repeat(sums[heads] - x[heads], sizes)


class Lattices:
    """Vocabulary of a SentencePiece model, and the lattices of the words seen so far.

    A piece weighs ``-sharpness * log(2 + rank)``, its rank being the negated score
    of the (byte-pair) model; characters without a piece are spelt in bytes.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.size, self.surface, self.ids = n, [], []
        self.bytes, self.pieces, weights = {}, {}, []
        for k in range(n):
            text = self.model.id_to_piece(k)
            special = self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k)
            if self.model.is_byte(k):
                self.bytes[int(text[3:5], 16)] = k
            elif not special:
                if SPACE in text.lstrip(SPACE) or "\n" in text and len(text) > 1:
                    raise ValueError(f"pieces like {text!r} cross words; this sampler cuts texts into words")
                self.pieces[text] = k
            weights.append(-sharpness * float(np.log(2 + min(-self.model.get_score(k), 1e9))))
            self.surface.append("" if special else text)
            self.ids.append(np.uint32(k).tobytes())
        self.weights, self.spelt, self.written = weights, {}, None
        self.byte_weight = -sharpness * float(np.log(2 + n))
        self.keys, self.known = self.prefix_table()
        self.longest = max(map(len, self.pieces))
        # marks that no piece joins to a letter: words may be cut between the two
        joined = {b for p in self.pieces for pair in zip(p, p[1:]) for a, b in (pair, pair[::-1]) if a.isalpha() and not b.isalpha()}
        self.kinds = np.fromiter((chr(c).isalpha() for c in range(0x110000)), "u1", 0x110000) * np.uint8(_LETTER)
        self.kinds[[ord(c) for c in string.punctuation if c not in joined]] = _MARK
        self.kinds[[ord(" "), ord(SPACE)]], self.kinds[ord("\n")] = _SPACE, _LINE
        self.clear()

    def prefix_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the beginnings of pieces (0: none) at the first free slot from their highest bits on, and the piece each is, or -1."""
        starts = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)}, key=len)
        sizes = np.array([len(p) for p in starts])
        h = np.zeros(len(starts), "u8")
        for k in range(sizes[-1]):
            a = np.searchsorted(sizes, k, "right")  # the first longer than k
            h[a:] = self.mixed(h[a:], np.array([ord(p[k]) for p in starts[a:]], "u8"))
        bits = (4 * len(starts)).bit_length()
        keys, known = np.zeros(2**bits, "u8"), np.full(2**bits, -1, "i4")
        free = [True] * 2**bits
        for p, key, slot in zip(starts, h, (h >> np.uint64(64 - bits)).tolist()):
            while not free[slot]:
                slot = (slot + 1) % 2**bits
            free[slot], keys[slot], known[slot] = False, key, self.pieces.get(p, -1)
        return keys, known

    def clear(self) -> None:
        self.parts: dict[bytes, int] = {}  # first arc of each part, which is written in four bytes a character
        # memory is taken up page by page as it is written to
        self.held = {name: np.empty(n, kind) for names, n in ((_PLACES, 2 * KEPT_PLACES), (_ARCS, 8 * KEPT_PLACES)) for name, kind in names.items()}
        for name, buffer in self.held.items():
            setattr(self, name, buffer[:0])

    def append(self, **columns: np.ndarray) -> None:
        """Lengthen columns; buffers that do not suffice double."""
        for name, more in columns.items():
            n, buffer = len(getattr(self, name)), self.held[name]
            if n + len(more) > len(buffer):
                buffer = self.held[name] = np.concatenate([buffer[:n], np.empty(max(n, len(more)) + len(more), buffer.dtype)])
            buffer[n : n + len(more)] = more
            setattr(self, name, buffer[: n + len(more)])

    def in_bytes(self, char: str) -> int:
        """Number of the pseudo-piece that spells a character in bytes."""
        if char not in self.spelt:
            raw = char.encode("utf-8", "surrogatepass")
            self.spelt[char] = len(self.surface)
            self.surface.append(char)
            self.ids.append(b"".join(self.ids[self.bytes[b]] for b in raw))
            self.weights.append(self.byte_weight * len(raw))
        return self.spelt[char]

    def build(self, new: list[bytes]) -> np.ndarray:
        """Build the lattices of parts, all at once, and give their first arcs: pieces are found by hashed substrings of growing length."""
        sizes = np.fromiter(map(len, new), "i8", len(new)) // 4
        codes = np.frombuffer(b"".join(new), "<u4").astype("u8")
        total, ends = len(codes), np.repeat(np.cumsum(sizes), sizes)

        at, to, piece = [], [], []
        alive, h = np.arange(total), np.zeros(total, "u8")
        slots = np.uint64(65 - len(self.keys).bit_length())
        for n in range(1, self.longest + 1):
            fits = alive + n <= ends[alive]
            alive, h = alive[fits], self.mixed(h[fits], codes[alive[fits] + n - 1])
            if not len(alive):
                break
            k = (h >> slots).astype("i8")
            there = self.keys[k]
            ok = there == h
            other = np.flatnonzero(~ok & (there > 0))
            while len(other):
                k[other] = (k[other] + 1) % len(self.keys)
                there = self.keys[k[other]]
                ok[other] = same = there == h[other]
                other = other[~same & (there > 0)]
            known = self.known[k]
            if n == 1:  # characters without a piece
                bare = np.ones(total, bool)
                bare[alive[ok & (known >= 0)]] = False
                bare = np.flatnonzero(bare)
                at.append(bare)
                to.append(bare + 1)
                piece.append(np.array([self.in_bytes(chr(c)) for c in codes[bare].tolist()], "i4"))
            alive, h, found = alive[ok], h[ok], known[ok]
            whole = found >= 0
            at.append(alive[whole])
            to.append(alive[whole] + n)
            piece.append(found[whole])
        at, to, piece = map(np.concatenate, (at, to, piece))
        away = ends[at] - at  # arcs by their distance from the word's end, so that what lies ahead comes first
        order = np.argsort(away * (total + 1) + at)
        at, to, piece, away = at[order], to[order], piece[order], away[order]
        weight = np.array(self.weights)[piece]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        ahead = np.zeros(total + 1)  # log of the weight of all ways on from a place; a word's end is the last
        last = to == ends[at]
        to[last] = total
        levels = np.flatnonzero(np.r_[True, away[1:] != away[:-1], True])
        heads = np.searchsorted(first, levels)
        for a, b, x, y in zip(levels[:-1].tolist(), levels[1:].tolist(), heads[:-1].tolist(), heads[1:].tolist()):
            on = weight[a:b] + ahead[to[a:b]]
            if b - a < 200:
                ahead[at[first[x:y]]] = np.logaddexp.reduceat(on, first[x:y] - a)
            else:
                top = np.maximum.reduceat(on, first[x:y] - a)
                on -= np.repeat(top, count[x:y])
                ahead[at[first[x:y]]] = top + np.log(np.add.reduceat(np.exp(on), first[x:y] - a))
        logp = weight + ahead[to] - ahead[at]
        p = np.exp(logp)
        order = np.argsort(np.repeat(np.arange(0.5, len(first)), count) - p / 2)  # the likeliest of a place first
        to, piece, logp, p = to[order], piece[order], logp[order], p[order]
        cum = sums_within(p, first, count)
        cum[first + count - 1] = 2.0
        p[first] = 0.0
        arcs, place = len(self.arcs), len(self.start)
        start, others = np.empty(total + 1, "i8"), np.empty(total)
        start[at[first]], start[total] = first + arcs, -1
        with np.errstate(divide="ignore"):
            others[at[first]] = np.log(np.add.reduceat(p, first))
        more = np.empty(len(to), _ARC)
        more["cum"], more["logp"], more["next"], more["piece"], more["place"], more["count"] = cum, logp, start[to], piece, at + place, np.repeat(count, count)
        self.append(start=start[:total], others=others)
        self.append(arcs=more)
        found = start[np.cumsum(sizes) - sizes]
        self.parts |= zip(new, found.tolist())
        return found

    def shares(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of arcs, and of all other arcs at their places."""
        at = self.arcs.take(arcs)
        place, logp = at["place"], at["logp"].copy()
        return logp, np.where(self.start[place] == arcs, self.others[place], np.log1p(-np.exp(np.minimum(logp, _HALF))))

    @staticmethod
    def mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ (code + np.uint64(1))) * _A
        return h ^ (h >> np.uint64(29))

    def units(self, text: str) -> list[str]:
        return _UNITS(SPACE + text.replace(" ", SPACE)) if text else []

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Parts of the units of all texts, in four bytes a character, and where each text's begin, with the end."""
        data = "".join([SPACE + t for t in texts if t]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(data, "<u4").copy()
        codes[codes == ord(" ")] = ord(SPACE)
        kind = self.kinds[codes]
        line, space = kind == _LINE, kind == _SPACE
        head = line.copy()
        head[1:] |= line[:-1] | space[1:] & ~space[:-1] | (kind[1:] * kind[:-1] == _LETTER * _MARK)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        bounds = np.append(0, np.cumsum(sizes))
        head[bounds[:-1][sizes > 0]] = True
        starts = np.append(np.flatnonzero(head), len(codes))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(4 * starts), pa.py_buffer(codes)])
        return parts, np.searchsorted(starts, bounds)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First arcs of the parts of all texts' words, and where each text's begin, with the end."""
        if len(self.start) > KEPT_PLACES or len(self.parts) > KEPT_PARTS:
            self.clear()
        parts, bounds = self.split(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.parts.get, distinct, repeat(-1)), "i8", len(distinct))
        if len(new := np.flatnonzero(found < 0)):
            found[new] = self.build([distinct[i] for i in new.tolist()])
        return found[coded.indices.to_numpy()], bounds

    def ids_of(self, pieces: np.ndarray) -> bytes:
        """Ids as ``<u4`` bytes; characters spelt in bytes have several."""
        odd = np.flatnonzero(pieces >= self.size)
        if not len(odd):
            return pieces.astype("<u4").tobytes()
        raw, a, out = pieces.astype("<u4").tobytes(), 0, []
        for k in odd.tolist():
            out += (raw[4 * a : 4 * k], self.ids[pieces[k]])
            a = k + 1
        return b"".join([*out, raw[4 * a :]])

    def spell(self, pieces: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Text of pieces in UTF-8 with all spaces, and where each piece's begins, with the end."""
        if self.written is None or len(self.written) < len(self.surface):
            self.written = pa.array([x.replace(SPACE, " ").encode("utf-8", "surrogatepass") for x in self.surface], pa.large_binary())
        out = self.written.take(pa.array(pieces))
        _, ends, data = out.buffers()
        return memoryview(data if data is not None else b"").cast("B"), np.frombuffer(ends, "i8", len(out) + 1, 8 * out.offset)

    def decode(self, pieces: np.ndarray) -> str:
        data, ends = self.spell(pieces)
        return bytes(data[ends[0] : ends[-1]]).decode("utf-8", "surrogatepass")[1:]

    def round_trips(self, found: list[np.ndarray], text: str) -> list[bool]:
        """Whether segmentations decode to a text."""
        want = text.encode("utf-8", "surrogatepass")
        data, ends = self.spell(np.concatenate(found))
        cuts = ends[np.cumsum([0, *map(len, found)])].tolist()
        return [data[a + 1 : b] == want for a, b in zip(cuts[:-1], cuts[1:])]


def lattices(path: str, sharpness: float = 1.0) -> Lattices:
    return remembered(("lattices", path, sharpness), lambda: Lattices(path, sharpness))


def _descend(lat: Lattices, first: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow each part from its first arc to its end by draws from a seed each; (arcs taken, their parts, their numbers there)."""
    part, arc, step, found = np.arange(len(first)), first.copy(), 0, []
    while len(part):
        u = uniform(seed ^ np.uint64((step * int(_C) + int(_B)) % 2**64))
        cum = lat.arcs["cum"]
        beyond = np.flatnonzero(u >= cum[arc])
        while len(beyond):
            arc[beyond] += 1
            beyond = beyond[u[beyond] >= cum[arc[beyond]]]
        found.append((arc, part))
        on = lat.arcs["next"][arc]
        if len(go := np.flatnonzero(on >= 0)) < len(part):
            part, seed, on = part[go], seed[go], on[go]
        arc, step = on.astype("i8"), step + 1
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate([a for a, _ in found]), np.concatenate([p for _, p in found]), np.repeat(np.arange(step), [len(a) for a, _ in found])


class _Path:
    """A segmentation found: its arcs and the siblings passed by.

    ``passed`` holds, per arc, the log mass of the siblings there that no path has taken
    and ``top`` the largest of them; arcs before the one where the path left its parent
    belong to the parent.  It ends where all that follows weighs less than exp(-DEEP) of
    it, and grows when that changes.  ``prefix`` is the log probability up to each arc
    looked at and ``beyond`` that of all of them.
    """

    __slots__ = ("arcs", "pieces", "log_p", "own", "prefix", "passed", "beyond", "top", "taken", "offer")

    def __init__(self, arcs: np.ndarray, pieces: np.ndarray, log_p: float, own: int):
        self.arcs, self.pieces, self.log_p, self.own = arcs, pieces, log_p, own
        self.prefix = self.passed = _NONE
        self.beyond, self.top, self.taken, self.offer = 0.0, -np.inf, {}, -np.inf

    def wants(self) -> bool:
        """Whether the siblings of further arcs may count."""
        n = len(self.passed)
        return n < len(self.arcs) and (not n or self.beyond > self.top - DEEP)


_NONE = np.empty(0)


def _reach(lat: Lattices, paths: list[_Path]) -> None:
    """Look at further arcs of paths while their siblings may count."""
    while paths := [p for p in paths if p.wants()]:
        parts = [p.arcs[len(p.passed) : max(2 * max(len(p.passed), p.own), max(len(p.passed), p.own) + 64)] for p in paths]
        sizes = np.array([len(x) for x in parts])
        heads = np.cumsum(sizes) - sizes
        arcs = np.concatenate(parts)
        logp, others = lat.shares(arcs)
        sums = sums_within(logp, heads, sizes) + np.repeat([p.beyond for p in paths], sizes)
        prefix = np.append(0.0, sums[:-1])
        prefix[heads] = [p.beyond for p in paths]
        passed = prefix + others
        for p, a, n in zip(paths, heads.tolist(), sizes.tolist()):
            if not len(p.passed):
                passed[a : a + p.own] = -np.inf
        tops = np.maximum.reduceat(passed, heads).tolist()
        beyond = sums[heads + sizes - 1].tolist()
        for p, a, n, top, b in zip(paths, heads.tolist(), sizes.tolist(), tops, beyond):
            more = passed[a : a + n], prefix[a : a + n]
            p.passed, p.prefix = map(np.concatenate, ((p.passed, more[0]), (p.prefix, more[1]))) if len(p.passed) else more
            p.top, p.beyond = max(p.top, top), b


def _chosen(logs: np.ndarray, heads: np.ndarray, sizes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Per span one of its places, by their log masses; each span has one above -inf."""
    top = np.maximum.reduceat(logs, heads)
    mass = sums_within(np.exp(logs - np.repeat(top, sizes)), heads, sizes)
    found = np.add.reduceat(mass <= np.repeat(u * mass[heads + sizes - 1], sizes), heads, dtype="i8")
    for k in np.flatnonzero(found >= sizes).tolist():  # rounding
        found[k] = np.flatnonzero(logs[heads[k] : heads[k] + sizes[k]] > -np.inf)[-1]
    return found


def _take(lat: Lattices, paths: list[_Path], u: np.ndarray) -> tuple[list[int], list[int]]:
    """(positions, arcs) of the siblings that paths offer, one each, which are then no longer there."""
    sizes = np.array([len(p.passed) for p in paths])
    where = _chosen(np.concatenate([p.passed for p in paths]), np.cumsum(sizes) - sizes, sizes, u[:, 0]).tolist()
    own = np.array([p.arcs[at] for p, at in zip(paths, where)])
    at = lat.arcs.take(own)
    sizes = at["count"].astype("i8")
    heads, start = np.cumsum(sizes) - sizes, lat.start[at["place"]].astype("i8")
    arcs = spans(start, sizes)
    logp = lat.arcs["logp"][arcs]
    shift = (heads - start).tolist()
    gone = [p.taken.setdefault(x, [a]) for p, x, a in zip(paths, where, own.tolist())]
    logp[[a + s for g, s in zip(gone, shift) for a in g]] = -np.inf
    spot = heads + _chosen(logp, heads, sizes, u[:, 1])
    chosen = arcs[spot].tolist()
    logp[spot] = -np.inf
    top = np.maximum.reduceat(logp, heads)
    top[top == -np.inf] = 0.0
    with np.errstate(divide="ignore"):
        others = top + np.log(np.add.reduceat(np.exp(logp - np.repeat(top, sizes)), heads))
    for p, x, a, g, o in zip(paths, where, chosen, gone, others.tolist()):
        g.append(a)
        p.passed[x] = p.prefix[x] + o
        p.top = float(p.passed.max())
    _reach(lat, paths)
    return where, chosen


def _offers(paths: list[_Path], limits: list[float], u: np.ndarray) -> None:
    """Draw the largest sibling of each path, given that it is below a limit."""
    for p in paths:
        p.offer = -np.inf
    some = [k for k, p in enumerate(paths) if p.top > -np.inf]
    if not some:
        return
    sizes, top = np.array([len(paths[k].passed) for k in some]), np.array([paths[k].top for k in some])
    passed = np.concatenate([paths[k].passed for k in some])
    mass = top + np.log(np.add.reduceat(np.exp(passed - np.repeat(top, sizes)), np.cumsum(sizes) - sizes))
    for k, x in zip(some, below(np.array(limits)[some], mass, u[some]).tolist()):
        paths[k].offer = x


def sample(lat: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to ``k`` (pieces, log probability, log inclusion probability), most perturbed first."""
    parts, bounds = lat.places(texts)
    seeds = keys.astype("i8").view("u8") * _A + _B
    paths: list[list[_Path]] = [[] for _ in texts]
    # (text, perturbed value, arcs already fixed, arc to go on from or -1, first part after it)
    none = np.empty(0, "i8")
    todo = [(i, x, none, -1, 0) for i, x in enumerate((-np.log(-np.log(uniform(seeds)))).tolist())]
    for turn in range(1, k + 1):
        salted = seeds * _C + np.uint64((turn * int(_A)) % 2**64)
        text, value, fixed, on, part = map(list, zip(*todo)) if todo else ([], [], [], [], [])
        text, on = np.array(text, "i8"), np.array(on, "i8")
        first = np.array(part, "i8") - (on >= 0)
        runs = bounds[text + 1] - bounds[text] - first
        at = spans(bounds[text] + first, runs)
        seed = np.repeat(salted[text], runs) ^ ((at - np.repeat(bounds[text], runs)).astype("u8") * _A)
        begun = np.append(0, np.cumsum(runs))
        at = parts[at]
        at[begun[:-1][on >= 0]] = on[on >= 0]
        arcs, of, step = _descend(lat, at, seed)

        # all paths one after another, each with what is fixed first
        ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(at))))
        own = np.array([len(f) for f in fixed], "i8")
        cuts = np.append(0, np.cumsum(ends[begun[1:]] - ends[begun[:-1]] + own))
        flat = np.empty(int(cuts[-1]), "i8")
        flat[(ends[:-1] + np.repeat(np.cumsum(own), runs))[of] + step] = arcs
        flat[spans(cuts[:-1], own)] = np.concatenate([none, *fixed])
        at = lat.arcs.take(flat)
        flat, pieces, sums = flat.astype("i4"), at["piece"].copy(), np.append(at["logp"], 0.0)
        sums = np.where(np.diff(cuts) > 0, np.add.reduceat(sums, cuts[:-1]), 0.0).tolist()
        new = [_Path(flat[a:b], pieces[a:b], x, n) for a, b, x, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), sums, own.tolist())]
        _reach(lat, new)
        for i, p in zip(text.tolist(), new):
            paths[i].append(p)
        use = np.zeros(len(new), "i8")
        if turn > 1:  # the path it left offers the next of its siblings
            new, value, text, use = new + left, value * 2, np.append(text, text), np.append(use, use + 1)
        _offers(new, value, uniform(salted[text] ^ _USES[use]))
        if turn == k:
            break
        best = [(i, max(found, key=lambda p: p.offer)) for i, found in enumerate(paths) if len(found) == turn]
        best = [(i, p) for i, p in best if p.offer > -np.inf]
        if not best:
            break
        chosen, left = map(list, zip(*best))
        value = [p.offer for p in left]
        draws = np.stack([uniform(salted[chosen] ^ _USES[2]), uniform(salted[chosen] ^ _USES[3])], axis=1)
        where, taken = _take(lat, left, draws)
        before = np.concatenate([p.arcs[:x] for p, x in zip(left, where)])
        whole = np.append(0, np.cumsum(lat.arcs["next"][before] < 0))[np.cumsum([0, *where])]
        follow = lat.arcs["next"][taken].tolist()
        todo = [
            (i, x, np.append(p.arcs[:n], arc), on, words + 1)
            for i, x, p, n, arc, on, words in zip(chosen, value, left, where, taken, follow, np.diff(whole).tolist())
        ]
    out = []
    for found in paths:
        rest = max(p.offer for p in found)  # the largest that was not taken
        each = []
        for p in found:
            x = p.log_p - rest
            log_in = 0.0 if x > 700 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            each.append((p.pieces, p.log_p, log_in))
        out.append(each)
    return out


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, rank, n_ids, ids_crc32, log_prob, log_inclusion, round_trip (and ids) per sampled segmentation.

    Each text gets ``k`` distinct segmentations, or all where it has fewer.  Null text
    counts as empty and has one segmentation, of no pieces.  Rows that repeat an
    identifier draw alike.  A text's own marks of the space symbol are read as spaces,
    as the model does, so such texts do not round-trip.  Other columns are ignored.
    """
    schema = "doc_id long, rank int, n_ids long, ids_crc32 long, log_prob double, log_inclusion double, round_trip boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattices(model, sharpness)
        for pdf in batches:
            sizes = np.array([t.count(" ") + 1 for t in pdf["body"].tolist()], "i8")
            cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_WORDS)) + 1, len(pdf)]
            for a, b in zip(cut[:-1], cut[1:]):
                part = pdf.iloc[a:b]
                if not len(part):
                    continue
                texts, rows = part["body"].tolist(), []
                for doc_id, text, found in zip(part["doc_id"].tolist(), texts, sample(lat, texts, part["doc_id"].to_numpy("i8"), k)):
                    back = lat.round_trips([pieces for pieces, *_ in found], text)
                    for rank, (pieces, log_p, log_in) in enumerate(found):
                        ids = lat.ids_of(pieces)
                        row = [doc_id, rank, len(ids) // 4, zlib.crc32(ids), log_p, log_in, back[rank]]
                        rows.append([*row, np.frombuffer(ids, "<u4").astype("i4")] if with_ids else row)
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), body(text_col).alias("body"))
    out = rows.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
