"""Language ID by interpolated Kneser-Ney character models.

One model per language over the characters of words (contexts start at a word's
edge), kept as sorted arrays of n-gram hashes with their discounted probabilities,
and of context hashes with their interpolation weights.  A text gets the language
with the lowest cross-entropy per character; a temperature fitted on documents the
counts did not see turns the differences into a probability, and a rejection level
per language is taken from the cross-entropies of those documents.

As contexts end at word edges, a text's cross-entropy is a sum over its words.  Texts
are cut at white space and common marks, and a worker keeps the scores of the cuttings
it meets most; new ones are scored for all languages in one search of merged arrays.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, cut, remembered, trim

ORDER = 5
UNKNOWN = "und"
#: The models are fitted on about this many labelled documents per language, and in all
#: (chosen by hashed identifier; texts longer than SAMPLE_CHARS only where a language has
#: no others, and then that much of them).  Of a language's documents every fifth only
#: calibrates.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS = 500, 20_000, 100_000
#: Cross-entropies up to this many standard deviations (or REJECT_LEAST nats) above
#: those of a language's calibration documents are accepted, and short texts get
#: SHORT / sqrt(characters) more: mixed languages, codes and numbers are no ground to reject.
REJECT_SIGMAS, REJECT_LEAST, SHORT = 6.0, 1.75, 5.0
#: Confidence is judged as if a text had at most this many characters: neighbouring
#: characters are not independent evidence.
EVIDENCE = 400
#: Cuttings of texts remembered by a worker; of more, the half used most stays.
CACHE_WORDS = 150_000
#: Texts scored together, and about how many characters of them.
BATCH_TEXTS, BATCH_CHARS = 500, 1_000_000
#: Marks that texts are cut at besides white space; no word holds them.
MARKS = ".,;:!?"
_WORDS = re.compile(r"[^\W\d_]+").findall
_PRIME = np.uint64(0x100000001B3)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes that end at each place from ORDER - 1 on."""
    h = np.full(len(codes) - ORDER + 1, 0xCBF29CE484222325 + n, "u8")
    for k in range(n):
        h = (h ^ codes[ORDER - n + k : len(codes) - n + k + 1]) * _PRIME
        h ^= h >> np.uint64(31)
    return h


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each after ORDER - 1 edge marks and before one; which places predict; of which word."""
    text = ("\0" * (ORDER - 1)).join(["", *[w + "\0" for w in words]])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    sizes = np.array([len(w) + 1 for w in words], "i8")
    ends = np.cumsum(sizes + ORDER - 1)
    first = ends - sizes
    at = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    return codes, at - (ORDER - 1), np.repeat(np.arange(len(words)), sizes)


def cuttings(text: str) -> list[str]:
    """A text in lower case, cut where no word goes on."""
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    return text.split()


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to be scored together."""
    a = chars = 0
    for k, t in enumerate(texts):
        if k - a == BATCH_TEXTS or k > a and chars + len(t or "") > BATCH_CHARS:
            yield a, k
            a, chars = k, 0
        chars += len(t or "")
    if len(texts) > a:
        yield a, len(texts)


class Model:
    """Interpolated Kneser-Ney with one discount per order, from word counts."""

    def __init__(self, counts: Counter):
        words = sorted(counts)
        codes, at, owner = spell(words)
        weight = np.array([counts[w] for w in words], "f8")[owner]
        hashed = [grams(codes, n)[at] for n in range(1, ORDER + 1)]
        shorter = [np.zeros(len(at), "u8"), *[grams(np.r_[np.uint64(0), codes[:-1]], n)[at] for n in range(1, ORDER)]]
        self.keys, self.disc, self.ctx, self.gamma = [], [], [], []
        for n in range(ORDER):
            keys, first, where = np.unique(hashed[n], return_index=True, return_inverse=True)
            if n == ORDER - 1:
                c = np.bincount(where, weight)
            else:  # in how many longer n-grams it ends
                longer = np.unique(hashed[n + 1], return_index=True)[1]
                c = np.bincount(where[longer], minlength=len(keys)).astype("f8")
            ones, twos = (c == 1).sum(), (c == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, of = np.unique(shorter[n][first], return_inverse=True)
            total = np.bincount(of, c)
            self.keys.append(keys)
            self.disc.append(np.maximum(c - d, 0) / total[of])
            self.ctx.append(ctx)
            self.gamma.append(np.bincount(of, np.minimum(c, d)) / total)
        self.floor = 1 / (len(self.keys[0]) + 1)

    def log_probs(self, hashed: list[np.ndarray], shorter: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(hashed[0]), self.floor)
        for n in range(ORDER):
            k = np.minimum(np.searchsorted(self.keys[n], hashed[n]), len(self.keys[n]) - 1)
            c = np.minimum(np.searchsorted(self.ctx[n], shorter[n]), len(self.ctx[n]) - 1)
            known = self.ctx[n][c] == shorter[n]
            disc = np.where(known & (self.keys[n][k] == hashed[n]), self.disc[n][k], 0)
            p = disc + np.where(known, self.gamma[n][c], 1) * p
        return np.log(p)


@dataclass
class Identifier:
    """Models by language with temperature and highest accepted cross-entropy."""

    languages: list[str]
    models: list[Model]
    temperature: float = 1.0
    reject_above: tuple[float, ...] = ()

    def __post_init__(self):
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table", "uses", "merged")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(self.languages) + 1), "f8")
        self.uses = np.empty(0, "i8")
        self.merged: list[tuple[np.ndarray, ...]] = []

    def shrink(self) -> None:
        """Keep the cuttings used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_WORDS // 2])
        names = list(self.known)
        self.known = {names[k]: row for row, k in enumerate(keep.tolist())}
        self.table, self.uses = self.table[keep], self.uses[keep] // 2

    def merge(self) -> None:
        """Per order the n-grams and contexts of all languages, and a row of values a language each; the last row is that of the unknown."""
        for n in range(ORDER):
            keys, ctx = (np.unique(np.concatenate(x)) for x in ([m.keys[n] for m in self.models], [m.ctx[n] for m in self.models]))
            disc, gamma = np.zeros((len(keys) + 1, len(self.models))), np.ones((len(ctx) + 1, len(self.models)))
            for j, m in enumerate(self.models):
                disc[np.searchsorted(keys, m.keys[n]), j] = m.disc[n]
                gamma[np.searchsorted(ctx, m.ctx[n]), j] = m.gamma[n]
            self.merged.append((keys, disc, ctx, gamma))

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word the sums of log probabilities by language, and its number of places."""
        if not self.merged:
            self.merge()
        codes, at, owner = spell(words)
        codes = np.r_[np.uint64(0), codes]
        hashed = [grams(codes, n) for n in range(1, ORDER + 1)]
        _, first, where = np.unique(hashed[-1][at + 1], return_index=True, return_inverse=True)  # places alike in their last ORDER characters
        here = at[first]
        p = np.repeat(np.array([[m.floor for m in self.models]]), len(here), axis=0)
        for n, (keys, disc, ctx, gamma) in enumerate(self.merged):
            gram, shorter = hashed[n][here + 1], hashed[n - 1][here] if n else np.zeros(len(here), "u8")
            k = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            c = np.minimum(np.searchsorted(ctx, shorter), len(ctx) - 1)
            p *= gamma[np.where(ctx[c] == shorter, c, len(ctx))]
            p += disc[np.where(keys[k] == gram, k, len(keys))]
        logp = np.log(p)[where]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.column_stack([np.add.reduceat(logp, starts, axis=0), np.diff(np.r_[starts, len(owner)])])

    def learn(self, cuttings: list[str]) -> None:
        """Score cuttings not seen yet; a row of the table has the sums of one's words and their number of places."""
        others = [c for c in cuttings if not c.isalpha()]
        split = [[w for w in _WORDS(c) if any(map(str.isalpha, w))] for c in others]
        plain = [c for c in cuttings if c.isalpha()]
        words = list(dict.fromkeys(chain(plain, chain.from_iterable(split))))
        rows = np.zeros((len(words), len(self.languages) + 1))
        for a in range(0, len(words), 20_000):
            rows[a : a + 20_000] = self.scores(words[a : a + 20_000])
        place = dict(zip(words, range(len(words)))) if others else {}
        of = np.repeat(np.arange(len(split)), [len(w) for w in split])
        held = rows[[place[w] for w in chain.from_iterable(split)]]
        sums = np.column_stack([np.bincount(of, x, len(others)) for x in held.T])
        self.known |= zip(plain + others, range(len(self.table), len(self.table) + len(cuttings)))
        self.table = np.concatenate([self.table, rows[: len(plain)], sums])
        self.uses = np.concatenate([self.uses, np.zeros(len(cuttings), "i8")])

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for each text and language, and the characters counted (0: no letter)."""
        total = np.zeros((len(texts), len(self.languages) + 1))
        for a, b in batches_of(texts):
            total[a:b] = self.sums(texts[a:b])
        n = total[:, -1]
        return -total[:, :-1] / np.maximum(n, 1)[:, None], n

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Per text the sums of its cuttings' rows."""
        split = [cuttings(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.shrink()
        sizes = np.fromiter(map(len, split), "i8", len(split))
        at = np.fromiter(map(self.known.get, chain.from_iterable(split), repeat(-1)), "i8", int(sizes.sum()))
        if len(missed := np.flatnonzero(at < 0)):
            every = list(chain.from_iterable(split))
            new = [every[k] for k in missed.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[missed] = np.fromiter(map(self.known.__getitem__, new), "i8", len(new))
        self.uses += np.bincount(at, minlength=len(self.uses))
        total, some = np.zeros((len(texts), self.table.shape[1])), np.flatnonzero(sizes)
        if len(some):
            heads = (np.cumsum(sizes) - sizes)[some]
            for j in range(total.shape[1]):
                total[some, j] = np.add.reduceat(self.table[at, j], heads)
        return total

    def beliefs(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = -entropy * (np.minimum(n, EVIDENCE) * self.temperature)[:, None]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def identify(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "entropy": np.nan, "accepted": False})
        entropy, n = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        some = n > 0
        return pd.DataFrame(
            {
                "lang_pred": np.where(some, np.array(self.languages, object)[best], UNKNOWN),
                "score": np.where(some, self.beliefs(entropy, n).max(axis=1), 0.0),
                "entropy": np.where(some, low, np.nan),
                "accepted": some & (low <= np.array(self.reject_above or [np.inf] * len(self.languages))[best] + SHORT / np.sqrt(np.maximum(n, 1))),
            }
        )


def fit(samples: list[tuple[str, str]]) -> Identifier:
    """Identifier from (language, text) pairs; a language of fewer than five texts has none set apart."""
    counts: dict[str, Counter] = {}
    seen: Counter[str] = Counter()
    apart: list[tuple[str, str]] = []
    for lang, text in samples:
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            apart.append((lang, text))
        else:
            counts.setdefault(lang, Counter()).update(_WORDS(text.lower()))
    languages = sorted(lang for lang, c in counts.items() if c)
    found = Identifier(languages, [Model(counts[lang]) for lang in languages])
    apart = [(lang, t) for lang, t in apart if lang in languages and _WORDS(t)]
    if not apart:
        return found
    entropy, n = found.entropies([t for _, t in apart])
    truth = np.array([languages.index(lang) for lang, _ in apart])
    own = entropy[np.arange(len(truth)), truth]

    def loss(temperature: float) -> float:
        found.temperature = temperature
        return -np.log(np.maximum(found.beliefs(entropy, n)[np.arange(len(truth)), truth], 1e-12)).mean()

    found.temperature = min((2.0**-k for k in range(12)), key=loss)
    level = lambda x: x.mean() + max(REJECT_SIGMAS * x.std(), REJECT_LEAST)
    found.reject_above = tuple(level(own[truth == k]) if (truth == k).any() else np.inf for k in range(len(languages)))
    return found


def training_sample(docs: DataFrame, learn_from: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About SAMPLE_DOCS (language, text) pairs per language, SAMPLE_ALL in all at most, by hashed identifier."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)).alias("draw"), (F.length(text_col) > SAMPLE_CHARS).alias("long")
    )
    counts = cut(rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count(F.lit(1)).alias("n")))  # a row per language
    languages = counts.count()
    wanted = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // max(1, languages)))
    share = counts.select("lang", (F.col("short") == 0).alias("long_too"), (F.lit(1_000_000 * wanted) / F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n"))).alias("below"))
    share = F.broadcast(share) if languages <= SAMPLE_ALL else share  # a few bytes each
    chosen = rows.join(share, "lang").where((F.col("draw") < F.col("below")) & (~F.col("long") | F.col("long_too")))
    found = chosen.select("lang", "draw", F.substring("body", 1, SAMPLE_CHARS).alias("body")).limit(2 * SAMPLE_ALL).collect()
    return [(r.lang, r.body) for r in sorted(found, key=lambda r: (r.draw, r.body))]


def keep_accepted(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text some learnt language explains, with all their columns.

    Null text, text without a letter and text far from every language go; nothing is
    shuffled.  Where nothing could be learnt there is no ground to reject, and all
    rows stay.
    """
    if not identifier.languages:
        return docs
    shared, key = docs.sparkSession.sparkContext.broadcast(identifier), ("language", uuid.uuid4().hex)  # bounded by the sample

    @F.pandas_udf("boolean")  # only texts go to the worker, and a flag comes back
    def accepted(texts: pd.Series) -> pd.Series:
        own = remembered(key, lambda: copy.copy(shared.value))
        flags = own.identify([t if isinstance(t, str) else None for t in texts])["accepted"].astype(bool)
        trim()
        return flags

    return docs.where(accepted(F.col(text_col).cast("string")))


def identify(
    docs: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    identifier: Identifier | None = None,
) -> DataFrame:
    """doc_id, lang_pred, score, entropy, accepted for every row.

    Fits an identifier on labelled rows where ``learn_from`` holds (all by default),
    unless one is given.  Null text, or text without a letter, gives ``und`` with
    score 0, never accepted; so does every row where nothing can be learnt.
    ``accepted`` is false for text no learnt language explains.  Ties go to the
    language first in order.  Identifiers may be null or repeat.  Other columns are
    ignored, and no label is an input of a prediction.
    """
    spark = docs.sparkSession
    if identifier is None:
        identifier = fit(training_sample(docs, F.lit(True) if learn_from is None else learn_from, id_col, text_col, lang_col))
    shared, key = spark.sparkContext.broadcast(identifier), ("language", uuid.uuid4().hex)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = remembered(key, lambda: copy.copy(shared.value))  # its words go when another operator comes
        for pdf in batches:
            out = own.identify([t if isinstance(t, str) else None for t in pdf["body"]])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    found = rows.mapInPandas(run, "doc_id long, lang_pred string, score double, entropy double, accepted boolean")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
