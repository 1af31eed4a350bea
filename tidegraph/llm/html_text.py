"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order.  Each block becomes a vector: hashed
names of the tags and classes above it, hashed words, and a few measures.  A
bidirectional LSTM (numpy) reads the whole sequence, so each block is judged with
the page around it, and labels it main text or not.

The model is trained when it is needed: on invented pages in many layouts, whose main
text is known because it was put there, and on a bounded sample of the corpus' own
pages, as far as their structure tells (article and main elements, and the elements
the HTML standard has for navigation, headers, footers, asides and forms).  Blocks of
pages without such structure have no label and teach nothing.  Training is seeded, so
the same sample gives the same model.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, sample_rows

#: Pages of the corpus used for training, at most, and the longest of them.
SAMPLE_PAGES, SAMPLE_CHARS = 100, 50_000
PATHS, WORDS, MEASURES, HIDDEN = 64, 16, 5, 16
INPUT = PATHS + WORDS + MEASURES
INVENTED, EPOCHS, BATCH, RATE, SEED = 300, 10, 25, 0.01, 11
#: Characters of pages cut into blocks at a time, and blocks (padding included) read at a time; a longer page comes alone.
READ_CHARS, READ_BLOCKS = 2_000_000, 20_000

#: Elements whose content is no text of the page; an unclosed one of the first two hides the rest, as in
#: browsers, and an unclosed one of the others hides nothing.
_CODE = frozenset(("script", "style"))
_HIDDEN = _CODE | frozenset(("noscript", "template", "title", "textarea", "iframe", "noembed", "noframes", "canvas"))
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>""",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: These do too, and hold what follows only if they are closed.
_CLOSED = frozenset(("button", "label", "select", "option", "object", "svg"))
_NO_END = frozenset(("hr", "br", "img", "input", "meta", "link"))
#: What an opening tag ends first.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}

#: Elements that by their meaning hold an article, and those that by theirs are around one.
ARTICLE = frozenset(("article", "main"))
AROUND = frozenset(("nav", "menu", "header", "footer", "aside", "form", "dialog", "button", "label", "select", "svg"))
#: Names above a block that count most.
NEAR = 6


class Block:
    """A leaf block: its text, a vector of the names above it, the share of it in links, where it
    starts in the page, and what the elements above say (1: in an article, 0: around one, None: nothing)."""

    __slots__ = ("text", "path", "linked", "at", "told")

    def __init__(self, text: str, path: np.ndarray, linked: float, at: int, told: int | None):
        self.text, self.path, self.linked, self.at, self.told = text, path, linked, at, told


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    return (tag, *(n for m in _NAMED.finditer(attributes) for n in _NAME.findall((m[1] or m[2] or m[3] or "").lower())))


class _Element:
    """An open element below others.  Elements that repeat under one parent share what is worked out of their names."""

    __slots__ = ("tag", "slots", "above", "held", "told", "below", "vector")

    def __init__(self, tag: str, slots: list[int], above: _Element | None):
        self.tag, self.slots, self.above, self.below, self.vector = tag, slots, above, {}, None
        if above is None:
            self.held, self.told = np.zeros(PATHS, "f4"), None
            return
        self.held = above.held.copy() if slots else above.held
        for k in slots:
            self.held[k] += 0.5
        self.told = 0 if above.told == 0 or tag in AROUND else 1 if above.told == 1 or tag in ARTICLE else None

    def names(self) -> np.ndarray:
        """Sums over the hashed names of the elements here, the nearest counted twice: the cost of a block does not depend on how deep it lies."""
        if self.vector is None:
            self.vector, left, at = self.held.copy(), NEAR, self
            while at is not None and left > 0:
                for k in reversed(at.slots[-left:]):
                    self.vector[k] += 0.5
                left, at = left - len(at.slots), at.above
        return self.vector


class _Open:
    """The elements open at a place."""

    def __init__(self):
        self.last = _Element("", [], None)
        self.tags: Counter[str] = Counter()

    def pop(self) -> str:
        tag, self.last = self.last.tag, self.last.above
        self.tags[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.tags[tag] > 0:
            while self.pop() != tag:
                pass

    def begin(self, tag: str, attributes: str) -> None:
        for ended in _ENDS.get(tag, ("p",)):
            if self.last.tag == ended:
                self.pop()
        key = (tag, attributes)
        found = self.last.below.get(key)
        if found is None:
            found = self.last.below[key] = _Element(tag, [_path_slots[n] for n in names_of(tag, attributes)], self.last)
        self.last = found
        self.tags[tag] += 1


class _Closings:
    """Where the next closing tag of an element is; every stretch of the page is searched once per name."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def after(self, tag: str, at: int) -> re.Match | None:
        found = self.next.get(tag, -1)
        if found == -1 or found is not None and found.start() < at:
            found = self.next[tag] = _closing(tag).search(self.page, at)
        return found


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, their text with single spaces."""
    out: list[Block] = []
    above, closings = _Open(), _Closings(page)
    parts: list[str] = []
    links, linked, at, first = 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, above.last.names(), min(1.0, linked / len(text)), first, above.last.told))
            parts, linked = [], 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            chunk = page[at : m.start()]
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            first = first if parts else at
            parts.append(chunk)
            linked += len(chunk.strip()) if links else 0
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _HIDDEN:
            if not closing:
                end = closings.after(tag, at)
                at = end.end() if end else len(page) if tag in _CODE else at
        elif tag == "br":
            first = first if parts else at
            parts.append(" ")
        elif tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag in BLOCKS or tag in _CLOSED:
            flush()
            if tag in BLOCKS:
                links = 0
            if closing:
                above.close(tag)
            elif tag not in _NO_END and (tag in BLOCKS or not m[3].endswith("/") and closings.after(tag, at)):
                above.begin(tag, m[3] or "")
    if at < len(page):
        first = first if parts else at
        parts.append(html.unescape(page[at:]))
    flush()
    return out


class _Slots(dict):
    """Hashed slot and sign of a name."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return found


_path_slots, _word_slots = _Slots(PATHS), _Slots(WORDS)


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), INPUT), "f4")
    for k, b in enumerate(found):
        words = b.text.split()
        n = len(words)
        x[k, :PATHS] = b.path
        x[k, PATHS : PATHS + WORDS] = np.bincount(list(map(_word_slots.__getitem__, words)), minlength=WORDS) / n
        x[k, PATHS + WORDS :] = (np.log1p(n) / 4, b.linked, k / len(found), sum(map(b.text.count, ".!?,")) / n, 1.0)
    return np.minimum(x, 2.0)


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.w = [draw.normal(0, 0.15, (INPUT + HIDDEN + 1, 4 * HIDDEN)).astype("f4") for _ in range(2)]
        for w in self.w:
            w[-1, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.out = draw.normal(0, 0.15, 2 * HIDDEN + INPUT + 1).astype("f4")

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over x (time, pages, inputs); states stand still where the mask is 0.  Training keeps what it needs."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), "f4"), np.zeros((pages, HIDDEN), "f4")
        pre = x.reshape(-1, INPUT) @ w[:INPUT] + w[-1]
        pre = pre.reshape(steps, pages, -1)
        states, kept = np.empty((steps, pages, HIDDEN), "f4"), []
        for t in range(steps):
            z = pre[t] + h @ w[INPUT:-1]
            s = self._sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((h, c, i, f, o, g, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            states[t] = h
        return states, kept

    def _back(self, w: np.ndarray, x: np.ndarray, kept: list, dh_out: np.ndarray) -> np.ndarray:
        dw, dh, dc = np.zeros_like(w), 0.0, 0.0
        for t in range(len(kept) - 1, -1, -1):
            h0, c0, i, f, o, g, tanh, m = kept[t]
            dh = dh + dh_out[t]
            dcell = dc + np.where(m, dh * o * (1 - tanh**2), 0)
            live = np.where(m, dcell, 0)
            dz = np.concatenate([live * g * i * (1 - i), live * c0 * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), live * i * (1 - g**2)], axis=1)
            dw[:INPUT] += x[t].T @ dz
            dw[INPUT:-1] += h0.T @ dz
            dw[-1] += dz.sum(axis=0)
            dh = np.where(m, dz @ w[INPUT:-1].T, dh)
            dc = np.where(m, dcell * f, dc)
        return dw

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
        a, ka = self._run(self.w[0], x, mask, keep)
        b, kb = self._run(self.w[1], x[::-1], mask[::-1], keep)
        seen = np.concatenate([a, b[::-1], x, np.ones((*x.shape[:2], 1), "f4")], axis=2)
        return self._sigmoid(seen @ self.out), [ka, kb], seen

    @staticmethod
    def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), INPUT), "f4"), np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
        return x, mask

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        while order:
            n = 1  # the longest first, and as many more as the bound on blocks read at a time allows
            while n < len(order) and n < 256 and (n + 1) * len(pages[order[-1]]) <= READ_BLOCKS:
                n += 1
            part = order[-n:]
            del order[-n:]
            p, _, _ = self._forward(*self.pad([pages[k] for k in part]))
            for j, k in enumerate(part):
                out[k] = p[: len(pages[k]), j] > 0.5
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
        """Adam on the mean loss of the blocks whose label is not nan."""
        draw, params = np.random.default_rng(SEED), [*self.w, self.out]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(pages))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                x, mask = self.pad([pages[k] for k in part])
                y = np.full(mask.shape, np.nan, "f4")
                for j, k in enumerate(part):
                    y[: len(labels[k]), j] = labels[k]
                known = ~np.isnan(y)
                p, kept, seen = self._forward(x, mask, keep=True)
                d = np.where(known, p - np.nan_to_num(y), 0) / max(1, known.sum())
                ds = d[:, :, None] * self.out
                grads = [self._back(self.w[0], x, kept[0], ds[:, :, :HIDDEN]), self._back(self.w[1], x[::-1], kept[1], ds[::-1, :, HIDDEN : 2 * HIDDEN]), np.tensordot(d, seen, ((0, 1), (0, 1)))]
                step += 1
                for q, g, u, v in zip(params, grads, m1, m2):  # Adam
                    g = np.clip(g, -1, 1)
                    u += 0.1 * (g - u)
                    v += 0.01 * (g * g - v)
                    q -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self


def by_structure(found: list[Block]) -> np.ndarray:
    """Labels as far as elements tell: on a page with an article all that is not in it is around it; nan where nothing tells."""
    some = any(b.told for b in found)
    return np.array([b.told if b.told is not None else 0 if some else np.nan for b in found], "f4")


def invented_pages(n: int, seed: int = SEED) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pages in many layouts, with what surrounds articles in the wild, and the stretches of each that are main text."""
    draw = np.random.default_rng(seed)
    pick = lambda *xs: xs[draw.integers(len(xs))]
    word = lambda: "".join(draw.choice(list("aeioustrnlmdk"), draw.integers(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(draw.integers(a, b))).capitalize()
    prose = lambda: " ".join(line(4, 14) + pick(".", ".", "!", "?") for _ in range(draw.integers(1, 6)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(draw.integers(2, 8))) + "</ul>"
    named = lambda *xs: f'{pick("class", "class", "id")}="{pick(*xs)}"'
    for _ in range(n):
        before = [
            lambda: f"<nav>{links()}</nav>",
            lambda: f"<div {named('nav', 'menu', 'navbar', 'breadcrumb')}>{links()}</div>",
            lambda: f"<header><h1>{line(1, 4)}</h1><p>{line(2, 8)}</p></header>",
            lambda: f"<div {named('header', 'masthead', 'topbar banner')}><p>{line(1, 6)}</p></div>",
            lambda: f"<div {named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo')}>{prose()}</div>",
            lambda: f"<div {named('cookie-notice', 'notice', 'consent', 'alert', 'popup')}><p>{prose()}</p><button>{line(1, 2)}</button></div>",
            lambda: f"<form><label>{line(1, 2)}</label><input><button>{line(1, 2)}</button></form>",
            lambda: f"<aside {named('sidebar', 'widget', 'left')}><p>{prose()}</p>{links()}</aside>",
        ]
        after = [
            lambda: f"<footer><p>{line(2, 12)} {pick('&copy;', '')}</p></footer>",
            lambda: f"<footer>&copy; {line(2, 12)}.</footer>",
            lambda: f"<div {named('footer', 'copyright', 'legal')}>{prose()}</div>",
            lambda: f"<section {named('comments', 'comment-list', 'discussion', 'replies')}><h2>{line(1, 3)}</h2>" + "".join(f"<div {named('comment', 'reply')}><p>{prose()}</p></div>" for _ in range(draw.integers(1, 5))) + "</section>",
            lambda: f"<div {named('related', 'share social', 'tags', 'recommended')}>{links()}</div>",
            lambda: f"<aside><p>{prose()}</p></aside>",
            lambda: f"<div {named('sidebar', 'widget')}><h3>{line(1, 3)}</h3><p>{prose()}</p></div>",
            lambda: f"<form {named('newsletter', 'subscribe', 'search')}><p>{line(3, 9)}</p><button>{line(1, 2)}</button></form>",
            lambda: f"<div {named('ad', 'advert', 'sponsor')}><p>{prose()}</p></div>",
        ]
        some = lambda xs: "".join(x() for x in xs if draw.random() < 0.35)
        heading = pick("h1", "h1", "h2")
        inner = [(f"<{heading}>{line(2, 9)}</{heading}>", True)] if draw.random() < 0.85 else []
        for _ in range(draw.integers(1, 12)):
            inner.append((pick(f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}", f"<p><b>{prose()}<br>", f"<h2>{line(2, 6)}</h2>", f"<p>{line(1, 3)}.</p>", f"<ul><li>{line(2, 9)}</li><li>{prose()}</li></ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<pre>{prose()}</pre>", f"<object><p>{prose()}</p></object>"), True))
            if draw.random() < 0.08:
                inner.append((pick(*before[4:6])(), False))
        shell = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f"<div {named('content', 'post', 'entry-content', 'story-body', 'main-text')}>", "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"))
        page, main = f"<html><body>{some(before)}{shell[0]}", []
        for fragment, own in inner:
            if own:
                main.append((len(page), len(page) + len(fragment)))
            page += fragment
        yield f"{page}{shell[1]}{some(after)}</body></html>", main


def trained(own_pages: list[str]) -> Labeller:
    examples = []
    for page, main in invented_pages(INVENTED):
        found = blocks(page)
        examples.append((vectors(found), np.array([any(a <= b.at < z for a, z in main) for b in found], "f4")))
    for page in own_pages:
        found = blocks(page)
        examples.append((vectors(found), by_structure(found)))
    examples = [(x, y) for x, y in examples if len(x)]
    return Labeller().train([x for x, _ in examples], [y for _, y in examples])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row; text joins the main blocks by a blank line.

    Null or blank html, and pages without a main block, give the empty text.  Broken
    markup is read as far as it goes: unclosed elements end with the page, and only an
    unclosed comment, script or style hides what follows.  Time and memory are linear in
    a page's length, however deep it nests.  Rows may repeat, identifiers and urls may be
    null; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    if labeller is None:
        sample = sample_rows(rows.where(F.length("html") <= SAMPLE_CHARS), "page_id", SAMPLE_PAGES).select("page_id", "html").collect()
        labeller = trained([r.html for r in sorted(sample)])
    shared = spark.sparkContext.broadcast(labeller)  # a few thousand weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["html"].str.len().to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes + READ_CHARS // 256) // READ_CHARS)) + 1, len(pdf)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = pdf.iloc[a:b]
                if not len(part):
                    continue
                found = [blocks(p) for p in part["html"]]
                kept = shared.value.label([vectors(b) for b in found])
                text = ["\n\n".join(b.text for b, main in zip(bs, ks) if main) for bs, ks in zip(found, kept)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    out = rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
    return out.withColumn("page_id", F.nullif("page_id", F.lit(NULL_ID)))
