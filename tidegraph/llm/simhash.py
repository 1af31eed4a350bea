"""SimHash near-dedup by anchor-point covering.

Texts become fingerprints (bitwise majority over the hashes of their word
shingles).  Anchors are the words of a covering code: the perfect binary Golay code
on 23 bits (every 23-bit word lies within 3 bits of exactly one codeword), on each
of several blocks of the fingerprint; further bits of a block are covered with
radius 0.  Fingerprints within t bits of each other are within floor(t / blocks)
bits on some block, so each fingerprint is sent to every anchor of a block within
covering radius plus that many bits, and pairs are compared in full per anchor.

Equal fingerprints are folded before anything is replicated, and an anchor emits
only links that join parts not yet joined there, never all pairs of a dense group.

Near-dedup takes the groups so found as candidates only: inside each, the shingle sets
are compared, tile by tile, and texts are linked by their Jaccard similarity.  The more
fingerprints there are, the more bits its blocks have and the more blocks there are, so
that the load of an anchor does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, body, cut, partitions, remembered, whole_groups
from tidegraph.llm.components import connected_components

SEED = 42
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011
#: Anchors with up to this many fingerprints are compared together, by shifting.
SMALL = 48
#: and anchors with up to this many by their whole matrix.
CROWD = 1024
_CHUNK = 1 << 15
#: Texts compared at a time within a group, and shingles at a time.
TILE, _COLUMNS = 256, 4096
#: Candidates of near_dedup: 64 of 256 bits is the difference expected at a similarity of 0.55.
#: 80 blocks send nearly all pairs at 0.8 (about 39 bits) to one anchor.
CANDIDATES = dict(width=4, most=64, blocks=80, block_bits=23)
#: Fingerprints per anchor and block beyond which blocks get further bits, and the share of bits
#: that two fingerprints have in common at 0.8.
LOAD, IN_COMMON = 4096, 0.85
#: Blocks whose links are joined before the others are looked at.
EARLY = 16
_LAST = 2**63 - 1


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words; of all of them where there are fewer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not w:
        return np.empty(0, "u8")
    runs = zip(*(w[k:] for k in range(words))) if len(w) > words else [w]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), "u8")


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes."""
    total = np.zeros(64, "i8")
    for a in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[a : a + _CHUNK]).view("u1").reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype="i4")
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("u8")[0])


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits per hash: odd multiple, folded (k = 0: the hash itself)."""
    if not k:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, words: int = 3, width: int = 1, once: bool = False) -> list[int]:
    """``width`` 64-bit integers; zeros where the text has no word.  With ``once`` repeated shingles count once."""
    h = shingle_hashes(text, words)
    h = np.unique(h) if once else h
    return [majority(remix(h, k)) if len(h) else 0 for k in range(width)]


def fingerprints(docs: DataFrame, words: int, width: int, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """(doc_id, h1, h2, f0, f1, ...) per row, as signed 64-bit integers; ``h1`` and ``h2`` stand for the text."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered(("fingerprints",))
        for pdf in batches:
            found = np.array([fingerprint(t, words, width, once) for t in pdf["body"]], "u8").reshape(-1, width).view("i8")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h1": pdf["h1"], "h2": pdf["h2"], **{n: found[:, k] for k, n in enumerate(names)}})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), body(text_col).alias("body"), *text_identity(text_col))
    return rows.mapInPandas(run, ", ".join(f"{n} long" for n in ["doc_id", "h1", "h2", *names]))


def text_identity(text_col: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(body(text_col)).alias("h1"), F.xxhash64(F.lit(1), body(text_col)).alias("h2")]


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; per syndrome the nearest error, and the 5 errors of weight 4 (or -1)."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], "i8")
    high = np.array([remainder(x << 12) for x in range(1 << 11)], "i8")
    near, four = np.zeros(1 << 11, "i8"), [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(low[e & 4095] ^ high[e >> 12])
            if weight < 4:
                near[s] = e
            else:
                four[s].append(e)
    return low, high, near, np.array([x if len(x) == 5 else [-1] * 5 for x in four], "i8")


def blocks_of(width: int, blocks: int, block_bits: int) -> list[np.ndarray]:
    """Bit numbers of each block.  Disjoint where they fit; else drawn evenly at random with a fixed seed."""
    if blocks * block_bits <= 64 * width:
        return [np.arange(k * block_bits, (k + 1) * block_bits) for k in range(blocks)]
    draw = np.random.default_rng(SEED)
    return [draw.permutation(64 * width)[:block_bits] for _ in range(blocks)]


def gather(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The chosen bits of each fingerprint (rows of ``u8``) as one integer."""
    out = np.zeros(len(prints), "i8")
    for to, b in enumerate(bits.tolist()):
        out |= ((prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype("i8") << to
    return out


def anchors(prints: np.ndarray, plan: list[np.ndarray], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code): every anchor each fingerprint is sent to; code = anchor * 2 + (1 where it only visits).

    With ``slack`` 0 a fingerprint goes to its nearest anchor of each block, which
    lies within the covering radius; with 1 also to those one bit further.
    """
    if slack not in (0, 1):
        raise ValueError("blocks must be at least half the threshold: slack is 0 or 1")
    low, high, near, four = golay_tables()
    rows, codes, every = [], [], np.arange(len(prints))
    for k, bits in enumerate(plan):
        x = gather(prints, bits)
        g, raw = x & ((1 << 23) - 1), x >> 23
        s = low[g & 4095] ^ high[g >> 12]
        extra = len(bits) - 23
        name = lambda raw, word: ((k << extra | raw) << 12 | word >> 11) << 1  # noqa: E731  a codeword is known by its 12 high bits
        home = g ^ near[s]
        rows.append(every)
        codes.append(name(raw, home))
        if slack:
            far = np.flatnonzero(four[s, 0] >= 0)
            for c in range(5):
                rows.append(far)
                codes.append(name(raw[far], g[far] ^ four[s[far], c]) | 1)
            for b in range(extra):
                rows.append(every)
                codes.append(name(raw ^ (1 << b), home) | 1)
    return np.concatenate(rows), np.concatenate(codes)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype="i4")


def links(anchor: np.ndarray, visits: np.ndarray, prints: np.ndarray, most: int, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join, per anchor, what its pairs within ``most`` bits join; rows sorted by anchor, homes first.

    A pair counts if the anchor is home to one of its ends.  Rows of one ``node`` are
    joined beforehand.  Each node joined to others is paired once with the least of
    them, so anchors which hold the same nodes say the same, and none says more than it
    has nodes.
    """
    node = np.arange(len(anchor)) if node is None else node
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for k in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=0)))):
        i = np.flatnonzero((anchor[k:] == anchor[:-k]) & small[:-k] & ~visits[:-k])
        i = i[differing(prints[i], prints[i + k]) <= most]
        left.append(i)
        right.append(i + k)
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for i, j in _spanning(prints[start : start + size], size - int(visits[start : start + size].sum()), most):
            left.append(start + i)
            right.append(start + j)
    none = np.empty(0, "i8")
    left, right = np.concatenate([none, *left]).astype("i8"), np.concatenate([none, *right]).astype("i8")
    # ranks number the nodes of each anchor in order; labels run along the pairs, and by their own labels, until they stand still
    order = np.lexsort((node, anchor))
    head = np.flatnonzero(np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (node[order][1:] != node[order][:-1])]) if len(order) else order
    rank = np.empty(len(node), "i8")
    rank[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    label, left, right = np.arange(len(head)), rank[left], rank[right]
    while True:
        least, before = np.minimum(label[left], label[right]), label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(len(head)))
    return order[head[joined]], order[head[label[joined]]]


def _spanning(own: np.ndarray, homes: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the rows of an anchor, the first ``homes`` of which are at home.

    Up to CROWD rows are compared at once.  More are reached breadth first, and each is
    compared only with those not reached yet: a dense group is walked in one step, not
    pair by pair.
    """
    if len(own) <= CROWD:
        wide = max(1, (1 << 20) // own.size)
        for a in range(0, homes, wide):
            i, j = np.nonzero(differing(own[a : min(a + wide, homes), None, :], own[None, :, :]) <= most)
            yield i + a, j
        return
    free, step = np.ones(len(own), bool), max(1, (1 << 22) // own.size)
    for seed in range(homes):
        if not free[seed]:
            continue
        free[seed], front = False, np.array([seed])
        while len(front):
            now, front = front[:step], front[step:]
            for side, others in ((now[now < homes], np.flatnonzero(free)), (now[now >= homes], None)):
                others = np.flatnonzero(free[:homes]) if others is None else others  # visits meet homes only
                if not len(side) or not len(others):
                    continue
                close = differing(own[side][:, None, :], own[others][None, :, :]) <= most
                hit = close.any(axis=0)
                if hit.any():
                    yield side[close[:, hit].argmax(axis=0)], others[hit]
                    free[others[hit]] = False
                    front = np.concatenate([front, others[hit]])


def near_pairs(nodes: DataFrame, width: int, most: int, plan: list[np.ndarray], slack: int, num_partitions: int | None = None) -> DataFrame:
    """Links (a, b) that join fingerprints within ``most`` bits, if some block of ``plan`` sends both to one anchor; nodes: node, f0, f1, ...

    Fingerprints may share a node, and are joined beforehand then.
    """
    names = [f"f{k}" for k in range(width)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                prints = np.ascontiguousarray(part[names].to_numpy("i8")).view("u8")
                rows, codes = anchors(prints, plan, slack)
                yield pd.DataFrame({"code": codes, "node": part["node"].to_numpy()[rows], **{n: prints[rows, k].view("i8") for k, n in enumerate(names)}})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(pdf: pd.DataFrame) -> pd.DataFrame:
            code, node = pdf["code"].to_numpy(), pdf["node"].to_numpy()
            i, j = links(code >> 1, (code & 1).astype(bool), np.ascontiguousarray(pdf[names].to_numpy("i8")).view("u8"), most, node)
            return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])}).drop_duplicates()

        held: list[pd.DataFrame] = []  # the rows of the last anchor so far, which may go on
        for pdf in batches:
            if not len(pdf):
                continue
            anchor = pdf["code"].to_numpy() >> 1
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last or held and held[-1]["code"].iloc[-1] >> 1 != anchor[0]:
                yield found(pd.concat([*held, pdf.iloc[:last]]))
                held = []
            held.append(pdf.iloc[last:])
        if held:
            yield found(pd.concat(held))

    columns = ", ".join(f"{n} long" for n in ["node", *names])
    sent = nodes.select("node", *names).mapInPandas(send, f"code long, {columns}")
    parts = num_partitions or partitions(nodes.sparkSession)
    dealt = sent.repartition(parts, F.shiftright("code", 1)).sortWithinPartitions("code")
    return dealt.mapInPandas(compare, "a long, b long")


def plan_for(n: int) -> dict:
    """``near_groups`` arguments for the candidates of ``n`` fingerprints: about LOAD to an anchor at most.

    Each further bit of a block keeps a pair at 0.8 together with probability IN_COMMON,
    which that many more blocks make up for.
    """
    more = max(0, int(np.ceil(np.log2(max(1, n / 4096 / LOAD)))))
    return CANDIDATES | dict(blocks=int(np.ceil(CANDIDATES["blocks"] / IN_COMMON**more)), block_bits=CANDIDATES["block_bits"] + more)


def near_groups(
    docs: DataFrame,
    words: int = 5,
    width: int = 4,
    most: int = 45,
    blocks: int | None = 32,
    block_bits: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    num_partitions: int | None = None,
    once: bool = False,
) -> DataFrame:
    """doc_id, h1, h2 (which stand for the text), f0.., component_id (the smallest doc_id reachable over links), root per row.

    The defaults suit a Jaccard similarity of 0.8 or more between sets of five-word
    shingles: 45 of 256 bits is the difference expected at about 0.76.  For an exact
    guarantee on few bits use width 1, ``most`` 3 and two blocks of 32 bits.  Where
    ``blocks`` is None, :func:`plan_for` chooses blocks by the number of fingerprints.

    Null text counts as empty, and texts without words share fingerprint zero and so
    one group.  A null identifier never names a group unless no other can; then
    component_id is null (``root`` numbers every group).  Repeated rows are kept, in one
    group.  An empty table gives no rows.  Other columns of ``docs`` are ignored.
    """
    names = [f"f{k}" for k in range(width)]
    parts = num_partitions or partitions(docs.sparkSession)
    marks = cut(fingerprints(docs, words, width, id_col, text_col, once))
    firsts = marks.groupBy(*names).agg(F.coalesce(F.min(F.nullif("doc_id", F.lit(NULL_ID))), F.lit(_LAST)).alias("first"))
    # numbered in order of their smallest identifiers: the least node of a group names it
    nodes = cut(firsts.repartitionByRange(parts, "first").sortWithinPartitions("first").withColumn("node", F.monotonically_increasing_id()))
    if blocks is None:
        wanted = plan_for(nodes.count())
        blocks, block_bits = wanted["blocks"], wanted["block_bits"]
    plan = blocks_of(width, blocks, block_bits)
    # complete where disjoint blocks fit the fingerprint and exceed half of ``most``; overlapping ones find a pair with some probability
    slack = min(1, most // blocks) if blocks * block_bits <= 64 * width else 0
    # many blocks would find the links of a dense group many times over: what a few of them join is one node to the others
    rooted = nodes.withColumn("root", F.col("node"))
    for part in (plan[:EARLY], plan[EARLY:]) if len(plan) > EARLY else (plan,):
        found = connected_components(near_pairs(rooted.select(F.col("root").alias("node"), *names), width, most, part, slack, parts))
        found = found.toDF("root", "least")
        rooted = cut(rooted.join(found, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least"))
    heads = nodes.select(F.col("node").alias("root"), F.nullif("first", F.lit(_LAST)).alias("component_id"))
    groups = rooted.select(*names, "root").join(heads, "root").select(*names, "component_id", "root")
    return marks.join(groups, names).select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "h1", "h2", *names, "component_id", "root")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (each sorted, none empty) have at least this Jaccard similarity."""
    size = np.array([len(x) for x in sets])
    _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), met[column] > 1
    row, column = row[shared], (np.cumsum(met > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), "f4")
        held[row[lo:hi], column[lo:hi] - a] = 1
        both += held @ held.T
    return both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9


def verified_links(texts: DataFrame, words: int, similarity: float, num_partitions: int) -> DataFrame:
    """Links (a, b) that join what pairs of one group with alike shingle sets join; texts: group, node, body and size (of the group).

    Groups are compared by pairs of tiles; each gives at most as many links as it has texts.
    """
    tiled = texts.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in pdf["body"]]
            yield pdf.drop(columns="body").assign(shingles=[(x if len(x) else np.zeros(1, "u8")).tobytes() for x in sets])

    cells = tiled.select("group", "node", "tile", "tiles", "body").mapInPandas(hashed, "group long, node long, tile int, tiles int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    cell = ["group", "low", "high"]
    sent = cells.select("group", "node", "tile", "shingles", other).select("group", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "node", "shingles")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, *cell):
            if len(pdf) < 2:
                continue
            close = similar([np.frombuffer(x, "u8") for x in pdf["shingles"]], similarity)
            key, label = pdf["node"].to_numpy(), np.arange(len(pdf))
            left, right = [], []
            for i in np.flatnonzero(close.sum(axis=1) > 1):
                hit = np.flatnonzero(close[i])
                met, at = np.unique(label[hit], return_index=True)
                if len(met) > 1:
                    left.append(np.full(len(met), key[i]))
                    right.append(key[hit[at]])
                    label[np.isin(label, met)] = met[0]
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return sent.repartition(num_partitions, *cell).sortWithinPartitions(*cell).mapInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, num_partitions: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without those that another of their group stands for.

    Groups are joined by pairs of texts whose sets of ``words``-word shingles have this
    Jaccard similarity or more; texts without words are alike.  The row with the smallest
    identifier of a group stays, and of rows of one identifier that with the first text;
    a null identifier stays only if its group has no other.  Rows go by identifier and
    text, so one that merely repeats an identifier is not touched; rows that repeat both
    share one fate.
    """
    parts = num_partitions or partitions(docs.sparkSession)
    key, order = ["h1", "h2"], F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("order")
    marks = near_groups(docs, words, id_col=id_col, text_col=text_col, num_partitions=num_partitions, once=True, **CANDIDATES | dict(blocks=None))
    marks = cut(marks.select(F.coalesce("doc_id", F.lit(_LAST)).alias("order"), *key, F.col("root").alias("group")))
    firsts = marks.groupBy("group", *key).agg(F.min("order").alias("first"))
    # texts numbered in order of their smallest identifiers, so that the least of a group is the one that stays
    texts = cut(firsts.repartitionByRange(parts, "first", *key).sortWithinPartitions("first", *key).withColumn("node", F.monotonically_increasing_id()))
    # written first, so that a join with a large group can be split
    many = cut(texts.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1))
    crowded = cut(texts.join(many, "group").select("group", "node", "size", *key))
    known = docs.select(*text_identity(text_col), body(text_col).alias("body"))
    bodies = known.join(crowded, key).groupBy("group", "node", "size").agg(F.first("body").alias("body"))
    roots = connected_components(verified_links(bodies, words, similarity, parts))
    told = texts.join(roots, "node", "left").select(*key, "first", F.coalesce(F.col("root") == F.col("node"), F.lit(True)).alias("stays"))
    gone = marks.join(told, key).where(~F.col("stays") | (F.col("order") > F.col("first"))).select("order", *key).distinct()
    marked = docs.select("*", order.alias("__order"), *[h.alias(f"__h{k}") for k, h in enumerate(text_identity(text_col), 1)])
    gone = gone.toDF("__order", "__h1", "__h2")
    return marked.join(gone, gone.columns, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
