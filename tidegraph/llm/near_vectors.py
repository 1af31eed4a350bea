"""Embedding near-dedup by NN-descent.

Equal vectors are folded first.  A neighbour graph with K neighbours per vector is
started from random-hyperplane buckets and refined: in each round the neighbours of
a vector and the vectors it is a neighbour of are compared with each other, which
are the neighbours-of-neighbours of each, and every list keeps its K best.  Edges at
or above the threshold join vectors into components.  Vectors of different lengths
never meet.

A list that holds nothing below the threshold is saturated: the vector may have
further links.  Such a list is enlarged, up to MOST_K entries, until it holds one below.
What is still saturated then lies in a large component, and the search goes on with
lists that admit only vectors of other components, until none of those is saturated
either; no list hides a link between components then.  Links inside a component are
counted tile by tile in double precision, without ever being written as pairs.
Buckets and neighbourhoods of more than SPLIT vectors are dealt into random parts, anew
in each table and round, so that no task compares a crowd with itself.

Audits compare bounded sets of vectors with all others: vectors in large components,
vectors with a neighbour near the threshold, and others.  Recall counts by vector, so
that one dense group cannot stand for the isolated pairs.  While it is less than asked
for, more buckets and rounds follow; a search that stays below it raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, cut, partitions, same_length, whole_groups
from tidegraph.llm.components import connected_components

#: Neighbours per vector, the most an enlarged list has, and how many a group may propose to a member per round.
K, MOST_K, PROPOSALS = 8, 32, 5
#: 16-bit floats choose candidates: entries this little below the threshold may be links.
ROUNDING = 0.005
#: Hyperplane tables per start at least and at most, rounds per start, and a group's
#: share of changed entries below which rounds end.
TABLES, MOST_TABLES, ROUNDS, SETTLED = 6, 512, 3, 0.02
#: Members of a bucket on average.
BUCKET = 12
#: The audits: at most this many vectors each, the recall asked for, failures at most.
AUDIT, RECALL, RESTARTS = 2000, 0.98, 8
#: Vectors compared at a time within a component or a group; larger groups are split.
TILE, SPLIT = 1024, 1024
#: Audited vectors count as near a link if their list reaches this close to the threshold.
AUDIT_NEAR = 0.1
_LAST = 2**63 - 1


def _identity() -> list:
    """128 bits that stand for a vector."""
    return [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(v, h1, h2, copies, first, small, exact) per distinct usable vector, scaled to length 1.

    ``v`` is a number, ``first`` the smallest identifier; ``small`` holds 16-bit floats
    to search with, ``exact`` doubles to decide with.
    """
    distinct = vectors.groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scaled = [np.asarray(x, "f8") for x in pdf["vec"]]
            scaled = [x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max() for x in scaled]
            yield pdf.drop(columns="vec").assign(small=[x.astype("f2").tobytes() for x in scaled], exact=[x.tobytes() for x in scaled])

    numbered = distinct.select(F.monotonically_increasing_id().alias("v"), *_identity(), "copies", F.coalesce("first", F.lit(_LAST)).alias("first"), "vec")
    return numbered.mapInPandas(run, "v long, h1 long, h2 long, copies long, first long, small binary, exact binary")


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def split(groups: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """Groups larger than SPLIT dealt into random parts; sizes: g, n."""
    large = sizes.where(F.col("n") > SPLIT)
    part = F.pmod(F.xxhash64("v", F.lit(seed)), F.ceil(F.col("n") / SPLIT))
    out = groups.join(large, "g", "left").withColumn("g", F.when(F.col("n").isNull(), F.col("g")).otherwise(F.xxhash64("g", part)))
    return out.drop("n")


def propose(groups: DataFrame, num_partitions: int) -> DataFrame:
    """(v, u, sim): the best PROPOSALS of each member's group, if above its bar and of another root.  groups: g, v, root, small, bar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for group in whole_groups(batches, "g"):
            for pdf in same_length(group, "small") if len(group) > 1 else ():
                m = len(pdf)
                v, root, bar = pdf["v"].to_numpy(), pdf["root"].to_numpy(), pdf["bar"].to_numpy()
                if (root == root[0]).all():
                    continue
                x = _matrix(pdf["small"], "f2").astype("f4")
                for a in range(0, m, TILE):
                    sim = x[a : a + TILE] @ x.T
                    sim[root[a : a + TILE, None] == root[None, :]] = -2
                    best = np.argpartition(sim, m - min(PROPOSALS, m), axis=1)[:, -PROPOSALS:]
                    row, rank = np.nonzero(np.take_along_axis(sim, best, 1) > bar[a : a + TILE, None])
                    out.append((v[a + row], v[best[row, rank]], sim[row, best[row, rank]]))
                    n += len(row)
            if n > 20_000:
                yield pd.DataFrame(dict(zip(("v", "u", "sim"), map(np.concatenate, zip(*out)))))
                out, n = [], 0
        if n:
            yield pd.DataFrame(dict(zip(("v", "u", "sim"), map(np.concatenate, zip(*out)))))

    return groups.repartition(num_partitions, "g").sortWithinPartitions("g").mapInPandas(run, "v long, u long, sim float")


def rooted(units: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The vectors with the root of their component; those in none are their own."""
    if roots is None:
        return units.withColumn("root", F.col("v"))
    return units.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))


def between_components(lists: DataFrame, units: DataFrame) -> DataFrame:
    """The entries whose ends have different roots."""
    ends = units.select("v", "root")
    apart = lists.join(ends, "v").join(ends.toDF("u", "other"), "u").where("root <> other")
    return apart.select("v", "u", "sim")


def bucket_bits(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n / BUCKET)))))


def tables_for(n: int, threshold: float) -> int:
    """Tables of which one at least holds a pair at the threshold together, with probability RECALL."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bucket_bits(n)
    return TABLES if together == 1 else int(np.clip(np.ceil(np.log(1 - RECALL) / np.log1p(-together)), TABLES, MOST_TABLES))


def bucket_groups(units: DataFrame, lists: DataFrame | None, n: int, threshold: float, tables: int, seed: int) -> DataFrame:
    """Groups by the signs of random projections, ``tables`` of them, large ones split."""
    bits = bucket_bits(n)

    def codes(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf["small"], "f2").astype("f4")
        planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits)).astype("f4")
        found = (x @ planes > 0).reshape(len(pdf), tables, bits) @ (1 << np.arange(bits, dtype="i8"))
        return found << 9 | np.arange(tables)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in same_length(pdf, "small"):
                g, n = np.unique(codes(part), return_counts=True)
                yield pd.DataFrame({"g": g, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in same_length(pdf, "small"):
                code = codes(part)
                for t in range(tables):
                    yield part.assign(g=code[:, t])

    sizes = units.select("small").mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    groups = with_bars(units, lists, threshold).mapInPandas(run, "g long, v long, root long, small binary, bar float")
    return split(groups, sizes, seed)


def with_bars(units: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """Each vector with the similarity a newcomer to its list must exceed."""
    units = units.select("v", "root", "small")
    if lists is None:
        return units.withColumn("bar", F.lit(-2.0).cast("float"))
    held, least = F.count(F.lit(1)), F.min("sim")
    enlarged = F.when(held < MOST_K, F.least(least, F.lit(threshold - ROUNDING))).otherwise(least)
    bars = lists.groupBy("v").agg(F.when(held >= K, enlarged).otherwise(-2.0).cast("float").alias("bar"))
    return units.join(bars, "v", "left").select("v", "root", "small", F.coalesce("bar", F.lit(-2.0)).cast("float").alias("bar"))


def refine(units: DataFrame, lists: DataFrame, threshold: float, parts: int, seed: int) -> DataFrame:
    """Proposals of one round: for every vector, its neighbours and those it is a neighbour of, compared with each other."""
    forward = lists.select(F.col("v").alias("g"), F.col("u").alias("v"))
    back = lists.select(F.col("u").alias("g"), "v")
    near = forward.unionByName(back).distinct()
    near = split(near, near.groupBy("g").agg(F.count(F.lit(1)).alias("n")), seed)
    return propose(near.join(with_bars(units, lists, threshold), "v").select("g", "v", "root", "small", "bar"), parts)


def best_lists(proposals: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """The K most similar per vector, or as many at the threshold up to MOST_K; ties go to the smaller number."""
    found = proposals.withColumn("new", F.lit(1))
    if lists is not None:
        found = found.unionByName(lists.select("v", "u", "sim").withColumn("new", F.lit(0)))
    once = found.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= MOST_K)
    return ranked.where((F.col("rank") <= K) | (F.col("sim") >= threshold - ROUNDING)).drop("rank")


def component_links(units: DataFrame, roots: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(v, links): vectors of the same component within the threshold, copies counted; by tile pairs."""
    members = units.join(roots.select(F.col("node").alias("v"), "root"), "v").select("v", "root", "copies", "exact")
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiled = members.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("v", F.lit(7)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sent = tiled.select("v", "root", "copies", "exact", "tile", other).select("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "v", "copies", "exact")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "root", "low", "high"):
            tile = pdf["tile"].to_numpy()
            lows, highs = (pdf[tile == tile.min()], pdf[tile == tile.max()])
            for a, b in [(lows, highs), (highs, lows)] if tile.min() != tile.max() else [(lows, lows)]:
                x, y, n = _matrix(a["exact"], "f8"), _matrix(b["exact"], "f8"), b["copies"].to_numpy()
                for k in range(0, len(x), TILE):
                    close = x[k : k + TILE] @ y.T >= threshold
                    own = a["v"].to_numpy()[k : k + TILE]
                    if a is b:
                        close[np.arange(len(own)), np.arange(k, k + len(own))] = True
                    yield pd.DataFrame({"v": own, "links": close @ n})

    counted = sent.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high").mapInPandas(run, "v long, links long")
    return counted.groupBy("v").agg(F.sum("links").alias("links"))


def audited_recall(units: DataFrame, roots: DataFrame, threshold: float, lists: DataFrame | None = None) -> float:
    """The lesser recall of two audits: vectors in components larger than a list, and the others.

    Recall is the mean, over vectors that have links, of the share of a vector's links
    that lie within its component.  At most AUDIT vectors of each kind are compared with
    all.  Of those outside large components, where most have no link, as many are taken
    among those in small components or with a near neighbour (``lists``) as among the
    rest, and each kind weighs by its number.
    """
    sizes = roots.groupBy("root").count()
    large = sizes.where(F.col("count") > K).select("root", F.lit(True).alias("dense"))
    here = rooted(units, roots).select("v", "root", "exact")
    near = roots.select(F.col("node").alias("v"))
    if lists is not None:
        near = near.unionByName(lists.where(F.col("sim") >= threshold - AUDIT_NEAR).select("v"))
    marked = here.join(large, "root", "left").join(near.distinct().withColumn("near", F.lit(True)), "v", "left")
    kind = F.when(F.col("dense"), 2).when(F.col("near"), 1).otherwise(0).alias("kind")
    marked = cut(marked.select("v", "root", "exact", kind))
    count = {r.kind: r["count"] for r in marked.groupBy("kind").count().collect()}
    linked, found = {}, {}
    for k in count:
        asked = marked.where(F.col("kind") == k).orderBy(F.xxhash64("v"), "v").limit(AUDIT if k == 2 else AUDIT // 2).select("v", "root", "exact").collect()
        shares = _shares(here, asked, threshold)
        linked[k], found[k] = len(shares) * count[k] / len(asked), sum(shares) * count[k] / len(asked)
    of = lambda *kinds: sum(found.get(k, 0) for k in kinds) / total if (total := sum(linked.get(k, 0) for k in kinds)) else 1.0
    return min(of(0, 1), of(2))


def _shares(units: DataFrame, asked: list, threshold: float) -> list[float]:
    """For the vectors asked about that have links, the share of them within their component."""
    ids, own = np.array([r.v for r in asked]), np.array([r.root for r in asked])
    sizes = np.array([len(r.exact) for r in asked])
    questions = {n: (np.flatnonzero(sizes == n), np.array([np.frombuffer(r.exact, "f8") for r in asked if len(r.exact) == n])) for n in set(sizes.tolist())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = np.zeros(len(ids), "i8"), np.zeros(len(ids), "i8")
        for pdf in batches:
            for k in range(0, len(pdf), TILE):
                for part in same_length(pdf.iloc[k : k + TILE], "exact"):
                    where, q = questions.get(len(part["exact"].iloc[0]), (None, None))
                    if q is None:
                        continue
                    i, j = np.nonzero(_matrix(part["exact"], "f8") @ q.T >= threshold)
                    j = where[j]
                    apart = part["v"].to_numpy()[i] != ids[j]
                    n += np.bincount(j[apart], minlength=len(ids))
                    joined = apart & (part["root"].to_numpy()[i] == own[j])
                    found += np.bincount(j[joined], minlength=len(ids))
        some = n > 0
        yield pd.DataFrame({"v": ids[some], "n": n[some], "found": found[some]})

    counted = units.mapInPandas(run, "v long, n long, found long").groupBy("v").agg((F.sum("found") / F.sum("n")).alias("share"))
    return [r.share for r in counted.collect()]  # at most one per vector asked about


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", num_partitions: int | None = None, audit: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept per row.

    Vectors that are null, zero, or hold null or non-finite components link with
    nothing (component_id = vec_id, kept).  Vectors of any length are searched, and link
    with vectors of their own length only.  Equal vectors are linked.  Rows that repeat
    an identifier count as separate vectors.  A null identifier is never a component's
    name unless it stands alone, and is then kept.  An empty table gives no rows.

    ``audit``, if given, receives the recall found and the number of starts.
    """
    parts = num_partitions or partitions(vectors.sparkSession)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0), F.lit(False))
    keyed = rows.select("id", F.when(sound, F.transform("vec", lambda x: x + 0.0)).alias("vec"))
    units = cut(unit_vectors(keyed.where("vec IS NOT NULL").withColumn("id", F.nullif("id", F.lit(NULL_ID)))))
    n, lists, tied, roots = units.count(), None, None, None

    def holds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in same_length(pdf, "x"):
                ok = (_matrix(part["x"], "f8") * _matrix(part["y"], "f8")).sum(axis=1) >= threshold
                yield part.loc[ok, ["v", "first", "u", "other"]]

    failed, start, tables, recall = 0, 0, tables_for(n, threshold), 1.0
    while n > 1:
        here = rooted(units, roots)
        if roots is not None:
            here = cut(here)
            lists = between_components(lists, here)
        lists = cut(best_lists(propose(bucket_groups(here, lists, n, threshold, min(MOST_TABLES, tables << failed), seed=start), parts), lists, threshold))
        for turn in range(ROUNDS):
            lists = cut(best_lists(refine(here, lists, threshold, parts, 100 * start + turn), lists, threshold))
            if lists.agg(F.avg("new")).head()[0] < SETTLED:
                break
        # 16-bit floats choose candidates; whether an edge holds is decided on doubles
        likely = lists.where(F.col("sim") >= threshold - ROUNDING).select("v", "u")
        mine = units.select("v", "first", F.col("exact").alias("x"))
        theirs = units.select(F.col("v").alias("u"), F.col("first").alias("other"), F.col("exact").alias("y"))
        edges = cut(likely.join(mine, "v").join(theirs, "u").mapInPandas(holds, "v long, first long, u long, other long"))
        full = edges.groupBy("v").count().where(F.col("count") >= MOST_K).limit(1).count()
        # nodes in order of their smallest identifiers: a component's root names it
        known = edges.select(F.struct("first", "v").alias("a"), F.struct(F.col("other").alias("first"), F.col("u").alias("v")).alias("b"))
        if tied is not None:
            known = known.unionByName(tied.toDF("a", "b"))
        tied, start = cut(connected_components(known)), start + 1
        roots = tied.select(F.col("node.v").alias("node"), F.col("root.v").alias("root"), F.col("root.first").alias("name"))
        if full:
            continue
        recall = audited_recall(units, roots, threshold, lists)
        if recall >= RECALL:
            break
        failed += 1
        if failed == RESTARTS:
            raise RuntimeError(f"found {recall:.3f} of the links per audited vector, below {RECALL}, after {start} starts")
    if audit is not None:
        audit.update(recall=recall, starts=start)

    told = units.select("v", "h1", "h2", "copies", "first")
    if roots is not None:
        told = told.join(component_links(units, roots, threshold, parts), "v", "left").join(roots.select(F.col("node").alias("v"), "name"), "v", "left")
    else:
        told = told.withColumns({"links": F.lit(None).cast("long"), "name": F.lit(None).cast("long")})
    named = told.select("h1", "h2", F.coalesce("links", "copies").alias("links"), F.nullif(F.coalesce("name", "first"), F.lit(_LAST)).alias("component_id"))
    found = keyed.select("id", *[F.when(F.col("vec").isNotNull(), h).alias(f"h{k}") for k, h in enumerate(_identity(), 1)]).join(named, ["h1", "h2"], "left")
    out = found.select(F.nullif("id", F.lit(NULL_ID)).alias("vec_id"), F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), "component_id")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
