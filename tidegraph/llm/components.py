"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import cut


def _towards_least(edges: DataFrame, upwards: bool) -> DataFrame:
    """Hang neighbours (larger ones, or the node with its smaller ones) on the least of them."""
    if upwards:  # every node with all its neighbours
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if upwards:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one orderable type); root is its least node.

    Alternating large-star and small-star rounds: edges stay at most as many as
    nodes and edges together, no adjacency list is ever gathered in one row, and a
    hub's edges may be split by a skew join.  Each round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most.
    Null ends and self-links are ignored; repeated edges do no harm; no edges give
    no rows.  Raises if ``max_rounds`` do not suffice (they suffice for any chain of
    up to 2^50 nodes).
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = cut(now), None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if state == seen or not state[0]:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen, now = state, cut(_towards_least(_towards_least(now, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
