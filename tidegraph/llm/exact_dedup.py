"""Exact dedup by content sort.

Range splitters sampled from the texts' first bytes and hashes deal whole texts out
to partitions (``repartitionByRange``), every partition is sorted with Spark's
external sort, so equal texts end up next to each other, and one walk over the
sorted rows compares each text in full with its neighbour to delimit the groups.

A text that occurs so often that one partition would feel it is handled before
anything moves: its copies are folded where they lie (map-side aggregation over
the full text) and only one row per task and text is shuffled.  There are at most
``4 x partitions`` such texts, because each needs more than a ``1 / (4 x
partitions)`` share of the rows, so their digests may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import body, partitions

#: A text with fewer copies than this is never treated as heavy.
HEAVY_FLOOR = 64
#: Characters of a text in the range key; the hash after them splits ranges of texts
#: that start alike.  A bounded key bounds what sampling sends to the driver.
KEY_CHARS = 24


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise=None,
    num_partitions: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the column that is compared (default:
    unchanged).  ``keep`` is ``min`` or ``max``: which identifier of a group stays.

    Null text counts as the empty text.  A null identifier never stays unless its
    group has no other; it then has ``keep_id`` null and is kept.  Rows that repeat
    both identifier and text share one fate (``kept`` is a property of the
    identifier) and all count towards ``group_size``.  Other columns of ``docs`` are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    spark = docs.sparkSession
    parts = num_partitions or partitions(spark)
    best = F.min if keep == "min" else F.max
    text: Column = body(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("body"))

    limit = max(rows.count() // (4 * parts), HEAVY_FLOOR)
    heavy = [
        (r.h,)
        for r in rows.groupBy(F.xxhash64("body").alias("h")).count().where(F.col("count") > limit).select("h").collect()
    ]
    cold = rows
    if heavy:
        marks = F.broadcast(spark.createDataFrame(heavy, "h long"))
        hashed = rows.withColumn("h", F.xxhash64("body"))
        cold = hashed.join(marks, "h", "left_anti").drop("h")

    whole = Window.partitionBy("start", "hash", "body")
    out = (
        cold.withColumns({"start": F.substring("body", 1, KEY_CHARS), "hash": F.xxhash64("body")})
        .repartitionByRange(parts, "start", "hash")
        .sortWithinPartitions("start", "hash", "body")
        .select(
            "doc_id",
            best("doc_id").over(whole).alias("keep_id"),
            F.count(F.lit(1)).over(whole).alias("group_size"),
            F.sha2("body", 256).alias("text_sha256"),
        )
    )
    if heavy:
        hot = hashed.join(marks, "h", "left_semi").drop("h")
        folded = hot.groupBy("body").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        folded = folded.select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
        joined = hot.select("doc_id", F.sha2("body", 256).alias("text_sha256")).join(F.broadcast(folded), "text_sha256")
        out = out.unionByName(joined.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", num_partitions: int | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns, of which each distinct text keeps one.

    The same sort, walked once: of neighbours with equal text the one with the
    smallest (or largest) identifier stays; a null identifier stays only if no
    other has its text, and of repeated identifiers any one row does.  Null text
    counts as empty.  An empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    spark = docs.sparkSession
    parts = num_partitions or partitions(spark)
    text = body(text_col)
    order = F.col(id_col).asc_nulls_last() if keep == "min" else F.col(id_col).desc_nulls_last()
    rows = docs.withColumns({"__start": F.substring(text, 1, KEY_CHARS), "__hash": F.xxhash64(text)})

    limit = max(rows.count() // (4 * parts), HEAVY_FLOOR)
    heavy = [(r["__hash"],) for r in rows.groupBy("__hash").count().where(F.col("count") > limit).select("__hash").collect()]
    cold = rows
    if heavy:
        marks = F.broadcast(spark.createDataFrame(heavy, "__hash long"))
        cold = rows.join(marks, "__hash", "left_anti")
    dealt = cold.repartitionByRange(parts, "__start", "__hash").sortWithinPartitions("__start", "__hash", text, order)
    rank = F.row_number().over(Window.partitionBy("__start", "__hash", text).orderBy(order))
    out = dealt.withColumn("__rank", rank).where("__rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    if heavy:  # one row per task and text is shuffled
        hot = rows.join(marks, "__hash", "left_semi")
        fields = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        best = F.min_by if keep == "min" else F.max_by
        one = hot.groupBy(text.alias("__text")).agg(F.coalesce(best(fields, id_col), F.first(fields)).alias("__row"))
        out = out.unionByName(one.select("__row.*"))
    return out
