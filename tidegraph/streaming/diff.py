"""Differences between two results of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADD, UPDATE, DELETE, AGGREGATION = "add", "update", "delete", "aggregation"


def diff_results(before: DataFrame, after: DataFrame, keys: list[str], defaults: dict[str, object] | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Rows added, updated and deleted: op, before, after, grouping_keys, default_before, default_after.

    Rows meet by ``keys`` (of repeated rows the n-th meets the n-th); rows that are
    the same before and after give nothing.  With ``defaults`` (values of an empty
    group by column) changes are aggregations: a group that appears starts from the
    defaults and one that goes ends in them.  ``hidden`` columns may be keys and are
    not shown.
    """
    from pyspark.sql import Window

    columns = [c for c in after.columns if c not in hidden]
    value = [c for c in columns if c not in keys]

    def numbered(df: DataFrame, side: str) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.xxhash64(c) for c in value] or [F.lit(0)]))
        return df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], order.alias("__n"), F.struct(*columns).alias(side))

    a, b = numbered(before, "before"), numbered(after, "after")
    met = [a[f"__k{i}"].eqNullSafe(b[f"__k{i}"]) for i in range(len(keys))] + [a["__n"] == b["__n"]]
    joined = a.join(b, met, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    gone, new = F.col("after").isNull(), F.col("before").isNull()
    op = F.when(new, ADD).when(gone, DELETE).otherwise(UPDATE)
    first, last, false = F.col("before"), F.col("after"), F.lit(False)
    if defaults is not None:
        rest = lambda side: F.struct(*[F.lit(defaults[c]).cast(after.schema[c].dataType).alias(c) if c in defaults else F.col(side)[c].alias(c) for c in columns])
        return joined.select(
            F.lit(AGGREGATION).alias("op"),
            F.when(new, rest("after")).otherwise(first).alias("before"),
            F.when(gone, rest("before")).otherwise(last).alias("after"),
            F.array(*[F.lit(k) for k in keys]).alias("grouping_keys"),
            new.alias("default_before"),
            gone.alias("default_after"),
        )
    return joined.select(op.alias("op"), first.alias("before"), last.alias("after"), F.array().cast("array<string>").alias("grouping_keys"), false.alias("default_before"), false.alias("default_after"))
