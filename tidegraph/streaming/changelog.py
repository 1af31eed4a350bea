"""From changes of elements to the tables of a graph."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.graph import Graph

#: Changes in order of ``seq``; ``properties`` is JSON text.
CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("element_id", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("effective_from", T.LongType()),
        T.StructField("src_source_id", T.StringType()),
        T.StructField("src_id", T.StringType()),
        T.StructField("dst_source_id", T.StringType()),
        T.StructField("dst_id", T.StringType()),
        T.StructField("properties", T.StringType()),
    ]
)


_ENDS = ("src_source_id", "src_id", "dst_source_id", "dst_id")


def element_versions(changes: DataFrame, names: Collection[str] | None = None) -> DataFrame:
    """Every version of every element, with the whole state it had then: the properties ``names``, or all.

    Updates fill properties they do not name from the version before (labels are not
    merged); an update of an unknown element acts as an insert; an insert, and what
    follows a delete, starts afresh.  Deletes themselves are no versions.  ``live``
    marks the versions since an element's last insert, unless it has been deleted, and
    ``current`` the last of those.
    """
    own = Window.partitionBy("source_id", "element_id")
    so_far = own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lives = changes.withColumns(
        {
            "life": F.sum(F.when(F.col("op") == "update", 0).otherwise(1)).over(so_far),
            "ends": F.max_by("op", "seq").over(own) == "delete",
            "latest": F.max("seq").over(own) == F.col("seq"),
        }
    )
    lives = lives.withColumns({"live": (F.max("life").over(own) == F.col("life")) & ~F.col("ends"), "current": F.col("latest") & ~F.col("ends")}).where("op <> 'delete'")
    given = lives.withColumn("given", F.from_json("properties", "map<string,string>"))
    if names is None:
        names = sorted(r.name for r in given.select(F.explode(F.map_keys("given")).alias("name")).distinct().collect())  # a row per property name
    in_life = Window.partitionBy("source_id", "element_id", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name: F.last(F.when(F.map_contains_key("given", F.lit(name)), F.struct(F.lit(name).alias("key"), F.try_element_at("given", F.lit(name)).alias("value"))), ignorenulls=True).over(in_life)
    known = F.filter(F.array(*[last(n) for n in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<struct<key:string,value:string>>")
    return given.select("source_id", "element_id", "element_type", "labels", *_ENDS, "effective_from", "seq", "live", "current", F.map_from_entries(known).alias("properties"))


def current_elements(changes: DataFrame) -> DataFrame:
    """The latest state of every element that has not been deleted.

    Only an element's last run of updates is merged, after a map-side choice of its
    last delete or insert.
    """
    last = changes.groupBy("source_id", "element_id").agg(F.max(F.when(F.col("op").isin("delete", "insert"), F.col("seq"))).alias("since"))
    live = changes.join(last, ["source_id", "element_id"]).where("since IS NULL OR seq >= since")
    entries = live.where("op <> 'delete'").select("source_id", "element_id", "seq", F.explode(F.from_json("properties", "map<string,string>")).alias("name", "value"), "properties")
    latest = entries.groupBy("source_id", "element_id", "name").agg(F.max_by("value", "seq").alias("value"))
    props = latest.groupBy("source_id", "element_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("properties"))
    heads = live.groupBy("source_id", "element_id").agg(
        F.max_by(F.struct("op", "element_type", "labels", *_ENDS), "seq").alias("h"), F.max("effective_from").alias("effective_from"), F.max("seq").alias("seq")
    )
    heads = heads.where("h.op <> 'delete'").select("source_id", "element_id", "h.*", "effective_from", "seq").drop("op")
    return heads.join(props, ["source_id", "element_id"], "left")


def advance_elements(before: DataFrame, changes: DataFrame) -> DataFrame:
    """Current elements after further changes: only those the changes touch are merged anew."""
    keys = ["source_id", "element_id"]
    touched = changes.select(*keys).distinct()
    known = before.join(touched, keys, "left_semi").select(
        F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "element_type", "source_id", "element_id", "labels", "effective_from",
        *_ENDS, F.coalesce(F.to_json("properties"), F.lit("{}")).alias("properties"),
    )
    merged = current_elements(known.unionByName(changes.select(*known.columns)))
    return before.join(touched, keys, "left_anti").select(*merged.columns).unionByName(merged)


def element_tables(elements: DataFrame, nodes: dict[str, dict[str, str]], relations: dict[str, tuple[str, str, dict[str, str]]] | None = None, versions: DataFrame | None = None, history: bool = False) -> Graph:
    """A graph over current elements; ``versions`` may hold all versions beside them.

    ``nodes``: label to properties and their SQL types; ``relations``: label to start
    label, end label and properties.  Elements are told apart by source and identifier.
    With ``history`` the elements are all versions, and those not current are marked.
    """
    graph = Graph()
    key = lambda source, id_: F.concat_ws("\x1f", F.coalesce(*[F.col(c) for c in source], F.lit("")), F.col(id_))
    more = {"seq": "seq", "live": "current"} if history else {"seq": "seq"}

    def typed(df: DataFrame, label: str, kind: str, props: dict[str, str], *columns) -> DataFrame:
        own = df.where((F.col("element_type") == kind) & F.array_contains("labels", label))
        marks = [c for c in ("seq", "live", "current") if c in df.columns]
        return own.select(key(["source_id"], "element_id").alias("@key"), "element_id", "effective_from", *marks, *columns, *[F.try_element_at("properties", F.lit(p)).try_cast(t).alias(p) for p, t in props.items()])

    for label, props in nodes.items():
        own = typed(elements, label, "node", props)
        own = own if history else own.select(*[c for c in own.columns if c not in ("live", "current")])
        past = None
        if versions is not None:
            past = typed(versions, label, "node", props)
            past = past.withColumn("current", F.col("live")).drop("live")
            own = own.withColumn("current", F.lit(True))
        graph.add_nodes(label, own.drop("live"), "@key", "effective_from", history, id="element_id", versions=past, **more | ({"live": "current"} if past is not None else {}))
    for label, (start, end, props) in (relations or {}).items():
        ends = [key(["src_source_id", "source_id"], "src_id").alias("src_id"), key(["dst_source_id", "source_id"], "dst_id").alias("dst_id")]
        own = typed(elements, label, "relation", props, *ends).drop("@key", "live", *([] if history else ["current"]))
        graph.add_relations(label, own, (start, "src_id"), (end, "dst_id"), "element_id", "effective_from", **more)
    return graph
