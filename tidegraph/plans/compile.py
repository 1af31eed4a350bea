"""Queries to DataFrames: match, then a chain of filters and projections."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.ast import Binary, Call, Expr, Item, Part, Query, Ref, children
from tidegraph.functions import FUNCTIONS, Registry
from tidegraph.functions.temporal import length_nanos
from tidegraph.graph import ID, KEY, LABEL, LIVE, SEQ, TS, Graph, Slot, quoted
from tidegraph.parser import parse_cypher, parse_gql
from tidegraph.parser.grammar import base_name, has_aggregate, is_aggregate
from tidegraph.plans.expressions import Lowering, Scope
from tidegraph.plans.match import match
from tidegraph.types import LoweringError, Typed, floor_div, widened


def aggregate_calls(e: Expr) -> list[tuple[Call, Call | None]]:
    """Aggregate calls in an expression, each with the sliding window around it, if any."""
    if is_aggregate(e):
        return [(e, None)]
    if isinstance(e, Call) and base_name(e.name) == "slidingWindow":
        return [(call, e) for call, _ in aggregate_calls(e.args[1])]
    return [x for c in children(e) for x in aggregate_calls(c)]


def _unwrapped(e: Expr) -> Expr:
    """An expression without markers that only change how its aggregates are fed."""
    while isinstance(e, Call) and base_name(e.name) in ("slidingWindow", "retainHistory") and len(e.args) == (2 if base_name(e.name) == "slidingWindow" else 1):
        e = e.args[-1]
    return e


#: Tells the rows of a result apart: the elements matched, or the keys of their group.
ROW = "@rid"


def retains(e: Expr) -> bool:
    return isinstance(e, Call) and base_name(e.name) == "retainHistory" or any(map(retains, children(e)))


class Compiler:
    """Turns a parsed query into a DataFrame over a graph, as of a clock.

    With ``rows`` the result has a column ROW.  With ``states``, which gives the table
    that the n-th function with a memory left behind (None at first), such functions
    go on from there, and ``kept`` holds the tables they leave behind now.
    """

    def __init__(self, graph: Graph, registry: Registry = FUNCTIONS, params: dict[str, object] | None = None, now: dt.datetime | Column | None = None, rows: bool = False, states: Callable[[int], DataFrame | None] | None = None):
        self.graph, self.registry, self.params, self.fresh = graph, registry, params or {}, count(1)
        self.now = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.timestamp_millis(F.lit(int(now.timestamp() * 1000)))
        self.df: DataFrame | None = None
        self.scope = Scope()
        self.rows, self.states, self.kept = rows or states is not None, states, []

    def lowering(self, scope: Scope) -> Lowering:
        return Lowering(scope, self.now, self.registry, self.params, add_column=_Columns(self))

    def run(self, query: Query) -> DataFrame:
        first = query.parts[0]
        self.df, slots = match(self.graph, first.paths, self.lowering)
        if self.rows:
            ids = [c for c in self.df.columns if c.endswith((f".{KEY}", f".{ID}"))]
            self.df = self.df.withColumn(ROW, F.to_json(F.array(*[quoted(c).cast("string") for c in ids]), {"ignoreNullFields": "false"}))
        self.scope = Scope(slots)
        # versions that are not current only count where an aggregate retains history
        if not any(retains(e) for p in query.parts for e in [*p.where, *(i.expr for i in p.items)]) and any(t.live for t in self.graph.nodes.values()):
            live = self.lowering(self.scope).live()
            self.df = self.df if live is None else self.df.where(live)
        for k, part in enumerate(query.parts):
            for e in part.where:
                self.filter(e, part)
            self.project(part, last=k == len(query.parts) - 1)
        return self.df

    def guarded(self, low: Lowering) -> None:
        for g in low.guards:
            self.df = self.df.where(g)
        low.guards.clear()

    def filter(self, e: Expr, part: Part) -> None:
        if isinstance(e, Binary) and e.op == "AND" and has_aggregate(e):  # what stands to the right folds rows that pass the left
            self.filter(e.left, part)
            return self.filter(e.right, part)
        low = self.lowering(self.scope)
        if calls := aggregate_calls(e):
            self.fold_beside(low, calls, part)
        condition = low.condition(e)
        self.guarded(low)
        self.df = self.df.where(condition)

    def keyed(self, part: Part) -> list[Item]:
        """The grouping items of an aggregating part."""
        if part.keys is None:
            return [i for i in part.items if not has_aggregate(i.expr)]
        by_name = {i.name: i for i in part.items}
        return [by_name.get(k.name, Item(k)) if isinstance(k, Ref) and k.name in by_name else next((i for i in part.items if i.expr == k), Item(k)) for k in part.keys]

    def fold_beside(self, low: Lowering, calls: list, part: Part) -> None:
        """Aggregates in a filter are folded by the groups of the part's projection, over all rows if it has none, and joined to the rows."""
        names, columns = {}, []
        for call, window in calls:
            name = f"@a{next(self.fresh)}"
            columns.append(self.folded(low, call, window).alias(name))
            names[window or call] = name
        at = f"@a{next(self.fresh)}"
        columns.append(F.max(low.changed_at()).alias(at))
        grouped = part.keys is not None or any(has_aggregate(i.expr) for i in part.items)
        keys = []
        for item in self.keyed(part) if grouped else []:
            keys.append(f"@g{next(self.fresh)}")
            self.df = self.df.withColumn(keys[-1], low.value(item.expr).col)
        if keys:
            there = [f"{k}'" for k in keys]
            one = self.df.groupBy(*[quoted(k).alias(t) for k, t in zip(keys, there)]).agg(*columns)
            self.df = self.df.join(one, reduce(and_, [quoted(k).eqNullSafe(quoted(t)) for k, t in zip(keys, there)])).drop(*map(quoted, there))
        else:
            one = self.df.agg(*columns)  # one row
            self.df = self.df.crossJoin(F.broadcast(one))
        kinds = {f.name: f.dataType for f in one.schema}
        low.aggregated = {c: Typed(quoted(n), widened(kinds[n])) for c, n in names.items()}
        low.group_at, low.group_key = quoted(at), F.to_json(F.array(*[quoted(k).cast("string") for k in keys]), {"ignoreNullFields": "false"})

    def folded(self, low: Lowering, call: Call, window: Call | None) -> Column:
        return self.folded_typed(low, call, window).col

    def folded_typed(self, low: Lowering, call: Call, window: Call | None) -> Typed:
        if window is not None:
            ends = low.changed_at() + floor_div(length_nanos(low.value(window.args[0])), 1_000_000)
            low.expiry = low.now_ms() < ends
        low.retained = retains(call)
        try:
            return low.aggregate(Call(call.name, tuple(_unwrapped(a) for a in call.args)))
        finally:
            low.expiry, low.retained = None, False

    # -- projection
    def project(self, part: Part, last: bool) -> None:
        low = self.lowering(self.scope)
        if part.keys is not None or any(has_aggregate(i.expr) for i in part.items):
            self.group(part, low, last)
        else:
            self.select(part.items, low, last)

    def outputs(self, item: Item, low: Lowering, last: bool, scope: Scope) -> list[Column]:
        """Columns an item becomes; later parts see them through ``scope``."""
        x = low.value(item.expr)
        if x.node is not None and not last:
            slot = low.scope.slots[x.node]
            scope.slots[item.name] = slot.renamed(item.name)
            present = [c for c in self.df.columns if c.startswith(f"{x.node}.") and "." not in c[len(x.node) + 1 :]]
            return [quoted(c).alias(f"{item.name}.{c[len(x.node) + 1 :]}") for c in present]
        x = low.element(x)
        scope.values[item.name] = Typed(quoted(item.name), x.type)
        col = x.col.cast("string") if last and isinstance(x.type, T.NullType) else x.col
        return [col.alias(item.name)]

    def select(self, items: list[Item], low: Lowering, last: bool) -> None:
        scope = Scope()
        columns = [c for i in items for c in self.outputs(i, low, last, scope)]
        if not last:  # the time of the last change goes along
            scope = self.carry(scope, low, columns)
        self.guarded(low)
        self.df = self.df.select(*columns, *([ROW] if self.rows else []))
        self.scope = scope

    def carry(self, scope: Scope, low: Lowering, columns: list[Column]) -> Scope:
        if not scope.slots:
            name = "@row"
            columns += [low.order()["ts"].alias(f"{name}.{TS}"), low.order()["seq"].alias(f"{name}.{SEQ}"), F.lit("").alias(f"{name}.{ID}")]
            scope.slots[name] = Slot(name, (), {})
        return scope

    def group(self, part: Part, low: Lowering, last: bool) -> None:
        items = part.items
        keyed = self.keyed(part)
        keys: list[Column] = []
        scope = Scope()
        columns: list[Column] = []  # of the aggregated frame
        for k, i in enumerate(keyed):
            x = low.value(i.expr)
            if x.node is not None:
                slot = low.scope.slots[x.node]
                held = [c for c in self.df.columns if c.startswith(f"{x.node}.") and "." not in c[len(x.node) + 1 :]]
                for c in held:
                    target = f"@k{k}.{c[len(x.node) + 1 :]}"
                    if c == slot.name(ID):
                        keys.append(quoted(c).alias(target))
                    else:  # the same for all rows of an element
                        columns.append(F.first(quoted(c)).alias(target))
                scope.slots[f"@k{k}"] = slot.renamed(f"@k{k}")
            else:
                keys.append(x.col.alias(f"@k{k}"))
                scope.values[f"@k{k}"] = Typed(quoted(f"@k{k}"), x.type)
        aggregated: dict[Expr, Typed] = {}
        for i in items:
            if i in keyed:
                continue
            for call, window in aggregate_calls(i.expr):
                target = window or call
                if target not in aggregated:
                    name = f"@a{next(self.fresh)}"
                    x = self.folded_typed(low, call, window)
                    columns.append(x.col.alias(name))
                    aggregated[target] = Typed(quoted(name), x.type)
            for e in self.loose(i.expr):  # taken from the group's latest row
                if e not in aggregated:
                    name = f"@a{next(self.fresh)}"
                    x = low.element(low.value(e))
                    columns.append(F.max_by(x.col, low.order()).alias(name))
                    aggregated[e] = Typed(quoted(name), x.type)
        columns.append(F.max(low.order()).alias("@last"))
        self.guarded(low)
        self.df = self.df.groupBy(*keys).agg(*columns)
        named = [c for c in self.df.columns if re.match(rf"@k\d+($|\.{KEY}$|\.{ID}$)", c)]
        more = {f"@row.{TS}": F.col("`@last`.ts"), f"@row.{SEQ}": F.col("`@last`.seq"), f"@row.{ID}": F.lit("")}
        if self.rows:
            more[ROW] = F.to_json(F.array(*[quoted(c).cast("string") for c in named]), {"ignoreNullFields": "false"})
        self.df = self.df.withColumns(more).drop("@last")
        scope.slots["@row"] = Slot("@row", (), {})
        after = self.lowering(scope)
        after.aggregated = aggregated
        for k, i in enumerate(keyed):
            after.aggregated = after.aggregated | {i.expr: Typed(scope.slots[f"@k{k}"].col(ID), T.StringType(), node=f"@k{k}") if f"@k{k}" in scope.slots else scope.values[f"@k{k}"]}
        self.select(items, after, last)

    def loose(self, e: Expr) -> list[Expr]:
        """Row values used beside aggregates."""
        if is_aggregate(e) or isinstance(e, Call) and base_name(e.name) == "slidingWindow":
            return []
        if not has_aggregate(e):
            return [e] if self.reads_row(e) else []
        return [x for c in children(e) for x in self.loose(c)]

    def reads_row(self, e: Expr) -> bool:
        return isinstance(e, Ref) and (e.name in self.scope.values or e.name in self.scope.slots) or any(map(self.reads_row, children(e)))


class _Columns:
    """Adds helper columns, versions of elements and memories of functions to the frame being compiled."""

    def __init__(self, compiler: Compiler):
        self.compiler = compiler

    def __call__(self, col: Column) -> Column:
        name = f"@w{next(self.compiler.fresh)}"
        self.compiler.df = self.compiler.df.withColumn(name, col)
        return quoted(name)

    # -- memories
    @property
    def keeps(self) -> bool:
        return self.compiler.states is not None

    def before(self, schema: str, key: Column | None = None) -> dict[str, Column]:
        """What a function kept for each row (or for another key), as columns; nulls where it kept nothing."""
        c = self.compiler
        n, name = len(c.kept), f"@s{next(c.fresh)}"
        c.kept.append(None)
        fields = [f.split()[0] for f in schema.split(", ")]
        own = self(quoted(ROW) if key is None else key)
        if (held := c.states(n)) is None:
            out = {f: self(F.lit(None).cast(f_type)) for f, f_type in (x.split(" ", 1) for x in schema.split(", "))}
        else:
            held = held.select(F.col("key").alias(f"{name}.key"), *[F.col(f).alias(f"{name}.{f}") for f in fields])
            c.df = c.df.join(held, own == quoted(f"{name}.key"), "left").drop(quoted(f"{name}.key"))
            out = {f: quoted(f"{name}.{f}") for f in fields}
        return out | {"@n": n, "@key": own}

    def keep(self, before: dict, wanted: Column, **columns: Column) -> None:
        """What a function leaves behind for the rows at hand."""
        c = self.compiler
        c.kept[before["@n"]] = c.df.where(wanted).groupBy(before["@key"].alias("key")).agg(*[F.first(x).alias(k) for k, x in columns.items()])

    # -- versions
    def past(self, slot: Slot) -> tuple[Slot, DataFrame]:
        tables = [self.compiler.graph.nodes[x] for x in slot.labels]
        if not (slot.history or slot.versions):
            raise LoweringError("versions need a label registered with its history")
        return self.compiler.graph.node_slot("@h", slot.labels, past=not all(t.history for t in tables))

    def joined(self, slot: Slot, table: DataFrame, name: str) -> Column:
        """A column per element, by the element of a slot; table: key, label, value."""
        c = self.compiler
        renamed = table.toDF(f"{name}.key", f"{name}.label", name)
        c.df = c.df.join(renamed, (slot.col(KEY) == quoted(f"{name}.key")) & (slot.col(LABEL) == quoted(f"{name}.label")), "left").drop(quoted(f"{name}.key"), quoted(f"{name}.label"))
        return quoted(name)

    @staticmethod
    def version(held: Slot) -> tuple[Column, T.StructType]:
        """A version as a struct of ``@ts``, its number, the identifier and the properties."""
        fields = F.struct(held.col(TS).alias("@ts"), held.col(SEQ).alias("@seq"), held.col(ID).alias("id"), *[held.col(p).alias(p) for p in held.props if p != "id"])
        return fields, T.StructType([T.StructField("@ts", T.LongType()), T.StructField("@seq", T.LongType()), T.StructField("id", T.StringType()), *[T.StructField(p, t) for p, t in held.props.items() if p != "id"]])

    def versions(self, slot: Slot, between: tuple[Column, Column] | None = None) -> Typed:
        """All versions of a slot's element, or those between two times, in order."""
        held, df = self.past(slot)
        fields, kind = self.version(held)
        if between is not None:
            df = df.where(held.col(TS).between(*between))
        lists = df.groupBy(held.col(KEY), held.col(LABEL)).agg(F.array_sort(F.collect_list(fields)))
        return Typed(self.joined(slot, lists, f"@v{next(self.compiler.fresh)}"), T.ArrayType(kind))

    def version_at(self, slot: Slot, when: Column) -> Typed:
        """The last version of a slot's element at a time."""
        held, df = self.past(slot)
        fields, kind = self.version(held)
        last = df.where(held.col(TS) <= when).groupBy(held.col(KEY), held.col(LABEL)).agg(F.max_by(fields, F.struct(held.col(TS), held.col(SEQ))))
        return Typed(self.joined(slot, last, f"@v{next(self.compiler.fresh)}"), kind)

    def from_versions(self, slot: Slot, make: Callable[[Lowering, list[Column]], Column]) -> Column:
        """A value per element over its versions since its last insert, read at the last of them."""
        held, df = self.past(slot)
        df = df.where(held.col(LIVE))
        c, low = self.compiler, self.compiler.lowering(Scope({slot.alias: held}))
        keys = [held.col(KEY), held.col(LABEL)]
        each = df.withColumn("@x", make(low, keys))
        last = each.groupBy(*keys).agg(F.max_by("@x", F.struct(held.col(TS), held.col(SEQ))))
        return self.joined(slot, last, f"@v{next(c.fresh)}")


def compile_query(graph: Graph, text: str, language: str = "cypher", **options) -> DataFrame:
    """The result of a query over the graph's current tables, as a DataFrame not yet run."""
    if language not in ("cypher", "gql"):
        raise ValueError(f"unknown language {language!r}")
    parsed = parse_cypher(text) if language == "cypher" else parse_gql(text)
    return Compiler(graph, **options).run(parsed)


