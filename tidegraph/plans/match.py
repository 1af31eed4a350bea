"""Pattern matching as joins.

Slots join along the pattern's relations in the order in which they connect; Catalyst
picks and reorders the physical joins.  Inline predicates filter a slot before it is
joined.  Patterns that do not connect are refused rather than multiplied.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.ast import Binary, Expr, NodePattern, Path, Prop, Ref, RelationPattern
from tidegraph.graph import ID, KEY, LABEL, LIVE, SEQ, TS, Graph, Slot
from tidegraph.plans.expressions import Scope
from tidegraph.types import LoweringError


def _rebased(e: Expr, alias: str) -> Expr:
    """Inline properties of an element without a name, under the name it is given."""
    if isinstance(e, Binary) and isinstance(e.left, Prop) and e.left.of == Ref(""):
        return Binary(e.op, Prop(Ref(alias), e.left.key), e.right)
    return e


class Matcher:
    def __init__(self, graph: Graph, lowering):
        self.graph, self.lowering, self.fresh = graph, lowering, count(1)
        self.slots: dict[str, Slot] = {}
        self.named: set[str] = set()
        self.df: DataFrame | None = None

    def aliased(self, path: Path) -> Path:
        nodes = []
        for n in path.nodes:
            alias = n.alias or f"@n{next(self.fresh)}"
            nodes.append(n if n.alias else NodePattern(alias, n.labels, tuple(_rebased(e, alias) for e in n.where)))
        return replace(path, nodes=tuple(nodes))

    def run(self, paths: list[Path]) -> tuple[DataFrame, dict[str, Slot]]:
        paths = [self.aliased(p) for p in paths]
        steps = [self.steps(p) for p in paths if not p.optional]
        wanted = self.labels_of([n for p in paths for n in p.nodes])
        waiting = [s for path in steps for s in path]
        if waiting:
            self.bind(waiting[0][0], wanted)
        if self.df is None:
            raise LoweringError("a query needs a pattern that is not optional")
        singles = [p.nodes[0] for p in paths if not p.optional and not p.relations]
        if any(n.alias not in self.slots for n in singles):
            raise LoweringError("patterns must be connected")
        waiting = [s for s in waiting if s[1] is not None]
        while waiting:
            step = next((s for s in waiting if s[0].alias in self.slots or s[2].alias in self.slots), None)
            if step is None:
                raise LoweringError("patterns must be connected")
            waiting.remove(step)
            self.extend(*step, wanted)
        for p in paths:
            if p.optional:
                self.optional(p, wanted)
        named = {k: s for k, s in self.slots.items() if k in self.named}
        unnamed = [s for k, s in self.slots.items() if k not in self.named and s.history]
        if unnamed:  # elements without a name count for whether a row is current
            alive = reduce(and_, [F.coalesce(s.col(LIVE), F.lit(True)) for s in unnamed])
            more = {f"@alive.{LIVE}": alive, f"@alive.{ID}": F.lit(""), f"@alive.{TS}": F.lit(0).cast("long"), f"@alive.{SEQ}": F.lit(0).cast("long")}
            self.df, named["@alive"] = self.df.withColumns(more), Slot("@alive", (), {}, True)
        return self.df, named

    def labels_of(self, nodes: list[NodePattern]) -> dict[str, tuple[tuple[str, ...], tuple[Expr, ...]]]:
        """Labels and predicates of each alias, wherever in the pattern they are given."""
        out: dict[str, tuple[tuple[str, ...], tuple[Expr, ...]]] = {}
        for n in nodes:
            labels, where = out.get(n.alias, ((), ()))
            if n.labels and labels and set(n.labels) != set(labels):
                raise LoweringError(f"{n.alias} is given different labels")
            out[n.alias] = (labels or n.labels, where + n.where)
        return out

    def steps(self, path: Path) -> list[tuple[NodePattern, RelationPattern | None, NodePattern | None]]:
        nodes = path.nodes
        self.named |= {n.alias for n in nodes if not n.alias.startswith("@")}
        if not path.relations:
            return [(nodes[0], None, None)]
        return [(a, r, b) for a, r, b in zip(nodes, path.relations, nodes[1:])]

    def scan(self, alias: str, wanted: dict) -> tuple[Slot, DataFrame]:
        labels, where = wanted[alias]
        slot, df = self.graph.node_slot(alias, labels)
        for e in where:
            df = df.where(self.lowering(Scope({alias: slot})).condition(e))
        return slot, df

    def bind(self, node: NodePattern, wanted: dict) -> None:
        self.slots[node.alias], self.df = self.scan(node.alias, wanted)

    def extend(self, a: NodePattern, r: RelationPattern, b: NodePattern, wanted: dict) -> None:
        known = a.alias in self.slots
        new = b if known else a
        if a.alias in self.slots and b.alias in self.slots:
            self.df = self.link(self.df, self.slots, a.alias, r, b.alias, None, None, "inner")
            return
        slot, df = self.scan(new.alias, wanted)
        self.df = self.link(self.df, self.slots | {new.alias: slot}, a.alias, r, b.alias, new.alias, df, "inner")
        self.slots[new.alias] = slot

    def relation(self, r: RelationPattern, slots: dict[str, Slot], a: str, b: str) -> tuple[list, list]:
        """Relation tables and joins that the pattern may mean between these ends."""
        labels = r.labels or tuple(dict.fromkeys([*self.graph.relations, *self.graph.joins]))
        if missing := [x for x in labels if x not in self.graph.relations and x not in self.graph.joins]:
            raise LoweringError(f"no relations with label {', '.join(missing)}")
        left, right = set(slots[a].labels), set(slots[b].labels)
        tables = []
        for t in (t for x in labels for t in self.graph.relations.get(x, [])):
            forward, backward = t.start_label in left and t.end_label in right, t.end_label in left and t.start_label in right
            if r.direction == "right" and forward or r.direction == "left" and backward or r.direction == "either" and (forward or backward):
                tables.append(t)
        joins = []
        for j in (self.graph.joins[x] for x in labels if x in self.graph.joins):
            joins += [(j, x, y) for x in j.keys for y in j.keys if x != y and x[0] in left and y[0] in right]
        if not tables and not joins:
            raise LoweringError(f"no relation of {'|'.join(labels)} connects {a} and {b}")
        return tables, joins

    def link(self, df: DataFrame, slots: dict[str, Slot], a: str, r: RelationPattern, b: str, new: str | None, new_df: DataFrame | None, how: str) -> DataFrame:
        """Join ``df`` with the node ``new`` (None: both ends are bound) over the relation."""
        tables, joins = self.relation(r, slots, a, b)
        if tables and joins:
            raise LoweringError("a pattern cannot mix relations of tables with joins of properties")
        if joins:
            if r.where:
                raise LoweringError("a join of properties has no properties of its own")
            condition = self.property_condition(slots, a, b, joins)
            return df.where(condition) if new is None else df.join(new_df, condition, how)
        alias = r.alias or f"@r{next(self.fresh)}"
        if alias in self.slots:
            raise LoweringError(f"{alias} names two relations")
        slot, rows = self.graph.relation_rows(alias, tables, r.direction)
        for e in r.where:
            rows = rows.where(self.lowering(Scope({alias: slot})).condition(_rebased(e, alias)))
        self.slots[alias] = slot
        if r.alias:
            self.named.add(r.alias)
        ends = {a: self.end(slots[a], slot, "from", tables), b: self.end(slots[b], slot, "to", tables)}
        if new is None:
            return df.join(rows, ends[a] & ends[b], how)
        bound = b if new == a else a
        if how == "inner":
            return df.join(rows, ends[bound], how).join(new_df, ends[new], how)
        return df.join(rows.join(new_df, ends[new]), ends[bound], how)

    @staticmethod
    def end(node: Slot, relation: Slot, side: str, tables: list) -> Column:
        condition = node.col(KEY) == relation.col(f"@{side}")
        labels = {t.start_label for t in tables} | {t.end_label for t in tables}
        several = len(node.labels) > 1 or len(labels & set(node.labels)) < len({getattr(t, f"{'start' if side == 'from' else 'end'}_label") for t in tables})
        return condition & (node.col(LABEL) == relation.col(f"@{side}_label")) if several else condition

    @staticmethod
    def property_condition(slots: dict[str, Slot], a: str, b: str, joins: list) -> Column:
        out = None
        for _, (la, pa), (lb, pb) in joins:
            if pa not in slots[a].props or pb not in slots[b].props:
                raise LoweringError(f"join of {la}.{pa} with {lb}.{pb}: no such property")
            one = slots[a].col(pa) == slots[b].col(pb)
            if len(slots[a].labels) > 1:
                one &= slots[a].col(LABEL) == la
            if len(slots[b].labels) > 1:
                one &= slots[b].col(LABEL) == lb
            out = one if out is None else out | one
        return out

    def optional(self, path: Path, wanted: dict) -> None:
        """Left join of the whole optional path, joined up beforehand."""
        waiting = [s for s in self.steps(path) if s[1] is not None]
        if not waiting:
            if path.nodes[0].alias not in self.slots:
                raise LoweringError("an optional pattern must touch what is matched before it")
            return
        outer_df, outer = self.df, dict(self.slots)
        shared = [n.alias for n in path.nodes if n.alias in outer]
        if not shared:
            raise LoweringError("an optional pattern must touch what is matched before it")
        if len(waiting) == 1 and len(set(shared)) == 1:
            a, r, b = waiting[0]
            new = b.alias if a.alias in outer else a.alias
            slot, df = self.scan(new, wanted)
            self.df = self.link(outer_df, outer | {new: slot}, a.alias, r, b.alias, new, df, "left_outer")
            self.slots[new] = slot
            return
        # longer paths: match the path by itself, over the keys of what it shares, then join it back
        inner = Matcher(self.graph, self.lowering)
        inner.fresh = self.fresh
        rename = {x: f"@o{next(self.fresh)}{x}" for x in dict.fromkeys(shared)}
        moved = lambda n: NodePattern(rename.get(n.alias, n.alias), wanted[n.alias][0], () if n.alias in rename else wanted[n.alias][1])
        df, _ = inner.run([Path(tuple(map(moved, path.nodes)), path.relations)])
        condition = None
        for x, y in rename.items():
            one = (outer[x].col(KEY) == inner.slots[y].col(KEY)) & (outer[x].col(LABEL) == inner.slots[y].col(LABEL))
            condition = one if condition is None else condition & one
        keep = {k: s for k, s in inner.slots.items() if k not in rename.values()}
        columns = [c for c in df.columns if c.rpartition(".")[0] in keep or c.rpartition(".")[2] in (KEY, LABEL)]
        self.df = outer_df.join(df.select(*[F.col(f"`{c}`") for c in columns]), condition, "left_outer")
        self.slots = outer | keep
        self.named |= {k for k in keep if not k.startswith("@")}


def match(graph: Graph, paths: list[Path], lowering) -> tuple[DataFrame, dict[str, Slot]]:
    """Solutions of the patterns, and the slots they bind by alias.  ``lowering`` makes one for a scope."""
    return Matcher(graph, lowering).run(paths)


