"""Expressions to typed columns.

Predicates are two-valued: what is not true is false, so ``NOT`` of null is true.
Equality compares values of one type only (an integer never equals a real) and holds
between nulls; inequality and order are false for null, and text has no order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.ast import Binary, Call, Case, Comprehension, Expr, Index, Lit, ListOf, MapOf, Param, Prop, Reduce, Ref, Slice, Unary, children
from tidegraph.functions import FUNCTIONS, Registry
from tidegraph.functions.registry import need
from tidegraph.functions.temporal import add_durations, epoch_millis, length_nanos, shift, temporal_field
from tidegraph.functions.text import shown
from tidegraph.graph import ID, LABEL, LIVE, SEQ, TS, Slot
from tidegraph.parser.grammar import base_name, has_aggregate, is_aggregate
from tidegraph.types import (
    BOOL,
    DATE,
    DATETIME,
    DOUBLE,
    DURATION,
    INSTANTS,
    LOCAL_DATETIME,
    LONG,
    STRING,
    LoweringError,
    Typed,
    as_bool,
    cast_to,
    common,
    duration,
    epoch_nanos,
    floor_div,
    is_list,
    is_null,
    is_number,
    is_object,
    lit,
    of_column,
)


@dataclass
class Scope:
    """Names in reach: elements of the pattern, and columns."""

    slots: dict[str, Slot] = field(default_factory=dict)
    values: dict[str, Typed] = field(default_factory=dict)


@dataclass
class Lowering:
    """Compiles expressions of one part.  ``now`` is the query's clock; ``wall`` the session's."""

    scope: Scope
    now: Column
    registry: Registry = field(default_factory=lambda: FUNCTIONS)
    params: dict[str, object] = field(default_factory=dict)
    aggregated: dict[Expr, Typed] = field(default_factory=dict)
    guards: list[Column] = field(default_factory=list)
    #: Adds a computed column to the frame and returns it (for window functions that build on each other).
    add_column: object = None
    guarded: bool = True
    expiry: Column | None = None
    #: When the group that an aggregate in a filter is folded over last changed, and the key of that group.
    group_at: Column | None = None
    group_key: Column | None = None
    #: Whether the aggregate being folded keeps values that have been replaced or deleted.
    retained: bool = False

    @property
    def wall(self) -> Column:
        return self.now

    @property
    def realtime(self) -> Column:
        return self.now

    @property
    def transaction(self) -> Column:
        return F.timestamp_millis(self.changed_at())

    def changed_at(self) -> Column:
        """When the row last changed: the latest of its elements' times."""
        times = [F.coalesce(s.col(TS), F.lit(0)) for s in self.scope.slots.values()]
        return F.greatest(*times) if len(times) > 1 else times[0] if times else F.unix_millis(self.now)

    def order(self) -> Column:
        """Changes in order: by time, then by their number."""
        stamps = [F.struct(F.coalesce(s.col(TS), F.lit(0)).alias("ts"), F.coalesce(s.col(SEQ), F.lit(0)).alias("seq")) for s in self.scope.slots.values()]
        return F.greatest(*stamps) if len(stamps) > 1 else stamps[0] if stamps else F.struct(F.unix_millis(self.now).alias("ts"), F.lit(0).cast("long").alias("seq"))

    def live(self) -> Column | None:
        """Whether all of a row's elements are current, where versions are matched; else None."""
        past = [F.coalesce(s.col(LIVE), F.lit(True)) for s in self.scope.slots.values() if s.history]
        return reduce(and_, past) if past else None

    # -- entry points
    def value(self, e: Expr) -> Typed:
        if e in self.aggregated:
            return self.aggregated[e]
        match e:
            case Lit(v):
                return lit(v)
            case Param(name):
                return lit(self.params.get(name))
            case Ref(name):
                return self.name(name)
            case Prop():
                return self.prop(e)
            case Index(of, at):
                return self.index(self.value(of), self.value(at))
            case Slice():
                return self.slice(e)
            case Unary(op, arg):
                return self.unary(op, arg)
            case Binary(op, a, b):
                return self.binary(op, a, b)
            case Case():
                return self.case(e)
            case ListOf(items):
                return self.list_of([self.element(self.value(i)) for i in items])
            case MapOf(items):
                fields = {k: self.element(self.value(v)) for k, v in items}
                kind = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
                return Typed(F.struct(*[v.col.alias(k) for k, v in fields.items()]), kind, fields=fields)
            case Comprehension():
                return self.comprehension(e)
            case Reduce():
                return self.reduce(e)
            case Call():
                return self.call(e)
        raise LoweringError(f"cannot compile {e}")

    def predicate(self, e: Expr) -> Column:
        return as_bool(self.value(e))

    def condition(self, e: Expr) -> Column:
        """A predicate for a filter, where null and false are alike: comparisons stay as scans can take them."""
        if isinstance(e, Binary):
            if e.op == "AND":
                return self.condition(e.left) & self.condition(e.right)
            if e.op in ("=", "<>", "<", "<=", ">", ">=") and e not in self.aggregated:
                a, b = self.pair(self.value(e.left), self.value(e.right))
                if a.type == b.type and not is_null(a.type) and (e.op != "=" or a.literal is not None or b.literal is not None):
                    if e.op in ("=", "<>") and a.node is None and b.node is None:
                        return a.col == b.col if e.op == "=" else a.col != b.col
                    if is_number(a.type) or a.type in (DATE, LOCAL_DATETIME, DATETIME):
                        return {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[e.op]
        return self.predicate(e)

    # -- names
    def name(self, name: str) -> Typed:
        if name in self.scope.values:
            return self.scope.values[name]
        if name in self.scope.slots:
            return Typed(self.scope.slots[name].col(ID), STRING, node=name)
        raise LoweringError(f"unknown name {name}")

    def element(self, x: Typed) -> Typed:
        """An element as a value of its own: its identifier and properties."""
        if x.node is None:
            return x
        slot = self.scope.slots[x.node]
        kind = T.StructType([T.StructField("id", STRING), *[T.StructField(p, t) for p, t in slot.props.items() if p != "id"]])
        fields = F.struct(slot.col(ID).alias("id"), *[slot.col(p).alias(p) for p in slot.props if p != "id"])
        return Typed(F.when(slot.col(ID).isNotNull(), fields), kind)

    def prop(self, e: Prop) -> Typed:
        of = self.value(e.of)
        if of.node is not None:
            slot = self.scope.slots[of.node]
            return Typed(slot.col(e.key), slot.props[e.key]) if e.key in slot.props else lit(None)
        if (found := temporal_field(of, e.key)) is not None:
            return found
        return self.get(of, e.key)

    def get(self, of: Typed, key: str) -> Typed:
        if of.fields:
            return of.fields.get(key, lit(None))
        if isinstance(of.type, T.StructType):
            return of_column(of.col[key], of.type[key].dataType) if key in of.type.fieldNames() else lit(None)
        if isinstance(of.type, T.MapType):
            return of_column(F.try_element_at(of.col, F.lit(key)), of.type.valueType)
        if isinstance(of.type, T.VariantType):
            return Typed(F.try_variant_get(of.col, f"$['{key}']", "variant"), T.VariantType())
        if is_null(of.type):
            return lit(None)
        raise LoweringError(f"{of.type.simpleString()} has no property {key}")

    def index(self, of: Typed, at: Typed) -> Typed:
        if at.type == STRING and (is_object(of.type) or isinstance(of.type, T.VariantType) or of.node is not None):
            need(isinstance(at.literal, str), "an object's index", "a literal name")
            return self.prop(Prop(Ref(of.node), at.literal)) if of.node else self.get(of, at.literal)
        if isinstance(of.type, T.VariantType):
            need(isinstance(at.literal, int), "an index into JSON", "a literal number")
            return Typed(F.try_variant_get(of.col, f"$[{at.literal}]", "variant"), T.VariantType())
        need(is_list(of.type), "an index", "a list")
        where = F.when(at.col < 0, at.col).otherwise(at.col + 1).cast("int")
        return of_column(F.try_element_at(of.col, where), of.type.elementType)

    def slice(self, e: Slice) -> Typed:
        """Half-open; a negative end counts from the end, a negative start is its size plus one."""
        of = self.value(e.of)
        need(is_list(of.type), "a slice", "a list")
        n = F.size(of.col).cast("long")
        start = self.value(e.start).col if e.start else F.lit(0).cast("long")
        end = self.value(e.end).col if e.end else n
        start = F.when(start < 0, F.abs(start) + 1).otherwise(start)
        end = F.least(F.when(end < 0, n + end).otherwise(end), n)
        size = F.greatest(end - start, F.lit(0))
        return Typed(F.slice(of.col, (start + 1).cast("int"), size.cast("int")), of.type)

    # -- operators
    def unary(self, op: str, arg: Expr) -> Typed:
        if op == "NOT":
            return Typed(~self.predicate(arg), BOOL)
        x = self.value(arg)
        if op == "IS NULL":
            return Typed(x.col.isNull(), BOOL)
        if op == "IS NOT NULL":
            return Typed(x.col.isNotNull(), BOOL)
        return Typed(-x.col, x.type) if is_number(x.type) else lit(None)

    def pair(self, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """JSON values meet typed ones as values of that type."""
        if isinstance(a.type, T.VariantType) and not isinstance(b.type, (T.VariantType, T.NullType)):
            return Typed(F.try_variant_get(a.col, "$", b.type.simpleString()), b.type), b
        if isinstance(b.type, T.VariantType) and not isinstance(a.type, (T.VariantType, T.NullType)):
            return a, Typed(F.try_variant_get(b.col, "$", a.type.simpleString()), a.type)
        return a, b

    def binary(self, op: str, left: Expr, right: Expr) -> Typed:
        if op in ("AND", "OR"):
            a, b = self.predicate(left), self.predicate(right)
            return Typed(a & b if op == "AND" else a | b, BOOL)
        a, b = self.pair(self.value(left), self.value(right))
        match op:
            case "=":
                return Typed(equal(a, b), BOOL)
            case "<>":
                same = a.type == b.type or is_number(a.type) and is_number(b.type)
                return Typed(F.coalesce(a.col != b.col, F.lit(False)) if same else F.lit(False), BOOL)
            case "<" | "<=" | ">" | ">=":
                return Typed(ordered(op, a, b), BOOL)
            case "IN":
                return Typed(within(a, b), BOOL)
            case "STARTS WITH" | "ENDS WITH" | "CONTAINS":
                if a.type != STRING or b.type != STRING:
                    return lit(None) if is_null(a.type) or is_null(b.type) else lit(False)
                return Typed({"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col), BOOL)
            case "+" | "-":
                return self.sum(op, a, b)
        return self.product(op, a, b)

    def sum(self, op: str, a: Typed, b: Typed) -> Typed:
        if is_number(a.type) and is_number(b.type):
            return Typed(a.col + b.col if op == "+" else a.col - b.col, common([a.type, b.type]))
        sign = 1 if op == "+" else -1
        if a.type in INSTANTS and b.type == DURATION:
            return shift(a, b, sign)
        if a.type == DURATION and b.type == DURATION:
            return add_durations(a, b, sign)
        texts = is_number(a.type) and b.type == STRING or a.type == STRING and (b.type in (STRING, BOOL) or is_number(b.type))
        return Typed(F.concat(shown(a), shown(b)), STRING) if op == "+" and texts else lit(None)

    def product(self, op: str, a: Typed, b: Typed) -> Typed:
        if not (is_number(a.type) and is_number(b.type)):
            return lit(None)
        kind = common([a.type, b.type])
        if op == "*":
            return Typed(a.col * b.col, kind)
        if op == "/":
            if self.guarded and b.literal in (None, 0):  # a row that divides by zero is left out
                self.guards.append(~F.coalesce(b.col == 0, F.lit(False)))
            return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), DOUBLE)
        if op == "%":
            return Typed(F.try_mod(a.col, b.col), kind)
        power = F.pow(a.col.cast("double"), b.col.cast("double"))
        return Typed(power.cast("long") if kind == LONG else power, kind)

    def case(self, e: Case) -> Typed:
        held, self.guarded = self.guarded, False
        whens = []
        for when, then in e.whens:
            if e.subject is None:
                test = self.predicate(when)
            else:
                test = same_value(*self.pair(self.value(e.subject), self.value(when)))
            whens.append((test, self.element(self.value(then))))
        other = self.element(self.value(e.otherwise)) if e.otherwise is not None else lit(None)
        self.guarded = held
        kind = common([t.type for _, t in whens] + [other.type])
        col = F
        for test, then in whens:
            col = col.when(test, cast_to(then, kind))
        return Typed(col.otherwise(cast_to(other, kind)), kind)

    def list_of(self, items: list[Typed]) -> Typed:
        kind = common([i.type for i in items])
        return Typed(F.array(*[cast_to(i, kind) for i in items]), T.ArrayType(kind))

    # -- lists
    def inner(self, **names: Typed) -> Lowering:
        scope = Scope(self.scope.slots, self.scope.values | names)
        return replace(self, scope=scope, guards=[], guarded=False)

    def source(self, e: Expr) -> Typed:
        x = self.value(e)
        if isinstance(x.type, T.VariantType):
            return Typed(F.try_variant_get(x.col, "$", "array<variant>"), T.ArrayType(T.VariantType()))
        need(is_list(x.type), "iteration", "a list")
        return x

    def _bound(self, col: Column, t: T.DataType) -> Typed:
        return of_column(col, t)

    def comprehension(self, e: Comprehension) -> Typed:
        x = self.source(e.source)
        item, col = x.type.elementType, x.col
        if e.where is not None:
            where = e.where
            col = F.filter(col, lambda v: self.inner(**{e.var: self._bound(v, item)}).predicate(where))
        if e.body is None:
            return Typed(col, x.type)
        kinds: list[T.DataType] = []

        def body(v: Column) -> Column:
            found = self.inner(**{e.var: self._bound(v, item)}).value(e.body)
            kinds.append(found.type)
            return found.col

        col = F.transform(col, body)
        return Typed(col, T.ArrayType(kinds[0]))

    def reduce(self, e: Reduce) -> Typed:
        x, init = self.source(e.source), self.value(e.init)
        item, col = x.type.elementType, x.col
        if e.where is not None:
            where = e.where
            col = F.filter(col, lambda v: self.inner(**{e.var: self._bound(v, item)}).predicate(where))
        probe: list[T.DataType] = []

        def step(kind: T.DataType):
            def run(acc: Column, v: Column) -> Column:
                found = self.inner(**{e.acc: Typed(acc, kind), e.var: self._bound(v, item)}).value(e.body)
                probe.append(found.type)
                return cast_to(found, kind) if found.type != kind else found.col

            return run

        F.aggregate(col, init.col, step(init.type))  # to learn the body's type
        kind = common([init.type, probe[0]])
        return Typed(F.aggregate(col, cast_to(init, kind), step(kind)), kind)

    # -- calls
    def call(self, e: Call) -> Typed:
        name = base_name(e.name)
        if is_aggregate(e):
            raise LoweringError(f"{e.name} cannot be used here")
        if name in self.registry.lazy:
            return self.registry.lazy[name](self, *e.args)
        if name in self.registry.mutating:
            context, inner = self.registry.mutating[name](self, *e.args)
            return context.value(inner)
        if (special := getattr(self, f"fn_{name}", None)) is not None:
            return special(*e.args)
        if name not in self.registry.known and e.name in self.registry.known:
            name = e.name
        return self.registry.build(name, self, [self.element(self.value(a)) if isinstance(a, Ref) and name in ("coalesce",) else self.value(a) for a in e.args])

    def slot_of(self, e: Expr, name: str) -> Slot:
        x = self.value(e)
        need(x.node is not None, name, "an element")
        return self.scope.slots[x.node]

    def fn_elementId(self, e: Expr) -> Typed:
        return Typed(self.slot_of(e, "elementId").col(ID), STRING)

    fn_element_id = fn_elementId

    def fn_labels(self, e: Expr) -> Typed:
        return Typed(F.array(self.slot_of(e, "labels").col(LABEL)), T.ArrayType(STRING))

    def fn_changeDateTime(self, e: Expr) -> Typed:
        return Typed(F.timestamp_millis(self.slot_of(e, "changeDateTime").col(TS)), DATETIME)

    def fn_retainHistory(self, e: Expr) -> Typed:
        return self.value(e)

    # predicates that become true as time passes: null (awaiting) until the clock allows a verdict
    def now_ms(self) -> Column:
        return F.unix_millis(self.now)

    def due(self, e: Expr) -> Column:
        return epoch_millis(self.value(e)) <= self.now_ms()

    def fn_awaiting(self) -> Typed:
        return Typed(F.lit(None).cast("boolean"), BOOL)

    def fn_trueLater(self, condition: Expr, at: Expr) -> Typed:
        return Typed(F.when(self.due(at), self.predicate(condition)), BOOL)

    def fn_trueNowOrLater(self, condition: Expr, at: Expr) -> Typed:
        return Typed(F.when(self.predicate(condition), True).when(self.due(at), False), BOOL)

    def fn_trueUntil(self, condition: Expr, at: Expr) -> Typed:
        return Typed(F.when(~self.predicate(condition), False).when(self.due(at), True), BOOL)

    def fn_trueFor(self, condition: Expr, span: Expr) -> Typed:
        """True once the condition has held for the span; the span starts with the change that made it true."""
        holds = self.predicate(condition)
        since = self.since(condition, holds)
        ends = since + floor_div(length_nanos(self.value(span)), 1_000_000)
        return Typed(F.when(~holds, False).when(ends <= self.now_ms(), True), BOOL)

    def since(self, condition: Expr, holds: Column) -> Column:
        folded = has_aggregate(condition) and self.group_at is not None
        at = self.group_at if folded else self.changed_at()
        if self.add_column.keeps:
            # state: since when the condition has held, for the rows (or groups) for which it does
            before = self.add_column.before("since long", self.group_key if folded else None)
            found = self.add_column(F.when(holds, F.coalesce(before["since"], at)))
            self.add_column.keep(before, found.isNotNull(), since=found)
            return found
        if (slot := self.one_slot(condition)) is not None and slot.versions and not slot.history:
            return F.coalesce(self.add_column.from_versions(slot, lambda low, keys: _held_since(low, condition, keys)), at)
        return at

    def one_slot(self, e: Expr) -> Slot | None:
        """The only element an expression reads, if it reads nothing else."""
        names = set() if has_aggregate(e) else read_names(e)
        slots = [self.scope.slots[n] for n in names if n in self.scope.slots]
        return slots[0] if len(slots) == 1 and len(names) == 1 else None

    def fn_future(self, e: Expr, at: Expr) -> Typed:
        x = self.element(self.value(e))
        return Typed(F.when(self.due(at), x.col), x.type)

    # earlier values of a row
    def row_window(self):
        slots = list(self.scope.slots.values())
        need(bool(slots) and any(s.history for s in slots), "an earlier value", "a label registered with its versions, or a stream")
        return Window.partitionBy(*[s.col(ID) for s in slots]).orderBy(*[c for s in slots for c in (s.col(TS), s.col(SEQ))])

    def earlier(self, e: Expr, default: Expr | None, distinct: bool) -> Typed:
        x = self.value(e)
        other = self.value(default).literal if default is not None else None
        other = F.lit(other).cast(x.type)
        if self.add_column.keeps:
            # state: the value of each row, the one before it, and the change that brought it
            kind = x.type.simpleString()
            before = self.add_column.before(f"now {kind}, earlier {kind}, ts long, seq long")
            order = self.order()
            known = before["ts"].isNotNull()
            if distinct:
                found = F.when(~known, other).when(~before["now"].eqNullSafe(x.col), before["now"]).otherwise(before["earlier"])
            else:
                again = (order["ts"] != before["ts"]) | (order["seq"] != before["seq"]) | ~before["now"].eqNullSafe(x.col)
                found = F.when(~known, other).when(again, before["now"]).otherwise(before["earlier"])
            found = self.add_column(found)
            self.add_column.keep(before, F.lit(True), now=x.col, earlier=found, ts=order["ts"], seq=order["seq"])
            return Typed(found, x.type)
        if (slot := self.one_slot(e)) is not None and slot.versions and not slot.history:
            found = self.add_column.from_versions(slot, lambda low, keys: _one_before(low, e, keys, distinct))
            return Typed(F.coalesce(found, other), x.type)
        w = self.row_window()
        if not distinct:
            return Typed(F.when(F.row_number().over(w) == 1, other).otherwise(F.lag(x.col, 1).over(w)), x.type)
        last = self.add_column(F.lag(x.col, 1).over(w))
        changed = self.add_column(F.when(~last.eqNullSafe(x.col) & last.isNotNull(), last))
        return Typed(F.coalesce(F.last(changed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), other), x.type)

    def fn_previousValue(self, e: Expr, default: Expr | None = None) -> Typed:
        return self.earlier(e, default, False)

    def fn_previousDistinctValue(self, e: Expr, default: Expr | None = None) -> Typed:
        return self.earlier(e, default, True)

    def instant(self, e: Expr) -> tuple[Column, bool]:
        """Milliseconds of an instant, and whether it is the same for all rows."""
        fixed = not read_names(e)
        at = epoch_millis(self.value(e))
        return at if fixed else self.add_column(at), fixed

    def fn_getVersionByTimestamp(self, e: Expr, at: Expr) -> Typed:
        slot = self.slot_of(e, "getVersionByTimestamp")
        when, fixed = self.instant(at)
        if fixed:  # the last version of each element is found before anything is joined
            return self.add_column.version_at(slot, when)
        versions = self.add_column.versions(slot)
        known = F.filter(versions.col, lambda v: v["@ts"] <= when)
        return Typed(F.try_element_at(known, F.lit(-1)), versions.type.elementType)

    def fn_getVersionsByTimeRange(self, e: Expr, start: Expr, end: Expr, initial: Expr | None = None) -> Typed:
        slot = self.slot_of(e, "getVersionsByTimeRange")
        (a, a_fixed), (b, b_fixed) = self.instant(start), self.instant(end)
        wanted = initial is not None and self.value(initial).literal is True
        # only versions of the range are gathered where it is the same for all rows
        versions = self.add_column.versions(slot, (a, b) if a_fixed and b_fixed else None)
        none = F.array().cast(versions.type)
        found = F.coalesce(F.filter(versions.col, lambda v: (v["@ts"] >= a) & (v["@ts"] <= b)), none)
        if wanted:
            if a_fixed and b_fixed:
                first = self.add_column.version_at(slot, a).col
                first = F.when(first.isNotNull(), F.array(first)).otherwise(none)
            else:
                first = F.slice(F.filter(versions.col, lambda v: v["@ts"] <= a), -1, 1)
            has = F.exists(found, lambda v: v["@ts"] == a)
            found = F.when((F.size(first) > 0) & ~has, F.concat(first, found)).otherwise(found)
        return Typed(F.coalesce(found, none), versions.type)

    # -- aggregates
    def aggregate(self, e: Call) -> Typed:
        """The aggregate column of a call, for ``groupBy().agg``."""
        name = base_name(e.name)
        args = [self.value(a) for a in e.args]
        # what is folded: rows of current elements unless history is retained, within the sliding window if there is one
        current = None if self.retained else self.live()
        wanted = [c for c in (current, self.expiry) if c is not None]
        live = (lambda c: F.when(reduce(and_, wanted), c)) if wanted else (lambda c: c)
        if name in self.registry.aggregating:
            return self.registry.aggregating[name](self, args, live)
        if name == "count":
            need(len(args) == 1, "count", "one argument")
            return Typed(F.count(live(args[0].col)), LONG)
        if name in ("sum", "avg"):
            x = args[0]
            fold = F.sum if name == "sum" else F.avg
            if x.type == DURATION:
                parts = [F.coalesce(fold(live(x.col[k])), F.lit(0)) for k in ("years", "months", "nanos")]
                return duration(*[F.floor(p) for p in parts])
            need(is_number(x.type) or is_null(x.type), name, "numbers or durations")
            return Typed(F.coalesce(fold(live(x.col.cast("double"))), F.lit(0.0)), DOUBLE)
        if name in ("min", "max"):
            x = args[0]
            fold = F.min if name == "min" else F.max
            need(is_number(x.type) or x.type in INSTANTS or x.type == DURATION or is_null(x.type), name, "numbers or temporal values")
            if is_number(x.type) or is_null(x.type):
                return Typed(fold(live(x.col.cast("double"))), DOUBLE)
            if x.type in (DATE, LOCAL_DATETIME, DATETIME):
                return Typed(fold(live(x.col)), x.type)
            by = F.min_by if name == "min" else F.max_by
            return Typed(by(live(x.col), length_nanos(x) if x.type == DURATION else epoch_nanos(x)), x.type)
        if name == "collect":
            x = self.element(args[0])
            rows = F.collect_list(F.when(live(x.col).isNotNull(), F.struct(self.order().alias("at"), x.col.alias("x"))))
            return Typed(F.transform(F.array_sort(rows, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda r: r["x"]), T.ArrayType(x.type))
        if name == "linearGradient":
            x, y = (a.col.cast("double") if is_number(a.type) else epoch_millis(a).cast("double") for a in args)
            return Typed(F.regr_slope(live(y), live(x)), DOUBLE)
        at = self.order() if not wanted else F.when(reduce(and_, wanted), self.order())
        return Typed(F.max_by(args[0].col, at), args[0].type)


def read_names(e: Expr) -> set[str]:
    """Names an expression reads."""
    return {e.name} if isinstance(e, Ref) else set().union(*map(read_names, children(e)))


def _held_since(low: Lowering, condition: Expr, keys: list[Column]) -> Column:
    """Over an element's versions: the time of the first of those at its end for which a condition holds."""
    holds, order = low.predicate(condition), low.order()
    broken = F.max(F.when(~holds, order)).over(Window.partitionBy(*keys))
    return F.min(F.when(holds & (broken.isNull() | (order > broken)), low.changed_at())).over(Window.partitionBy(*keys))


def _one_before(low: Lowering, e: Expr, keys: list[Column], distinct: bool) -> Column:
    """Over an element's versions: the value before the last one, or the last that differs from it."""
    x, order = low.value(e).col, low.order()
    own = Window.partitionBy(*keys)
    if not distinct:
        return F.lag(x, 1).over(own.orderBy(order))
    now = F.max_by(x, order).over(own)
    return F.max_by(F.when(~x.eqNullSafe(now), x), F.when(~x.eqNullSafe(now), order)).over(own)


def equal(a: Typed, b: Typed) -> Column:
    if a.type == b.type:
        return a.col.eqNullSafe(b.col)
    if is_null(a.type):
        return b.col.isNull()
    if is_null(b.type):
        return a.col.isNull()
    return a.col.isNull() & b.col.isNull()


def same_value(a: Typed, b: Typed) -> Column:
    """Equality of values: integers and reals compare as numbers."""
    if is_number(a.type) and is_number(b.type):
        return a.col.eqNullSafe(b.col)
    return equal(a, b)


def ordered(op: str, a: Typed, b: Typed) -> Column:
    if is_number(a.type) and is_number(b.type) or a.type == b.type and a.type in (DATE, LOCAL_DATETIME, DATETIME):
        x, y = a.col, b.col
    elif a.type in INSTANTS and b.type in INSTANTS:
        x, y = epoch_nanos(a), epoch_nanos(b)
    elif a.type == DURATION and b.type == DURATION:
        x, y = length_nanos(a), length_nanos(b)
    else:
        return F.lit(False)
    found = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.coalesce(found, F.lit(False))


def within(a: Typed, b: Typed) -> Column:
    if is_null(b.type):
        return F.lit(False)
    need(is_list(b.type), "IN", "a list")
    item = b.type.elementType
    if is_null(item) or not (a.type == item or is_null(a.type) or is_number(a.type) and is_number(item)):
        return F.coalesce(F.exists(b.col, lambda e: e.isNull()), F.lit(False)) & a.col.isNull()
    return F.coalesce(F.exists(b.col, lambda e: e.eqNullSafe(a.col)), F.lit(False))


