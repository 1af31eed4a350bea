"""A labelled property graph over DataFrames.

Each label is a table with a key; relations are tables of their own or equalities of
properties (synthetic joins).  Only tables a query names are ever read, and only the
columns it uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.types import LoweringError, common, widened

ID, KEY, LABEL, TS, SEQ, LIVE = "@id", "@key", "@label", "@ts", "@seq", "@live"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: A table, or a function that opens it when a query first needs it.
Table = DataFrame | Callable[[], DataFrame]


class _Opened:
    source: Table

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()


@dataclass(frozen=True)
class NodeTable(_Opened):
    """Elements of a label.  ``effective_from``: column with milliseconds or a timestamp.

    ``history`` tables hold all versions of their elements, and queries over them give a
    row per version; others hold the current one, and ``versions`` (same columns) may
    hold them all beside it.  ``id`` is the identifier shown where it is not the key,
    ``seq`` orders changes of one time, ``live`` tells a current version from others.
    """

    label: str
    source: Table
    key: str
    effective_from: str | None = None
    history: bool = False
    versions: Table | None = None
    id: str | None = None
    seq: str | None = None
    live: str | None = None

    @property
    def hidden(self) -> set[str]:
        """Columns that are no properties."""
        return {c for c in (self.id and self.key, self.seq, self.live) if c}

    def past(self) -> NodeTable:
        """The table of all versions, as one with history."""
        return replace(self, source=self.versions if self.versions is not None else self.source, history=True, versions=None)


@dataclass(frozen=True)
class RelationTable(_Opened):
    """Relations with columns that hold the keys of their start and end."""

    label: str
    source: Table
    start_label: str
    start: str
    end_label: str
    end: str
    key: str | None = None
    effective_from: str | None = None
    seq: str | None = None
    live: str | None = None


@dataclass(frozen=True)
class PropertyJoin:
    """Nodes with equal properties are related both ways; two equal entries never pair."""

    id: str
    keys: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Slot:
    """What is bound to a pattern's alias: columns ``alias.property`` and their types."""

    alias: str
    labels: tuple[str, ...]
    props: dict[str, T.DataType]
    history: bool = False
    #: Whether all versions are at hand beside the current ones.
    versions: bool = False

    def col(self, prop: str) -> Column:
        return quoted(f"{self.alias}.{prop}")

    def name(self, prop: str) -> str:
        return f"{self.alias}.{prop}"

    def renamed(self, alias: str) -> Slot:
        return replace(self, alias=alias)


def _millis(df: DataFrame, name: str | None) -> Column:
    if name is None:
        return F.lit(0).cast("long")
    return F.unix_millis(F.col(name).cast("timestamp")) if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(name).cast("long")


@dataclass
class Graph:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    relations: dict[str, list[RelationTable]] = field(default_factory=dict)
    joins: dict[str, PropertyJoin] = field(default_factory=dict)

    def add_nodes(self, label: str, df: Table, key: str, effective_from: str | None = None, history: bool = False, **more) -> Graph:
        self.nodes[label] = NodeTable(label, df, key, effective_from, history, **more)
        return self

    def add_relations(self, label: str, df: Table, start: tuple[str, str], end: tuple[str, str], key: str | None = None, effective_from: str | None = None, **more) -> Graph:
        self.relations.setdefault(label, []).append(RelationTable(label, df, *start, *end, key, effective_from, **more))
        return self

    def add_join(self, id: str, *keys: tuple[str, str]) -> Graph:
        self.joins[id] = PropertyJoin(id, tuple(keys))
        return self

    def schema(self) -> dict[str, dict[str, str]]:
        """Properties and their types by node label."""
        return {label: {f.name: f.dataType.simpleString() for f in t.df.schema} for label, t in self.nodes.items()}

    def node_slot(self, alias: str, labels: tuple[str, ...], past: bool = False) -> tuple[Slot, DataFrame]:
        """The nodes with any of the labels (all nodes if none is given); with ``past`` all their versions."""
        wanted = labels or tuple(self.nodes)
        if missing := [x for x in wanted if x not in self.nodes]:
            raise LoweringError(f"no nodes with label {', '.join(missing)}")
        tables = [self.nodes[x].past() if past else self.nodes[x] for x in wanted]
        props: dict[str, T.DataType] = {}
        for name in dict.fromkeys(f.name for t in tables for f in t.df.schema if f.name not in t.hidden):
            props[name] = common([widened(t.df.schema[name].dataType) for t in tables if name in t.df.columns])
        keys = {t.df.schema[t.key].dataType.simpleString() for t in tables}
        parts = []
        for t in tables:
            key = quoted(t.key) if len(keys) == 1 else quoted(t.key).cast("string")
            own = [quoted(p).cast(kind) if p in t.df.columns else F.lit(None).cast(kind) for p, kind in props.items()]
            parts.append(
                t.df.select(
                    key.alias(f"{alias}.{KEY}"),
                    quoted(t.id or t.key).cast("string").alias(f"{alias}.{ID}"),
                    F.lit(t.label).alias(f"{alias}.{LABEL}"),
                    _millis(t.df, t.effective_from).alias(f"{alias}.{TS}"),
                    (quoted(t.seq).cast("long") if t.seq else F.lit(0).cast("long")).alias(f"{alias}.{SEQ}"),
                    (quoted(t.live) if t.live else F.lit(True)).alias(f"{alias}.{LIVE}"),
                    *[c.alias(f"{alias}.{p}") for p, c in zip(props, own)],
                )
            )
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        history, versions = any(t.history for t in tables), all(t.history or t.versions is not None for t in tables)
        return Slot(alias, wanted, props, history, versions), df

    def relation_rows(self, alias: str, tables: list[RelationTable], direction: str) -> tuple[Slot, DataFrame]:
        """Rows of relations with ``@from`` the left end and ``@to`` the right end of the pattern."""
        props: dict[str, T.DataType] = {}
        for name in dict.fromkeys(f.name for t in tables for f in t.df.schema if f.name not in (t.seq, t.live)):
            props[name] = common([widened(t.df.schema[name].dataType) for t in tables if name in t.df.columns])
        parts = []
        for t in tables:
            id_ = quoted(t.key).cast("string") if t.key else F.concat_ws(":", quoted(t.start).cast("string"), quoted(t.end).cast("string"))
            ends = [(t.start, t.start_label, t.end, t.end_label)] if direction == "right" else [(t.end, t.end_label, t.start, t.start_label)]
            if direction == "either":
                ends = [(t.start, t.start_label, t.end, t.end_label), *ends]
            for k, (a, a_label, b, b_label) in enumerate(ends):
                rows = t.df.where(quoted(t.start) != quoted(t.end)) if k and t.start_label == t.end_label else t.df
                own = [quoted(p).cast(kind) if p in t.df.columns else F.lit(None).cast(kind) for p, kind in props.items()]
                parts.append(
                    rows.select(
                        id_.alias(f"{alias}.{ID}"),
                        _millis(t.df, t.effective_from).alias(f"{alias}.{TS}"),
                        (quoted(t.seq).cast("long") if t.seq else F.lit(0).cast("long")).alias(f"{alias}.{SEQ}"),
                        (quoted(t.live) if t.live else F.lit(True)).alias(f"{alias}.{LIVE}"),
                        quoted(a).alias(f"{alias}.@from"),
                        F.lit(a_label).alias(f"{alias}.@from_label"),
                        quoted(b).alias(f"{alias}.@to"),
                        F.lit(b_label).alias(f"{alias}.@to_label"),
                        *[c.alias(f"{alias}.{p}") for p, c in zip(props, own)],
                    )
                )
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return Slot(alias, tuple(t.label for t in tables), props, any(t.live for t in tables)), df
