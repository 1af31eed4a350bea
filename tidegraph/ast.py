"""Syntax tree shared by both query languages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """Base of all expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Ref(Expr):
    name: str


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    start: Expr | None
    end: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    body: Expr | None


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    where: Expr | None
    body: Expr


@dataclass(frozen=True)
class Item:
    """A projected expression and the name it gets."""

    expr: Expr
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        match self.expr:
            case Prop(_, key):
                return key
            case Ref(name):
                return name
            case Call(name):
                return name
            case Case():
                return "case"
            case ListOf():
                return "list"
            case MapOf():
                return "object"
            case Comprehension():
                return "iterator"
        return "expression"


@dataclass(frozen=True)
class NodePattern:
    alias: str | None
    labels: tuple[str, ...]
    where: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class RelationPattern:
    alias: str | None
    labels: tuple[str, ...]
    direction: str  # right, left, either
    where: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Path:
    nodes: tuple[NodePattern, ...]
    relations: tuple[RelationPattern, ...]
    optional: bool = False


@dataclass
class Part:
    """One step: patterns (first part only), filters, then a projection.

    ``keys`` are the explicit grouping keys of GROUP BY (None: implicit grouping);
    ``keep_scope`` adds the items to what is in scope instead of replacing it.
    """

    paths: list[Path] = field(default_factory=list)
    where: list[Expr] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    keys: list[Expr] | None = None
    keep_scope: bool = False


@dataclass
class Query:
    parts: list[Part]


def children(e: Expr) -> list[Expr]:
    match e:
        case Prop(of, _) | Unary(_, of):
            return [of]
        case Index(of, at):
            return [of, at]
        case Slice(of, a, b):
            return [x for x in (of, a, b) if x is not None]
        case Call(_, args):
            return list(args)
        case Binary(_, a, b):
            return [a, b]
        case Case(subject, whens, otherwise):
            return [x for x in (subject, *(y for w in whens for y in w), otherwise) if x is not None]
        case ListOf(items):
            return list(items)
        case MapOf(items):
            return [v for _, v in items]
        case Comprehension(_, source, where, body):
            return [x for x in (source, where, body) if x is not None]
        case Reduce(_, init, _, source, where, body):
            return [x for x in (init, source, where, body) if x is not None]
    return []
