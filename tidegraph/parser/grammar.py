"""Tokens and grammar.

Operators bind, from loosest to tightest: AND and OR (one level), NOT, comparisons
and text and list predicates, + and -, * and /, % and ^ (one level), sign, then
property, index and slice.  Keywords are written all in capitals or all small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidegraph.ast import (
    Binary,
    Call,
    Case,
    Comprehension,
    Expr,
    Index,
    Item,
    Lit,
    ListOf,
    MapOf,
    NodePattern,
    Param,
    Part,
    Path,
    Prop,
    Query,
    Reduce,
    Ref,
    RelationPattern,
    Slice,
    Unary,
    children,
)

#: Registries add to them.
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "linearGradient", "last"}
#: ``last`` aggregates only where it is named with a namespace; alone it takes the last of a list.
NAMESPACED_ONLY = frozenset(("linearGradient", "last"))


class ParseError(ValueError):
    pass


_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/"
    r"|(?P<real>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)"
    r"""|(?P<text>'[^']*'|"[^"]*")|(?P<tick>`[^`]+`)|(?P<param>\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)"""
    r"|(?P<op><>|!=|<=|>=|<-|->|\.\.|[-+*/%^=<>(){}\[\],.:|])",
    re.S,
)
_WORDS = frozenset(
    "MATCH OPTIONAL WHERE WITH RETURN AS AND OR NOT IN IS NULL TRUE FALSE CASE WHEN THEN ELSE END STARTS ENDS CONTAINS "
    "SET DELETE CREATE LET YIELD FILTER GROUP BY NEXT CAST".split()
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"cannot read {text[at : at + 20]!r} at {at}")
        if m.lastgroup:
            word, kind = m[0], m.lastgroup
            if kind == "name" and word.upper() in _WORDS and word in (word.upper(), word.lower()):
                kind = "word"
            out.append(Token(kind, word.upper() if kind == "word" else word, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def base_name(name: str) -> str:
    """A function's name without a leading namespace of extensions."""
    head, _, tail = name.rpartition(".")
    return name if not head or head in ("date", "time", "datetime", "localtime", "localdatetime", "duration", "coll") else tail


def is_aggregate(e: Expr) -> bool:
    if not isinstance(e, Call):
        return False
    name = base_name(e.name)
    return name in AGGREGATES and (name not in NAMESPACED_ONLY or "." in e.name)


def has_aggregate(e: Expr) -> bool:
    return is_aggregate(e) or any(map(has_aggregate, children(e)))


class Parser:
    def __init__(self, text: str):
        self.toks, self.k = tokens(text), 0

    # -- tokens
    @property
    def tok(self) -> Token:
        return self.toks[self.k]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.k + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.tok.kind in ("op", "word") and self.tok.text in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.k += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text} but found {self.tok.text or 'the end'!r} at {self.tok.at}")

    def name(self) -> str:
        t = self.tok
        if t.kind == "name":
            self.k += 1
            return t.text
        if t.kind == "tick":
            self.k += 1
            return t.text[1:-1]
        raise ParseError(f"expected a name but found {t.text or 'the end'!r} at {t.at}")

    def key(self) -> str:
        """A property or field name, which may look like a keyword."""
        if self.tok.kind == "word":
            text = self.tok
            self.k += 1
            return text.text.lower()
        return self.name()

    def listed(self, one, end: str | None = None) -> list:
        out = []
        if end and self.take(end):
            return out
        out.append(one())
        while self.take(","):
            out.append(one())
        if end:
            self.need(end)
        return out

    # -- expressions
    def expr(self) -> Expr:
        left = self.negation()
        while self.at("AND", "OR"):
            op = self.tok.text
            self.k += 1
            left = Binary(op, left, self.negation())
        return left

    def negation(self) -> Expr:
        if self.take("NOT"):
            return Unary("NOT", self.negation())
        return self.comparison()

    def comparison(self) -> Expr:
        left = self.sum()
        while True:
            if self.at("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.tok.text
                self.k += 1
                left = Binary("<>" if op == "!=" else op, left, self.sum())
            elif self.take("IN"):
                left = Binary("IN", left, self.sum())
            elif self.take("CONTAINS"):
                left = Binary("CONTAINS", left, self.sum())
            elif self.at("STARTS", "ENDS"):
                op = f"{self.tok.text} WITH"
                self.k += 1
                self.need("WITH")
                left = Binary(op, left, self.sum())
            elif self.take("IS"):
                wanted = not self.take("NOT")
                self.need("NULL")
                left = Unary("IS NULL" if wanted else "IS NOT NULL", left)
            else:
                return left

    def binary(self, below, *ops: str) -> Expr:
        left = below()
        while self.at(*ops):
            op = self.tok.text
            self.k += 1
            left = Binary(op, left, below())
        return left

    def sum(self) -> Expr:
        return self.binary(self.product, "+", "-")

    def product(self) -> Expr:
        return self.binary(self.power, "*", "/")

    def power(self) -> Expr:
        return self.binary(self.sign, "%", "^")

    def sign(self) -> Expr:
        if self.take("-"):
            arg = self.sign()
            return Lit(-arg.value) if isinstance(arg, Lit) and isinstance(arg.value, (int, float)) else Unary("-", arg)
        self.take("+")
        return self.postfix()

    def postfix(self) -> Expr:
        e = self.atom()
        while True:
            if self.take("."):
                e = Prop(e, self.key())
            elif self.take("["):
                start = None if self.at("..") else self.expr()
                if self.take(".."):
                    e = Slice(e, start, None if self.at("]") else self.expr())
                else:
                    e = Index(e, start)
                self.need("]")
            else:
                return e

    def atom(self) -> Expr:
        t = self.tok
        if t.kind == "int":
            self.k += 1
            return Lit(int(t.text))
        if t.kind == "real":
            self.k += 1
            return Lit(float(t.text))
        if t.kind == "text":
            self.k += 1
            return Lit(t.text[1:-1])
        if t.kind == "param":
            self.k += 1
            return Param(t.text[1:])
        if self.take("TRUE"):
            return Lit(True)
        if self.take("FALSE"):
            return Lit(False)
        if self.take("NULL"):
            return Lit(None)
        if self.take("CASE"):
            return self.case()
        if self.take("CAST"):
            self.need("(")
            value = self.expr()
            self.need("AS")
            kind = self.name()
            self.need(")")
            return Call("CAST", (value, Lit(kind.upper())))
        if self.take("("):
            e = self.argument()
            self.need(")")
            return e
        if self.take("["):
            if self.tok.kind in ("name", "tick") and self.peek().text == "IN":
                e = self.comprehension()
                self.need("]")
                return e
            return ListOf(tuple(self.listed(self.expr, "]")))
        if self.take("{"):
            return MapOf(tuple(self.listed(self.entry, "}")))
        if t.kind in ("name", "tick"):
            return self.named()
        raise ParseError(f"unexpected {t.text or 'end'!r} at {t.at}")

    def entry(self) -> tuple[str, Expr]:
        key = self.tok.text[1:-1] if self.tok.kind == "text" else None
        if key is None:
            key = self.key()
        else:
            self.k += 1
        self.need(":")
        return key, self.expr()

    def case(self) -> Expr:
        subject = None if self.at("WHEN") else self.expr()
        whens, otherwise = [], None
        while self.take("WHEN"):
            condition = self.expr()
            self.need("THEN")
            whens.append((condition, self.expr()))
        if self.take("ELSE"):
            otherwise = self.expr()
        self.need("END")
        return Case(subject, tuple(whens), otherwise)

    def comprehension(self) -> Comprehension:
        var = self.name()
        self.need("IN")
        source = self.sum()
        where = self.expr() if self.take("WHERE") else None
        body = self.expr() if self.take("|") else None
        return Comprehension(var, source, where, body)

    def named(self) -> Expr:
        start = self.k
        names = [self.name()]
        while self.at(".") and self.peek().kind in ("name", "tick") and self.toks[start].kind == "name":
            self.k += 1
            names.append(self.name())
        if self.take("("):
            return self.call(".".join(names))
        self.k = start
        return Ref(self.name())

    def call(self, name: str) -> Expr:
        if base_name(name) == "reduce":
            acc = self.name()
            self.need("=")
            init = self.expr()
            self.need(",")
            c = self.comprehension()
            self.need(")")
            if c.body is None:
                raise ParseError("reduce needs an expression after |")
            return Reduce(acc, init, c.var, c.source, c.where, c.body)
        return Call(name, tuple(self.listed(self.argument, ")")))

    def argument(self) -> Expr:
        if self.tok.kind == "name" and self.peek().text == "IN":
            mark = self.k
            try:
                c = self.comprehension()
            except ParseError:
                c = None
            if c is not None and (c.where is not None or c.body is not None):
                return c
            self.k = mark
        return self.expr()

    # -- patterns
    def labels(self) -> tuple[str, ...]:
        if not self.take(":"):
            return ()
        out = [self.name()]
        while self.take("|"):
            self.take(":")
            out.append(self.name())
        return tuple(out)

    def inline(self, alias: str) -> tuple[Expr, ...]:
        out = []
        if self.take("{"):
            out += [Binary("=", Prop(Ref(alias), k), v) for k, v in self.listed(self.entry, "}")]
        if self.take("WHERE"):
            out.append(self.expr())
        return tuple(out)

    def node(self) -> NodePattern:
        self.need("(")
        alias = self.name() if self.tok.kind in ("name", "tick") else None
        labels = self.labels()
        where = self.inline(alias or "")
        self.need(")")
        return NodePattern(alias, labels, where)

    def relation(self) -> RelationPattern:
        left = self.take("<-")
        if not left:
            self.need("-")
        alias, labels, where = None, (), ()
        if self.take("["):
            alias = self.name() if self.tok.kind in ("name", "tick") else None
            labels = self.labels()
            if self.take("*"):
                raise ParseError("relations of variable length are not supported")
            where = self.inline(alias or "")
            self.need("]")
            right = self.take("->")
            if not right:
                self.need("-")
        else:
            right = not left and self.take(">")
        return RelationPattern(alias, labels, "left" if left else "right" if right else "either", where)

    def path(self, optional: bool) -> Path:
        nodes, relations = [self.node()], []
        while self.at("-", "<-", "->"):
            if self.take("->"):
                relations.append(RelationPattern(None, (), "right"))
            else:
                relations.append(self.relation())
            nodes.append(self.node())
        return Path(tuple(nodes), tuple(relations), optional)

    def matches(self) -> list[Path]:
        out: list[Path] = []
        while self.at("MATCH") or self.at("OPTIONAL"):
            optional = self.take("OPTIONAL")
            self.need("MATCH")
            out += self.listed(lambda optional=optional: self.path(optional))
        return out

    def wheres(self) -> list[Expr]:
        out = []
        while self.take("WHERE"):
            out.append(self.expr())
        if self.at("SET", "DELETE", "CREATE"):
            raise ParseError(f"{self.tok.text} is not supported: queries only read")
        return out

    def item(self) -> Item:
        e = self.argument()
        return Item(e, self.name() if self.take("AS") else None)

    def finish(self) -> None:
        if self.tok.kind != "end":
            raise ParseError(f"unexpected {self.tok.text!r} at {self.tok.at}")

    # -- Cypher
    def cypher(self) -> Query:
        parts = []
        while True:
            part = Part(self.matches())
            if parts and part.paths:
                raise ParseError("MATCH is only allowed before the first WITH")
            part.where = self.wheres()
            done = self.take("RETURN")
            if not done:
                self.need("WITH")
            part.items = self.listed(self.item)
            parts.append(part)
            if done:
                self.finish()
                return Query(parts)

    # -- GQL
    def gql(self) -> Query:
        part = Part(self.matches(), self.wheres())
        parts: list[Part] = []
        known = {n.alias for p in part.paths for n in p.nodes if n.alias}
        pending = part  # patterns and filters not yet closed by a projection

        def close(items: list[Item], **more) -> None:
            nonlocal pending
            pending.items = items
            for k, v in more.items():
                setattr(pending, k, v)
            parts.append(pending)
            pending = Part()

        def carry() -> list[Item]:
            return [Item(Ref(x), x) for x in sorted(known)]

        while True:
            if self.take("LET"):
                new = []
                while True:
                    name = self.name()
                    self.need("=")
                    new.append(Item(self.expr(), name))
                    if not self.take(","):
                        break
                close([*[i for i in carry() if i.name not in {n.name for n in new}], *new])
                known |= {i.name for i in new}
            elif self.take("YIELD"):
                items = self.listed(self.item)
                for i in items:
                    if i.alias is None and not isinstance(i.expr, (Ref, Prop)):
                        raise ParseError("YIELD needs AS for anything but names and properties")
                    root = i.expr
                    while isinstance(root, Prop):
                        root = root.of
                    if isinstance(root, Ref) and root.name not in known:
                        raise ParseError(f"YIELD of unknown {root.name}")
                close(items)
                known = {i.name for i in items}
            elif self.take("FILTER"):
                self.take("WHERE")
                if pending.paths or pending.where:
                    close(carry())
                pending.where = [self.expr()]
            elif self.take("RETURN"):
                items = self.listed(self.item)
                keys = None
                if self.take("GROUP"):
                    self.need("BY")
                    keys = [] if self.at("(") and self.peek().text == ")" else self.listed(self.expr)
                    if not keys:
                        self.k += 2
                    self.check_grouping(items, keys)
                close(items, keys=keys)
                known = {i.name for i in items}
                if not self.take("NEXT"):
                    self.finish()
                    return Query(parts)
                if self.at("MATCH", "OPTIONAL"):
                    raise ParseError("MATCH is not allowed after NEXT")
            else:
                raise ParseError(f"unexpected {self.tok.text or 'end'!r} at {self.tok.at}")

    @staticmethod
    def check_grouping(items: list[Item], keys: list[Expr]) -> None:
        for i in items:
            if not has_aggregate(i.expr) and i.expr not in keys and Ref(i.name) not in keys:
                raise ParseError(f"{i.name} is neither grouped by nor aggregated")


def parse_cypher(text: str) -> Query:
    return Parser(text).cypher()


def parse_gql(text: str) -> Query:
    return Parser(text).gql()
