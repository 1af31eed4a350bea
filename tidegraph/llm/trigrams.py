"""Boolean trigram queries that every match of a regular expression satisfies.

The pattern is parsed and read from its leaves up.  Of each part is known either the
whole set of strings it matches, or what those strings start and end with and a query
that they satisfy; joining two parts adds the trigrams that span the joint.  Everything
is lower case, as the index is.  Where a part says nothing, as most repeats do, it
asks nothing: a query may be weaker than the pattern and never stronger.

A query is an OR of branches, each a tuple of trigrams all of which must occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

#: Sets of strings and queries of more members than this are given up for weaker ones.
MOST = 64
#: Trigrams of a branch that are looked up; the first, the last and those between say enough.
LOOKED_UP = 3

Branch = tuple[str, ...]
#: Satisfied by everything: one branch that asks nothing.
ANYTHING: tuple[Branch, ...] = ((),)


def _either(*queries: tuple[Branch, ...]) -> tuple[Branch, ...]:
    """OR, without branches that ask for more than another."""
    found = sorted({b for q in queries for b in q}, key=len)
    kept: list[Branch] = []
    for b in found:
        if not any(set(k) <= set(b) for k in kept):
            kept.append(b)
    return tuple(sorted(kept)) if len(kept) <= MOST else ANYTHING


def _both(a: tuple[Branch, ...], b: tuple[Branch, ...]) -> tuple[Branch, ...]:
    if len(a) * len(b) > MOST:  # either alone is a weaker query
        return a if len(a) <= len(b) else b
    return _either(tuple(tuple(dict.fromkeys(x + y)) for x, y in product(a, b)))


def _spelt(strings: frozenset[str]) -> tuple[Branch, ...]:
    """One of the strings occurs."""
    return _either(tuple(tuple(dict.fromkeys(s[k : k + 3] for k in range(len(s) - 2))) for s in strings))


@dataclass(frozen=True)
class _Known:
    """What is known of a part's matches: all of them, or how they start and end and a query."""

    exact: frozenset[str] | None = None
    starts: frozenset[str] = frozenset([""])
    ends: frozenset[str] = frozenset([""])
    query: tuple[Branch, ...] = ANYTHING

    def opened(self) -> _Known:
        """The same without the exact set."""
        if self.exact is None:
            return self
        return _Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _spelt(self.exact))

    def then(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return _Known(frozenset(a + b for a in self.exact for b in other.exact))
        a, b = self.opened(), other.opened()
        query = _both(a.query, b.query)
        if len(a.ends) * len(b.starts) <= MOST:
            query = _both(query, _spelt(frozenset(x + y for x in a.ends for y in b.starts)))
        # only a whole part leads on to what its neighbour starts or ends with
        starts = frozenset((x + y)[:2] for x in self.exact for y in b.starts) if self.exact is not None else a.starts
        ends = frozenset((x + y)[-2:] for x in a.ends for y in other.exact) if other.exact is not None else b.ends
        return _Known(None, _few(starts), _few(ends), query)

    def alternatively(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST:
            return _Known(self.exact | other.exact)
        a, b = self.opened(), other.opened()
        return _Known(None, _few(a.starts | b.starts), _few(a.ends | b.ends), _either(a.query, b.query))


def _few(strings: frozenset[str]) -> frozenset[str]:
    return strings if len(strings) <= MOST else frozenset([""])


_NOTHING = _Known(frozenset([""]))
_ANY = _Known()


def _letter(code: int) -> _Known:
    return _Known(frozenset([chr(code).lower()])) if code < 128 else _ANY  # lower case of others may differ between libraries


def _class(members) -> _Known:
    found: set[str] = set()
    for kind, what in members:
        if str(kind) == "LITERAL" and what < 128:
            found.add(chr(what).lower())
        elif str(kind) == "RANGE" and what[1] < 128:
            found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
        else:
            return _ANY
    return _Known(frozenset(found)) if len(found) <= MOST // 4 else _ANY


def _sequence(parts) -> _Known:
    out = _NOTHING
    for part in parts:
        out = out.then(_part(part))
    return out


def _part(part) -> _Known:
    kind, what = str(part[0]), part[1]
    if kind == "LITERAL":
        return _letter(what)
    if kind == "IN":
        return _class(what)
    if kind == "BRANCH":
        out = _sequence(what[1][0])
        for other in what[1][1:]:
            out = out.alternatively(_sequence(other))
        return out
    if kind == "SUBPATTERN":
        return _sequence(what[3]) if not what[1] and not what[2] else _ANY
    if kind == "ATOMIC_GROUP":
        return _sequence(what)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = what
        one, out = _sequence(inner), _NOTHING
        for _ in range(min(least, 4)):
            out = out.then(one)
        if most == least <= 4:
            return out
        if least == 0 and most == 1:
            return one.alternatively(_NOTHING)
        if not least:
            return _ANY
        return _Known(None, out.opened().starts, one.opened().ends, out.opened().query)  # the last round ends as any one does
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):  # they match no characters
        return _NOTHING
    return _ANY


@lru_cache(256)
def trigram_query(pattern: str) -> tuple[Branch, ...]:
    """The branches, each of at most LOOKED_UP trigrams; () where some match need not hold any trigram."""
    found = _sequence(re._parser.parse(pattern)).opened().query
    if () in found:
        return ()
    spread = lambda b: b if len(b) <= LOOKED_UP else tuple(b[k * (len(b) - 1) // (LOOKED_UP - 1)] for k in range(LOOKED_UP))
    return _either(tuple(map(spread, found)))
