"""Functions by name.  A function turns typed arguments into a typed column when a query is compiled."""

from __future__ import annotations

from collections.abc import Callable

from tidegraph.parser.grammar import AGGREGATES
from tidegraph.types import LoweringError, Typed

Builder = Callable[..., Typed]


class Registry:
    """Functions by kind, case-sensitive; registering a name adds or replaces it.  Lists of names allow the spellings of both languages.

    * scalar: ``build(context, *arguments)`` with typed columns;
    * lazy: ``build(context, *expressions)`` decides itself which arguments to compile;
    * aggregating: ``build(context, arguments, live)`` gives an aggregate column, each
      argument passed through ``live`` so that rows outside the fold are null;
    * mutating: ``build(context, *expressions)`` gives the context and the expression to go on with.
    """

    def __init__(self, known: dict[str, Builder] | None = None):
        self.known = dict(known or {})
        self.lazy: dict[str, Builder] = {}
        self.aggregating: dict[str, Builder] = {}
        self.mutating: dict[str, Builder] = {}

    def register_lazy(self, *names: str) -> Callable[[Builder], Builder]:
        return self._adder(self.lazy, names)

    def register_mutating(self, *names: str) -> Callable[[Builder], Builder]:
        return self._adder(self.mutating, names)

    def register_aggregating(self, *names: str) -> Callable[[Builder], Builder]:
        """Such names aggregate in every query parsed from now on."""
        AGGREGATES.update(names)
        return self._adder(self.aggregating, names)

    @staticmethod
    def _adder(kind: dict[str, Builder], names: tuple[str, ...]) -> Callable[[Builder], Builder]:
        def add(build: Builder) -> Builder:
            kind.update(dict.fromkeys(names, build))
            return build

        return add

    def register(self, *names: str) -> Callable[[Builder], Builder]:
        def add(build: Builder) -> Builder:
            self.known |= dict.fromkeys(names, build)
            return build

        return add

    def copy(self) -> Registry:
        out = Registry(self.known)
        out.lazy, out.aggregating, out.mutating = dict(self.lazy), dict(self.aggregating), dict(self.mutating)
        return out

    def build(self, name: str, ctx, args: list[Typed]) -> Typed:
        if name not in self.known:
            raise LoweringError(f"unknown function {name}")
        try:
            return self.known[name](ctx, *args)
        except TypeError as wrong:
            if "positional argument" in str(wrong):
                raise LoweringError(f"{name}: wrong number of arguments ({len(args)})") from wrong
            raise


FUNCTIONS = Registry()


def need(ok: bool, name: str, what: str) -> None:
    if not ok:
        raise LoweringError(f"{name} needs {what}")
