"""Named sources, queries and reactions, started and stopped together."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidegraph.streaming.continuous import ContinuousQuery

ADDED, RUNNING, STOPPED, FAILED = "added", "running", "stopped", "failed"


@dataclass
class _Query:
    query: ContinuousQuery
    sources: list[str]
    reactions: dict[str, Callable[[DataFrame, int], None]] = field(default_factory=dict)
    stream: object = None
    state: str = ADDED
    stopped: threading.Event = field(default_factory=threading.Event)


class Server:
    """Runs continuous queries over streams of changes and hands differences to reactions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.sources: dict[str, tuple[DataFrame, DataFrame | None]] = {}
        self.queries: dict[str, _Query] = {}

    def add_source(self, name: str, changes: DataFrame, bootstrap: DataFrame | None = None) -> Server:
        """A stream of changes, and the elements known before it starts."""
        self._new(name, self.sources)
        self.sources[name] = (changes, bootstrap)
        return self

    def add_query(self, name: str, query: ContinuousQuery, *sources: str) -> Server:
        self._new(name, self.queries)
        if missing := [s for s in sources if s not in self.sources]:
            raise KeyError(f"no source {', '.join(missing)}")
        if not sources:
            raise ValueError("a query needs a source")
        self.queries[name] = _Query(query, list(sources))
        return self

    def add_reaction(self, name: str, query: str, sink: Callable[[DataFrame, int], None]) -> Server:
        self._new(name, self.queries[query].reactions)
        self.queries[query].reactions[name] = sink
        return self

    @staticmethod
    def _new(name: str, known: dict) -> None:
        if name in known:
            raise KeyError(f"{name} exists")

    def remove_query(self, name: str) -> None:
        self.stop(name)
        del self.queries[name]

    def remove_source(self, name: str) -> None:
        if users := [q for q, x in self.queries.items() if name in x.sources]:
            raise ValueError(f"{name} feeds {', '.join(users)}")
        del self.sources[name]

    def start(self, name: str, clock: Callable[[], dt.datetime] | None = None, tick_every: float | None = None, **trigger) -> None:
        """Start a query; it resumes after its last complete batch.

        The result of a query that looks at the clock is brought up to date every
        ``tick_every`` seconds until it is stopped, whether changes come or not; what
        that changes goes to its reactions.
        """
        q, clock = self.queries[name], clock or (lambda: dt.datetime.now(dt.timezone.utc))
        streams = [self.sources[s] for s in q.sources]
        changes = streams[0][0]
        for more, _ in streams[1:]:
            changes = changes.unionByName(more)
        known = [b for _, b in streams if b is not None]
        bootstrap = known[0] if known else None
        for b in known[1:]:
            bootstrap = bootstrap.unionByName(b)

        def react(diff: DataFrame, number: int) -> None:
            diff = diff.persist()
            for sink in q.reactions.values():
                sink(diff, number)
            diff.unpersist()

        place = f"{self.folder}/{name}"
        q.stream = q.query.start(changes, place, react, bootstrap, clock, **trigger)
        q.state = RUNNING
        q.stopped.set()  # a ticker of an earlier start
        q.stopped = stopped = threading.Event()

        def follow() -> None:
            while not stopped.wait(tick_every):
                if q.query.results(self.spark, place) is not None:
                    q.query.tick(self.spark, place, clock, react)

        if tick_every is not None and q.query.timed():
            threading.Thread(target=follow, daemon=True).start()

    def stop(self, name: str) -> None:
        q = self.queries[name]
        q.stopped.set()
        if q.stream is not None:
            q.stream.stop()
            q.state = STOPPED

    def status(self, name: str) -> str:
        q = self.queries[name]
        if q.stream is not None and not q.stream.isActive and q.state == RUNNING:
            q.state = FAILED if q.stream.exception() else STOPPED
        return q.state

    def results(self, name: str) -> DataFrame | None:
        """The live result of a query; None before its first batch."""
        return self.queries[name].query.results(self.spark, f"{self.folder}/{name}")

    def profile(self, name: str) -> dict[str, float]:
        """Milliseconds per batch over the recent ones: median, 95th and 99th percentile, and rows a second."""
        seen = [p for p in (self.queries[name].stream.recentProgress if self.queries[name].stream else []) if p["numInputRows"]]
        took = sorted(p["batchDuration"] for p in seen)
        if not took:
            return {}
        at = lambda q: float(took[min(len(took) - 1, int(q * len(took)))])
        return {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "rows_per_second": sum(p["numInputRows"] for p in seen) / max(1e-3, sum(took) / 1000)}

    def dependencies(self) -> list[tuple[str, str]]:
        """Edges source to query and query to reaction."""
        return [(s, q) for q, x in self.queries.items() for s in x.sources] + [(q, r) for q, x in self.queries.items() for r in x.reactions]
