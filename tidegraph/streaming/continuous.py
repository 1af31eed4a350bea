"""Queries kept up to date over a stream of changes.

Each micro-batch appends its changes to a log, merges them into the table of current
elements, runs the compiled query and reports how its result differs from the one
before.  Rows of a result are known by the elements they match (or the keys of their
group), so a row whose values change is an update.  Functions with a memory (since
when a condition has held, what a value was before) keep a small table of their own,
by row, that goes from version to version of the result; functions that look up
versions read the log beside the current elements.

State and results are tables under one folder, written once per version, so a batch
that runs again after a failure replaces what it wrote before; all but the last KEEP
versions are removed.  A tick is a version without changes: it reports what time alone
has changed, once.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.ast import Call, Query, children
from tidegraph.functions import FUNCTIONS, Registry
from tidegraph.operators.middleware import Pipeline
from tidegraph.parser import parse_cypher, parse_gql
from tidegraph.parser.grammar import base_name, has_aggregate
from tidegraph.plans.compile import ROW, Compiler
from tidegraph.streaming.changelog import CHANGES, advance_elements, current_elements, element_tables, element_versions
from tidegraph.streaming.diff import diff_results

#: Functions whose result changes as time passes.
TIMED = frozenset(("trueFor", "trueUntil", "trueLater", "trueNowOrLater", "future", "slidingWindow", "awaiting"))
#: Functions that look up versions of elements in the log.
LOGGED = frozenset(("getVersionByTimestamp", "getVersionsByTimeRange", "retainHistory"))
#: Functions that remember something about each row from one version of the result to the next.
REMEMBERING = frozenset(("trueFor", "previousValue", "previousDistinctValue"))
KEEP = 3
#: Versions per batch: the batch itself and the ticks after it.
STEP = 1_000_000


@dataclass
class ContinuousQuery:
    """A query over labelled elements; ``nodes`` and ``relations`` as for :func:`element_tables`."""

    text: str
    nodes: dict[str, dict[str, str]]
    relations: dict[str, tuple[str, str, dict[str, str]]] = field(default_factory=dict)
    joins: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    language: str = "cypher"
    middleware: Pipeline | None = None
    params: dict[str, object] = field(default_factory=dict)
    registry: Registry = field(default_factory=lambda: FUNCTIONS)

    def __post_init__(self):
        self.parsed: Query = parse_cypher(self.text) if self.language == "cypher" else parse_gql(self.text)
        self.lock = threading.RLock()

    # -- shape of the result
    def keys(self) -> list[str] | None:
        """The grouping columns of an aggregating query; None for other queries."""
        last = self.parsed.parts[-1]
        if last.keys is None and not any(has_aggregate(i.expr) for i in last.items):
            return None
        return [i.name for i in last.items if not has_aggregate(i.expr)]

    def empty_group(self, spark: SparkSession) -> dict[str, object]:
        """The values of a group without rows: the aggregates, and what is computed from them, over no elements."""
        last = self.parsed.parts[-1]
        items = [i for i in last.items if has_aggregate(i.expr)]
        nothing = element_versions(spark.createDataFrame([], CHANGES), [])
        query = replace(self.parsed, parts=[*self.parsed.parts[:-1], replace(last, items=items, keys=[])])
        row = self.compiler(nothing, nothing, None, states=lambda n: None).run(query).head()
        return row.asDict() if row is not None else {i.name: None for i in items}

    def timed(self) -> bool:
        """Whether the result may change without a change of any element."""
        return self.uses(TIMED)

    def uses(self, names: frozenset[str]) -> bool:
        def uses(e) -> bool:
            return isinstance(e, Call) and base_name(e.name) in names or any(map(uses, children(e)))

        return any(uses(e) for p in self.parsed.parts for e in [*p.where, *(i.expr for i in p.items)])

    # -- evaluation
    def result(self, changes: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """The result over all changes so far, as of a clock."""
        return self.rows(changes, now).drop(ROW)

    def rows(self, changes: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """The same with the column that tells rows apart.  Memories are worked out from the versions of elements."""
        changes = self.prepared(changes)
        versions = element_versions(changes, self.properties()) if self.uses(LOGGED | REMEMBERING) else None
        return self.over(current_elements(changes), versions, now)

    def prepared(self, changes: DataFrame) -> DataFrame:
        return self.middleware.apply(changes) if self.middleware is not None else changes

    def properties(self) -> list[str]:
        """The properties the query may read."""
        return sorted({p for props in [*self.nodes.values(), *(r[2] for r in self.relations.values())] for p in props})

    def compiler(self, elements: DataFrame, versions: DataFrame | None, now: dt.datetime | None, states: Callable[[int], DataFrame | None] | None = None) -> Compiler:
        if self.uses(frozenset(("retainHistory",))):  # aggregates see all versions, and tell the current ones
            graph = element_tables(versions, self.nodes, self.relations, history=True)
        else:
            graph = element_tables(elements, self.nodes, self.relations, versions)
        for id_, keys in self.joins.items():
            graph.add_join(id_, *keys)
        return Compiler(graph, self.registry, self.params, now, rows=True, states=states)

    def over(self, elements: DataFrame, versions: DataFrame | None, now: dt.datetime | None) -> DataFrame:
        return self.compiler(elements, versions, now).run(self.parsed)

    def diff(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Differences of two results; rows meet by their elements where both say which, else by all columns."""
        keys = self.keys()
        if keys is not None:
            return diff_results(before.drop(ROW), after.drop(ROW), keys, self.empty_group(after.sparkSession))
        known = ROW in before.columns and ROW in after.columns
        return diff_results(before, after, [ROW] if known else after.columns, hidden=(ROW,))

    def steps(self, spark: SparkSession, changes: list[dict], now: dt.datetime | list[dt.datetime] | None = None) -> list[list]:
        """Differences change by change: the finest grain, for tests and small feeds.  ``now``: one clock, or one per change."""
        out, before, states = [], None, {}
        for k in range(1, len(changes) + 1):
            log = self.prepared(spark.createDataFrame([self.row(c, n) for n, c in enumerate(changes[:k])], CHANGES))
            versions = element_versions(log, self.properties()) if self.uses(LOGGED) else None
            made = self.compiler(current_elements(log), versions, now[k - 1] if isinstance(now, list) else now, states.get)
            after = made.run(self.parsed)
            rows = spark.createDataFrame(after.collect(), after.schema)
            states = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in enumerate(made.kept) if t is not None}
            before = rows.where("false") if before is None else before
            out.append(self.diff(before, rows).collect())
            before = rows
        return out

    @staticmethod
    def row(change: dict, seq: int) -> tuple:
        values = {"seq": seq, "element_type": "node", "source_id": "test", "effective_from": 0} | change
        values["properties"] = json.dumps(change.get("properties", {}))
        return tuple(values.get(f.name) for f in CHANGES)

    def start(self, changes: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], bootstrap: DataFrame | None = None, clock: Callable[[], dt.datetime] | None = None, numbered: bool = False, **trigger):
        """Run over a stream of changes; ``sink`` gets the differences of every batch.

        ``bootstrap`` holds the elements known before the stream starts.  With a
        ``clock``, or where the query is timed, results follow time at every trigger
        that brings a batch; use :meth:`tick` between batches.  Where every source has
        ``numbered`` its changes in order, those it sends again are left out.
        """
        spark = changes.sparkSession
        log = f"{folder}/log"
        if bootstrap is not None:
            bootstrap.write.mode("overwrite").parquet(f"{log}/batch=-1")

        def batch(df: DataFrame, number: int) -> None:
            if numbered and self.exists(spark, log):
                seen = spark.read.option("basePath", log).parquet(log).where(F.col("batch").between(0, number - 1)).groupBy("source_id").agg(F.max("seq").alias("seen"))
                df = df.join(seen, "source_id", "left").where("seen IS NULL OR seq > seen").select(*df.columns)
            df.write.mode("overwrite").parquet(f"{log}/batch={number}")
            self.advance(spark, folder, number, sink, clock)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def advance(self, spark: SparkSession, folder: str, number: int, sink: Callable[[DataFrame, int], None], clock: Callable[[], dt.datetime] | None) -> None:
        with self.lock:
            log = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")
            self.elements(spark, folder, number, log)
            sink(self.next(spark, folder, number * STEP, clock() if clock else dt.datetime.now(dt.timezone.utc)), number)
            self.prune(spark, folder)

    def tick(self, spark: SparkSession, folder: str, clock: Callable[[], dt.datetime], sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
        """Differences that time alone has made since the last version; they become part of the result and are not reported again.

        A sink gets them under a number that no batch has.
        """
        with self.lock:
            number = self.latest(spark, f"{folder}/results") + 1
            diff = self.next(spark, folder, number, clock())
            if sink is not None:
                sink(diff, number + STEP)
            return diff

    def next(self, spark: SparkSession, folder: str, number: int, now: dt.datetime) -> DataFrame:
        """Write a version of the result and of the memories; its differences from the one before."""
        earlier = self.latest(spark, f"{folder}/results", number)
        at = lambda n, k: f"{folder}/memory/{n}/{k}"
        states = lambda k: spark.read.parquet(at(earlier, k)) if earlier is not None and self.exists(spark, at(earlier, k)) else None
        versions = None
        if self.uses(LOGGED):
            log = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log").where(F.col("batch") <= number // STEP)
            versions = element_versions(self.prepared(log.drop("batch")), self.properties())
        elements = spark.read.parquet(f"{folder}/elements/{self.latest(spark, f'{folder}/elements', number // STEP + 1)}")
        made = self.compiler(elements, versions, now, states)
        rows = made.run(self.parsed)
        for k, table in enumerate(made.kept):
            table.write.mode("overwrite").parquet(at(number, k))
        rows.write.mode("overwrite").parquet(f"{folder}/results/{number}")
        after = spark.read.parquet(f"{folder}/results/{number}")
        before = after.where("false") if earlier is None else spark.read.parquet(f"{folder}/results/{earlier}")
        return self.diff(before, after)

    def elements(self, spark: SparkSession, folder: str, number: int, log: DataFrame) -> None:
        """Write the current elements as of a batch."""
        earlier = self.latest(spark, f"{folder}/elements", number)
        new = self.prepared(log.where(F.col("batch").between((-1 if earlier is None else earlier + 1), number)).drop("batch"))
        now = current_elements(new) if earlier is None else advance_elements(spark.read.parquet(f"{folder}/elements/{earlier}"), new)
        now.write.mode("overwrite").parquet(f"{folder}/elements/{number}")

    def prune(self, spark: SparkSession, folder: str) -> None:
        for kind in ("elements", "results", "memory"):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
            store = path.getFileSystem(spark._jsc.hadoopConfiguration())
            known = sorted((s.getPath() for s in store.listStatus(path)), key=lambda x: int(x.getName())) if store.exists(path) else []
            for old in known[:-KEEP]:
                store.delete(old, True)

    @staticmethod
    def exists(spark: SparkSession, folder: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    @staticmethod
    def latest(spark: SparkSession, folder: str, before: float = float("inf")) -> int | None:
        """The number of the last table written in a folder before a version."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return None
        known = [int(s.getPath().getName()) for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((n for n in known if n < before), default=None)

    def results(self, spark: SparkSession, folder: str) -> DataFrame | None:
        """The live result."""
        number = self.latest(spark, f"{folder}/results")
        return None if number is None else spark.read.parquet(f"{folder}/results/{number}").drop(ROW)
