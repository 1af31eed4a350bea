"""Sinks for differences, as functions of (differences, batch number)."""

from __future__ import annotations

import queue
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.sources.embedded import append, embedded

Sink = Callable[[DataFrame, int], None]
_PLACE = r"\{\{\s*([\w.]+)\s*\}\}"


def render(template: str, side: str) -> Column:
    """``{{after.name}}`` and ``{{before.name}}`` filled in; ``{{name}}`` is taken from ``side``."""
    parts, at = [], 0
    for m in re.finditer(_PLACE, template):
        path = m[1] if m[1].split(".")[0] in ("before", "after") else f"{side}.{m[1]}"
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(path).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def rendered(diff: DataFrame, templates: dict[str, str]) -> DataFrame:
    """A line per difference whose op has a template (``aggregation`` falls back to ``update``)."""
    own = {"aggregation": templates.get("update"), **templates}
    col = None
    for op, side in (("add", "after"), ("update", "after"), ("delete", "before"), ("aggregation", "after")):
        if own.get(op):
            col = (F if col is None else col).when(F.col("op") == op, render(own[op], side))
    return diff.select(col.alias("line")).where("line IS NOT NULL")


def file_sink(folder: str, form: str = "json") -> Sink:
    """Differences of each batch in a folder of its own; a batch that runs again replaces its own."""
    return lambda diff, number: diff.write.mode("overwrite").format(form).save(f"{folder}/batch={number}")


def log_sink(templates: dict[str, str], out: Callable[[str], None] = print) -> Sink:
    """Rendered lines on the driver, one partition at a time; meant for small results."""

    def write(diff: DataFrame, number: int) -> None:
        for r in rendered(diff, templates).toLocalIterator():
            out(r.line)

    return write


def memory_sink(into: list) -> Sink:
    """Rows appended to a list, as (batch number, row); meant for tests."""
    return lambda diff, number: into.extend((number, r) for r in diff.collect())


def jdbc_sink(url: str, table: str, **properties: str) -> Sink:
    """Differences as JSON rows in a database table, written by the executors; by the driver if the database lives in its process."""

    def write(diff: DataFrame, number: int) -> None:
        rows = diff.select(F.lit(number).alias("batch"), "op", F.to_json("before").alias("before"), F.to_json("after").alias("after"))
        if embedded(url):
            append(rows, url, table, properties)
        else:
            rows.write.mode("append").jdbc(url, table, properties=properties)

    return write


def post_sink(url: str, timeout: float = 10.0, retries: int = 3, wait: float = 0.5, batch: int = 1, headers: dict[str, str] | None = None) -> Sink:
    """Differences as JSON posts, from the executors: one a post, or arrays of up to ``batch``.

    A post that fails is tried again after growing waits; one that still fails fails the batch.
    """

    def write(diff: DataFrame, number: int) -> None:
        def send(rows) -> None:
            import time
            from itertools import islice
            from urllib.error import URLError
            from urllib.request import Request, urlopen

            rows = iter(rows)
            while part := [r.body for r in islice(rows, batch)]:
                data = (part[0] if batch == 1 else f"[{','.join(part)}]").encode()
                for turn in range(retries + 1):
                    try:
                        with urlopen(Request(url, data, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout):
                            break
                    except (URLError, TimeoutError):
                        if turn == retries:
                            raise
                        time.sleep(wait * 2**turn)

        diff.select(F.to_json(F.struct(*diff.columns)).alias("body")).foreachPartition(send)

    return write


def kafka_sink(servers: str, topic: str, **options: str) -> Sink:
    """Differences as JSON records of a topic; needs Spark's Kafka connector."""

    def write(diff: DataFrame, number: int) -> None:
        rows = diff.select(F.to_json(F.struct(F.lit(number).alias("batch"), *diff.columns)).alias("value"))
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()

    return write


def procedure_sink(url: str, statements: dict[str, str], rows_at_once: int = 500, **properties: str) -> Sink:
    """A database statement per difference, by op: ``CALL changed({{after.id}}, {{after.name}})``.

    Placeholders become parameters of a prepared statement, so values are never part of
    its text.  Statements run in order on one connection of the driver, for results small
    enough to follow one by one; :func:`jdbc_sink` writes from the executors.
    """
    parsed = {op: (re.sub(_PLACE, "?", text), [m[1] for m in re.finditer(_PLACE, text)]) for op, text in statements.items()}

    def write(diff: DataFrame, number: int) -> None:
        jvm = diff.sparkSession._jvm
        given = jvm.java.util.Properties()
        for k, v in properties.items():
            given.setProperty(k, v)
        to = jvm.java.sql.DriverManager.getConnection(url, given)
        try:
            to.setAutoCommit(False)
            ready = {op: to.prepareCall(text) for op, (text, _) in parsed.items()}
            held = dict.fromkeys(ready, 0)
            for r in diff.toLocalIterator():
                op = r.op if r.op in parsed else "update" if r.op == "aggregation" else None
                if op not in parsed:
                    continue
                for k, path in enumerate(parsed[op][1], 1):
                    value = r
                    for part in path.split("."):
                        value = None if value is None else value[part]
                    ready[op].setObject(k, value if value is None or isinstance(value, (str, int, float, bool)) else str(value))
                ready[op].addBatch()
                held[op] += 1
                if held[op] % rows_at_once == 0:
                    ready[op].executeBatch()
            for s in ready.values():
                s.executeBatch()
            to.commit()
        finally:
            to.close()

    return write


def routed(routes: dict[str, dict[str, str]], default: dict[str, str], sink: Callable[[dict[str, str]], Sink]) -> Callable[[str], Sink]:
    """A sink per query with the query's own templates, or the default ones: ``routed(...)("query name")``."""
    return lambda query: sink({**default, **routes.get(query, {})})


class EventStream:
    """Server-sent events: every difference goes, rendered, to all clients of ``GET /events``; meant for small results."""

    def __init__(self, templates: dict[str, str] | None = None, host: str = "127.0.0.1", port: int = 0, beat: float = 15.0):
        self.templates, self.clients, self.lock = templates, [], threading.Lock()
        stream = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                if self.path != "/events":
                    return self.send_error(404)
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.send_header("Cache-Control", "no-cache")
                self.end_headers()
                own = queue.Queue(10_000)  # a client that falls further behind is let go
                with stream.lock:
                    stream.clients.append(own)
                try:
                    while True:
                        try:
                            line = own.get(timeout=beat)
                        except queue.Empty:
                            line = None
                        if line is Ellipsis:
                            break
                        self.wfile.write(b": beat\n\n" if line is None else f"data: {line}\n\n".encode())
                        self.wfile.flush()
                except OSError:
                    pass
                finally:
                    with stream.lock:
                        stream.clients = [c for c in stream.clients if c is not own]

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __call__(self, diff: DataFrame, number: int) -> None:
        lines = rendered(diff, self.templates) if self.templates else diff.select(F.to_json(F.struct(*diff.columns)).alias("line"))
        for r in lines.toLocalIterator():
            self.tell(r.line)

    def tell(self, line) -> None:
        with self.lock:
            for own in list(self.clients):
                try:
                    own.put_nowait(line)
                except queue.Full:
                    self.clients = [c for c in self.clients if c is not own]

    def stop(self) -> None:
        self.tell(Ellipsis)
        self.server.shutdown()
        self.server.server_close()
