"""Changes sent by programs: from this process, over HTTP, or by polling tables.

Every source ends in a folder of JSON lines that :func:`json_folder` streams, so that a
batch can be read again after a failure wherever its changes came from.  The folder must
be one that all executors see.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.embedded import beyond_executors, read
from tidegraph.sources.readers import as_changes, json_folder
from tidegraph.streaming.changelog import CHANGES


class PushSource:
    """Changes handed over by this process, as dictionaries with the fields of CHANGES (properties as a dictionary)."""

    def __init__(self, spark: SparkSession, folder: str, source_id: str = "application"):
        self.spark, self.folder, self.source_id, self.last, self.lock = spark, folder.rstrip("/"), source_id, 0, threading.Lock()
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.mkdirs(path)

    def send(self, changes: Iterable[dict]) -> int:
        """Write the changes as one file, which appears whole or not at all; returns their number."""
        with self.lock:  # numbers ascend over restarts too
            lines = [json.dumps(self.complete(c)) for c in changes]
            if lines:
                path, name = self.spark._jvm.org.apache.hadoop.fs.Path, f"{self.last:020d}-{uuid.uuid4().hex}.json"
                out = self.store.create(path(f"{self.folder}/_{name}"))
                out.write(bytearray("\n".join(lines).encode()))
                out.close()
                self.store.rename(path(f"{self.folder}/_{name}"), path(f"{self.folder}/{name}"))
            return len(lines)

    def complete(self, change: dict) -> dict:
        self.last = max(self.last + 1, time.time_ns())
        props = change.get("properties") or {}
        base = {"seq": self.last, "element_type": "node", "source_id": self.source_id, "effective_from": self.last // 1_000_000}
        found = base | {k: v for k, v in change.items() if v is not None} | {"properties": props if isinstance(props, str) else json.dumps(props)}
        if found.get("op") not in ("insert", "update", "delete") or not found.get("element_id"):
            raise ValueError(f"a change needs an op and an element_id: {change}")
        return {f.name: found.get(f.name) for f in CHANGES}

    def insert(self, element_id: str, labels: list[str], **properties) -> None:
        self.send([{"op": "insert", "element_id": element_id, "labels": labels, "properties": properties}])

    def update(self, element_id: str, labels: list[str], **properties) -> None:
        self.send([{"op": "update", "element_id": element_id, "labels": labels, "properties": properties}])

    def delete(self, element_id: str, labels: list[str]) -> None:
        self.send([{"op": "delete", "element_id": element_id, "labels": labels}])

    def relate(self, element_id: str, labels: list[str], src_id: str, dst_id: str, **properties) -> None:
        self.send([{"op": "insert", "element_type": "relation", "element_id": element_id, "labels": labels, "src_id": src_id, "dst_id": dst_id, "properties": properties}])

    def stream(self) -> DataFrame:
        return json_folder(self.spark, self.folder)


def from_event(event: dict) -> dict:
    """A change from an event: operation, element (type, id, labels, properties, from, to) and timestamp in nanoseconds."""
    op, element = event.get("operation"), event.get("element") or {}
    found = {"op": op, "element_type": element.get("type", "node"), "element_id": element.get("id", event.get("id")), "labels": element.get("labels", event.get("labels")), "properties": element.get("properties")}
    if element.get("type") == "relation":
        found |= {"src_id": element.get("from"), "dst_id": element.get("to")}
    if (at := event.get("timestamp")) is not None:
        found["effective_from"] = int(at) // 1_000_000
    return found


class HttpSource:
    """Takes events posted to ``/sources/{id}/events`` (one) and ``/sources/{id}/events/batch`` (``{"events": [...]}``)."""

    def __init__(self, push: PushSource, host: str = "127.0.0.1", port: int = 0):
        source = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self.answer(200 if self.path == "/health" else 404, {"status": "healthy"} if self.path == "/health" else {"error": "not found"})

            def do_POST(self):
                parts = self.path.strip("/").split("/")
                batch = parts[3:] == ["batch"]
                if parts[:1] != ["sources"] or parts[2:3] != ["events"] or len(parts) > 4 or parts[3:] not in ([], ["batch"]):
                    return self.answer(404, {"error": "not found"})
                if parts[1] != push.source_id:
                    return self.answer(400, {"error": f"no source {parts[1]}"})
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                    n = push.send([from_event(e) for e in (body["events"] if batch else [body])])
                except (ValueError, KeyError, TypeError, AttributeError) as wrong:
                    return self.answer(400, {"error": str(wrong)})
                self.answer(200, {"success": True, "accepted": n})

            def answer(self, status: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_) -> None:
                pass

        source.server = ThreadingHTTPServer((host, port), Handler)
        source.port = source.server.server_port
        threading.Thread(target=source.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def snapshot_changes(before: DataFrame, after: DataFrame, label: str, key: str, source_id: str = "table") -> DataFrame:
    """Changes that turn one state of a table into another: rows that came, differ or went."""
    columns = [c for c in after.columns]
    side = lambda df, name: df.select(F.col(f"`{key}`").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))
    both = side(before, "a").join(side(after, "b"), "__key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("update")
    return as_changes(
        both, seq=F.monotonically_increasing_id(), op=op, element_type=F.lit("node"), source_id=F.lit(source_id), element_id=F.col("__key").cast("string"), labels=F.array(F.lit(label)),
        effective_from=F.unix_millis(F.current_timestamp()), properties=F.coalesce(F.to_json("b", {"ignoreNullFields": "false"}), F.lit("{}")),
    )


class TablePoller:
    """Changes of a database's table (or any other), found by reading it again.

    ``read`` gives the table as it is now, for instance :func:`jdbc_table`.  With
    ``changed`` (a column that ascends with every change) only rows beyond the last value
    seen are read, as updates; such a poll cannot see deletes.  Without it the whole table
    is compared with how it was, which finds them too.
    """

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], folder: str, label: str, key: str, changed: str | None = None, source_id: str = "table"):
        self.spark, self.read, self.folder, self.label, self.key, self.changed, self.source_id = spark, read, folder.rstrip("/"), label, key, changed, source_id
        self.polls, self.seen, self.held = 0, None, None

    def poll(self) -> int:
        """Read the table and write what has changed; returns the number of changes."""
        now = self.read()
        if self.changed:
            found = now if self.seen is None else now.where(F.col(self.changed) > F.lit(self.seen))
            changes = as_changes(
                found, op=F.lit("update" if self.polls else "insert"), element_type=F.lit("node"), source_id=F.lit(self.source_id), element_id=F.col(self.key).cast("string"), labels=F.array(F.lit(self.label)),
                effective_from=F.unix_millis(F.current_timestamp()), properties=F.to_json(F.struct(*now.columns), {"ignoreNullFields": "false"}),
            )
            top = found.agg(F.max(self.changed)).head()[0]
        else:
            kept = f"{self.folder}/_state/{self.polls}"
            now.write.mode("overwrite").parquet(kept)
            now = self.spark.read.parquet(kept)
            changes = snapshot_changes(now.where("false") if self.held is None else self.held, now, self.label, self.key, self.source_id)
        changes = changes.withColumn("seq", F.lit(time.time_ns()))  # an element changes once in a poll; numbers ascend from poll to poll
        out = f"{self.folder}/changes/poll-{self.polls:010d}"
        changes.write.mode("overwrite").option("ignoreNullFields", "false").json(out)
        n = self.spark.read.schema(CHANGES).json(out).count()
        if self.changed:
            self.seen = top if top is not None else self.seen
        else:
            self.held = now
        self.polls += 1
        return n

    def stream(self) -> DataFrame:
        return json_folder(self.spark, f"{self.folder}/changes", recursive=True)


def jdbc_table(spark: SparkSession, url: str, table: str, place: str | None = None, **properties: str) -> Callable[[], DataFrame]:
    """Reads a table of PostgreSQL, MySQL, SQL Server, Oracle, SQLite or any other database whose JDBC driver Spark is given.

    A database that lives in the driver's process is copied, on a cluster, to ``place``: a
    folder that all executors see.
    """
    if not beyond_executors(spark, url):
        return lambda: spark.read.jdbc(url, table, properties=properties)
    if place is None:
        raise ValueError(f"{url}: executors cannot open a database inside the driver; name a place that they share with it")
    return lambda: read(spark, url, table, place, properties)
