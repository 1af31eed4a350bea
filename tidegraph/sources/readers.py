"""Readers that give changes in the schema of :data:`tidegraph.streaming.changelog.CHANGES`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.streaming.changelog import CHANGES

_SCRIPT = "kind string, id string, labels array<string>, properties string, start_id string, end_id string, start_time string, description string, comment string, label string"


def as_changes(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of the schema, those not given null."""
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGES])


def script_file(spark: SparkSession, path: str, source_id: str = "script") -> DataFrame:
    """Bootstrap script: JSON lines of kind Header, Comment, Label, Node, Relation and Finish.

    Nodes and relations become inserts at the header's time; records after Finish are
    ignored, others only inform.  Fails if the first record is no header.
    """
    rows = spark.read.text(path).select(F.from_json("value", _SCRIPT).alias("r"), F.get_json_object("value", "$.properties").alias("p"), F.monotonically_increasing_id().alias("at"))
    heads = rows.agg(F.min_by("r.kind", "at").alias("first"), F.min(F.when(F.col("r.kind") == "Finish", F.col("at"))).alias("finish"), F.min_by("r.start_time", F.when(F.col("r.kind") == "Header", F.col("at"))).alias("start")).head()
    if heads.first is not None and heads.first != "Header":
        raise ValueError(f"{path}: a script starts with a header, not {heads.first}")
    own = rows.where(F.col("r.kind").isin("Node", "Relation"))
    if heads.finish is not None:
        own = own.where(F.col("at") < heads.finish)
    ends = {"src_id": F.col("r.start_id"), "dst_id": F.col("r.end_id"), "src_source_id": F.lit(source_id), "dst_source_id": F.lit(source_id)}
    began = F.unix_millis(F.lit(heads.start).try_cast("timestamp")) if heads.start else F.lit(0)
    return as_changes(
        own, seq=F.col("at"), op=F.lit("insert"), element_type=F.lower("r.kind"), source_id=F.lit(source_id), element_id=F.col("r.id"), labels=F.col("r.labels"), effective_from=F.coalesce(began, F.lit(0)), properties=F.coalesce("p", F.lit("{}")), **ends
    )


def table_snapshot(df: DataFrame, label: str, key: str, source_id: str = "table", effective_from: str | None = None) -> DataFrame:
    """Rows of any table (files, JDBC, ...) as inserts of nodes."""
    at = F.unix_millis(F.col(effective_from).cast("timestamp")) if effective_from else F.lit(0)
    return as_changes(df, seq=F.monotonically_increasing_id(), op=F.lit("insert"), element_type=F.lit("node"), source_id=F.lit(source_id), element_id=F.col(key).cast("string"), labels=F.array(F.lit(label)), effective_from=at, properties=F.to_json(F.struct(*df.columns)))


def json_folder(spark: SparkSession, path: str, max_files: int = 1000, recursive: bool = False) -> DataFrame:
    """Stream of change records, one JSON object a line, from files dropped into a folder (or, if ``recursive``, below it)."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", str(recursive).lower()).json(path)


def kafka_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Stream of a topic's records (value, headers, timestamp) for :func:`map_records`; needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"), "headers", "timestamp")


def _mock(df: DataFrame, n: Column, kind: str, sensors: int, at: Column) -> DataFrame:
    if kind == "counter":
        props, id_, op = F.struct(n.alias("value")), F.concat(F.lit("counter_"), n.cast("string")), F.lit("insert")
    elif kind == "sensor":
        which = F.pmod(n, F.lit(sensors))
        noise = F.pmod(F.xxhash64(n), F.lit(1000)) / 100.0
        props = F.struct(F.concat(F.lit("sensor_"), which.cast("string")).alias("sensor_id"), (20 + noise).alias("temperature"), (40 + noise * 2).alias("humidity"))
        id_, op = F.concat(F.lit("sensor_"), which.cast("string")), F.when(n < sensors, "insert").otherwise("update")
    elif kind == "generic":
        props, id_, op = F.struct(n.alias("value"), F.lit("generic data").alias("message")), F.concat(F.lit("generic_"), n.cast("string")), F.lit("insert")
    else:
        raise ValueError(f"no generator {kind!r}")
    label = {"counter": "Counter", "sensor": "SensorReading", "generic": "Generic"}[kind]
    return as_changes(df, seq=n, op=op, element_type=F.lit("node"), source_id=F.lit("mock"), element_id=id_, labels=F.array(F.lit(label)), effective_from=at, properties=F.to_json(props))


def mock_changes(spark: SparkSession, n: int, kind: str = "counter", sensors: int = 5) -> DataFrame:
    """``n`` generated changes: counter, sensor or generic; the same every time."""
    df = spark.range(n)
    return _mock(df, F.col("id"), kind, sensors, F.col("id") * 1000)


def mock_stream(spark: SparkSession, per_second: int = 1, kind: str = "counter", sensors: int = 5) -> DataFrame:
    df = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return _mock(df, F.col("value"), kind, sensors, F.unix_millis("timestamp"))
