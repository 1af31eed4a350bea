"""Stages that rewrite changes before they reach a graph.

A change is a row of the schema in :data:`tidegraph.streaming.changelog.CHANGES`; its
``properties`` are JSON text.  Every stage is a DataFrame-to-DataFrame function on
built-in functions, so it works on batches and streams alike (``Unwind`` of updates
needs the earlier version of an element, given as a table).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.types import LoweringError

FAIL, SKIP = "fail", "skip"
OTHER = "properties"
_PATH = re.compile(r"^\$(?:\.[A-Za-z_]\w*|\[(?:\d+|\*|'[^']*')\])*$")
_FILTER = re.compile(r"^(\$[^?]*)\[\?\(@((?:\.[A-Za-z_]\w*)+)\s*(==|!=|<|<=|>|>=)\s*('[^']*'|-?[\d.]+)\)\](.*)$")


def check_path(path: str) -> str:
    """A JSON path that Spark can evaluate; anything else fails before a stream starts."""
    if not _PATH.match(path):
        raise LoweringError(f"not a JSON path: {path!r}")
    return path


def get(json: Column, path: str) -> Column:
    """Text at a path of JSON text; null where there is none."""
    return F.get_json_object(json, check_path(path))


def json_at(json: Column, path: str) -> Column:
    """JSON of the value at a path, text quoted; null where there is none."""
    if "[*]" in check_path(path):
        return _as_json(F.get_json_object(json, path))
    return F.to_json(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def _as_json(text: Column) -> Column:
    """JSON for a value taken out with ``get``: numbers, booleans, arrays and objects as they are, else quoted."""
    bare = text.rlike(r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null|[\[{].*)$")
    return F.when(bare & F.try_parse_json(text).isNotNull(), text).otherwise(quote(text))


def quote(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def with_property(json: Column, name: Column, value_json: Column) -> Column:
    """JSON object with a property set; its other properties keep their values."""
    held = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    entries = F.map_filter(held, lambda k, v: k != name)
    kept = F.transform(F.map_entries(entries), lambda e: F.concat(quote(e["key"]), F.lit(":"), F.coalesce(_raw(json, e["key"], e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.concat(kept, F.array(F.concat(quote(name), F.lit(":"), value_json))), ","), F.lit("}"))


def _raw(json: Column, key: Column, text: Column) -> Column:
    """A property as JSON: text stays quoted even where it looks like a number."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), F.concat(F.lit("$['"), key, F.lit("']")), "variant"))
    return F.when(kind == "STRING", quote(text)).when(kind == "VOID", F.lit("null")).otherwise(text)


def failed(condition: Column, policy: str, message: Column, otherwise: Column) -> Column:
    """``otherwise``, except that a failing row raises under the ``fail`` policy and stays as it was under ``skip``."""
    if policy not in (FAIL, SKIP):
        raise LoweringError(f"on_error must be {FAIL} or {SKIP}")
    if policy == FAIL:
        return F.when(condition, F.raise_error(message).cast("string")).otherwise(otherwise)
    return F.when(condition, F.col(OTHER)).otherwise(otherwise)


@dataclass(frozen=True)
class Relabel:
    """Rename labels; those without a mapping stay."""

    labels: dict[str, str]

    def apply(self, changes: DataFrame) -> DataFrame:
        names = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        return changes.withColumn("labels", F.transform("labels", lambda x: F.coalesce(F.try_element_at(names, x), x)))


@dataclass(frozen=True)
class Promote:
    """Copy nested values to properties.  ``mappings``: (path, target name) pairs."""

    mappings: tuple[tuple[str, str], ...]
    on_conflict: str = FAIL
    on_error: str = FAIL

    def apply(self, changes: DataFrame) -> DataFrame:
        out = changes
        for path, target in self.mappings:
            props = F.col(OTHER)
            value = json_at(props, path)
            taken = F.array_contains(F.json_object_keys(props), target)
            done = with_property(props, F.lit(target), value)
            if self.on_conflict == SKIP:
                done = F.when(taken, props).otherwise(done)
            elif self.on_conflict == FAIL:
                done = failed(taken, self.on_error, F.lit(f"promote: {target} exists"), done)
            elif self.on_conflict != "overwrite":
                raise LoweringError("on_conflict must be overwrite, skip or fail")
            new = failed(value.isNull(), self.on_error, F.lit(f"promote: nothing at {path}"), done)
            out = out.withColumn(OTHER, F.when(F.col("op") == "delete", props).otherwise(new))
        return out


@dataclass(frozen=True)
class Decoder:
    """Decode a text property: base64, base64url, hex, url or json_escape."""

    encoding: str
    target: str
    output: str | None = None
    strip_quotes: bool = False
    max_size_bytes: int = 1 << 20
    on_error: str = FAIL

    def decoded(self, s: Column) -> Column:
        binary = {
            "base64": lambda: F.try_to_binary(s, F.lit("base64")),
            "base64url": lambda: F.try_to_binary(F.concat(F.translate(s, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)).cast("int"))), F.lit("base64")),
            "hex": lambda: F.try_to_binary(s, F.lit("hex")),
        }
        if self.encoding in binary:
            found = binary[self.encoding]()
            return F.when(F.is_valid_utf8(found.cast("string")), found.cast("string"))
        if self.encoding == "url":
            return F.try_url_decode(s)
        if self.encoding == "json_escape":
            return F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v")
        raise LoweringError(f"unknown encoding {self.encoding!r}")

    def apply(self, changes: DataFrame) -> DataFrame:
        props = F.col(OTHER)
        text = get(props, f"$.{self.target}")
        text = F.regexp_replace(text, '^"(.*)"$', "$1") if self.strip_quotes else text
        found = self.decoded(text)
        bad = text.isNull() | (F.octet_length(text) > self.max_size_bytes) | found.isNull()
        done = with_property(props, F.lit(self.output or self.target), quote(found))
        new = failed(bad, self.on_error, F.lit(f"decoder: cannot decode {self.target}"), done)
        return changes.withColumn(OTHER, F.when(F.col("op") == "delete", props).otherwise(new))


@dataclass(frozen=True)
class ParseJson:
    """Replace a property's JSON text by its value."""

    target: str
    output: str | None = None
    max_json_size: int = 1 << 20
    max_nesting_depth: int = 20
    on_error: str = FAIL

    def apply(self, changes: DataFrame) -> DataFrame:
        props = F.col(OTHER)
        text = get(props, f"$.{self.target}")
        bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
        depth = F.aggregate(
            F.split(bare, ""),
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
            lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")),
            lambda a: a["most"],
        )
        bad = text.isNull() | (F.octet_length(text) > self.max_json_size) | F.try_parse_json(text).isNull() | (depth > self.max_nesting_depth)
        done = with_property(props, F.lit(self.output or self.target), text)
        new = failed(bad, self.on_error, F.lit(f"parse_json: cannot parse {self.target}"), done)
        return changes.withColumn(OTHER, F.when(F.col("op") == "delete", props).otherwise(new))


@dataclass(frozen=True)
class Mapping:
    """One output of :class:`Map`: paths start at ``$`` (the change's properties) or ``$selected``."""

    selector: str | None = None
    condition: str | None = None
    op: str | None = None
    label: str | None = None
    id: str | None = None
    element_type: str = "node"
    start: str | None = None
    end: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Map:
    """Build new changes from old ones.  ``mappings``: (label, op) to outputs; all else is dropped."""

    mappings: dict[tuple[str, str], tuple[Mapping, ...]]

    def apply(self, changes: DataFrame) -> DataFrame:
        out = None
        for (label, op), maps in self.mappings.items():
            own = changes.where((F.col("op") == op) & F.array_contains("labels", label))
            for m in maps:
                one = self.mapped(own, m, label)
                out = one if out is None else out.unionByName(one)
        return changes.where("false") if out is None else out

    @staticmethod
    def selected(own: DataFrame, selector: str | None) -> DataFrame:
        if selector is None:
            return own.withColumn("__sel", F.lit(None).cast("string"))
        test = None
        if m := _FILTER.match(selector):
            selector, test = f"{m[1]}[*]{m[5]}", m
            if m[5]:
                raise LoweringError(f"a filter must end the selector: {selector!r}")
        check_path(selector)
        base = selector.removesuffix("[*]")
        hits = F.from_json(get(F.col(OTHER), base), "array<string>") if selector.endswith("[*]") else F.array(get(F.col(OTHER), selector))
        rows = own.withColumn("__sel", F.explode(F.filter(hits, lambda h: h.isNotNull())))
        if test:
            value = get(F.col("__sel"), f"${test[2]}")
            want = test[4]
            left = value if want.startswith("'") else value.try_cast("double")
            right = F.lit(want[1:-1]) if want.startswith("'") else F.lit(float(want))
            rows = rows.where({"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[test[3]])
        return rows

    @staticmethod
    def at(path: str | None) -> Column:
        if path is None:
            return F.lit(None).cast("string")
        if path.startswith("$selected"):
            rest = path.removeprefix("$selected")
            return get(F.col("__sel"), f"${rest}") if rest else F.col("__sel")
        return get(F.col(OTHER), path) if path.startswith("$") else F.lit(path)

    @classmethod
    def json(cls, path: str) -> Column:
        if path == "$selected":
            return _as_json(F.col("__sel"))
        if path.startswith("$selected"):
            return json_at(F.col("__sel"), f"${path.removeprefix('$selected')}")
        return json_at(F.col(OTHER), path) if path.startswith("$") else quote(F.lit(path))

    def mapped(self, own: DataFrame, m: Mapping, label: str) -> DataFrame:
        rows = self.selected(own, m.selector)
        if m.condition:
            rows = rows.where(F.coalesce(self.at(m.condition).isin("true"), F.lit(False)) if m.condition.startswith("$") else F.expr(m.condition))
        pairs = [F.concat(quote(F.lit(k)), F.lit(":"), F.coalesce(self.json(p), F.lit("null"))) for k, p in m.properties.items()]
        props = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.col(OTHER)
        return rows.withColumns(
            {
                "__id": self.at(m.id) if m.id else F.col("element_id"),
                "__p": props,
                "__s": self.at(m.start),
                "__e": self.at(m.end),
            }
        ).select(*changes_columns(own, {"op": F.lit(m.op) if m.op else F.col("op"), "labels": F.array(F.lit(m.label or label)), "element_id": F.col("__id"), "element_type": F.lit(m.element_type), OTHER: F.col("__p"), "src_id": F.col("__s"), "dst_id": F.col("__e")}))


def changes_columns(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    return [new[c].cast(df.schema[c].dataType).alias(c) if c in new else F.col(c) for c in df.columns if not c.startswith("__")]


@dataclass(frozen=True)
class Unwind:
    """Items of an array property become nodes of their own, related to their parent.

    ``previous``: properties of parents before an update (element_id, properties);
    children that vanished since are deleted.  The parent's change stays.
    """

    label: str
    selector: str
    child: str
    key: str | None = None
    relation: str | None = None
    previous: DataFrame | None = None

    def items(self, own: DataFrame, props: str) -> DataFrame:
        check_path(self.selector)
        array = F.from_json(get(F.col(props), self.selector.removesuffix("[*]")), "array<string>")
        rows = own.select("*", F.posexplode(F.coalesce(array, F.array().cast("array<string>"))).alias("__at", "__item"))
        item = get(F.col("__item"), self.key) if self.key else F.col("__at").cast("string")
        return rows.withColumn("__child", F.concat(F.lit(f"$unwind-{self.selector}-"), F.col("element_id"), F.lit("-"), item))

    def children(self, rows: DataFrame, op: Column) -> DataFrame:
        nodes = rows.select(*changes_columns(rows, {"op": op, "element_type": F.lit("node"), "element_id": F.col("__child"), "labels": F.array(F.lit(self.child)), OTHER: F.col("__item")}))
        if not self.relation:
            return nodes
        ends = {"src_source_id": F.col("source_id"), "src_id": F.col("element_id"), "dst_source_id": F.col("source_id"), "dst_id": F.col("__child")}
        links = rows.select(*changes_columns(rows, {"op": op, "element_type": F.lit("relation"), "element_id": F.concat("__child", F.lit("$rel")), "labels": F.array(F.lit(self.relation)), OTHER: F.lit("{}")} | ends))
        return nodes.unionByName(links)

    def apply(self, changes: DataFrame) -> DataFrame:
        own = changes.where(F.array_contains("labels", self.label))
        now = self.items(own.where("op <> 'delete'"), OTHER)
        out = self.children(now, F.col("op")).unionByName(changes)
        if self.previous is not None:
            before = own.where("op <> 'insert'").join(self.previous.select("element_id", F.col(OTHER).alias("__was")), "element_id")
            old = self.items(before, "__was")
            gone = old.join(now.select("__child"), "__child", "left_anti")
            out = self.children(gone, F.lit("delete")).unionByName(out)
        return out


@dataclass(frozen=True)
class Jq:
    """A jq program over each change's properties; needs the optional ``jq`` package."""

    program: str
    halt_on_error: bool = True

    def apply(self, changes: DataFrame) -> DataFrame:
        import jq  # not a requirement: only this stage needs it

        compiled, halt = self.program, self.halt_on_error
        jq.compile(compiled)  # fails before anything runs

        @F.pandas_udf("array<string>")
        def run(texts):
            import json as js

            import jq
            import pandas as pd

            program = jq.compile(compiled)

            def one(t):
                try:
                    return [js.dumps(x) for x in program.input_text(t)]
                except ValueError:
                    if halt:
                        raise
                    return []

            return pd.Series([one(t) for t in texts])

        return changes.withColumn(OTHER, F.explode(run(OTHER)))


@dataclass(frozen=True)
class Pipeline:
    """Stages in order."""

    stages: tuple

    def apply(self, changes: DataFrame) -> DataFrame:
        for s in self.stages:
            changes = s.apply(changes)
        return changes


STAGES = {"map": Map, "unwind": Unwind, "promote": Promote, "relabel": Relabel, "decoder": Decoder, "parse_json": ParseJson, "jq": Jq}
__all__ = ["FAIL", "SKIP", "STAGES", "Decoder", "Jq", "Map", "Mapping", "ParseJson", "Pipeline", "Promote", "Relabel", "Unwind"]
