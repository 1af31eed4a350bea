"""Rules that turn arbitrary JSON records into changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.middleware import get, json_at, quote
from tidegraph.sources.readers import as_changes

_TIMES = {"iso8601": lambda c: F.unix_millis(c.try_cast("timestamp")), "unix_seconds": lambda c: c.try_cast("long") * 1000, "unix_millis": lambda c: c.try_cast("long"), "unix_nanos": lambda c: F.floor(c.try_cast("long") / 1_000_000)}


@dataclass(frozen=True)
class MappingRule:
    """One rule; paths are JSON paths of the record's text, ids may be templates like ``room-{$.id}``.

    ``when``: (path or ``header:<name>``, test, value) with test equals, contains or regex.
    ``operation_from``: a path whose values ``operations`` maps to insert, update, delete.
    """

    id: str
    labels: tuple[str, ...]
    properties: dict[str, str] = field(default_factory=dict)
    when: tuple[str, str, str] | None = None
    operation: str = "insert"
    operation_from: str | None = None
    operations: dict[str, str] = field(default_factory=dict)
    element_type: str = "node"
    start: str | None = None
    end: str | None = None
    effective_from: str | None = None
    effective_format: str = "unix_millis"

    def text(self, template: str | None, record: Column) -> Column:
        """A template's text: ``{path}`` parts filled in."""
        if template is None:
            return F.lit(None).cast("string")
        parts, rest = [], template
        while "{" in rest:
            plain, _, rest = rest.partition("{")
            path, _, rest = rest.partition("}")
            parts += [F.lit(plain), get(record, path)]
        return F.concat(*parts, F.lit(rest)) if parts else (get(record, template) if template.startswith("$") else F.lit(template))

    def condition(self, record: Column, headers: Column | None) -> Column:
        if self.when is None:
            return F.lit(True)
        where, test, value = self.when
        if where.startswith("header:"):
            if headers is None:
                raise ValueError("a rule tests a header, but the records have none")
            name = where.removeprefix("header:")
            seen = F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(1))["value"].cast("string")
        else:
            seen = get(record, where)
        tests = {"equals": lambda: seen == value, "contains": lambda: seen.contains(value), "regex": lambda: seen.rlike(value)}
        if test not in tests:
            raise ValueError(f"no test {test!r}")
        return F.coalesce(tests[test](), F.lit(False))

    def apply(self, records: DataFrame, column: str, source_id: str, seq: Column) -> DataFrame:
        record = F.col(column)
        own = records.where(self.condition(record, F.col("headers") if "headers" in records.columns else None))
        op = F.lit(self.operation)
        if self.operation_from:
            names = F.create_map(*[F.lit(x) for p in self.operations.items() for x in p])
            op = F.try_element_at(names, get(record, self.operation_from))
            own = own.where(op.isNotNull())
        at = _TIMES[self.effective_format](get(record, self.effective_from)) if self.effective_from else F.lit(0)
        pairs = [F.concat(quote(F.lit(k)), F.lit(":"), F.coalesce(json_at(record, p), F.lit("null"))) for k, p in self.properties.items()]
        props = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
        return as_changes(
            own, seq=seq, op=op, element_type=F.lit(self.element_type), source_id=F.lit(source_id), element_id=self.text(self.id, record), labels=F.array(*[F.lit(x) for x in self.labels]), effective_from=F.coalesce(at, F.lit(0)), properties=props,
            src_id=self.text(self.start, record), dst_id=self.text(self.end, record), src_source_id=F.lit(source_id), dst_source_id=F.lit(source_id),
        )


def map_records(records: DataFrame, rules: list[MappingRule], column: str = "value", source_id: str = "records", seq: Column | None = None) -> DataFrame:
    """Changes that the rules make of JSON records; a record may match several rules."""
    seq = F.monotonically_increasing_id() if seq is None else seq
    out = None
    for r in rules:
        one = r.apply(records, column, source_id, seq)
        out = one if out is None else out.unionByName(one)
    return out
