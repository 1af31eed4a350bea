"""Secret scans through a trigram inverted index.

Every rule's pattern is parsed into a Boolean query over trigrams that any match must
contain (an OR of branches, each an AND of trigrams; see :mod:`tidegraph.llm.trigrams`).
A rule without such trigrams, like a run of hex digits, scans every text.

The index holds, per trigram and per bucket of 32,768 document positions, a bitmap
of the documents that contain it.  Positions are hashed identifiers, so buckets are
evenly filled however identifiers are spread, and two documents that share a
position merely become candidates together.  A branch intersects its postings, a
rule unites its branches, and only texts whose bit is set are matched against the
pattern, which verifies them and yields the spans.

Everything runs on DataFrame and SQL functions; no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import body
from tidegraph.llm.trigrams import trigram_query

#: Positions per bucket, fixed by Spark's bitmap functions.
BUCKET = 32_768
#: Candidate bitmaps are broadcast up to this size and joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret and the regular expression that finds it."""

    kind: str
    pattern: str
    #: A match counts only if this group of it has at least ``least`` characters.
    group: int = 0
    least: int = 1

    def trigrams(self) -> list[tuple[str, ...]]:
        """The Boolean query: an OR of ANDs of lower-case trigrams; [] where nothing is mandatory."""
        return list(trigram_query(self.pattern))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(["password", "passwd", "secret", "token", "api_?key"])
_ANY_CASE = "|".join("_?".join(_either_case(p) for p in w.split("_?")) for w in _KEYWORDS.split("|"))

#: The base rules, in the order in which they are listed; fixed patterns.
BASE_RULES = (
    Rule(
        "assign",
        rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the index makes cheap to look for besides; fixed patterns of public token formats.
EXTRA_RULES = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + EXTRA_RULES


def _position(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets * BUCKET))


def build_index(docs: DataFrame, grams: list[str], buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (bucket, gram, bitmap) of the given lower-case trigrams.

    Only positions and one bit per trigram are shuffled, never text.
    """
    low = docs.select(_position(id_col, buckets).alias("at"), F.lower(body(text_col)).alias("low"))
    found = low.select("at", F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]), lambda x: x.isNotNull()).alias("grams"))
    held = found.select(F.shiftright("at", 15).alias("bucket"), (F.col("at") % BUCKET).alias("bit"), "grams").repartition("bucket")
    maps = held.groupBy("bucket").agg(
        *[F.bitmap_construct_agg(F.when(F.array_contains("grams", k), F.col("bit"))).alias(f"g{k}") for k in range(len(grams))]
    )
    listed = F.array(*[F.struct(F.lit(g).alias("gram"), F.col(f"g{k}").alias("bitmap")) for k, g in enumerate(grams)])
    return maps.select("bucket", F.inline(listed))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(bucket, kind, bitmap): postings intersected within each branch, branches united per rule."""
    branches = [(r.kind, k, g) for r in rules for k, q in enumerate(r.trigrams()) for g in q]
    wanted = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("branch"), F.lit(g).alias("of")) for kind, k, g in branches])
    each = index.select("bucket", "gram", "bitmap", F.inline(F.filter(wanted, lambda x: x["of"] == F.col("gram"))))
    met = each.groupBy("bucket", "kind", "branch").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    return met.groupBy("bucket", "kind").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches: texts between matches and matches alternate."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    ok = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else match
    each = F.zip_with(F.slice(between, F.lit(1), F.size(match)), F.arrays_zip(match.alias("m"), ok.alias("g")), lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m["m"]).alias("n"), F.length(m["g"]).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        new = F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(each, zero, step, lambda acc: acc["out"])


def _named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``secret_spans``: array of (kind, start, end), by start, then rule order.

    Positions are code points, ends exclusive.  Null text counts as empty and has no
    spans.  Rows with a null identifier, and rows that share one, are candidates
    together and each verified on its own text.  An empty table gives no rows.
    A column of ``docs`` called ``secret_spans`` is replaced.
    """
    docs = docs.drop("secret_spans")
    queries = {r.kind: r.trigrams() for r in rules}
    indexed = tuple(r for r in rules if queries[r.kind])
    work = docs
    if indexed:
        grams = sorted({g for r in indexed for q in queries[r.kind] for g in q})
        buckets = max(1, -(-docs.count() // (BUCKET // 4)))  # at most a quarter of the bits taken
        index = build_index(docs, grams, buckets, id_col, text_col)
        marks = candidates(index, indexed).groupBy("bucket").pivot("kind", [r.kind for r in indexed]).agg(F.first("bitmap"))
        marks = marks.select(F.col("bucket").alias("__bucket"), *[F.col(r.kind).alias(f"__{r.kind}") for r in indexed])
        if buckets * len(indexed) * BUCKET // 8 <= BROADCAST_BYTES:
            marks = F.broadcast(marks)
        work = docs.withColumn("__at", _position(id_col, buckets)).withColumn("__bucket", F.shiftright("__at", 15)).join(marks, "__bucket", "left")
        bit = F.col("__at") % BUCKET
        work = work.select(*[docs[c] for c in docs.columns], *[_bit(F.col(f"__{r.kind}"), bit).alias(f"__{r.kind}") for r in indexed])
    text = body(text_col)
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = []
    for k, r in enumerate(rules):
        meant = F.col(f"__{r.kind}") if queries[r.kind] else F.lit(True)
        spans = F.when(meant & F.rlike(text, F.lit(r.pattern)), _spans(text, r)).otherwise(none)
        found.append(F.transform(spans, _named(k, r.kind)))
    ordered = F.array_sort(F.concat(*found))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return work.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias("secret_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.concat(acc["out"], F.array(kept, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
