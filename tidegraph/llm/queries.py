"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import scratch, table
from tidegraph.llm.exact_dedup import exact_dedup
from tidegraph.llm.html_text import extract
from tidegraph.llm.language_id import identify
from tidegraph.llm.near_vectors import near_vectors
from tidegraph.llm.packing import pack
from tidegraph.llm.segmentations import sample_segmentations
from tidegraph.llm.secrets import BASE_RULES, RULES, joined, scan
from tidegraph.llm.simhash import near_groups
from tidegraph.llm.token_files import read_tokens, write_tokens
from tidegraph.llm.warc import read_warc, write_warc


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), k=4)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(table(spark, sf_dir, "documents"), learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "secret_spans")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(
        "doc_id",
        *[of(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def _secret_sql() -> str:
    """Spans per rule from the texts between matches, as running sums of lengths."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, t,
                   string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS held
            FROM texts WHERE regexp_matches(t, '{p}')""")
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        matched AS ({" UNION ALL ".join(parts)}),
        each AS (SELECT doc_id, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, held FROM matched),
        spans AS (
            SELECT doc_id, rank, kind,
                   list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS a,
                   length(hits[i]) AS n
            FROM each WHERE length(held[i]) >= least),
        shown AS (SELECT doc_id, rank, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS s FROM spans),
        told AS (
            SELECT doc_id,
                   count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(s, ',' ORDER BY a, rank) FILTER (rank < {len(BASE_RULES)}) AS base, string_agg(s, ',' ORDER BY a, rank) AS spans
            FROM shown GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN told USING (doc_id)
    """


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, folder)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=3, width=1, most=3, blocks=2, block_bits=32)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_segmentations": op3_segmentations,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_vectors": op6_near_vectors,
    "op7_token_files": op7_token_files,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op5_secret_scan": _secret_sql(),
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM q
    """,
}
