"""Dictionary-compressed WARC archives.

An archive (``*.warc.zst``) starts with a skippable frame (magic 0x184D2A5D) that
holds a Zstandard dictionary built from records of the same collection; every
record after it is a Zstandard frame of its own, so a record can be read alone.
Pages whose payload another page already has are written as ``revisit`` records
that name the response and hold no payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import files
from tidegraph.llm.common import NULL_ID, sample_rows
from tidegraph.llm.token_files import train_dictionary

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always stored.
LEAST_PAYLOAD = 100
#: A task starts another archive once one holds this many compressed bytes.
ARCHIVE_BYTES = 128 << 20
#: The dictionary is built from at most this many records (smallest hashed
#: identifiers) and at most SAMPLE_BYTES of each.
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 16_384
_READ = 1 << 14


def record_id(page_id: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    target = "".join(c for c in url or f"urn:page:{page_id}" if c > " ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {page_id}", f"Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/") or len(block) != int(fields["content-length"]):
        raise ValueError("no WARC record, or one cut short")
    return fields, block


class ArchiveWriter:
    def __init__(self, uri: str, dictionary: bytes, level: int):
        store, path = files.filesystem(uri)
        self.out = store.open_output_stream(path)
        self.at = self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=level, dict_data=shared)

    def add(self, record: bytes) -> None:
        self.at += self.out.write(self.press.compress(record))

    def close(self) -> None:
        self.out.close()


def read_archive(uri: str) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    store, path = files.filesystem(uri)
    with store.open_input_stream(path) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} does not start with a dictionary frame")
        held = f.read(size)
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        data = f.read(_READ)
        while data:
            frame, parts = unpress.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    break
                if not (data := f.read(_READ)):
                    raise ValueError(f"{uri} ends within a record")
            yield b"".join(parts)
            data = frame.unused_data or f.read(_READ)


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    level: int = 3,
) -> list[dict]:
    """Write a record per row; returns the manifest (file, records), also stored as ``manifest.json``.

    Of records with equal payloads of ``LEAST_PAYLOAD`` bytes or more, that with the
    smallest identifier is the response and the others revisit it.  Null html is an
    empty payload, a null url becomes ``urn:page:<id>``, a null identifier is never
    a response to others while another has it (it sorts last) and reads back as
    null.  Rows that repeat both identifier and payload are alike: all responses or
    all revisits.  An empty table gives no archive.  Other columns are ignored.

    Payloads move at most once, to meet their revisit marks, and not at all where
    the marks are few.  Files of attempts that no manifest names are never read.
    """
    files.make_dir(folder)
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("string").cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    keys = rows.select("page_id", "digest").where(F.col("size") >= LEAST_PAYLOAD)
    known = F.nullif("page_id", F.lit(NULL_ID))
    groups = keys.groupBy("digest").agg(F.coalesce(F.min(known), F.lit(NULL_ID)).alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = keys.join(groups, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    marked = rows.join(revisits, ["page_id", "digest"], "left")

    some = sample_rows(rows, "page_id", SAMPLE_RECORDS).select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"), "digest", "size")
    dictionary = train_dictionary([make_record(r.page_id, r.url, bytes(r.payload), r.digest, r.size, None, date) for r in some.collect()], 64 * 1024)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            for page_id, digest, url, payload, size, first in zip(pdf["page_id"], pdf["digest"], pdf["url"], pdf["payload"], pdf["size"], pdf["refers_to"]):
                if out is None:
                    name, n = files.attempt_name(part, ".warc.zst"), 0
                    out = ArchiveWriter(f"{folder}/{name}", dictionary, level)
                out.add(make_record(page_id, url, payload, digest, size, int(first) if first else None, date))
                n += 1
                if out.at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"file": [name], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "records": [n]})

    # as text, so that pandas keeps a missing reference apart from the 64-bit identifiers
    sent = marked.select("page_id", "digest", "url", "payload", "size", F.col("refers_to").cast("string").alias("refers_to"))
    manifest = [r.asDict() for r in sorted(sent.mapInPandas(write, "file string, records long").collect())]  # a row per archive
    files.put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) per record.

    The digest of every response is computed anew and compared with its header.
    """
    manifest = json.loads(files.get(f"{folder}/manifest.json"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if with_payload else "")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                out = []
                for data in read_archive(f"{folder}/{name}"):
                    fields, block = parse_record(data)
                    digest, payload = fields["warc-payload-digest"].removeprefix("sha256:"), None
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: payload of page {fields['page-id']} is damaged")
                    out.append([int(fields["page-id"]), fields["warc-target-uri"], int(fields["payload-length"]), digest, fields["warc-type"], fields.get("refers-to-page-id"), *[payload] * with_payload])
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    listed = spark.createDataFrame([(m["file"],) for m in manifest], "file string").repartition(max(1, len(manifest)))
    found = listed.mapInPandas(read, schema)
    null = F.lit(NULL_ID)
    return found.withColumns({"page_id": F.nullif("page_id", null), "refers_to": F.nullif(F.col("refers_to").cast("long"), null)})
