"""Token ids in binary files with one shared Zstandard dictionary.

A dataset is a folder with ``dictionary.zdict`` and one ``*.tgi`` file per range of
documents.  Layout of a ``.tgi`` file (all integers little-endian)::

    magic ``TGIDS001`` | 32 bytes SHA-256 of the dictionary | u32 bytes per id
    one Zstandard frame per document (shared dictionary, size in the frame)
    index: i64 identifiers, u64 frame offsets (n + 1 of them), u32 ids per document
    u64 documents | u64 index offset | magic ``TGIDXEND``

Any document is read with two seeks: its offsets from the index, then its frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import files
from tidegraph.llm.common import NULL_ID, body, partitions, sample_rows
from tidegraph.llm.token_cache import encoder

MAGIC, END = b"TGIDS001", b"TGIDXEND"
TAIL = struct.Struct("<QQ8s")
#: The dictionary is trained on at most this many documents (those with the
#: smallest hashed identifiers) and at most SAMPLE_IDS ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1500, 4096, 32 * 1024


def _pack(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Zstandard dictionary over the samples; empty where there is too little to learn."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class TokenWriter:
    """Writes one file; ids arrive as ``<u4`` bytes."""

    def __init__(self, uri: str, dictionary: bytes, width: int):
        store, path = files.filesystem(uri)
        self.out, self.width, self.at = store.open_output_stream(path), width, 44
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", width))
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False)
        self.ids, self.offsets, self.counts = [], [44], []

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.press.compress(_pack(ids, self.width))
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // 4)

    def close(self) -> None:
        self.out.write(np.asarray(self.ids, "<i8").tobytes() + np.asarray(self.offsets, "<u8").tobytes() + np.asarray(self.counts, "<u4").tobytes())
        self.out.write(TAIL.pack(len(self.ids), self.at, END))
        self.out.close()


class TokenReader:
    """Random access to one file: ``doc_ids``, ``counts`` and ``ids(k)``."""

    def __init__(self, uri: str, dictionary: bytes):
        store, path = files.filesystem(uri)
        self.f = store.open_input_file(path)
        magic, digest, self.width = struct.unpack("<8s32sI", self.f.read_at(44, 0))
        n, at, end = TAIL.unpack(self.f.read_at(TAIL.size, self.f.size() - TAIL.size))
        if magic != MAGIC or end != END:
            raise ValueError(f"{uri} is no token file, or was cut short")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.f.read_at(n * 8 + (n + 1) * 8 + n * 4, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, n * 8)
        self.counts = np.frombuffer(index, "<u4", n, n * 16 + 8)
        self.unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.unpress.decompress(self.f.read_at(b - a, a)), f"<u{self.width}").astype("<u4")


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    num_partitions: int | None = None,
) -> list[dict]:
    """Encode, append ``end_id`` and write in ascending identifier order; returns the manifest.

    The manifest has a row per file (file, documents, tokens, start: ids of all
    files before it) and is also stored as ``manifest.json``.  Null text counts as
    empty; a null identifier comes first and is read back as null; rows that repeat
    an identifier are all written, ordered by text.  An empty table gives an empty
    manifest.  A lost task is simply run again: files of attempts that no manifest
    names are never read.
    """
    spark = docs.sparkSession
    files.make_dir(folder)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), body(text_col).alias("body"))
    sample = sample_rows(rows, "doc_id", SAMPLE_DOCS).select(F.substring("body", 1, 4 * SAMPLE_IDS).alias("body"))
    encode = encoder(vocabulary)
    end = struct.pack("<I", end_id)
    width = 2 if encode.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
    dictionary = train_dictionary([_pack((encode(r.body) + end)[: 4 * SAMPLE_IDS], width) for r in sample.collect()])
    files.put(f"{folder}/dictionary.zdict", dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, out = encoder(vocabulary), TaskContext.get().partitionId(), None
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"], encode.many(pdf["body"])):
                if out is None:
                    name = files.attempt_name(part, ".tgi")
                    out = TokenWriter(f"{folder}/{name}", dictionary, width)
                out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            yield pd.DataFrame({"part": [part], "file": [name], "documents": [len(out.ids)], "tokens": [int(np.sum(out.counts, dtype="int64"))]})

    dealt = rows.repartitionByRange(num_partitions or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "body")
    found = dealt.mapInPandas(write, "part long, file string, documents long, tokens long").collect()  # a row per file
    manifest, start = [], 0
    for r in sorted(found):
        manifest.append({"file": r.file, "documents": r.documents, "tokens": r.tokens, "start": start})
        start += r.tokens
    files.put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Read a dataset back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    manifest = json.loads(files.get(f"{folder}/manifest.json"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = None
        for pdf in batches:
            for name, start in zip(pdf["file"], pdf["start"]):
                dictionary = files.get(f"{folder}/dictionary.zdict") if dictionary is None else dictionary
                held = TokenReader(f"{folder}/{name}", dictionary)
                for a in range(0, len(held.doc_ids), 2000):
                    ks = range(a, min(a + 2000, len(held.doc_ids)))
                    each = [held.ids(k) for k in ks]
                    n = np.array([len(x) for x in each], "int64")
                    out = {"doc_id": held.doc_ids[a : a + 2000], "start": int(start) + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.tobytes()) for x in each]}
                    start = int(start) + int(n.sum())
                    yield pd.DataFrame(out | ({"ids": [x.astype("int32") for x in each]} if with_ids else {}))

    rows = [(m["file"], m["start"]) for m in manifest]
    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return listed.mapInPandas(read, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
