"""Order-preserving packing of documents into fixed windows.

Documents are dealt out by ranges of their identifier and, within a range, read as
one stream of token ids.  Window cuts are chosen by dynamic programming over the
ends of documents and sentences: a window of n ids costs its padding (L - n, or
nothing where n is a power of two) plus a penalty if its end truncates a document.
As padding is linear in the cut, the best start of a window ending at a cut is a
sliding minimum of ``cost + position``, kept in a monotone queue, so the work is
linear in the number of cuts.  The horizon rolls: once HORIZON windows' worth of
ids is held, all but the last windows are settled, which bounds memory.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import NULL_ID, body, partitions
from tidegraph.llm.token_cache import encoder

#: Cost, in ids of padding, of ending a window at a sentence end inside a document
#: and of ending it inside a sentence (offered only where a sentence exceeds it).
SENTENCE_CUT, HARD_CUT = 8, 256
#: Lengths other than the full window that need no padding.
UNPADDED = (2048, 1024)
HORIZON, UNSETTLED = 64, 4


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Positions of the cheapest window ends; the last of ``ends`` is always one.

    ``ends`` are ascending candidate cuts (ids from the start), no two neighbours
    further apart than ``window``; ``penalties`` their costs.
    """
    pos, pen = [0, *ends.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    at = {0: 0}
    queue = deque([0])  # candidate starts, their cost + position ascending
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + window - p + pos[i]
        for n in UNPADDED:
            if (k := at.get(p - n)) is not None and n < window and cost[k] < best:
                i, best = k, cost[k]
        best += pen[j]
        cost[j], back[j] = best, i
        at[p] = j
        key = best + p
        while queue and cost[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of (doc_id, ids as ``<u4`` bytes); yields pieces."""

    def __init__(self, window: int, stops: np.ndarray, first_sequence: int):
        self.window, self.stops, self.sequence = window, stops, first_sequence
        self.docs: deque[list] = deque()  # [doc_id, ids, ids already placed]
        self.ends: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        a = np.frombuffer(ids, "<u4")
        ends = np.flatnonzero(self.stops[a]) + 1
        ends = ends[ends < len(a)]
        ends = np.append(ends, len(a))
        penalties = np.full(len(ends), SENTENCE_CUT)
        penalties[-1] = 0
        gaps = np.diff(ends, prepend=0)
        if gaps.max() > self.window:  # a sentence longer than a window
            extra = np.concatenate([np.arange(e - g + self.window // 2, e, self.window // 2) for e, g in zip(ends[gaps > self.window], gaps[gaps > self.window])])
            ends, penalties = np.append(ends, extra), np.append(penalties, np.full(len(extra), HARD_CUT))
            order = np.argsort(ends, kind="stable")
            ends, penalties = ends[order], penalties[order]
        self.docs.append([doc_id, ids, 0])
        self.ends.append(ends + self.held)
        self.penalties.append(penalties)
        self.held += len(a)
        return self.settle(False) if self.held >= HORIZON * self.window else []

    def settle(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        ends, penalties = np.concatenate(self.ends), np.concatenate(self.penalties)
        cuts = choose_cuts(ends, penalties, self.window)
        if not last:
            cuts = cuts[:-UNSETTLED]
        pieces, at = [], 0
        for cut in cuts:
            offset, left = 0, cut - at
            while left:
                doc_id, ids, done = doc = self.docs[0]
                n = min(left, len(ids) // 4 - done)
                pieces.append((doc_id, done, n, zlib.crc32(ids[4 * done : 4 * (done + n)]), len(ids) // 4, self.sequence, offset))
                doc[2], offset, left = done + n, offset + n, left - n
                if doc[2] * 4 == len(ids):
                    self.docs.popleft()
            self.sequence += 1
            at = cut
        keep = ends > at
        self.ends, self.penalties, self.held = [ends[keep] - at], [penalties[keep]], self.held - at
        return pieces


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    num_partitions: int | None = None,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece, in identifier order
    within a range.  ``sequence_id`` is the range's number times 2^32 plus a count.
    Null text counts as empty (a document of the end id alone); null identifiers
    come first; rows that repeat an identifier are packed one by one, ordered by
    text.  An empty table gives no pieces.  Other columns are ignored.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(vocabulary), struct.pack("<I", end_id)
        stops = np.zeros(max(encode.tokenizer.get_vocab_size(), end_id + 1), bool)
        for mark in ".!?":
            stops[np.frombuffer(encode(mark), "<u4")] = True
        packer = Packer(window, stops, TaskContext.get().partitionId() << 32)

        def frame(pieces: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(pieces, columns=columns)

        for pdf in batches:
            pieces = []
            for doc_id, text in zip(pdf["doc_id"], pdf["body"]):
                pieces += packer.add(doc_id, encode(text) + end)
            if pieces:
                yield frame(pieces)
        if pieces := packer.settle(True):
            yield frame(pieces)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), body(text_col).alias("body"))
    dealt = rows.repartitionByRange(num_partitions or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "body")
    out = dealt.mapInPandas(run, ", ".join(f"{c} long" for c in columns))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
