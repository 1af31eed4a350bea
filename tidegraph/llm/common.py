"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier where columns pass through Python, so that pandas keeps
#: them as 64-bit integers.
NULL_ID = -(2**63)
#: Rows handed to a Python worker at once where an operator asks for little, in bytes.
BATCH_BYTES = 8 * 2**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``).

    Where the session names none, a folder of this machine is made and set if Spark runs
    in this process alone (tests, notebooks), so that ``checkpoint()`` works there too;
    on a cluster that would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(remove, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    found = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, found)
    return found


def remove(folder: str) -> None:
    """Delete a folder, if it is there and in a store that can be reached."""
    try:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)
    except (OSError, ValueError):
        pass


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most BATCH_BYTES of rows at once: several operators' workers share an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(col: str | Column) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def sample_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashed identifiers; for training only.

    Identifiers are chosen first, so that no task hands texts to the driver that the
    sample will not hold.
    """
    chosen = df.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n)
    return df.join(F.broadcast(chosen), id_col, "left_semi").limit(n)


_kept: dict[tuple, object] = {}


def trim() -> None:
    """Give memory that is free back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def remembered(key: tuple, make: Callable[[], object] = lambda: None) -> object:
    """What ``make`` gives, kept by a worker until another key is asked for.

    Workers serve one operator after another; each releases what the one before held,
    so that their memories do not add up.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            trim()
        _kept[key] = make()
    return _kept[key]


def whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[k].to_numpy() for k in keys]
        edge = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = np.r_[0, np.flatnonzero(edge) + 1, len(pdf)]
        if held and any(held[-1][k].iloc[-1] != c[0] for k, c in zip(keys, columns)):
            yield pd.concat(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pd.concat([*held, pdf.iloc[a:b]]) if held else pdf.iloc[a:b]
            held = []
        held.append(pdf.iloc[cuts[-2] :])
    if held:
        yield pd.concat(held)


def same_length(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """The rows of a frame apart by the length of a column's values."""
    sizes = np.fromiter(map(len, pdf[column]), "i8", len(pdf))
    for n in np.unique(sizes):
        yield pdf[sizes == n] if (sizes != n).any() else pdf
