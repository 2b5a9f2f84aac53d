"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast; its caller counts it first.
BROADCAST_ROWS = 20_000


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so that added columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ready(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's folder; where none is named, one in the warehouse, which all machines share too."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to the shared checkpoint folder and survive lost executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table, marked for broadcast only where its counted rows allow it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which all machines share."""
    ready(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release() -> None:
    """At a task's end: its process stays for other tasks, and hands back to the system what the last one freed (where the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: The session's bound on the bytes of a batch that Spark hands to a Python worker, and the one that `bound_batches` sets.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Bounds batches of texts by bytes, not only by rows, unless the session has a bound of its own. Each process of a stage then holds a few MB of texts, however long they are."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, MOST_BYTES)


#: Texts whose results a task holds at once.
SLICE = 500


def slices(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch in small parts, so that what is made of it leaves a task part by part."""
    for begin in range(0, len(batch), SLICE):
        yield batch.iloc[begin : begin + SLICE]
