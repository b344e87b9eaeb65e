"""What the operators of this subpackage share: scratch tables in the cluster's shared
folder, and Arrow helpers that keep the memory of a Python worker bounded."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{os.path.join(tempfile.gettempdir(), 'gleaner-checkpoints')}"
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: the lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a frame from written() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch", None)
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Gives back what finished jobs hold: the driver's heap and Arrow memory, and shuffle files and broadcasts that nothing refers to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the bytes of a column reach the limit; one row at least in each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def whole_groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Sorted rows of a partition in tables that end where a group ends, whatever the batches' edges."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in by], axis=1)
        other = np.flatnonzero(np.any(key != key[-1], axis=1))
        k = int(other[-1]) + 1 if len(other) else 0
        if k:
            yield pa.Table.from_batches([*held, b.slice(0, k)])
            held.clear()
        held.append(b.slice(k))
    if held:
        yield pa.Table.from_batches(held)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and where each row starts (one more at the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: a column-pruned aggregate, from which partition counts follow."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def blocks_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
