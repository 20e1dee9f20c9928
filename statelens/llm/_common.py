"""Shared folders, table access and small Arrow helpers of the llm operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of an Arrow batch (one row at least) between an executor and its Python workers, in sessions that set no other number.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes; a worker gives back what it has freed when a task ends.

    Batches bound the memory outside an executor's heap as well as the worker's: Arrow's buffers
    on both sides and the Python objects made of them.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _default(df.sparkSession):
        conf.set(_BATCH, str(BATCH_BYTES))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(held, schema)


def _default(spark: SparkSession) -> str:
    """The batch setting of a session that sets none."""
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_BATCH)


def release() -> None:
    """Free memory of this worker back to the system: a worker lives on, and its executor's memory counts it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc: its allocator decides
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster its lack is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statelens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/statelens/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", compression)
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    if df is not None and hasattr(df, "saved_at"):
        delete(df.sparkSession, df.saved_at)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else: lower() where the string is ASCII, else a character map."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fold of a labelled row."""
    return F.crc32(c.cast("string").cast("binary")) % m


def fold_of(doc_id, m: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % m


def longs(col) -> np.ndarray:
    """An Arrow column of longs as numpy, nulls as 0."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts, from batches sorted by keys (longs)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool):
        nonlocal held, size
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(len(t), dtype=bool)
        new[:1] = True
        for k in keys:
            v = longs(t[k])
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if last:
            held, size = [], 0
            return t, starts
        end = int(starts[-1])
        rest = t.slice(end)
        held, size = rest.combine_chunks().to_batches(), len(rest)
        return (t.slice(0, end), starts[:-1]) if end else None

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
            if size >= most:
                got = cut(False)
                if got:
                    yield got
                most = max(most, size + (1 << 15))
    if held:
        yield cut(True)
