"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few ids, and bytes of their strings, that a lookup may broadcast; more are joined by shuffle.
LOOKUP_ROWS, LOOKUP_BYTES = 500_000, 32 << 20


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in :func:`shared_folder`."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small(kept: DataFrame, rows: int = LOOKUP_ROWS, size: int = LOOKUP_BYTES) -> DataFrame:
    """A written or checkpointed table, measured: broadcast if it has few rows and bytes, and else as it is."""
    strings = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in kept.schema if f.dataType.simpleString() in ("string", "binary")]
    n, *held = kept.agg(F.count("*"), *strings).first()
    return F.broadcast(kept) if n <= rows and sum(held) <= size else kept


def lookup(df: DataFrame) -> DataFrame:
    """A table of ids, checkpointed: broadcast if it is small, so that what is looked up need not be
    shuffled, and else joined by shuffle."""
    return small(keep(df))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)
    trim()


def trim() -> None:
    """Give memory that is free back to the system: workers live on between tasks and operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where none is set and all of Spark runs in one process is it a folder of this machine;
    a cluster without the setting is an error, because its executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="leafwire-")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
