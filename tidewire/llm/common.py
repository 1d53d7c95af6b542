"""What the corpus operators share: reading tables, cutting lineage, dealing text out in bounded chunks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python: with Spark's usual 10,000 rows a batch, buffers outside the heap grow to hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without spark.checkpoint.dir (a test) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidewire-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later reads neither repeat the work nor depend on an executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """The rows of a table that grows from round to round, these included, and its path: its plan stays one scan."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/tidewire/{uuid.uuid4().hex}"
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(rows: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    spark = rows.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(rows: DataFrame, most: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """A hint for tables with as many rows as these (slim ones): broadcast if counted to be few, else left to a shuffle."""
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda df: df


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def released(run: Callable) -> Callable:
    """The same function of batches, after which a worker gives the memory back that it no longer needs: workers stay, and with them what they hold."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return whole


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows that hold about size bytes of a binary column; a longer row is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(offsets(batch.column(batch.schema.get_field_index(column))))
        cut, held = [0], 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                cut.append(i)
                held = 0
            held += n
        cut.append(batch.num_rows)
        for a, b in zip(cut, cut[1:]):
            yield batch.slice(a, b - a)


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets of the values of a binary or string array in its data buffer."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
