"""Helpers that the training-data operators share: tables, written intermediates, text defaults."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, as in tests, all in one
    process, a folder of that machine; on a cluster ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share; intermediate tables go there")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="pathwise-"))
        path = _OWN[0]
    return path.rstrip("/")


#: The folder of this process where spark.checkpoint.dir is unset.
_OWN: list[str] = []
#: Paths of the tables that `written` made and nobody has deleted.
_LEFT: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: lineage ends there and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _LEFT.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _LEFT:
        _LEFT.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no DataFrame in use reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def left_tables() -> list[str]:
    """Paths of the tables that `written` made and nobody has deleted."""
    return list(_LEFT)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables by path: for callers that have stored what they wanted of an operator's result."""
    for path in paths:
        _delete(spark, path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from stage to stage, and what one stage had at its peak
    would add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into at most `rows` rows, so that a Python worker holds few texts and results at a time."""
    try:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)
    finally:
        give_back()
