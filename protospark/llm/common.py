"""Session helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.session import cut

__all__ = ["batches", "cut", "held_out", "in_arrow", "table", "without"]


def batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 4 MB, so that long texts don't fill a Python worker; the same for every operator, as lazy plans read it later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def in_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)``; a task's Python worker, which Spark keeps for later tasks, gives back the memory that it no longer uses."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches_)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(col: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 on division by 5 (a null id counts as the text ``''``)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Ids that may be broadcast (a long each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``doc_id`` is in ``ids``; rows with a null id stay."""
    ids = cut(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)
