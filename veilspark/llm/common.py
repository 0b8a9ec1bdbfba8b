"""Shared plumbing: written intermediate tables, table access, Arrow batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove_folder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode, where all share one machine, a temporary folder is made where none is set; on a
    cluster that is an error, as executors would write to disks of their own.
    """
    return shared_folder(spark)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4194304") -> None:
    """Arrow batches end at 4 MB unless the session says otherwise: row counts alone do not bound long texts."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "", str(2**31 - 1), str(2**63 - 1), "-1"):
        spark.conf.set(BATCH_BYTES, size)


class Stages:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs at most the stage that was running, since everything earlier is read
    back from shared storage.  ``drop`` removes tables that nothing reads any more; what a lazy
    result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark, self.names = spark, set()
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))

    def _end(self) -> None:
        with contextlib.suppress(Exception):
            remove_folder(self.spark, self.root)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so columns of any other name can neither clash nor be read."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Hands memory that a finished task freed back to the system, as an idle worker keeps it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches never reach it."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        release()

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, columns: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [more])


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
