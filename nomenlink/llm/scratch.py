"""Tables of one run, written to the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nomenlink.session import run_dir


class Scratch:
    """Writes intermediate tables and removes those no longer needed.

    A table cuts the lineage: after the loss of an executor only the tasks of
    the current step are run again. Tables that feed the returned frame stay
    until the folder is cleared by whoever owns it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = run_dir(spark, label)
        self.names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and read it back."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables and let Spark clear the shuffles of finished steps."""
        jvm = self.spark._jvm
        for name in names:
            self.names.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()

    def keep_only(self, *names: str) -> None:
        self.drop(*[name for name in self.names if name not in names])


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that returns its memory to the system when it ends.

    Python workers are used again by later tasks and stages; what their
    allocators keep would add up over the stages of a pipeline.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task
