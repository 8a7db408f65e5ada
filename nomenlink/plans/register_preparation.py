"""From a raw bulk register to the partitioned one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nomenlink.sources.columns import text_partitions
from nomenlink.sources.register import (
    clean_bulk_register,
    register_search,
    scan_register,
    write_register_partitioned,
)


def prepare_register(
    spark: SparkSession, source: str, target: str, check_department: str = "75", check_text: str = "Paris"
) -> DataFrame:
    """Clean and write the register; returns the rows of a trial search."""
    with text_partitions(spark):
        raw = spark.read.parquet(source)
    write_register_partitioned(clean_bulk_register(raw), target)
    return register_search(scan_register(spark, target), check_department, check_text)
