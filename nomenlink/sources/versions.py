"""Tables that a run may read and replace: versions in folders, and the one that counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_CURRENT = StructType([StructField("version", LongType())])


def current_version(spark: SparkSession, root: str) -> int | None:
    """Number of the version published last; None if there is none."""
    try:
        return spark.read.schema(_CURRENT).parquet(f"{root}/current").agg(F.max("version").alias("v")).first()["v"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The version published last, or an empty table."""
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/versions/{version}")


def publish(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next version, then make it the one that counts.

    ``rows`` may be made from the current version, whose files stay. A run that
    stops before the end leaves the former version in place; the next one
    overwrites what it left. One writer at a time.
    """
    spark = rows.sparkSession
    former = current_version(spark, root)
    version = 0 if former is None else former + 1
    rows.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    spark.createDataFrame([(version,)], _CURRENT).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return version
