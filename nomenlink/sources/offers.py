"""Offers, work lists and enriched offers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.schemas import ARTIFACT_COLUMNS, OFFER_COLUMNS
from nomenlink.sources.columns import choose_column, require_columns, text_partitions


def scan_offers(spark: SparkSession, root: str, columns: dict[str, str] = OFFER_COLUMNS) -> DataFrame:
    """Hive-partitioned offers, files unified by column name.

    ``columns`` maps the names in the files to those of this package; files
    that already use the latter are read as they are.
    """
    with text_partitions(spark):
        df = spark.read.option("mergeSchema", "true").option("basePath", root).parquet(root)
    for source, target in columns.items():
        spelled = choose_column(df.columns, [source])
        if spelled and target not in df.columns:
            df = df.withColumnRenamed(spelled, target)
    return require_columns(df, columns.values())


def drop_artifact_columns(df: DataFrame) -> DataFrame:
    return df.drop(*ARTIFACT_COLUMNS)


def scan_work_list(spark: SparkSession, paths_by_role: dict[str, str]) -> DataFrame:
    """One file of unresolved entities per role, with the role as a column."""
    parts = [spark.read.parquet(path).withColumn("role", F.lit(role)) for role, path in paths_by_role.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_enriched(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_all_string(df: DataFrame, path: str) -> None:
    """Every column as text; nulls stay null."""
    df.select([F.col(name).cast("string").alias(name) for name in df.columns]).write.mode("overwrite").parquet(path)
