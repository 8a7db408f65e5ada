"""Caches, pair files, review files and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import safe_text
from nomenlink.schemas import CACHE_SCHEMA

# A file with line breaks inside values is read by one task, so files are kept short.
ROWS_PER_CSV_FILE = 250_000

# --- fixed values: renamed and defaulted columns of a reviewed pair file
GOLD_RENAMES = {"candidate_name": "known_entreprise_nom", "candidate_siren": "target_siren"}
GOLD_DEFAULTS = {
    "missing_location_label": None,
    "known_location_label": None,
    "city_key": None,
    "zipcode_norm": None,
    "dept_norm": None,
    "n_known_rows": 1,
    "nom_key": None,
}


def scan_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, or an empty one when there is no file yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    writer.option("maxRecordsPerFile", ROWS_PER_CSV_FILE).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so that a decision ``1`` stays ``1``."""
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def load_gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed pairs from Parquet or CSV, completed to the pair columns."""
    gold = read_csv(spark, path) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
    gold = gold.withColumnsRenamed(GOLD_RENAMES)
    keyed = "nom_key" in gold.columns
    for name, default in GOLD_DEFAULTS.items():
        if name not in gold.columns:
            kind = "string" if default is None else "long"
            gold = gold.withColumn(name, F.lit(default).cast(kind))
    # Without the column nothing is counted, so the files are read once.
    any_key = gold.agg(F.count("nom_key")).scalar() if keyed else F.lit(0)
    from_name = F.lower(safe_text(F.col("missing_entreprise_nom")))
    return gold.withColumns(
        {
            "nom_key": F.when(any_key == 0, from_name).otherwise(F.col("nom_key")),
            "n_known_rows": F.col("n_known_rows").cast("long"),
            "label": F.col("label").cast("int"),
        }
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    summary.coalesce(1).write.mode("overwrite").json(path)
