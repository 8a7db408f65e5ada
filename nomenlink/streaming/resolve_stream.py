"""Resolution of offers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nomenlink.operators import resolve as r
from nomenlink.operators.cache import cache_index, cache_lookup
from nomenlink.schemas import CACHE_SCHEMA, CONFIDENCE_CACHE, CONFIDENCE_NONE, EntityColumns
from nomenlink.session import materialise


def stream_cached(
    spark: SparkSession, schema: StructType, landing: str, columns: EntityColumns, cache: DataFrame
) -> DataFrame:
    """Arriving rows joined to the cache, as a plain stream-static join."""
    rows = spark.readStream.schema(schema).parquet(landing)
    looked_up = cache_lookup(r.queries_of(rows, columns), cache_index(cache).withColumnRenamed("siren", "_siren"))
    kept = [name for name in rows.columns if name != columns.siren_col]
    return looked_up.select(*kept, F.col("_siren").alias(columns.siren_col))


def _answers(target: str, batch_id: int) -> str:
    """Where a batch leaves its answers; readers of the target skip names with an underscore."""
    return f"{target}/_answers/through-{batch_id}"


def answers_before(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """Answers of all batches before ``batch_id``, in the form of a cache."""
    if batch_id == 0:
        return spark.createDataFrame([], CACHE_SCHEMA)
    # Batch numbers have no gaps, so no folder has to be listed.
    return spark.read.schema(CACHE_SCHEMA).parquet(*[_answers(target, number) for number in range(batch_id)])


def stream_resolve(
    spark: SparkSession,
    schema: StructType,
    landing: str,
    target: str,
    checkpoint: str,
    columns: EntityColumns,
    providers: list[r.Provider],
    cache: DataFrame | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Resolve each batch of arriving rows against cache, former answers and register.

    Ranking candidates needs whole batches, so the work is done per batch. What
    a batch finds by other means than the cache is stored under its number and
    looked up by all later ones, so an entity is compared with the register
    once. A retried batch sees the answers of earlier batches only and
    overwrites its own files.

    The cache is indexed once, when the stream starts, not by every batch; the
    rows of a batch are written once with their keys.
    """
    indexed = None if cache is None else materialise(cache_index(cache), "cache-index")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = cache_index(answers_before(spark, target, batch_id))
        if indexed is not None:
            # The highest identifier of a key wins, as in an index of all rows.
            known = known.unionByName(indexed).groupBy(*r.QUERY_KEY).agg(F.max("siren").alias("siren"))
        queries = materialise(r.queries_of(batch, columns), "batch-asked")
        known = materialise(known, "batch-known")
        answers = materialise(r.resolve(queries, providers, index=known), "batch-answers")
        kept = [*batch.columns, *([] if columns.siren_col in batch.columns else [columns.siren_col])]
        back = r.map_back(queries, answers, columns.siren_col)
        back.select(*kept).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        # Written last: a batch counts for later ones when it is complete.
        fresh = answers.where(~F.col("confidence").isin(CONFIDENCE_NONE, CONFIDENCE_CACHE))
        fresh = fresh.select("name", F.col("address_text").alias("address"), "siren")
        fresh.write.mode("overwrite").parquet(_answers(target, batch_id))

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
