"""Landed register pages to a partitioned register, page by page.

The checkpoint of the stream takes the place of a page cursor: a page is
consumed once, and a batch that fails is written again under its own number.

Each batch writes one run of rows, the newest of each establishment. Runs are
merged by powers of ``FANOUT``: when that many runs of a level are full, one
run of the next level replaces them. A batch costs the same however many came
before, each row is merged once per level, and a reader finds few runs. Batch
numbers have no gaps, so the number of the last batch says which runs count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nomenlink.schemas import REGISTER_PAGE_SCHEMA, REGISTER_SCHEMA, UNKNOWN_DEPARTMENT
from nomenlink.sources.columns import text_partitions
from nomenlink.sources.register import REGISTER_COLUMNS, flatten_pages

FANOUT = 8

_PROGRESS = "progress"
_LANDED = "_landed"
_STORED = T.StructType([*REGISTER_SCHEMA.fields, T.StructField("batch_id", T.LongType())])


def _run(target: str, level: int, last: int, fanout: int) -> str:
    """Folder of the run of ``fanout ** level`` batches that ends with ``last``."""
    return f"{target}/rows/fanout-{fanout}/level-{level}/through-{last}"


def current_runs(target: str, last: int, fanout: int = FANOUT) -> list[str]:
    """Folders that together hold the batches 0 to ``last``, each batch in one of them."""
    runs, start = [], 0
    while start <= last:
        level = 0
        while start % fanout ** (level + 1) == 0 and start + fanout ** (level + 1) - 1 <= last:
            level += 1
        start += fanout**level
        runs.append(_run(target, level, start - 1, fanout))
    return runs


def _read_runs(spark: SparkSession, runs: list[str]) -> DataFrame:
    """Rows of a few runs; each is a table of department folders."""
    with text_partitions(spark):
        read = [spark.read.schema(_STORED).parquet(run).select(*REGISTER_COLUMNS, "batch_id") for run in runs]
    return reduce(DataFrame.unionByName, read)


def _newest(rows: DataFrame, *order: str) -> DataFrame:
    """One row per establishment: the last in the given order."""
    others = [c for c in rows.columns if c not in ("siret", *order)]
    best = rows.groupBy("siret").agg(F.max(F.struct(*order, *others)).alias("r"))
    return best.select("siret", *[f"r.{c}" for c in (*order, *others)])


def _write_run(rows: DataFrame, path: str) -> None:
    stored = rows.select(*REGISTER_COLUMNS, "batch_id").hint("rebalance", F.col("code_departement"))
    stored.write.mode("overwrite").partitionBy("code_departement").parquet(path)


def read_streamed_register(spark: SparkSession, target: str, fanout: int = FANOUT) -> DataFrame:
    """The register as the stream has seen it last: of each establishment the newest version.

    A correction or a move to another department replaces the former row.
    """
    last = _progress(spark, target).agg(F.max("batch_index").alias("last")).first()["last"]
    return _newest(_read_runs(spark, current_runs(target, last, fanout)), "batch_id").select(*REGISTER_COLUMNS)


def _write_batch(target: str, fanout: int):
    def write(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        # Among versions of one batch the page landed last wins, in a file the later line.
        landed = pages.withColumn(_LANDED, F.struct(_LANDED, F.monotonically_increasing_id().alias("line")))
        found = flatten_pages(landed, _LANDED).fillna({"code_departement": UNKNOWN_DEPARTMENT})
        rows = _newest(found, _LANDED).withColumn("batch_id", F.lit(batch_id).cast("long"))
        _write_run(rows, _run(target, 0, batch_id, fanout))
        level = 0
        while (batch_id + 1) % fanout ** (level + 1) == 0:
            full = [_run(target, level, batch_id - i * fanout**level, fanout) for i in range(fanout)]
            _write_run(_newest(_read_runs(spark, full), "batch_id"), _run(target, level + 1, batch_id, fanout))
            level += 1
        # Written last: a batch without progress does not count.
        pages.agg(
            F.coalesce(F.sum(F.size("etablissements")).cast("long"), F.lit(0).cast("long")).alias("fetched"),
            F.max("header.total").alias("expected"),
            F.count(F.lit(1)).alias("pages"),
        ).write.mode("overwrite").parquet(f"{target}/{_PROGRESS}/batch_id={batch_id}")

    return write


def stream_register(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    pages_per_batch: int | None = None,
    fanout: int = FANOUT,
) -> StreamingQuery:
    """Consume all landed pages and stop; start it again for later pages.

    ``fanout`` is the number of runs that are merged into one; it must stay the
    same for a target.
    """
    reader = spark.readStream.schema(REGISTER_PAGE_SCHEMA)
    if pages_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", pages_per_batch)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return (
        reader.json(landing)
        .withColumn(_LANDED, place)
        .writeStream.foreachBatch(_write_batch(target, fanout))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _progress(spark: SparkSession, target: str) -> DataFrame:
    with text_partitions(spark):
        steps = spark.read.option("basePath", f"{target}/{_PROGRESS}").parquet(f"{target}/{_PROGRESS}")
    return steps.select(F.col("batch_id").cast("long").alias("batch_index"), "fetched", "expected")


def stream_progress(spark: SparkSession, target: str) -> DataFrame:
    """Establishments fetched so far after each batch, and the expected total."""
    # One row per batch: a running total over few rows.
    so_far = Window.orderBy("batch_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _progress(spark, target).select(
        "batch_index",
        F.sum("fetched").over(so_far).alias("total_fetched"),
        F.max("expected").over(so_far).alias("total_expected"),
    )
