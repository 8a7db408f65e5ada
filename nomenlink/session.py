"""Session helpers: settings the jobs expect and the shared scratch folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def build_session(app_name: str = "nomenlink", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    On a cluster leave ``master`` unset and pass cluster settings through
    ``spark-submit``; only engine-neutral options are set here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Codes such as "01" or "2A" are text, also when they name a partition.
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local master with the setting unset falls back to a fresh temporary
    folder; on a cluster the setting is required, because a folder of one
    machine is lost to all others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(app_id: str) -> str:
    """One folder per local session."""
    return tempfile.mkdtemp(prefix=f"nomenlink-{app_id}-")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and lets several downstream jobs reuse the rows; unlike a
    local checkpoint the files survive the loss of an executor. Columns without
    a type, which files cannot hold, are null again when read.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    untyped = [field.name for field in df.schema if isinstance(field.dataType, NullType)]
    stored = df.drop(*untyped)
    stored.write.parquet(path)
    read = spark.read.schema(stored.schema).parquet(path)
    return read.withColumns({name: F.lit(None) for name in untyped}).select(*df.columns) if untyped else read


def ship_package(spark) -> None:
    """Send this package to the executors, once per session.

    Workers import the functions of Python stages by name; without this they
    need the package on their own path (``--py-files``).
    """
    _ship(spark.sparkContext, spark.sparkContext.applicationId)


@cache
def _ship(context, app_id: str) -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="nomenlink-package-"), "nomenlink.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
