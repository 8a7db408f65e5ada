"""Suffix-array deduplication: bytes covered by a string that starts twice.

No suffix is sorted. The dealt radix sort is replaced by the anchored counting
of ``repeats``, shared with ``doubling_windows``: an anchor gram and its
surroundings are counted by hash first, then longer surroundings of what
repeats. A core that stands alone is dropped; those of the threshold's length
that repeat are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm import repeats
from nomenlink.llm.scratch import Scratch

THRESHOLD = 400


def byte_plan(threshold: int) -> repeats.Plan:
    """Passes for a threshold of at least 8 bytes."""
    gram = max(4, threshold * 2 // 25)
    first = max(1, (threshold - gram + 1) * 128 // 369)
    return repeats.Plan("bytes", threshold, gram, (first, max(1, first // 8)))


def _remove(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, runs in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer()
            sizes.append(data.size)
            if not runs.is_valid:
                spans.append([])
                kept.append(data.to_pybytes())
                continue
            low, high = (np.asarray(runs.values.field(name)).astype(np.int64) for name in ("low", "high"))
            array = np.frombuffer(data, dtype=np.uint8)
            gone = repeats.covered(len(array), threshold, low, high)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
            kept.append(array[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Each document without the bytes of strings that start twice in the corpus.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Returns ``doc_id``, ``n_bytes``, ``spans`` (removed runs, start and
    stop in bytes) and ``kept`` (binary, as a cut may split a character).

    Null texts count as empty; empty and shorter texts are kept as they are;
    a null ``doc_id`` stays null. Rows that repeat are all documents: each
    makes the other's windows repeated. Long texts are read whole. No rows
    give no rows.
    """
    scratch = Scratch(docs.sparkSession, "byte-repeats")
    kept = repeats.keyed(docs.select("doc_id", "text"))
    runs = repeats.repeated_starts(kept, byte_plan(threshold), scratch)
    joined = repeats.with_runs(kept, runs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    return joined.mapInArrow(lambda batches: _remove(batches, threshold), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that start twice, removed from all documents."""
    found = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
