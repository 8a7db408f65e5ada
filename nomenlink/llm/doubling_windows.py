"""Substring deduplication by levels: repeated windows of one length grow to twice it.

Level one counts sequences of a third of the window; only those found twice
are extended to twice that length, and only what is still repeated is extended
to the window itself. Sequences are taken around anchors (see ``repeats``), so
that a level handles all windows that share a sequence in one row, and a group
whose surroundings agree beyond the window is settled without further levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm import repeats, units
from nomenlink.llm.scratch import Scratch

WINDOW = 35


def word_plan(window: int) -> repeats.Plan:
    """Sequence lengths ``start``, ``2 * start`` and ``window``, the last at most twice the one before."""
    start = -(-window // 4) if window < 12 else -(-window // 3)
    return repeats.Plan("words", window, start, (window - start + 1, max(1, window - 2 * start + 1)))


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept"]
    for batch in batches:
        counts, removed, kept = [], [], []
        for begin, data, bounds in units.blocks(batch.column(1)):
            starts, ends, _, rows = units.words(data, bounds)
            for row in range(len(bounds) - 1):
                first, last = rows[row], rows[row + 1]
                count = int(last - first)
                runs = batch.column(2)[begin + row]
                gone = np.zeros(count, dtype=bool)
                if runs.is_valid:
                    low, high = (np.asarray(runs.values.field(name)).astype(np.int64) for name in ("low", "high"))
                    gone = repeats.covered(count, window, low, high)
                counts.append(count)
                removed.append(int(gone.sum()))
                kept.append(_joined(data, starts[first:last][~gone], ends[first:last][~gone]))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, one space between them."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    out = np.full(int(sizes.sum()) - 1, 32, dtype=np.uint8)
    places = np.cumsum(sizes) - sizes
    steps = np.arange(len(out) + 1) - np.repeat(places, sizes)
    inside = (steps < np.repeat(sizes - 1, sizes))[:-1]
    source = np.repeat(starts, sizes)[:-1] + steps[:-1]
    out[inside] = data[source[inside]]
    return out.tobytes()


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document without the words of windows that start twice in the corpus.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the
    words left, one space between them).

    Null texts have no words; texts shorter than the window are kept; a null
    ``doc_id`` stays null. Rows that repeat are all documents: each makes the
    other's windows repeated. Long texts are read whole. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "word-repeats")
    kept = repeats.keyed(docs.select("doc_id", "text"))
    runs = repeats.repeated_starts(kept, word_plan(window), scratch)
    joined = repeats.with_runs(kept, runs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return joined.mapInArrow(lambda batches: _remove(batches, window), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that start twice, removed from all documents."""
    found = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
