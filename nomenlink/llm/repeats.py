"""Windows of a fixed number of units (bytes or words) that start in two places.

Every window start is a suffix of its text, to be compared through ``window``
units only. Writing all of them out would multiply the input; instead:

* A window's anchor is the leftmost least hash among its grams. Equal windows
  have equal anchors at equal offsets, so window starts are handled in runs:
  a cell is a run of starts whose offsets to the anchor lie in one slot of a
  fixed grid. What all windows of a cell share is its core, what any of them
  covers is its full span.
* A level counts cells by core and by full span. A core found once holds no
  repeated window; a full span found twice holds nothing but repeated ones.
  Only the rest is cut into smaller cells, down to single windows. Of each
  full span that is decided while others with its core are not, one cell goes
  on as a witness, so that later levels still see it.

All counting is grouped with partial sums, and rows learn their counts by
joins of written tables, which Spark can split when a key is hot. Nothing is
gathered per key. Hashes are 64 bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.llm import units
from nomenlink.llm.scratch import Scratch

_SECTION = 1 << 21
_PLACE_BITS = 23
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_CELL = "doc_key long, text_key long, anchor int, low int, high int, core long, whole long"


@dataclass(frozen=True)
class Plan:
    """``kind`` is bytes or words; ``cells`` are the numbers of starts in a cell, per level."""

    kind: str
    window: int
    gram: int
    cells: tuple[int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_key`` and ``text_key`` name a row: equal keys mean equal id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"text": text, "doc_key": F.coalesce("doc_id", F.lit(-1)).cast("long"), "text_key": F.xxhash64(text)}
    )


def _values(kind: str, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if kind == "bytes":
        return units.byte_values(data), bounds
    _, _, hashes, rows = units.words(data, bounds)
    return hashes, rows


def _anchors(prefix: np.ndarray, plan: Plan) -> np.ndarray:
    """Place of the anchor of each window start, ends of texts ignored."""
    reach = plan.window - plan.gram + 1
    found = []
    for begin in range(0, len(prefix) - plan.window, _SECTION):
        stop = min(begin + _SECTION, len(prefix) - plan.window)
        grams = units.gram_hash(prefix, plan.gram, begin, stop + reach - 1)
        best = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= reach:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if reach > size:
            best = np.minimum(best[: len(best) - (reach - size)], best[reach - size :])
        found.append((best & _PLACE).astype(np.int64)[: stop - begin] + begin)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _runs(prefix: np.ndarray, bounds: np.ndarray, plan: Plan):
    """Runs of window starts with one anchor: row, anchor, first start, last start."""
    if len(prefix) <= plan.window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    anchors = _anchors(prefix, plan)
    starts = np.arange(len(anchors))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(starts)]
    fits = bounds[rows + 1] - starts >= plan.window
    starts, anchors, rows = starts[fits], anchors[fits], rows[fits]
    if not len(starts):
        return rows, anchors, starts, starts
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:] - 1, len(starts) - 1)
    return rows[first], anchors[first], starts[first], starts[last]


def _cut(rows, anchors, lows, highs, prefix, bounds, plan: Plan, size: int):
    """Cells of ``size`` starts: row, anchor, low, high, core, whole, whole known."""
    slot_low, slot_high = (anchors - highs) // size, (anchors - lows) // size
    counts = slot_high - slot_low + 1
    of = np.repeat(np.arange(len(rows)), counts)
    slot = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + slot_low[of]
    rows, anchors = rows[of], anchors[of]
    last = anchors - slot * size
    first = last - size + 1
    low, high = np.maximum(first, lows[of]), np.minimum(last, highs[of])
    salt = (slot * 4096 + size).astype(np.uint64)
    core = units.mix(units.span_hash(prefix, last, first + plan.window) + salt)
    known = (first >= bounds[rows]) & (last + plan.window <= bounds[rows + 1])
    whole = np.zeros(len(rows), dtype=np.uint64)
    whole[known] = units.mix(units.span_hash(prefix, first[known], last[known] + plan.window) + salt[known])
    return rows, anchors, low, high, core, whole, known


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _first_cells(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_key, text_key = (np.asarray(batch.column(k)) for k in (0, 1))
        for begin, data, bounds in units.blocks(batch.column(2)):
            values, bounds = _values(plan.kind, data, bounds)
            prefix = units.prefix_hash(values)
            rows, anchors, low, high, core, whole, known = _cut(
                *_runs(prefix, bounds, plan), prefix, bounds, plan, plan.cells[0]
            )
            base = bounds[rows]
            columns = [
                _long(doc_key[begin + rows]), _long(text_key[begin + rows]), _int(anchors - base), _int(low - base),
                _int(high - base), _long(core), pa.array(whole.view(np.int64), mask=~known),
            ]
            names = ["doc_key", "text_key", "anchor", "low", "high", "core", "whole"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _next_cells(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Smaller cells of the open ones, each with the hashes of its windows."""
    names = ["doc_key", "text_key", "anchor", "low", "high", "core", "whole", "windows"]
    for batch in batches:
        doc_key, text_key = (np.asarray(batch.column(k)) for k in (0, 1))
        lists = batch.column(2)
        ends = np.asarray(lists.offsets).astype(np.int64)
        parts = lists.values
        anchor, low, high = (np.asarray(parts.field(name)).astype(np.int64) for name in ("anchor", "low", "high"))
        for begin, data, bounds in units.blocks(batch.column(3)):
            values, bounds = _values(plan.kind, data, bounds)
            prefix = units.prefix_hash(values)
            held = ends[begin : begin + len(bounds)]
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(held))
            mine, base = slice(held[0], held[-1]), bounds[rows]
            rows, anchors, lows, highs, core, whole, known = _cut(
                rows, anchor[mine] + base, low[mine] + base, high[mine] + base, prefix, bounds, plan, plan.cells[1]
            )
            counts = highs - lows + 1
            of = np.repeat(np.arange(len(rows)), counts)
            start = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + lows[of]
            offset = (anchors[of] - start).astype(np.uint64)
            windows = units.mix(units.span_hash(prefix, start, start + plan.window) + offset * np.uint64(4096))
            base = bounds[rows]
            columns = [
                _long(doc_key[begin + rows]), _long(text_key[begin + rows]), _int(anchors - base), _int(lows - base),
                _int(highs - base), _long(core), pa.array(whole.view(np.int64), mask=~known),
                pa.ListArray.from_arrays(_int(np.append(0, np.cumsum(counts))), _long(windows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _judged(scratch: Scratch, cells: DataFrame, name: str) -> DataFrame:
    """Cells with a repeated core: ``done`` if repeated as a whole, ``open`` if to be cut.

    A witness is both. ``cells`` must be a written table.
    """
    me = F.xxhash64("doc_key", "text_key", "anchor", "low")
    cells = cells.withColumn("me", me).withColumn("variant", F.coalesce("whole", "me")).drop("whole")
    variants = scratch.keep(
        cells.groupBy("core", "variant").agg(F.count(F.lit(1)).alias("n"), F.min("me").alias("witness")),
        f"{name}-variants",
    )
    # A core with a single variant needs no further level, however many cells it has.
    cores = variants.groupBy("core").agg(
        F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("int")).alias("single")
    )
    cores = scratch.keep(cores.where("total > 1"), f"{name}-cores")
    known = scratch.keep(variants.join(cores, "core"), f"{name}-known")
    scratch.drop(f"{name}-variants", f"{name}-cores")
    judged = cells.join(known, ["core", "variant"]).withColumns(
        {"done": F.col("n") > 1, "open": (F.col("n") == 1) | ((F.col("single") > 0) & (F.col("me") == F.col("witness")))}
    )
    return judged.drop("core", "variant", "me", "n", "witness", "total", "single")


def repeated_starts(docs: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Runs of window starts (``low`` to ``high``, in units) that are repeated, by row key.

    ``docs`` comes from ``keyed``. A window of one row of several with equal
    id and text counts as often as the row does.
    """
    source = docs.select("doc_key", "text_key", "text")
    first = scratch.keep(source.mapInArrow(lambda batches: _first_cells(batches, plan), _CELL), "cells")
    judged = scratch.keep(_judged(scratch, first, "one"), "judged")
    scratch.drop("cells", "one-known")

    part = F.collect_set(F.struct("anchor", "low", "high")).alias("parts")
    open_cells = judged.where("open").groupBy("doc_key", "text_key").agg(part)
    joined = source.join(open_cells, ["doc_key", "text_key"]).select("doc_key", "text_key", "parts", "text")
    # Equal rows must all be counted, as they were on the first level.
    second = scratch.keep(
        joined.mapInArrow(lambda batches: _next_cells(batches, plan), _CELL + ", windows array<long>"), "parts"
    )
    finer = scratch.keep(_judged(scratch, second, "two"), "finer")
    scratch.drop("parts", "two-known")

    single = finer.where("open").select("doc_key", "text_key", F.posexplode("windows").alias("step", "window"), "low")
    single = scratch.keep(single.withColumn("low", F.col("low") + F.col("step")).drop("step"), "single")
    twice = single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    twice = scratch.keep(twice, "twice")
    last = single.join(twice, "window", "left_semi")

    where = ["doc_key", "text_key", "low"]
    runs = judged.where("done").select(*where, "high").unionByName(finer.where("done").select(*where, "high"))
    return runs.unionByName(last.select(*where, F.col("low").alias("high")))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with the array ``runs`` of its repeated window starts, null if there are none."""
    gathered = runs.groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    return docs.join(gathered, ["doc_key", "text_key"], "left")


def covered(count: int, window: int, lows, highs) -> np.ndarray:
    """Which of ``count`` units lie in a window that starts in one of the runs."""
    steps = np.zeros(count + 1, dtype=np.int64)
    np.add.at(steps, lows, 1)
    np.add.at(steps, np.asarray(highs) + window, -1)
    return np.cumsum(steps[:-1]) > 0
