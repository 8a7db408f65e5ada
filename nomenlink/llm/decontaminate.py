"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

The words of the test items are counted over the whole corpus. A similar copy
misses a bounded number of an item's words, so of that number and ``SEED_HITS``
more places at least ``SEED_HITS`` are matched: the places of the rarest words
are the seeds. A text with so many seeds of an item is aligned with it by words
as far around them as an alignment can reach. It allows changed, missing and
added words, so edited copies are found as well, in a corpus of any size.

The items are the stated queries: they are taken in blocks of bounded size,
and each block is compared with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm import units
from nomenlink.llm.scratch import Scratch, giving_back

SIMILARITY = 0.8
# Matched seeds that a copy must show, fewer for items of fewer words.
SEED_HITS = 3
# An alignment with n matched words has fewer than 2 n added ones, as a match
# scores 2 and an added word costs 1.
REACH = 3
# Characters of items per block; a block is what a task holds.
BLOCK_CHARS = 16_000_000
# Aligned at once: cells of the score matrix.
_CELLS = 1 << 20
_SCORE = 1 << 20  # above the count of matched words in a cell


def _letters() -> np.ndarray:
    """Bytes of words: letters, digits, and all beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


_WORD = _letters()


def _plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words without the signs around them, bounds of the rows, byte starts."""
    spaced = np.where(_WORD[data], data, np.uint8(32))
    starts, _, hashes, rows = units.words(spaced, bounds, lower=True)
    return hashes, rows, starts


def _needed(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Least matched words of items of so many words, one at least."""
    return np.maximum(1, np.ceil(similarity * sizes - 1e-9)).astype(np.int64)


@dataclass
class _Items:
    """A block of items: their words, and their seeds sorted by hash."""

    ids: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_place: np.ndarray
    hits: np.ndarray  # seeds that a text must show, by item

    @staticmethod
    def read(ids: list[int], texts: list[str]) -> _Items:
        column = pa.array(texts, pa.large_string())
        (_, data, bounds), *_ = units.blocks(column, limit=1 << 62)
        hashes, rows, _ = _plain_words(data, bounds)
        item = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        place = np.arange(len(hashes)) - rows[:-1][item]
        order = np.argsort(hashes, kind="stable")
        return _Items(
            np.array(ids), hashes, rows, hashes[order], item[order], place[order], np.ones(len(rows) - 1, np.int64)
        )

    def rare(self, counts: dict[int, int], similarity: float) -> _Items:
        """Only the seeds of the rarest words, as many as a copy can miss and the hits it must show.

        Rarity is judged within the item, so that one leaked a million times
        keeps its seeds; their number depends on the item's words alone.
        """
        count = np.array([counts.get(int(x), 0) for x in self.seeds.view(np.int64)], dtype=np.int64)
        sizes = np.diff(self.rows)
        needed = _needed(sizes, similarity)
        hits = np.minimum(SEED_HITS, needed)
        order = np.lexsort((self.seed_place, count, self.seed_item))
        rank = np.arange(len(order)) - self.rows[:-1][self.seed_item[order]]
        chosen = rank < (sizes - needed + hits)[self.seed_item[order]]
        keep = np.sort(order[chosen])
        return _Items(
            self.ids, self.hashes, self.rows, self.seeds[keep], self.seed_item[keep], self.seed_place[keep], hits
        )

    def matches(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word that is a seed, with the number of the seed."""
        low = np.searchsorted(self.seeds, hashes, side="left")
        some = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == hashes)
        low = low[some]
        times = np.searchsorted(self.seeds, hashes[some], side="right") - low
        which = np.repeat(np.arange(len(some)), times)
        return some[which], np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]


def _count(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[pa.RecordBatch]:
    known = np.unique(items.seeds)
    counts = np.zeros(len(known), dtype=np.int64)
    for batch in batches:
        for _, data, bounds in units.blocks(batch.column(1)):
            hashes = _plain_words(data, bounds)[0]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            counts += np.bincount(at[known[at] == hashes], minlength=len(known))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some])], names=["seed", "n"])


def align(queries: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman by words, for a batch of pairs of padded rows.

    A match scores 2, a changed, missing or added word costs 1. Returns the
    matched words of the best local alignment and where it ends in the text.
    Pads must differ between both sides. The score and the matched words share
    a number, so the best score with most matches is found at once.
    """
    number, width = texts.shape
    gap = np.int64(_SCORE)
    slope = np.arange(width, dtype=np.int64) * gap
    above = np.zeros((number, width), dtype=np.int64)
    best, place = np.zeros(number, np.int64), np.zeros(number, np.int64)
    for row in range(int(lengths.max(initial=0))):
        same = texts == queries[:, row][:, None]
        before = np.zeros_like(above)
        before[:, 1:] = above[:, :-1]
        cell = np.maximum(np.where(same, before + 2 * gap + 1, before - gap), above - gap)
        cell = np.maximum(np.maximum.accumulate(np.maximum(cell, 0) + slope, axis=1) - slope, 0)
        cell[cell < gap] = 0
        spot = cell.argmax(axis=1)
        top = cell[np.arange(number), spot]
        better = top > best
        best, place = np.where(better, top, best), np.where(better, spot, place)
        above = cell
    return best % gap, place


def _padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pad: int, backward: bool = False) -> np.ndarray:
    width = max(1, int(sizes.max(initial=0)))
    step = np.arange(width)
    inside = step < sizes[:, None]
    index = starts[:, None] + (sizes[:, None] - 1 - step if backward else step)
    return np.where(inside, values[np.where(inside, index, 0)], np.uint64(pad))


def _aligned(items: _Items, item: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: float):
    """Pairs that are similar enough: which, matched words, first and last word of the text.

    Where the best alignment of a text is not similar enough, the words before
    and after it are aligned on their own.
    """
    sizes = np.diff(items.rows)[item]
    starts = items.rows[:-1][item]
    needed = _needed(sizes, similarity)
    found = []
    left = np.arange(len(item)), low, high
    while len(left[0]):
        pair, low, high = left
        order = np.argsort(high - low, kind="stable")
        rest = []
        begin = 0
        while begin < len(order):
            many = max(1, _CELLS // max(1, int((high - low)[order[begin]])))
            widest = int((high - low)[order[begin : begin + many][-1]])
            part = order[begin : begin + max(1, _CELLS // max(1, widest))]
            begin += len(part)
            part, first, end = pair[part], low[part], high[part]
            texts = _padded(hashes, first, end - first, 1)
            matched, last = align(_padded(items.hashes, starts[part], sizes[part], 2), sizes[part], texts)
            some = matched > 0
            part, matched, last, first, end = part[some], matched[some], last[some], first[some], end[some]
            if not len(part):
                continue
            # The same alignment from its end back finds where it starts.
            size = last + 1
            texts = _padded(hashes, first, size, 1, backward=True)
            _, back = align(_padded(items.hashes, starts[part], sizes[part], 2, backward=True), sizes[part], texts)
            start, last = first + size - 1 - back, first + last
            good = matched >= needed[part]
            found.append((part[good], matched[good], start[good], last[good]))
            for here, there in ((first, start), (last + 1, end)):
                again = ~good & (there - here >= needed[part])
                rest.append((part[again], here[again], there[again]))
        left = tuple(np.concatenate(x) for x in zip(*rest, strict=True)) if rest else (np.zeros(0, np.int64),) * 3
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_LEAK = "doc_id long, item_id long, matched long, item_words long, start long, stop long"


def _leaks(batches: Iterator[pa.RecordBatch], items: _Items, similarity: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "matched", "item_words", "start", "stop"]
    sizes = np.diff(items.rows)
    for batch in batches:
        for begin, data, bounds in units.blocks(batch.column(1)):
            hashes, rows, _ = _plain_words(data, bounds)
            at, seed = items.matches(hashes)
            if not len(at):
                continue
            doc = np.searchsorted(rows, at, side="right") - 1
            item, place = items.seed_item[seed], items.seed_place[seed]
            order = np.lexsort((at, item, doc))
            doc, item, place, at = doc[order], item[order], place[order], at[order]
            reach = REACH * sizes[item]
            fresh = np.ones(len(doc), dtype=bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > reach[1:])
            group = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc)) - 1
            different = np.unique(group * (int(sizes.max()) + 1) + place) // (int(sizes.max()) + 1)
            enough = np.bincount(different, minlength=len(first)) >= items.hits[item[first]]
            first, last = first[enough], last[enough]
            if not len(first):
                continue
            low = np.maximum(at[first] - reach[first], rows[doc[first]])
            high = np.minimum(at[last] + reach[first] + 1, rows[doc[first] + 1])
            which, matched, start, stop = _aligned(items, item[first], hashes, low, high, similarity)
            if not len(which):
                continue
            doc, item = doc[first][which], item[first][which]
            columns = [
                batch.column(0).take(pa.array(begin + doc)), pa.array(items.ids[item]), pa.array(matched),
                pa.array(sizes[item]), pa.array(start - rows[doc]), pa.array(stop + 1 - rows[doc]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Copies of test items in documents, edited ones included.

    Reads ``doc_id`` and ``text``, and ``item_id`` and ``text`` of
    ``benchmark``; other columns are ignored, whatever their names. Words are
    runs of letters and digits, A to Z lowered. Returns one row per document
    and item: ``doc_id``, ``item_id``, ``matched`` (words of the item found, in
    order), ``item_words``, ``start`` and ``stop`` (words of the document) and
    ``similarity``, at least the one asked for; of several copies in a document
    the best, then the first.

    Null and empty texts leak nothing; items without words or without an
    id are left out. A null ``doc_id`` stays null. Rows that repeat
    are one document if ids are equal. Long texts are searched whole. An empty
    benchmark gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_count("text", F.lit("[A-Za-z0-9\u0080-\U0010ffff]+"))
    asked = benchmark.where("item_id is not null and text is not null").where(words > 0)
    asked = asked.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, 2 * blocks))))
    found = spark.createDataFrame([], _LEAK)
    for block in range(2 * blocks if blocks > 1 else blocks):
        here = asked if blocks == 1 else asked.where(F.col("block") == block)
        rows = sorted((row["item_id"], row["text"]) for row in here.collect())  # about half of ``BLOCK_CHARS``
        if not rows:
            continue
        items = _Items.read([i for i, _ in rows], [t for _, t in rows])
        counted = source.mapInArrow(giving_back(lambda b, items=items: _count(b, items)), "seed long, n long")
        counts = counted.groupBy("seed").agg(F.sum("n").alias("n")).collect()  # at most a row per seed
        rare = items.rare({row["seed"]: row["n"] for row in counts}, similarity)
        leaks = source.mapInArrow(giving_back(lambda b, rare=rare: _leaks(b, rare, similarity)), _LEAK)
        found = found.unionByName(scratch.keep(leaks, f"block-{block}"))
    first, last = (-F.col("start")).alias("first"), (-F.col("stop")).alias("last")
    order = F.struct("matched", first, last, "item_words")
    best = found.groupBy("doc_id", "item_id").agg(F.max(order).alias("x"))
    share = F.col("x.matched") / F.col("x.item_words")
    return best.select(
        "doc_id", "item_id", "x.matched", "x.item_words", (-F.col("x.first")).alias("start"),
        (-F.col("x.last")).alias("stop"), share.alias("similarity"),
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a test item; a null ``doc_id`` is never dropped."""
    leaking = find_leaks(docs, benchmark, similarity).select("doc_id").distinct()
    leaking = Scratch(docs.sparkSession, "leaking").keep(leaking.where("doc_id is not null"), "ids")
    return docs.join(leaking, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with the items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
