"""N-gram Jaccard join by parity sketches.

The shingles of a text are dealt by hash to the parts of a sketch, and each
part holds the parity (XOR) of what fell into it. A shingle that two sets do
not share can change one part only, so the number of differing parts, like the
Hamming distance of a sketch of single bits, is at most the symmetric
difference. Sets of one size band that are similar enough differ in at most D
shingles; with more than D parts, some part is equal (pigeonhole), and the
equal parts are the join key. Sets are compared in full before they count as
linked.

Each set keeps D + 1 of its parts, those with most shingles: equal parts come
in the same order of fullness in both sets, so among the more than k - D equal
ones of k parts, at least one is kept by both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm import units
from nomenlink.llm.components import components
from nomenlink.llm.scratch import Scratch, giving_back

# Rows combined in a task before they are shuffled; bounds its memory.
_FLUSH = 1_000_000
_BITS = 1024
_BIT_COLUMNS = [f"bits_{k}" for k in range(_BITS // 64)]
# Sets of a key that all others of it are compared with first.
_HEADS = 16
_KEY, _DOCUMENT, _EDGE = 0, 1, 2
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``scale * common >= least * united``."""

    words: int = 5
    least: int = 80
    scale: int = 100

    def bands(self, largest: int) -> np.ndarray:
        """First sizes of the bands: a linked partner is in the same band or the next."""
        starts = [1, 2]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * self.scale // self.least + 1))
        return np.array([*starts, max(starts[-1] + 1, (starts[-1] - 1) * self.scale // self.least + 1)])

    def differing(self, united_most: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets of this total size can differ."""
        return united_most * (self.scale - self.least) // (self.scale + self.least)

    def parts(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts and kept parts of the sketches of each band and the next."""
        smaller = starts[1:] - 1
        kept = self.differing(smaller + smaller * self.scale // self.least) + 1
        return kept + -(-kept // 4), kept


def _set_ids(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One hash for each set: of its size and two independent combinations of its shingles."""
    sizes = np.diff(rows)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    xored, summed = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    np.bitwise_xor.at(xored, owner, hashes)
    np.add.at(summed, owner, units.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return units.mix(xored ^ units.mix(summed + units.mix(sizes.astype(np.uint64))))


def _part_keys(hashes: np.ndarray, rows: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key of each kept part, in both bands of each set."""
    sizes = np.diff(rows)
    starts = rule.bands(int(sizes.max(initial=1)))
    parts, kept = rule.parts(starts)
    band = np.searchsorted(starts, sizes, side="right") - 1
    owners, keys = [], []
    for domain in (band, band - 1):
        here = (sizes > 0) & (domain >= 0) & (kept[np.maximum(domain, 0)] > 1)
        if not here.any():
            continue
        chosen = np.flatnonzero(here)
        k = parts[domain[chosen]]
        first = np.append(0, np.cumsum(k))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        member = here[owner]
        place = np.cumsum(here) - 1
        local = place[owner[member]]
        mine = hashes[member]
        slot = first[local] + (mine % k[local].astype(np.uint64)).astype(np.int64)
        counts = np.bincount(slot, minlength=first[-1])
        parity = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(parity, slot, mine)
        of = np.repeat(np.arange(len(chosen)), k)
        order = np.argsort(of * (int(counts.max()) + 1) + counts, kind="stable")
        rank = np.arange(len(order)) - first[of]
        order = order[rank >= (k - kept[domain[chosen]])[of]]
        of = of[order]
        salt = (domain[chosen][of] << 32) | (order - first[of])
        owners.append(chosen[of])
        keys.append(units.mix(parity[order] ^ units.mix(salt.astype(np.uint64))))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _rows(deal, kind: int, a, b, n) -> pa.RecordBatch:
    count = len(deal)
    columns = [pa.array(np.asarray(x).view(np.int64)) for x in (b, n, deal, a)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, kind, np.int8)), *columns], names=["kind", "b", "n", "deal", "a"]
    )


def _combined(keys: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per key, and an edge to it from every other set of that key."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
    keys, sets = keys[fresh], sets[fresh]
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    leader = sets[np.flatnonzero(head)][np.cumsum(head) - 1]
    zero = np.zeros(int(head.sum()), np.int64)
    yield _rows(keys[head], _KEY, sets[head], zero, zero)
    rest = ~head
    yield _rows(units.mix(keys[rest] ^ sets[rest]), _EDGE, leader[rest], sets[rest], keys[rest])


def _scan(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for begin, data, bounds in units.blocks(batch.column(1)):
            _, _, hashes, rows = units.words(data, bounds, lower=True)
            hashes, rows = units.shingles(hashes, rows, rule.words)
            sets, sizes = _set_ids(hashes, rows), np.diff(rows)
            mine = ids[begin : begin + len(sizes)]
            yield _rows(units.mix(mine.view(np.uint64)), _DOCUMENT, mine, sets, sizes.astype(np.int64))
            fresh = np.array([not (x in seen or seen.add(x)) for x in sets.tolist()], dtype=bool)
            kept = np.repeat(fresh, sizes)
            owners, keys = _part_keys(hashes[kept], np.append(0, np.cumsum(sizes[fresh])), rule)
            held.append((keys, sets[fresh][owners]))
            waiting += len(keys)
            if waiting >= _FLUSH:
                yield from _combined(*map(np.concatenate, zip(*held, strict=True)))
                held, waiting = [], 0
    if held:
        yield from _combined(*map(np.concatenate, zip(*held, strict=True)))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: edges from the first set of each key; other rows as they are."""
    last_key, leader = None, 0
    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        other = kind != _KEY
        if other.any():
            yield batch.filter(pa.array(other))
        deal, sets = (np.asarray(batch.column(name))[~other] for name in ("deal", "a"))
        if not len(deal):
            continue
        head = np.ones(len(deal), dtype=bool)
        head[1:] = deal[1:] != deal[:-1]
        head[0] = last_key is None or deal[0] != last_key
        first = np.append(leader, sets[head]) if not head[0] else sets[head]
        leaders = first[np.cumsum(head) - (1 if head[0] else 0)]
        last_key, leader = deal[-1], leaders[-1]
        rest = leaders != sets
        if rest.any():
            yield _rows(deal[rest], _EDGE, leaders[rest], sets[rest], deal[rest])


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    names = ["set", "shingles", *_BIT_COLUMNS]
    for batch in batches:
        for _, data, bounds in units.blocks(batch.column(0)):
            _, _, hashes, rows = units.words(data, bounds, lower=True)
            hashes, rows = units.shingles(hashes, rows, rule.words)
            count = len(rows) - 1
            owner = np.repeat(np.arange(count), np.diff(rows))
            bits = np.zeros((count, _BITS), dtype=np.uint8)
            np.bitwise_xor.at(bits, (owner, (hashes % np.uint64(_BITS)).astype(np.int64)), 1)
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_set_ids(hashes, rows).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    *[pa.array(np.ascontiguousarray(column)) for column in packed.T],
                ],
                names=names,
            )


class _Comparison:
    """Compares pairs of sets in full; the sketch of bits rules out pairs first."""

    def __init__(self, sets: DataFrame, rule: Rule, scratch: Scratch):
        self.sets, self.rule, self.scratch = sets, rule, scratch

    def _side(self, name: str, *columns: str) -> DataFrame:
        return self.sets.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def sketches(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with size and bits of the set in the column ``name``."""
        return rows.join(self._side(name, "size", *_BIT_COLUMNS), name)

    def near(self) -> Column:
        """Whether sizes and Hamming distance of ``a`` and ``b`` allow a link."""
        rule = self.rule
        apart = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BIT_COLUMNS)
        total = F.col("size_a") + F.col("size_b")
        close = apart * (rule.scale + rule.least) <= total * (rule.scale - rule.least)
        return close & (F.least("size_a", "size_b") * rule.scale >= F.greatest("size_a", "size_b") * rule.least)

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        rule = self.rule
        both = pairs.join(self._side("a", "shingles"), "a").join(self._side("b", "shingles"), "b")
        common = F.size(F.array_intersect("shingles_a", "shingles_b")).alias("common")
        total = (F.size("shingles_a") + F.size("shingles_b")).alias("total")
        judged = both.select("a", "b", common, total)
        enough: Column = F.col("common") * rule.scale >= (F.col("total") - F.col("common")) * rule.least
        return self.scratch.keep(judged.where(enough).select("a", "b"), name)


def _separate(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets not yet known to be connected, with their roots."""
    up = roots.select(F.col("node").alias("a"), F.col("root").alias("up_a"))
    down = roots.select(F.col("node").alias("b"), F.col("root").alias("up_b"))
    both = pairs.join(up, "a", "left").join(down, "b", "left")
    both = both.withColumns({"up_a": F.coalesce("up_a", "a"), "up_b": F.coalesce("up_b", "b")})
    return both.where("up_a <> up_b")


def _members(edges: DataFrame, keys: DataFrame, roots: DataFrame, heads: int | None) -> DataFrame:
    """Sets of the keys with their roots; ``head`` marks about ``heads`` of each key, or all."""
    held = edges.join(keys, "key", "left_semi")
    held = held.select("key", F.col("a").alias("set")).union(held.select("key", "b")).distinct()
    held = held.join(roots.select(F.col("node").alias("set"), F.col("root").alias("up")), "set", "left")
    held = held.withColumn("up", F.coalesce("up", "set"))
    if heads is None:
        return held.withColumn("head", F.lit(True))
    counts = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / heads).alias("share"))
    marked = held.join(counts, "key").withColumn("head", F.pmod(F.xxhash64("set"), F.col("share")) == 0)
    return marked.drop("share")


def _meeting(members: DataFrame, compare: _Comparison) -> DataFrame:
    """Pairs of a set and a head of its key that are not connected but may be linked."""
    left = members.select("key", F.col("set").alias("a"), F.col("up").alias("up_a"))
    right = members.where("head").select("key", F.col("set").alias("b"), F.col("up").alias("up_b"))
    left, right = compare.sketches(left, "a"), compare.sketches(right, "b")
    # The sketches decide inside the join: a pair that cannot link is never a row.
    meet = (left["key"] == right["key"]) & F.expr("up_a <> up_b") & compare.near()
    return left.join(right, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_documents(docs: DataFrame, rule: Rule) -> DataFrame:
    """Documents with the size of their shingle set and the group they are linked into.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Returns ``doc_id``, ``n_shingles`` and ``component_id``: the least
    ``doc_id`` that links reach, the document's own included. Words are longest
    runs without white space, A to Z lowered.

    Null, empty and blank texts have no shingles, are linked with nothing, and
    are a group of their own each. Equal sets are one set throughout, so copies
    are never paired with one another. A null ``doc_id`` stays null and gives a
    group no name unless it has no other. Rows that repeat are all returned.
    Long texts are read whole. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sketch-join")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), text)

    schema = "kind byte, b long, n long, deal long, a long"  # what is mostly zero stands together
    dealt = source.mapInArrow(giving_back(lambda batches: _scan(batches, rule)), schema)
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "a")
    found = scratch.keep(dealt.mapInArrow(giving_back(_stars), schema), "found")
    scratch.drop()
    documents = found.where(F.col("kind") == _DOCUMENT).select(
        F.col("a").alias("doc_id"), F.col("b").alias("set"), F.col("n").alias("n_shingles")
    )
    edges = found.where(F.col("kind") == _EDGE).select("a", "b", F.col("n").alias("key"))
    pairs = scratch.keep(edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")), "pairs")

    joined = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    chosen = documents.join(joined, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    texts = source.join(chosen.select("doc_id").distinct(), "doc_id").select("text")
    schema = ", ".join(["set long, shingles array<long>", *(f"{c} long" for c in _BIT_COLUMNS)])
    sets = texts.mapInArrow(giving_back(lambda batches: _sets(batches, rule)), schema)
    sets = sets.withColumn("size", F.size("shingles").cast("long")).join(joined, "set", "left_semi")
    sets = scratch.keep(sets.dropDuplicates(["set"]), "sets")
    scratch.drop()
    compare = _Comparison(sets, rule, scratch)

    # The partner with most keys in common first; it connects nearly all.
    best = pairs.groupBy("b").agg(F.max(F.struct("hits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = compare.linked(scratch.keep(best, "best"), "linked-best")
    roots = components(links, scratch, "first")
    more = _separate(pairs.select("a", "b"), roots).select("a", "b")
    more = compare.sketches(compare.sketches(more, "a"), "b").where(compare.near()).select("a", "b")
    more = scratch.keep(more, "more")
    links = links.union(compare.linked(more, "linked-more"))
    roots = components(links, scratch, "second")

    # Keys whose sets are not all connected: what was not compared with one
    # another there is compared now, first with a few sets of each key, which
    # connects most, then without exception.
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn, heads in (("heads", _HEADS), ("all", None)):
        loose = scratch.keep(_separate(edges, roots).select("key").distinct(), f"loose-{turn}")
        if loose.isEmpty():
            break
        members = scratch.keep(_members(edges, loose, roots, heads), f"members-{turn}")
        across = _meeting(members, compare).join(tested, ["a", "b"], "left_anti")
        across = scratch.keep(across, f"across-{turn}")
        links = links.union(compare.linked(across, f"linked-{turn}"))
        roots = components(links, scratch, f"roots-{turn}")
        tested = tested.union(across)

    group = F.when(F.col("n_shingles") > 0, F.coalesce("root", "set"))
    labelled = documents.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_shingles", group.alias("group")
    )
    labelled = scratch.keep(labelled, "labelled")
    names = labelled.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    names = scratch.keep(names, "names")
    scratch.keep_only("labelled", "names")
    alone = labelled.where("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.join(names, "group").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def drop_near_copies(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one document, the least ``doc_id``, of each linked group; null ids stay."""
    groups = link_documents(docs, rule).where("doc_id <> component_id").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession, "near-copies").keep(groups, "ids")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by four-word shingles at a similarity of 0.85."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Rule(4, 85, 100))
