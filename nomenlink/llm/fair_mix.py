"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled and queued, once more behind themselves
for the second pass. A queued document's virtual finish time is the number of
its source's words up to its end, divided by the source's weight. All queues
are merged by finish time and cut where the budget of words is used up: a
source with words left has then given its weight's share, one that ran dry has
given all it may, and its excess has gone to the others by weight.

Running sums over hot sources are made without a task for each: rows are dealt
by range, summed inside each part, and parts are offset by the parts before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the budget: three halves of all words
PASSES = 2
SEED = "mix"


def words_in(text: Column) -> Column:
    """Number of longest runs of characters other than space and 9 to 13."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` dealt by range and sorted, with ``part`` and the place ``at`` in the whole order."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("*", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33))


def running_sums(placed: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``placed`` (a written result of ``in_order``) with ``total``, the sum of ``value`` up to each row.

    ``by`` names leading columns of the order; sums start anew with each of
    their values. A window holds the rows of one part, or one row per part.
    """
    sums = placed.groupBy(*by, "part").agg(F.sum(value).alias("here"))
    ahead = F.sum("here").over(Window.partitionBy(*by).orderBy("part")) - F.col("here")
    offsets = sums.select(*by, "part", ahead.alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy(*by, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("inside", inside).join(offsets, [*by, "part"]).withColumn(
        "total", F.col("inside") + F.col("ahead")
    ).drop("inside", "ahead")


def weighted_sources(sizes: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per source: ``place`` by code point from 0 (null last), ``weight``, ``source_size``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = scratch.keep(
        in_order(sums.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1)), "last", "source"), "placed"
    )
    place = (F.col("total") - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = running_sums(placed, "one").select("source", "source_size", place.alias("place"))
    return scratch.keep(numbered.withColumn("weight", weight), "sources")


def with_targets(sources: DataFrame, share: tuple[int, int] = SHARE, passes: int = PASSES) -> DataFrame:
    """``sources`` with ``target``: the budget by weight, no source above ``passes`` times its size.

    What a source cannot take is shared by weight among the others until none
    is above; each round reads one row, sums over the sources.
    """
    cap, weight = F.col("source_size") * passes, F.col("weight")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = whole * share[0] / share[1], -1.0
    while True:
        full = cap <= weight * level
        given, open_weight = sources.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(weight))
        ).first()
        if not open_weight:
            break
        higher = (budget - given) / open_weight
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap.cast("double"), weight * F.lit(level)))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    passes: int = PASSES,
    seed: str = SEED,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Reads ``doc_id``, ``source`` and ``text``; other columns are ignored,
    whatever their names. Returns them without the text and with ``size`` (the
    document's words), ``source_size``, ``weight`` and ``target`` of its
    source, and ``taken``: words of it in the mix, at most ``passes`` times its
    size. The mix has as many words as ``share`` of all sizes, rounded down;
    ``share`` is at most ``passes``. The document at the cut is taken in part.

    Documents are shuffled by a digest of ``seed`` and their id, so runs agree;
    rows of one id go by size, and rows equal in both are alike. A null text
    has no words, a null id is an id, null sources are one source, the last.
    Documents without words are in the result with nothing taken. Long texts
    are read whole. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "fair-mix")
    shuffle = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), shuffle.alias("shuffle"))
    # Rows equal in all else are told apart, so no value is too frequent for a range.
    sizes = scratch.keep(sizes.withColumn("salt", F.monotonically_increasing_id()), "sizes")
    sources = weighted_sources(sizes, scratch, weights)

    queued = in_order(sizes.withColumn("last", F.col("source").isNull()), "last", "source", "shuffle", "doc_id", "size", "salt")
    queued = scratch.keep(queued.drop("shuffle", "salt"), "queued")
    # Sums are kept by the place of the source, which is never null.
    targets = scratch.keep(with_targets(sources, share, passes), "targets").withColumnRenamed("source", "its")
    numbers = targets.select("its", "place", "source_size", "weight", "target")
    placed = _beside(queued.drop("last"), numbers)
    scale = math.lcm(*weights)
    ends = running_sums(scratch.keep(placed, "beside"), "size", ["place"])
    ends = scratch.keep(ends.drop("part"), "ends")

    passing = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long")))
    finish = (F.col("total") + F.col("pass") * F.col("source_size")) * F.floor(F.lit(scale) / F.col("weight"))
    order = ["finish", "place", "doc"]
    merged = ends.where("size > 0").select("place", F.col("at").alias("doc"), "size", "total", "source_size", "weight", passing.alias("pass"))
    merged = in_order(merged.select(finish.alias("finish"), "place", "doc", "size"), *order)
    cut = _cut(scratch.keep(merged, "merged"), share, targets)

    taken = F.lit(0).cast("long")
    for number in range(passes):
        at = (F.col("total") + number * F.col("source_size")) * F.floor(F.lit(scale) / F.col("weight"))
        key, last = F.struct(at, "place", "at"), F.struct(*[F.lit(cut[c]).cast("long") for c in order])
        whole = F.when(key < last, F.col("size")).when(key == last, F.lit(cut["rest"])).otherwise(0)
        taken += F.when(F.col("size") > 0, whole).otherwise(0)
    return ends.select("doc_id", "source", "size", "source_size", "weight", "target", taken.cast("long").alias("taken"))


def _beside(queued: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each queued row with the facts of its source.

    A part of the order holds few sources or few rows of each, so the facts are
    joined by part as well: a hot source lies in many parts.
    """
    both = queued.select("part", F.col("source").alias("own")).distinct()
    facts = both.join(numbers, F.col("own").eqNullSafe(F.col("its"))).drop("its").withColumnRenamed("part", "there")
    same = (F.col("there") == F.col("part")) & F.col("own").eqNullSafe(F.col("source"))
    return queued.join(facts, same).drop("there", "own")


def _cut(merged: DataFrame, share: tuple[int, int], sources: DataFrame) -> dict:
    """The queued document at which the budget is used up, and what is left for it."""
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = whole * share[0] // share[1]
    sums = merged.groupBy("part").agg(F.sum("size").alias("here"))
    before = F.sum("here").over(Window.orderBy("part")) - F.col("here")  # one row per part
    part = sums.withColumn("before", before).where((F.col("before") < budget) & (F.col("before") + F.col("here") >= budget)).first()
    if part is None:  # nothing to take
        return {"finish": -1, "place": -1, "doc": -1, "rest": 0}
    total = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    left = F.lit(budget - part["before"]) - (F.col("total") - F.col("size"))
    rows = merged.where(F.col("part") == part["part"]).withColumn("total", total)
    row = rows.withColumn("rest", left).where("rest > 0 and rest <= size").first()
    return row.asDict()


def op13_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix of the sources takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
with recursive sizes as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '')) as shuffle, row_number() over () as salt
  from documents
), sources as materialized (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place,
    [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sizes group by source
), whole as (select sum(source_size)::bigint as words from sources),
rounds(number, level) as (
  select 0, -1.0::double
  union all
  select number + 1, (select (any_value(words) * 3 / 2.0 - sum(case when 2 * source_size <= weight * level then 2 * source_size else 0 end))::double
      / nullif(sum(case when 2 * source_size <= weight * level then 0 else weight end), 0) from sources, whole)
  from rounds
  where (select bool_or(2 * source_size > weight * level) from sources)
    and number < 40
), facts as materialized (
  select source, source_size, place, weight, least((2 * source_size)::double, weight * (select max(level) from rounds)) as target from sources
), queue as materialized (
  select s.doc_id, s.size, f.source_size, f.place, f.weight, f.target, s.salt,
    sum(s.size) over (partition by f.place order by s.shuffle, s.doc_id, s.size, s.salt) as total,
    row_number() over (order by f.place, s.shuffle, s.doc_id, s.size, s.salt) as doc
  from sizes s join facts f on s.source is not distinct from f.source
), merged as (
  select doc, size, sum(size) over (order by (total + pass * source_size) * (6 // weight), place, doc) as used
  from queue, (values (0), (1)) p(pass) where size > 0
), parts as (
  select doc, sum(greatest(0, least(size, (select words * 3 // 2 from whole) - (used - size)))) as taken from merged group by doc
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::bigint as taken from queue q left join parts using (doc)
"""
