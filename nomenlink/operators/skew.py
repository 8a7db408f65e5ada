"""Joins of raw rows to small-per-key tables when some keys are very frequent.

A join sends all rows of a key to one task. Adaptive execution can split such
a task only when both sides were shuffled for the join itself, which is not so
when one side comes straight out of an aggregate on the same key. Here the
frequent keys are counted and given as many salts as they need; all other
keys keep a single one, so nothing is copied for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task takes without trouble.
ROWS_PER_TASK = 1_000_000
# Keys beyond the most frequent ones hold at most one row in this many.
HOT_KEYS = 1000
_NULL_SALTS = 4096
# Rows of a few narrow columns that may be broadcast: some megabytes.
BROADCAST_ROWS = 100_000


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The most frequent keys, at most ``HOT_KEYS``, with the salts each needs."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_PER_TASK)
    top = counts.orderBy(F.desc("_n"), *on).limit(HOT_KEYS)
    return top.select(*on, F.ceil(F.col("_n") / ROWS_PER_TASK).alias("_salts"))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    counted: DataFrame | None = None,
    grows: bool = False,
) -> DataFrame:
    """``rows.join(lookup, on, how)`` with frequent keys spread over many tasks.

    ``how`` is inner, left, left_semi or left_anti. Keys are counted on
    ``counted`` when that is a cheaper table with the same key frequencies,
    else on ``rows``. The broadcast table has at most ``HOT_KEYS`` rows. A join
    that makes many rows of one ``grows``: its tasks are not merged for the
    small size of what they read.
    """
    hot = F.broadcast(hot_keys(rows if counted is None else counted, on))
    one = F.lit(1).cast("long")
    # Copies of one row share a hash, so the number of the input partition
    # takes part; it is the same when a task is repeated.
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns]) + F.spark_partition_id()
    has_null = F.lit(False)
    for name in on:
        has_null = has_null | F.col(name).isNull()
    # Rows with a null key match nothing and need not meet.
    salt = F.when(has_null, -1 - F.pmod(spread, F.lit(_NULL_SALTS))).otherwise(
        F.pmod(spread, F.coalesce("_salts", one))
    )
    left = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    if grows:
        left = left.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "_salt")
    last = F.coalesce("_salts", one) - 1
    right = lookup.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    right = right.drop("_salts")
    # Nor is one side broadcast for its size, which would leave the tasks of the other.
    return left.join(right.hint("merge") if grows else right, [*on, "_salt"], how).drop("_salt")


def small_join(rows: DataFrame, small: DataFrame, on: list[str], unique: bool = True) -> DataFrame:
    """Inner join to a table expected to be tiny, with one row per key if ``unique``.

    ``small`` is broadcast when it is counted to have few rows, and joined with
    salts when it is not. Pass a written table, since it is read twice.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on)
    return salted_join(rows, small, on) if unique else rows.join(small, on)
