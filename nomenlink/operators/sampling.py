"""Repeatable samples and splits, chosen by digest instead of by an engine's seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.functions.hashing import digest, fraction
from nomenlink.session import materialise

# --- fixed values
SEED = 42
VALIDATION_SHARE = 0.2

# Up to this size a sorted limit is one small merge; beyond it the rows are cut
# by thresholds so that they never meet in one task.
SORTED_LIMIT = 10_000
_DIGITS_PER_CUT = 4


def hash_sample(
    df: DataFrame, n: int, seed: int = SEED, keys: list[str] | None = None, written: bool = False
) -> DataFrame:
    """The n rows with the smallest digests of ``keys`` (all columns by default).

    Repeatable, independent of partitioning, and equal to ``ORDER BY md5 LIMIT
    n``. For large n the rows are written once to the shared folder, unless
    ``df`` is a ``written`` table itself. One pass over them keeps those whose
    digests can be among the n smallest; among these the digest of the n-th row
    is located by counting rows per digest prefix, so only the rows of one
    prefix are ever sorted.
    """
    columns = df.columns
    key = digest(seed, *[F.col(name) for name in keys or columns])
    if n <= SORTED_LIMIT:
        return df.withColumn("_digest", key).orderBy("_digest").limit(n).select(*columns)
    rows = df if written else materialise(df, "sample")
    total = rows.count()
    if total <= n:
        return rows
    near = _near(rows.withColumn("_digest", key), total, n)
    return _smallest(near, F.lit(n).cast("long"), n, 1).select(*columns)


def _near(rows: DataFrame, total: int, n: int) -> DataFrame:
    """Rows that hold the n smallest digests and few others, written.

    Digests are spread evenly, so a share of the range a little above n rows'
    holds them. Rows that repeat share a digest, so the kept ones are counted,
    and while they are too few the share is widened.
    """
    share = (n + 6 * math.sqrt(n)) / total
    while share < 0.5:
        kept = materialise(rows.where(F.col("_digest") < f"{int(share * 16**12):012x}"), "sample-near")
        if kept.count() >= n:
            return kept
        share *= 4
    return rows


def _smallest(rows: DataFrame, wanted: Column, n: int, start: int) -> DataFrame:
    if start > 2 * _DIGITS_PER_CUT:
        # ``wanted`` is a subquery, which a limit cannot take: n bounds the
        # sort and the rank applies the exact number.
        rank = F.row_number().over(Window.orderBy("_digest"))
        top = rows.orderBy("_digest").limit(n)
        return top.withColumn("_rank", rank).where(F.col("_rank") <= wanted).drop("_rank")
    prefix = F.substring("_digest", start, _DIGITS_PER_CUT)
    # At most 16 ** 4 prefixes, so this window is small whatever the input.
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    reached = counts.withColumn("upto", F.sum("n").over(running)).where(F.col("upto") >= wanted)
    edge = reached.agg(F.min_by(F.struct("prefix", (F.col("upto") - F.col("n")).alias("below")), "prefix").alias("e"))
    edge_prefix = F.coalesce(edge.select("e.prefix").scalar(), F.lit("g"))
    below = edge.select("e.below").scalar()
    whole = rows.where(prefix < edge_prefix)
    part = _smallest(rows.where(prefix == edge_prefix), wanted - below, n, start + _DIGITS_PER_CUT)
    return whole.unionByName(part)


def limit_pairs(pairs: DataFrame, limit: int | None, seed: int = SEED, written: bool = False) -> DataFrame:
    """At most ``limit`` pairs, the same ones on every run."""
    return pairs if limit is None else hash_sample(pairs, limit, seed, written=written)


def audit_sample(pairs: DataFrame, n: int = 1000, seed: int = SEED) -> DataFrame:
    """Random pairs with blank columns for a reviewer's decision and comment."""
    columns = [
        "missing_row_id",
        "missing_entreprise_nom",
        "missing_location_label",
        "zipcode_norm",
        "dept_norm",
        "target_siren",
        "known_entreprise_nom",
        "known_location_label",
        "n_known_rows",
        "n_sirens_at_grain",
    ]
    blanks = {"audit_decision": F.lit(""), "audit_comment": F.lit("")}
    return hash_sample(pairs.select(*columns), n, seed).withColumns(blanks)


def group_split(
    df: DataFrame, key: str = "nom_key", share: float = VALIDATION_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``is_validation``; all rows of one key fall on the same side."""
    return df.withColumn("is_validation", fraction(seed, F.col(key)) < share)


def with_row_id(df: DataFrame, id_col: str | None = None, chunk: int = 100_000) -> DataFrame:
    """Adds a stable ``row_id``.

    A source key is used as it is. Without one the id is the digest of the row
    and a running number among identical rows. Identical rows are counted, not
    collected, and numbered again in bounded chunks.
    """
    if id_col is not None:
        return df.withColumn("row_id", F.col(id_col))
    columns = [F.col(name) for name in df.columns]
    # Lengths and a mark for nulls keep different rows apart.
    texts = [c.cast("string") for c in columns]
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(chunk).cast("long"))))
    spread = chunks.repartition(*columns, F.col("_from"))
    last = F.least(F.col("_from") + chunk - 1, F.col("_n"))
    return spread.withColumn("_i", F.explode(F.sequence(F.col("_from"), last))).select(
        *columns, F.concat_ws("-", digest("row", whole), F.col("_i").cast("string")).alias("row_id")
    )

