"""Whole orders and running sums without a task that sees all rows or a hot key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.session import materialise


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` dealt by range and sorted, with ``part`` and the place ``at`` in the whole order.

    End ``order`` with something that tells equal rows apart where many may be
    equal. Write the result before it is read twice.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("*", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33))


def running_sums(placed: DataFrame, sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``placed`` (a written result of ``in_order``) with running sums: name of each to the column it adds up.

    A sum reaches up to its row. ``by`` names leading columns of the order;
    sums start anew with each of their values. Sums inside a part are offset by
    the parts before, so a window holds the rows of one part or a row per part.
    """
    here = placed.groupBy(*by, "part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    parts = Window.partitionBy(*by).orderBy("part")
    ahead = here.select(*by, "part", *[(F.sum(f"_{name}").over(parts) - F.col(f"_{name}")).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy(*by, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    offset = summed.join(ahead, [*by, "part"]).withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums})
    return offset.drop(*[f"_{name}" for name in sums])


def counts_upto(marks: DataFrame, asks: DataFrame, value: str, by: Sequence[str] = (), name: str = "n_upto") -> DataFrame:
    """``asks`` with the number of ``marks`` of the same ``by`` whose ``value`` is at most their own.

    A range join by one common order of marks and asks, so its work is linear
    whatever the number of marks below an ask. Equal marks are added up first.
    ``value`` and ``by`` hold no nulls.
    """
    summed = marks.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_marks")).withColumn("_ask", F.lit(0))
    asked = asks.withColumns({"_marks": F.lit(0).cast("long"), "_ask": F.lit(1)})
    merged = in_order(summed.unionByName(asked, allowMissingColumns=True), *by, value, "_ask")
    counted = running_sums(materialise(merged, "merged"), {name: "_marks"}, by)
    return counted.where(F.col("_ask") == 1).select(*asks.columns, name)
