"""The coverage reports of an offers table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.operators.coverage import coverage, name_profile, top_entities, yield_curve
from nomenlink.operators.metrics import union_all
from nomenlink.session import materialise

# --- fixed values: lengths of the two lists
TOP_CLEAN, TOP_RAW = 30, 15


def diagnostics_report(offers: DataFrame) -> dict[str, DataFrame]:
    """Coverage, both lists of unresolved entities and the yield curve.

    All four share one profile of the raw names, the only pass over the
    offers; it is written first because four results are read from it.
    """
    profile = materialise(name_profile(offers), "names")
    return {
        "coverage": coverage(offers, profile),
        "top_clean": top_entities(offers, TOP_CLEAN, False, profile),
        "top_raw": top_entities(offers, TOP_RAW, True, profile),
        "yield_curve": yield_curve(offers, profile=profile),
    }


def diagnostics_lines(offers: DataFrame) -> DataFrame:
    """The same reports as lines of (report, item, measure, value)."""

    def lines(report: str, df: DataFrame, item: str | None) -> DataFrame:
        measures = [name for name in df.columns if name != item]
        pairs = [
            F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in measures
        ]
        label = F.lit("all") if item is None else F.col(item).cast("string")
        return df.select(F.lit(report).alias("report"), label.alias("item"), F.inline(F.array(*pairs)))

    items = {"coverage": None, "top_clean": "entity_name", "top_raw": "entity_name", "yield_curve": "threshold"}
    reports = diagnostics_report(offers)
    return union_all([lines(name, reports[name], item) for name, item in items.items()])
