"""How many offers lack an identifier, and what a frequency cut-off buys.

All reports start from ``name_profile``: one row per raw spelling. Names are
normalised and tested once per spelling instead of once per offer, and the
only shuffle of the offers is a partial aggregate, which a hot name cannot
skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import siren_norm_of
from nomenlink.functions.names import has_name, key_is_blacklisted, name_norm
from nomenlink.operators.skew import salted_join

# --- fixed values
YIELD_THRESHOLDS = (1, 2, 3, 5, 10, 20, 50, 100)


def name_profile(offers: DataFrame) -> DataFrame:
    """Offers per raw spelling: how many, how many with an identifier."""
    siren = siren_norm_of(offers, "entity_siren")
    spellings = offers.groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("n_offers"), F.count(siren).alias("n_with_siren"), F.max(siren).alias("known_siren")
    )
    named = F.coalesce(has_name(F.col("entity_name")), F.lit(False))
    keyed = spellings.withColumn("name_key", F.when(named, name_norm(F.col("entity_name"))))
    return keyed.withColumn("is_blacklisted", F.coalesce(key_is_blacklisted(F.col("name_key")), F.lit(False)))


def _key_profile(profile: DataFrame) -> DataFrame:
    """One row per name key; offers without a name share the null key."""
    return profile.groupBy("name_key", "is_blacklisted").agg(
        F.sum("n_offers").alias("n_offers"), F.sum("n_with_siren").alias("n_with_siren")
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2)


def coverage(offers: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row: where the offers go, from a missing name to the real target."""
    keys = _key_profile(name_profile(offers) if profile is None else profile)
    named = F.col("name_key").isNotNull()
    unresolved = named & (F.col("n_with_siren") == 0)

    def offers_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_offers"))), F.lit(0))

    counts = keys.agg(
        F.coalesce(F.sum("n_offers"), F.lit(0)).alias("total_offers"),
        offers_where(~named).alias("offers_without_name"),
        offers_where(named & F.col("is_blacklisted")).alias("offers_placeholder_name"),
        offers_where(unresolved).alias("offers_unresolved"),
        offers_where(unresolved & ~F.col("is_blacklisted")).alias("offers_target"),
    )
    return counts.withColumns(
        {
            "pct_target_of_total": _percent(F.col("offers_target"), F.col("total_offers")),
            "pct_target_of_named": _percent(
                F.col("offers_target"), F.col("total_offers") - F.col("offers_without_name")
            ),
        }
    )


def known_siren_by_name(offers: DataFrame) -> DataFrame:
    """Highest identifier seen with each name key."""
    profile = name_profile(offers).where(F.col("name_key").isNotNull() & F.col("known_siren").isNotNull())
    return profile.groupBy("name_key").agg(F.max("known_siren").alias("known_siren"))


def _named_without_siren(offers: DataFrame) -> DataFrame:
    wanted = has_name(F.col("entity_name")) & siren_norm_of(offers, "entity_siren").isNull()
    return offers.where(wanted).withColumn("name_key", name_norm(F.col("entity_name")))


def recoverable_by_name(offers: DataFrame) -> DataFrame:
    """Named offers without an identifier whose name has one elsewhere."""
    return salted_join(_named_without_siren(offers), known_siren_by_name(offers), ["name_key"])


def unrecoverable_offers(offers: DataFrame, drop_blacklisted: bool = False) -> DataFrame:
    """Named offers without an identifier, on the row or for the name."""
    rows = salted_join(_named_without_siren(offers), known_siren_by_name(offers), ["name_key"], "left_anti")
    return rows.where(~key_is_blacklisted(F.col("name_key"))) if drop_blacklisted else rows


def _unresolved_spellings(profile: DataFrame, include_blacklisted: bool) -> DataFrame:
    spellings_of_key = Window.partitionBy("name_key")
    named = profile.where(F.col("name_key").isNotNull())
    if not include_blacklisted:
        named = named.where(~F.col("is_blacklisted"))
    return named.withColumn("key_with_siren", F.sum("n_with_siren").over(spellings_of_key)).where(
        F.col("key_with_siren") == 0
    )


def top_entities(
    offers: DataFrame, n: int = 30, include_blacklisted: bool = False, profile: DataFrame | None = None
) -> DataFrame:
    """The n raw names with most unresolved offers; ties by name."""
    profile = name_profile(offers) if profile is None else profile
    return (
        _unresolved_spellings(profile, include_blacklisted)
        .select("entity_name", "n_offers")
        .orderBy(F.desc("n_offers"), "entity_name")
        .limit(n)
    )


def yield_curve(
    offers: DataFrame, thresholds: tuple[int, ...] = YIELD_THRESHOLDS, profile: DataFrame | None = None
) -> DataFrame:
    """Entities to treat and offers covered for each minimal group size.

    One pass over the frequencies with a pair of sums per threshold; no join.
    """
    keys = _key_profile(name_profile(offers) if profile is None else profile)
    frequency = keys.where(F.col("name_key").isNotNull() & ~F.col("is_blacklisted") & (F.col("n_with_siren") == 0))
    n = F.col("n_offers")
    aggregates = [F.count(F.lit(1)).alias("entities"), F.sum(n).alias("offers")]
    for t in thresholds:
        aggregates += [F.count(F.when(n >= t, 1)).alias(f"entities_{t}"), F.sum(F.when(n >= t, n)).alias(f"offers_{t}")]
    steps = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"entities_{t}").alias("entities"),
                _percent(F.col(f"entities_{t}"), F.col("entities")).alias("pct_entities"),
                F.col(f"offers_{t}").alias("offers_covered"),
                _percent(F.col(f"offers_{t}"), F.col("offers")).alias("pct_offers"),
            )
            for t in thresholds
        ]
    )
    return frequency.agg(*aggregates).select(F.inline(steps)).orderBy("threshold")
