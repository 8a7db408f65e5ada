"""Distinct unresolved entities, ranked by what resolving them is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import clean_numeric_of, siren_norm_of, zip_ok_weight
from nomenlink.functions.names import has_name, key_is_blacklisted, name_norm
from nomenlink.session import materialise

# --- fixed values
MIN_NAME_LENGTH = 3
DEFAULT_LIMIT = 100

PLACE = ["location_label", "location_zipcode", "location_departement"]


def resolvable_offers(offers: DataFrame, drop_blacklisted: bool = True) -> DataFrame:
    """Offers with a usable name and a zip code, with codes as text."""
    name = F.col("entity_name")
    wanted = has_name(name) & (F.length(F.trim(name)) >= MIN_NAME_LENGTH)
    rows = offers.where(wanted).select(
        name_norm(name).alias("name_key"),
        name,
        F.col("location_label").cast("string").alias("location_label"),
        clean_numeric_of(offers, "location_zipcode").alias("location_zipcode"),
        clean_numeric_of(offers, "location_departement").alias("location_departement"),
        siren_norm_of(offers, "entity_siren").alias("siren"),
    )
    if drop_blacklisted:
        rows = rows.where(~key_is_blacklisted(F.col("name_key")))
    return rows.where(F.col("location_zipcode").isNotNull())


def _entity_groups(offers: DataFrame) -> DataFrame:
    return (
        resolvable_offers(offers)
        .groupBy("name_key", *PLACE)
        .agg(
            F.min("entity_name").alias("entity_name_example"),
            F.count(F.lit(1)).alias("n_offers"),
            F.count("siren").alias("n_with_siren"),
        )
    )


def _locations(groups: DataFrame) -> DataFrame:
    return groups.groupBy("name_key").agg(F.count_distinct("location_zipcode").alias("n_locations"))


def entity_stats(offers: DataFrame) -> DataFrame:
    """Number of zip codes each name occurs in."""
    return _locations(_entity_groups(offers))


def unresolved_entities(offers: DataFrame, min_offers: int = 1) -> DataFrame:
    """Entities (name and place) of which no offer has an identifier."""
    return _unresolved(_entity_groups(offers), min_offers)


def _unresolved(groups: DataFrame, min_offers: int) -> DataFrame:
    wanted = (F.col("n_with_siren") == 0) & (F.col("n_offers") >= min_offers)
    return groups.where(wanted).drop("n_with_siren")


def entity_priority(offers: DataFrame, min_offers: int = 1) -> DataFrame:
    """Unresolved entities with their score: volume, spread, clean zip code."""
    score = F.col("n_offers") * F.log(1 + F.col("n_locations")) * zip_ok_weight(F.col("location_zipcode"))
    groups = materialise(_entity_groups(offers), "entities")  # the offers are read and grouped once
    return (
        _unresolved(groups, min_offers)
        .join(_locations(groups), "name_key")
        .withColumn("priority_score", F.round(score, 9))
        .select("name_key", "entity_name_example", *PLACE, "n_offers", "n_locations", "priority_score")
    )


def work_list(offers: DataFrame, min_offers: int = 1, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Entities in the order they should be resolved, the best ``limit`` of them."""
    ordered = entity_priority(offers, min_offers).orderBy(
        F.desc("priority_score"),
        F.desc("n_offers"),
        "name_key",
        "location_zipcode",
        F.coalesce("location_label", F.lit("")),
        F.coalesce("location_departement", F.lit("")),
    )
    return ordered if limit is None else ordered.limit(limit)


def worklist_volume(worklist: DataFrame) -> DataFrame:
    """Entities on a work list and offers they cover; also the dry-run answer."""
    return worklist.agg(
        F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum("n_offers"), F.lit(0)).alias("n_offers_covered")
    )
