"""Write identifiers back onto every offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import clean_numeric_of, siren_norm, siren_norm_of
from nomenlink.operators.skew import salted_join
from nomenlink.schemas import ARTIFACT_COLUMNS


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def known_siren_by_entity(offers: DataFrame) -> DataFrame:
    """Highest identifier per raw name and place."""
    return offers.groupBy(
        "entity_name",
        "location_label",
        clean_numeric_of(offers, "location_zipcode").alias("location_zipcode"),
        clean_numeric_of(offers, "location_departement").alias("location_departement"),
    ).agg(F.max(siren_norm_of(offers, "entity_siren")).alias("known_siren"))


def _keyed(df: DataFrame, name_key: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns(
        {
            "_name": name_key(F.col("entity_name")),
            "_zip": F.coalesce(clean_numeric_of(df, "location_zipcode"), F.lit("")),
            "_label": F.coalesce("location_label", F.lit("")),
        }
    )


def enrich_offers(
    offers: DataFrame, resolved: DataFrame, name_key: Callable[[Column], Column] = lower_trim
) -> DataFrame:
    """Every offer with its own identifier, else a known one, else a resolved one.

    ``resolved`` has ``entity_name``, ``location_label``, ``location_zipcode``
    and ``siren``. Known and resolved identifiers become one table with one row
    per join key, so rows never multiply and the offers are shuffled once.
    Offers that carry an identifier or have no name skip the join.
    """
    keys = ["_name", "_zip", "_label"]
    offers = offers.drop(*ARTIFACT_COLUMNS)
    own = siren_norm_of(offers, "entity_siren")
    known = _keyed(offers.where(own.isNotNull()), name_key).select(
        *keys, own.alias("known"), F.lit(None).cast("string").alias("resolved")
    )
    found = _keyed(resolved, name_key).select(
        *keys, F.lit(None).cast("string").alias("known"), siren_norm(F.col("siren")).alias("resolved")
    )
    answers = (
        known.unionByName(found.where(F.col("resolved").isNotNull()))
        .groupBy(*keys)
        .agg(F.coalesce(F.max("known"), F.max("resolved")).alias("_answer"))
    )
    needy = own.isNull() & F.col("entity_name").isNotNull()
    columns = [name for name in offers.columns if name != "entity_siren"]
    settled = offers.where(~needy).select(*columns, own.alias("entity_siren"))
    answered = salted_join(_keyed(offers.where(needy), name_key), answers, keys, "left").select(
        *columns, F.col("_answer").alias("entity_siren")
    )
    return settled.unionByName(answered)
