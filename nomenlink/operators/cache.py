"""Known answers by name and address, kept from one run to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.addresses import address_repr_norm, cache_key
from nomenlink.functions.hashing import fraction
from nomenlink.functions.identifiers import strip_whitespace
from nomenlink.operators.skew import salted_join
from nomenlink.schemas import CONFIDENCE_CACHE

# --- fixed values: share of the cache dropped per run, for re-checking
PRUNE_PROBABILITY = 0.01
PRUNE_SEED = 42

NAME_KEY, ADDRESS_KEY = "name_key", "address_key"


def _usable(siren: Column) -> Column:
    return F.coalesce(~siren.isin("", "nan"), F.lit(False))


def cache_index(cache: DataFrame, version: Column | None = None) -> DataFrame:
    """One identifier per key: that of the last row.

    ``version`` orders the rows; without it the highest identifier wins, since
    rows of a table have no order of their own.
    """
    version = F.col("siren") if version is None else version
    return (
        cache.where(_usable(F.col("siren")))
        .groupBy(
            F.lower(strip_whitespace(F.col("name"))).alias(NAME_KEY), address_repr_norm(F.col("address")).alias(ADDRESS_KEY)
        )
        .agg(F.max_by(F.col("siren"), F.struct(version, F.col("siren"))).alias("siren"))
    )


def cache_lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Queries with the cached identifier of their exact name and address."""
    if queries.isStreaming:
        # Batches of a stream are small, and their keys cannot be counted ahead.
        return queries.join(index, [NAME_KEY, ADDRESS_KEY], "left")
    return salted_join(queries, index, [NAME_KEY, ADDRESS_KEY], "left")


def with_keys(queries: DataFrame, name: str = "name", address_text: str = "address_text") -> DataFrame:
    name_key, address_key = cache_key(F.col(name), F.col(address_text))
    return queries.withColumns({NAME_KEY: name_key, ADDRESS_KEY: address_key})


def cache_upsert(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add the answers found by other means; exact repeats are stored once."""
    fresh = resolved.where(_usable(F.col("siren")))
    if "confidence" in resolved.columns:
        fresh = fresh.where(F.col("confidence") != CONFIDENCE_CACHE)
    columns = ["name", "address", "siren"]
    return cache.select(*columns).unionByName(fresh.select(*columns)).distinct()


def cache_prune(cache: DataFrame, probability: float = PRUNE_PROBABILITY, seed: int = PRUNE_SEED) -> DataFrame:
    """Drop a repeatable share of the rows, so that they are checked again."""
    if probability <= 0:
        return cache
    return cache.where(fraction(seed, *[F.col(name) for name in ("name", "address", "siren")]) > probability)
