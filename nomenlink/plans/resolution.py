"""Resolution of offers and of contract roles, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.addresses import OFFER_ENTITY
from nomenlink.functions.names import name_norm
from nomenlink.operators import resolve as r
from nomenlink.operators.cache import PRUNE_PROBABILITY, cache_prune, cache_upsert
from nomenlink.operators.enrich import enrich_offers
from nomenlink.operators.worklist import work_list, worklist_volume
from nomenlink.schemas import CACHE_SCHEMA, CONFIDENCE_CACHE, CONFIDENCE_NONE, EntityColumns
from nomenlink.session import materialise
from nomenlink.sources.versions import publish, read_current


@dataclass(frozen=True)
class Resolution:
    """Rows with their identifiers, answers per distinct query, the new cache."""

    rows: DataFrame
    answers: DataFrame
    cache: DataFrame | None


def resolve_entities(
    rows: DataFrame,
    columns: EntityColumns,
    providers: list[r.Provider],
    cache: DataFrame | None = None,
    prune: float = PRUNE_PROBABILITY,
) -> Resolution:
    """Resolve each distinct entity of ``rows`` once and write it on every row.

    Rows with their keys and the answers are written to the shared folder. The
    rows are read for the distinct queries, for the frequent keys and for the
    answers put back, and parsing their addresses costs more than reading them;
    the answers make both the rows and the new cache.
    """
    queries = materialise(r.queries_of(rows, columns), f"asked-{columns.role.lower()}")
    answers = materialise(r.resolve(queries, providers, cache), f"answers-{columns.role.lower()}")
    back = r.map_back(queries, answers, columns.siren_col)
    kept = [*rows.columns, *([] if columns.siren_col in rows.columns else [columns.siren_col])]
    new_cache = None
    if cache is not None:
        found = answers.where(~F.col("confidence").isin(CONFIDENCE_NONE, CONFIDENCE_CACHE))
        stored = found.select("name", F.col("address_text").alias("address"), "siren")
        new_cache = cache_prune(cache_upsert(cache, stored), prune)
    return Resolution(back.select(*kept), answers, new_cache)


def resolve_role(
    rows: DataFrame,
    columns: EntityColumns,
    providers: list[r.Provider],
    cache: DataFrame | None = None,
    prune: float = PRUNE_PROBABILITY,
) -> Resolution:
    """One role of the contracts; ``resolve_roles`` runs several."""
    return resolve_entities(rows, columns, providers, cache, prune)


def resolve_roles(
    rows: DataFrame, roles: list[EntityColumns], providers: list[r.Provider], cache_root: str, prune: float = PRUNE_PROBABILITY
) -> Resolution:
    """All roles of the contracts, one after the other, with a stored cache between them.

    Each role reads the cache as the role before left it and publishes its own
    version, so an entity that occurs in several roles is compared once, and a
    later run starts from all of them. A share ``prune`` of the cache is dropped
    each time, to be looked up anew. The answers are those of the last role.
    """
    spark = rows.sparkSession
    done = None
    for columns in roles:
        cache = read_current(spark, cache_root, CACHE_SCHEMA)
        done = resolve_role(rows if done is None else done.rows, columns, providers, cache, prune)
        publish(done.cache, cache_root)
    return done


def dry_run(offers: DataFrame, min_offers: int = 1, limit: int | None = None) -> DataFrame:
    """What a run would treat, without treating it."""
    return worklist_volume(work_list(offers, min_offers, limit))


def resolve_offers(
    offers: DataFrame,
    providers: list[r.Provider],
    cache: DataFrame | None = None,
    min_offers: int = 1,
    limit: int | None = None,
) -> Resolution:
    """Work list, resolution, and identifiers on every offer.

    Entities are grouped by name key, so the answers reach all spellings.
    """
    entities = work_list(offers, min_offers, limit).withColumn("entity_name", F.col("entity_name_example"))
    done = resolve_entities(entities, OFFER_ENTITY, providers, cache)
    resolved = done.rows.select(
        "entity_name", "location_label", "location_zipcode", F.col(OFFER_ENTITY.siren_col).alias("siren")
    )
    return Resolution(enrich_offers(offers, resolved, name_norm), done.answers, done.cache)
