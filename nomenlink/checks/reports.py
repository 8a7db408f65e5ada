"""Coverage reports, work list and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import (
    EMPLOYERS,
    OFFERS,
    UNRESOLVED,
    blacklisted,
    check,
    name_key,
    named,
    number_text,
    siren_text,
)
from nomenlink.functions.identifiers import clean_numeric_of
from nomenlink.functions.names import has_name, is_blacklisted
from nomenlink.operators import coverage as c
from nomenlink.operators import enrich as e
from nomenlink.operators import worklist as w
from nomenlink.plans.diagnostics import diagnostics_lines
from nomenlink.plans.resolution import dry_run
from nomenlink.sources.columns import register_view

# ---------------------------------------------------------------------------
# Filters


@check("has_name", f"with {OFFERS} select offer_id, entity_name from offers where {named('entity_name')}")
def has_name_(spark, sf):
    return b.offers(spark, sf).where(has_name(F.col("entity_name"))).select("offer_id", "entity_name")


@check(
    "name_min_len",
    f"with {OFFERS} select offer_id, entity_name from offers where {named('entity_name')} and length(trim(entity_name)) >= 10",
)
def name_min_len(spark, sf):
    o = b.offers(spark, sf)
    return o.where(has_name(F.col("entity_name")) & (F.length(F.trim("entity_name")) >= 10)).select(
        "offer_id", "entity_name"
    )


@check(
    "not_blacklisted",
    f"with {OFFERS} select offer_id, entity_name from offers where {named('entity_name')} and not {blacklisted('entity_name')}",
)
def not_blacklisted(spark, sf):
    o = b.offers(spark, sf)
    return o.where(has_name(F.col("entity_name")) & ~is_blacklisted(F.col("entity_name"))).select(
        "offer_id", "entity_name"
    )


@check(
    "zip_present",
    f"""with {OFFERS} select offer_id, {number_text('location_zipcode')} as zipcode from offers
    where {number_text('location_zipcode')} is not null""",
)
def zip_present(spark, sf):
    o = b.offers(spark, sf)
    rows = o.select("offer_id", clean_numeric_of(o, "location_zipcode").alias("zipcode"))
    return rows.where(F.col("zipcode").isNotNull())


# ---------------------------------------------------------------------------
# Coverage


def _coverage_sql(source: str) -> str:
    return f"""with {source}, {UNRESOLVED},
counts as (select (select count(*) from offers) as total_offers,
  (select count(*) from offers where not {named('entity_name')}) as offers_without_name,
  (select count(*) from offers where {named('entity_name')} and {blacklisted('entity_name')}) as offers_placeholder_name,
  (select count(*) from unresolved_raw) as offers_unresolved,
  (select count(*) from unresolved) as offers_target)
select *, round(cast(100 as double) * offers_target / total_offers, 2) as pct_target_of_total,
  round(cast(100 as double) * offers_target / nullif(total_offers - offers_without_name, 0), 2) as pct_target_of_named
from counts"""


check("coverage", _coverage_sql(OFFERS))(lambda spark, sf: c.coverage(b.offers(spark, sf)))
check("coverage_of_employers", _coverage_sql(EMPLOYERS))(lambda spark, sf: c.coverage(b.employer_offers(spark, sf)))


def _top_sql(source: str, n: int) -> str:
    return f"""with {EMPLOYERS}, {UNRESOLVED} select entity_name, count(*) as n_offers from {source}
    group by entity_name order by n_offers desc, entity_name limit {n}"""


@check("top_entities", _top_sql("unresolved", 30))
def top_entities(spark, sf):
    return c.top_entities(b.employer_offers(spark, sf), 30)


@check("top_entities_with_placeholders", _top_sql("unresolved_raw", 15))
def top_entities_with_placeholders(spark, sf):
    return c.top_entities(b.employer_offers(spark, sf), 15, include_blacklisted=True)


_YIELD = f"""freq as (select name_key, count(*) as n from unresolved group by name_key),
steps as (select unnest([{', '.join(map(str, c.YIELD_THRESHOLDS))}]) as threshold),
yields as (select s.threshold, count(f.n) as entities, sum(f.n) as offers_covered,
  (select count(*) from freq) as all_entities, (select sum(n) from freq) as all_offers
  from steps s left join freq f on f.n >= s.threshold group by s.threshold)"""
_YIELD_COLUMNS = """cast(threshold as int) as threshold, entities,
  round(cast(100 as double) * entities / nullif(all_entities, 0), 2) as pct_entities,
  cast(offers_covered as bigint) as offers_covered,
  round(cast(100 as double) * offers_covered / nullif(all_offers, 0), 2) as pct_offers"""


@check("yield_curve", f"with {EMPLOYERS}, {UNRESOLVED}, {_YIELD} select {_YIELD_COLUMNS} from yields")
def yield_curve(spark, sf):
    return c.yield_curve(b.employer_offers(spark, sf))


@check(
    "known_siren_by_name",
    f"with {EMPLOYERS}, {UNRESOLVED} select name_key, known_siren from known",
)
def known_siren_by_name(spark, sf):
    return c.known_siren_by_name(b.employer_offers(spark, sf))


@check(
    "recoverable_by_name",
    f"""with {EMPLOYERS}, {UNRESOLVED} select o.offer_id, k.name_key, k.known_siren from offers o
    join known k on {name_key('o.entity_name')} = k.name_key where {named('o.entity_name')} and {siren_text('o.entity_siren')} is null""",
)
def recoverable_by_name(spark, sf):
    return c.recoverable_by_name(b.employer_offers(spark, sf)).select("offer_id", "name_key", "known_siren")


@check(
    "unrecoverable_offers",
    f"""with {EMPLOYERS}, {UNRESOLVED} select o.offer_id, o.entity_name from offers o
    where {named('o.entity_name')} and {siren_text('o.entity_siren')} is null
    and not exists (select 1 from known k where k.name_key = {name_key('o.entity_name')})""",
)
def unrecoverable_offers(spark, sf):
    return c.unrecoverable_offers(b.employer_offers(spark, sf)).select("offer_id", "entity_name")


def _lines(report: str, source: str, item: str, measures: list[str]) -> str:
    return " union all ".join(
        f"select '{report}' as report, {item} as item, '{m}' as measure, cast({m} as double) as value from {source}"
        for m in measures
    )


_COVERAGE_MEASURES = [
    "total_offers", "offers_without_name", "offers_placeholder_name", "offers_unresolved", "offers_target",
    "pct_target_of_total", "pct_target_of_named",
]


@check(
    "diagnostics_report",
    f"""with {EMPLOYERS}, {UNRESOLVED}, {_YIELD}, curve as (select {_YIELD_COLUMNS} from yields),
    cover as ({_coverage_sql(EMPLOYERS)}),
    clean as (select entity_name, count(*) as n_offers from unresolved group by entity_name order by n_offers desc, entity_name limit 30),
    raw as (select entity_name, count(*) as n_offers from unresolved_raw group by entity_name order by n_offers desc, entity_name limit 15)
    {_lines('coverage', 'cover', "'all'", _COVERAGE_MEASURES)}
    union all {_lines('top_clean', 'clean', 'entity_name', ['n_offers'])}
    union all {_lines('top_raw', 'raw', 'entity_name', ['n_offers'])}
    union all {_lines('yield_curve', 'curve', 'cast(threshold as varchar)', ['entities', 'pct_entities', 'offers_covered', 'pct_offers'])}""",
)
def diagnostics_report(spark, sf):
    return diagnostics_lines(b.employer_offers(spark, sf))


# ---------------------------------------------------------------------------
# Work list

_BASE = f"""base as (select {name_key('entity_name')} as name_key, entity_name, location_label,
    {number_text('location_zipcode')} as location_zipcode, {number_text('location_departement')} as location_departement,
    {siren_text('entity_siren')} as siren
  from offers where {named('entity_name')} and length(trim(entity_name)) >= 3 and not {blacklisted('entity_name')}
    and {number_text('location_zipcode')} is not null)"""


def work_list_ctes(min_offers: int = 1, limit: int | None = 100) -> str:
    """One grouping of the offers; the places of a name are counted by a window before it."""
    weight = "cast(if(length(location_zipcode) = 5, 1.0, 0.5) as double)"
    return f"""{_BASE},
spread as (select *, count(distinct location_zipcode) over (partition by name_key) as places from base),
ranked as (select location_zipcode, location_departement, location_label, name_key,
    min(entity_name) as entity_name_example, max(places) as n_locations, count(*) as n_offers,
    round(count(*) * ln(1 + max(places)) * {weight}, 9) as priority_score
  from spread group by name_key, location_zipcode, location_departement, location_label
  having max(siren) is null and count(*) >= {min_offers}),
entities as (select * exclude (n_locations, priority_score) from ranked),
stats as (select name_key, any_value(places) as n_locations from spread group by name_key),
work as (select * from ranked order by priority_score desc, n_offers desc, name_key, location_zipcode,
  coalesce(location_label, ''), coalesce(location_departement, ''){f' limit {limit}' if limit else ''})"""


@check("resolvable_offers", f"with {OFFERS}, {_BASE} select * from base")
def resolvable_offers(spark, sf):
    return w.resolvable_offers(b.offers(spark, sf))


@check("entity_stats", f"with {OFFERS}, {work_list_ctes()} select * from stats")
def entity_stats(spark, sf):
    return w.entity_stats(b.offers(spark, sf))


@check("unresolved_entities", f"with {OFFERS}, {work_list_ctes()} select * from entities")
def unresolved_entities(spark, sf):
    return w.unresolved_entities(b.offers(spark, sf))


@check("min_offers", f"with {OFFERS}, {work_list_ctes(2)} select * from entities")
def min_offers(spark, sf):
    return w.unresolved_entities(b.offers(spark, sf), min_offers=2)


@check("entity_priority", f"with {OFFERS}, {work_list_ctes()} select * from ranked")
def entity_priority(spark, sf):
    return w.entity_priority(b.offers(spark, sf))


@check("order_priority", f"with {OFFERS}, {work_list_ctes()} select * from work")
def order_priority(spark, sf):
    return w.work_list(b.offers(spark, sf))


@check(
    "worklist_volume",
    f"""with {EMPLOYERS}, {work_list_ctes()} select count(*) as n_entities,
    cast(coalesce(sum(n_offers), 0) as bigint) as n_offers_covered from ranked""",
)
def worklist_volume(spark, sf):
    return dry_run(b.employer_offers(spark, sf), limit=None)


# ---------------------------------------------------------------------------
# Enrichment


@check(
    "known_siren_by_entity",
    f"""with {OFFERS} select entity_name, location_label, {number_text('location_zipcode')} as location_zipcode,
    location_departement, max({siren_text('entity_siren')}) as known_siren from offers group by all""",
)
def known_siren_by_entity(spark, sf):
    return e.known_siren_by_entity(b.offers(spark, sf))


# Answers for a part of the work list, as a resolver would give them.


def _resolved(offers):
    entities = w.unresolved_entities(offers)
    siren = (200000000 + F.length("name_key") * 1000 + F.col("n_offers")).cast("string")
    return entities.where(F.length("location_zipcode") == 5).select(
        F.col("entity_name_example").alias("entity_name"), "location_label", "location_zipcode", siren.alias("siren")
    )


_ENRICHED = f"""resolved as (select entity_name_example as entity_name, location_label, location_zipcode,
    cast(200000000 + length(name_key) * 1000 + n_offers as varchar) as siren from entities where length(location_zipcode) = 5),
keyed as (select *, lower(trim(entity_name)) as k_name, coalesce({number_text('location_zipcode')}, '') as k_zip,
    coalesce(location_label, '') as k_label, {siren_text('entity_siren')} as own from offers),
known_keys as (select k_name, k_zip, k_label, max(own) as known_siren from keyed group by all),
resolved_keys as (select lower(trim(entity_name)) as k_name, coalesce(location_zipcode, '') as k_zip,
    coalesce(location_label, '') as k_label, max({siren_text('siren')}) as resolved_siren from resolved group by all),
enriched as (select j.offer_id, j.entity_name, j.location_label, j.location_zipcode, j.location_departement,
    coalesce(j.own, k.known_siren, r.resolved_siren) as entity_siren
  from keyed j left join known_keys k on j.k_name = k.k_name and j.k_zip = k.k_zip and j.k_label = k.k_label
  left join resolved_keys r on j.k_name = r.k_name and j.k_zip = r.k_zip and j.k_label = r.k_label)"""

ENRICHED_SQL = f"with {OFFERS}, {work_list_ctes()}, {_ENRICHED} select * from enriched"


def enriched(spark, sf):
    offers = b.offers(spark, sf)
    return e.enrich_offers(offers, _resolved(offers))


check("enrich_offers", ENRICHED_SQL)(enriched)


@check(
    "register_view",
    f"""with {OFFERS} select location_departement, count(*) as n_offers, count(entity_siren) as n_with_siren
    from offers group by location_departement""",
)
def register_view_(spark, sf):
    register_view(b.offers(spark, sf), "nomenlink_offers_view")
    return spark.sql(
        """select location_departement, count(*) as n_offers, count(entity_siren) as n_with_siren
        from nomenlink_offers_view group by location_departement"""
    )

