"""Registration of queries and SQL fragments shared by their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nomenlink import bindings
from nomenlink.functions.names import AGENCY_PATTERNS, PLACEHOLDER_NAMES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


# ---------------------------------------------------------------------------
# SQL fragments


def number_text(c: str) -> str:
    return rf"regexp_replace(cast({c} as varchar), '\.0+$', '')"


def siren_text(c: str) -> str:
    x = number_text(c)
    return f"case when regexp_full_match({x}, '[0-9]+') then nullif(lpad({x}, 9, '0'), '000000000') end"


def name_key(c: str) -> str:
    return f"lower(strip_accents(trim({c})))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blacklisted(c: str) -> str:
    """Placeholder test of a raw name: the fixed values, folded here by SQL."""
    folded = name_key(c)
    held = ", ".join(name_key(_quoted(value)) for value in PLACEHOLDER_NAMES)
    agencies = ", ".join(_quoted(value) for value in AGENCY_PATTERNS)
    return (
        f"(length({folded}) < 2 or list_contains([{held}], {folded}) "
        f"or len(list_filter([{agencies}], lambda agency: contains({folded}, agency))) > 0)"
    )


def named(c: str) -> str:
    return f"({c} is not null and trim({c}) <> '')"


def department(zip_code: str, hint: str = "null") -> str:
    z = f"trim({zip_code})"
    return (
        f"coalesce(case when length({z}) >= 3 and substr({z}, 1, 2) in ('97', '98') then substr({z}, 1, 3) "
        f"when length({z}) >= 2 then substr({z}, 1, 2) end, {hint})"
    )


def hash_number(seed: object, *keys: str) -> str:
    return f"cast('0x' || substr({digest(seed, *keys)}, 1, 8) as bigint)"


def wide_number(seed: object, *keys: str) -> str:
    return f"cast('0x' || substr({digest(seed, *keys)}, 1, 15) as bigint)"


def digest(seed: object, *keys: str) -> str:
    parts = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


OFFERS = f"offers as ({bindings.OFFERS_SQL})"
EMPLOYERS = f"offers as ({bindings.EMPLOYER_OFFERS_SQL})"
REGISTER = f"register as ({bindings.REGISTER_SQL})"
CONTRACTS = f"contracts as ({bindings.CONTRACTS_SQL})"
SCORED = f"scored as ({bindings.SCORED_SQL})"

# One window per name tells whether any of its rows has an identifier.
UNRESOLVED = f"""
named_offers as (select *, max(siren) over (partition by name_key) as known_siren from (
  select entity_name, {name_key('entity_name')} as name_key, {siren_text('entity_siren')} as siren
  from offers where {named('entity_name')})),
known as (select distinct name_key, known_siren from named_offers where known_siren is not null),
unresolved_raw as (select entity_name, name_key from named_offers where known_siren is null),
unresolved as (from unresolved_raw where not {blacklisted('entity_name')})
"""

NORM = f"""
norm as (select offer_id as row_id, entity_name as entreprise_nom, {name_key('entity_name')} as nom_key,
    {siren_text('entity_siren')} as siren_norm, location_label, {name_key('location_label')} as city_key,
    {number_text('location_zipcode')} as zipcode_norm, {number_text('location_departement')} as dept_norm,
    {blacklisted('entity_name')} as is_blacklisted
  from offers where {named('entity_name')} and length({name_key('entity_name')}) >= 3)
"""

KNOWN_GROUPS = """
known as (select distinct siren_norm as target_siren, nom_key, city_key, zipcode_norm, dept_norm,
    first_value(entreprise_nom) over (same order by entreprise_nom nulls last
      rows between unbounded preceding and unbounded following) as known_entreprise_nom,
    min(location_label) over same as known_location_label, count(*) over same as n_known_rows
  from norm where not is_blacklisted and siren_norm is not null
  window same as (partition by siren_norm, nom_key, city_key, zipcode_norm, dept_norm))
"""

_GEO = {"department": ["dept_norm"], "zipcode": ["zipcode_norm"], "city_zipcode": ["city_key", "zipcode_norm"]}


def positives(level: str = "department", unambiguous: bool = True) -> str:
    """Rows without identifier beside the known groups of their name and place.

    The number of identifiers of a place is a window over the known groups, so
    one join is all there is.
    """
    place = _GEO[level]
    here = ", ".join(f"n.{c}" for c in place)
    there = ", ".join(f"g.{c}" for c in place)
    return f"""
placed as (select *, count(distinct target_siren) over (partition by nom_key, {', '.join(place)}) as n_sirens_at_grain
  from known),
grains as (select distinct nom_key, {', '.join(place)}, n_sirens_at_grain from placed),
positives as (select n.row_id as missing_row_id, n.entreprise_nom as missing_entreprise_nom,
    n.location_label as missing_location_label, n.nom_key, n.city_key, n.zipcode_norm, n.dept_norm, g.target_siren,
    g.known_entreprise_nom, g.known_location_label, g.n_known_rows, g.n_sirens_at_grain, cast(1 as int) as label
  from placed g join norm n on g.nom_key = n.nom_key and row({there}) is not distinct from row({here})
  where n.siren_norm is null and not n.is_blacklisted and n.{place[-1]} <> ''{' and g.n_sirens_at_grain = 1' if unambiguous else ''})
"""
