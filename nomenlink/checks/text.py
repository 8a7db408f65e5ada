"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import (
    CONTRACTS,
    EMPLOYERS,
    OFFERS,
    REGISTER,
    blacklisted,
    check,
    department,
    name_key,
    number_text,
    siren_text,
)
from nomenlink.functions import addresses as a
from nomenlink.functions import identifiers as i
from nomenlink.functions import names as n
from nomenlink.sources.offers import drop_artifact_columns

# The parts of contract addresses, as they were put into the texts.
ADDRESSES = """
parsed as (select contract_id, contract_id as k, stated_name,
    case when k % 4 in (0, 1) then s_name when k % 12 = 2 then null when k % 4 = 2 or k % 8 = 3 then s_name || ' ' || n_name end as street,
    case when k % 4 in (0, 1) then n_zip end as zip_code,
    case when k % 4 = 0 then n_name end as city
  from (select *, contract_id as k from contracts)),
addresses as (select contract_id, stated_name,
    case when k % 4 in (0, 1) then s_name end as street,
    case when k % 4 in (0, 1) or k % 3 = 0 then n_zip end as zip_code,
    case when k % 4 = 1 then null when k % 2 = 0 then n_name when k % 8 = 3 then s_name || ' ' || n_name end as city,
    location_departement as department_hint
  from (select *, contract_id as k from contracts))
"""


@check(
    "clean_numeric",
    f"""with {OFFERS} select offer_id, {number_text('location_zipcode')} as zipcode,
    {number_text('location_departement')} as departement, {number_text('entity_siren')} as siren from offers""",
)
def clean_numeric(spark, sf):
    o = b.offers(spark, sf)
    return o.select(
        "offer_id",
        i.clean_numeric_of(o, "location_zipcode").alias("zipcode"),
        i.clean_numeric_of(o, "location_departement").alias("departement"),
        i.clean_numeric_of(o, "entity_siren").alias("siren"),
    )


@check("siren_norm", f"with {EMPLOYERS} select offer_id, {siren_text('entity_siren')} as siren from offers")
def siren_norm(spark, sf):
    o = b.employer_offers(spark, sf)
    return o.select("offer_id", i.siren_norm_of(o, "entity_siren").alias("siren"))


@check("name_norm", f"select doc_id, {name_key('text')} as key, {name_key('source')} as source_key from documents")
def name_norm(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", n.name_norm(F.col("text")).alias("key"), n.name_norm(F.col("source")).alias("source_key"))


@check(
    "is_blacklisted",
    f"""with {OFFERS} select 'offer' as kind, offer_id as id, {blacklisted('entity_name')} as is_blacklisted from offers
    union all select 'document', doc_id, {blacklisted('text')} from documents""",
)
def is_blacklisted(spark, sf):
    def flagged(df, kind, key, text):
        return df.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), n.is_blacklisted(F.col(text)).alias("is_blacklisted")
        )

    o, d = b.offers(spark, sf), b.table(spark, sf, "documents")
    return flagged(o, "offer", "offer_id", "entity_name").unionByName(flagged(d, "document", "doc_id", "text"))


@check(
    "clean_numeric_text",
    rf"""with {CONTRACTS} select contract_id,
    case when lower(trim(location_zipcode)) <> 'nan' then nullif(regexp_replace(trim(location_zipcode), '\.0$', ''), '') end as zipcode,
    case when lower(trim(location_label)) <> 'nan' then nullif(regexp_replace(trim(location_label), '\.0$', ''), '') end as label
    from contracts""",
)
def clean_numeric_text(spark, sf):
    c = b.contracts(spark, sf)
    return c.select(
        "contract_id",
        i.clean_numeric_text(F.col("location_zipcode")).alias("zipcode"),
        i.clean_numeric_text(F.col("location_label")).alias("label"),
    )


def _component_sql(c: str) -> str:
    t = f"trim(cast({c} as varchar))"
    return (
        f"case when lower({t}) in ('', 'nan', 'none') then null "
        rf"when regexp_full_match({t}, '[0-9]+\.0') then substr({t}, 1, length({t}) - 2) else {t} end"
    )


@check(
    "address_component",
    f"""with {CONTRACTS} select contract_id, {_component_sql('location_zipcode')} as zipcode,
    {_component_sql('location_label')} as label, {_component_sql('stated_name')} as name from contracts""",
)
def address_component(spark, sf):
    c = b.contracts(spark, sf)
    return c.select(
        "contract_id",
        a.address_component(F.col("location_zipcode")).alias("zipcode"),
        a.address_component(F.col("location_label")).alias("label"),
        a.address_component(F.col("stated_name")).alias("name"),
    )


_RANK = r"regexp_replace({c}, 'rang[\s\-]?1', '', 'gi')"


@check(
    "strip_rank_marker",
    f"with {CONTRACTS} select contract_id, trim({_RANK.format(c='stated_name')}) as name from contracts",
)
def strip_rank_marker(spark, sf):
    return b.contracts(spark, sf).select("contract_id", n.strip_rank_marker(F.col("stated_name")).alias("name"))


@check(
    "company_name_norm",
    rf"""with {CONTRACTS}
    select 'contract' as kind, contract_id as id, lower(trim(regexp_replace({_RANK.format(c='stated_name')}, '\s+', ' ', 'g'))) as name from contracts
    union all
    select 'document', doc_id, lower(trim(regexp_replace({_RANK.format(c='text')}, '\s+', ' ', 'g'))) from documents""",
)
def company_name_norm(spark, sf):
    def normalised(df, kind, key, text):
        return df.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), n.company_name_norm(F.col(text)).alias("name")
        )

    c, d = b.contracts(spark, sf), b.table(spark, sf, "documents")
    return normalised(c, "contract", "contract_id", "stated_name").unionByName(
        normalised(d, "document", "doc_id", "text")
    )


_CONSORTIUM = """(lower(stated_name) like '%groupement%' and lower(stated_name) not like '%public%'
    and (regexp_matches(stated_name, '[/,&-]') or contains(stated_name, '\\') or contains(lower(stated_name), ' et ')))"""


@check("is_consortium", f"with {CONTRACTS} select contract_id, {_CONSORTIUM} as is_consortium from contracts")
def is_consortium(spark, sf):
    return b.contracts(spark, sf).select("contract_id", n.is_consortium(F.col("stated_name")).alias("is_consortium"))


_BARE = r"""trim(regexp_replace(regexp_replace(regexp_replace({c}, '\([^)]*\)', '', 'g'), '["“”«»]', '', 'g'), '\s+', ' ', 'g'))"""
_NO_WORDS = "regexp_replace(stated_name, 'groupement( (solidaire|conjoint))?', '', 'gi')"
_SEPARATOR = r"(?i)\s*/\s*|\s*-\s*|\s*,\s*|\s+et\s+|\s*&\s*|\s*\\\\\s*"


def _members_sql(cleaned: str, separator: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({cleaned}, '{separator}'), lambda x: trim(x)), lambda x: x <> '')"
    return f"({parts})[1:10]"


_SPLIT_CONSORTIUM = _members_sql(_BARE.format(c=_NO_WORDS), _SEPARATOR)
_SPLIT_SLASH = _members_sql(_BARE.format(c="stated_name"), "/")
MEMBERS = f"""case when {_CONSORTIUM} then {_SPLIT_CONSORTIUM}
    when contains(stated_name, '/') and not contains(lower(stated_name), 'groupement') then {_SPLIT_SLASH}
    else [stated_name] end"""


def _exploded(members: str) -> str:
    return f"""with {CONTRACTS}, split as (select contract_id, {members} as members from contracts)
    select contract_id, cast(unnest(range(len(members))) as int) as pos, unnest(members) as member from split"""


def _explode(df, members):
    return df.select("contract_id", F.posexplode(members).alias("pos", "member"))


@check("split_consortium", _exploded(_SPLIT_CONSORTIUM))
def split_consortium(spark, sf):
    return _explode(b.contracts(spark, sf), n.split_consortium(F.col("stated_name")))


@check("split_slash", _exploded(_SPLIT_SLASH))
def split_slash(spark, sf):
    return _explode(b.contracts(spark, sf), n.split_slash(F.col("stated_name")))


_MANY = "concat_ws(' / ', stated_name, s_name, n_name, n_zip, stated_name, s_name, n_name, location_departement)"


@check(
    "member_limit",
    f"""with {CONTRACTS}, split as (select contract_id, {_members_sql(_BARE.format(c=_MANY), '/')} as members from contracts)
    select contract_id, len(members) as n_members, array_to_string(members, '|') as members from split""",
)
def member_limit(spark, sf):
    parts = ["stated_name", "s_name", "n_name", "n_zip", "stated_name", "s_name", "n_name", "location_departement"]
    members = n.split_slash(F.concat_ws(" / ", *parts))
    return b.contracts(spark, sf).select(
        "contract_id", F.size(members).cast("long").alias("n_members"), F.array_join(members, "|").alias("members")
    )


def _address_columns(addr, hint: bool = True):
    parts = ["street", "zip_code", "city"] + (["department_hint"] if hint else [])
    return [addr[part].alias(part) for part in parts]


@check("parse_address", f"with {CONTRACTS}, {ADDRESSES} select contract_id, street, zip_code, city from parsed")
def parse_address(spark, sf):
    c = b.contracts(spark, sf)
    return c.select("contract_id", *_address_columns(a.parse_address(F.col("stated_address")), hint=False))


@check(
    "address_from_context",
    f"""with {CONTRACTS} select contract_id, {_component_sql('stated_address')} as street,
    {_component_sql('coalesce(location_zipcode, n_zip)')} as zip_code, {_component_sql('location_label')} as city,
    {_component_sql('location_departement')} as department_hint from contracts""",
)
def address_from_context(spark, sf):
    c = b.contracts(spark, sf).select(
        "contract_id",
        F.col("stated_address").alias("street"),
        F.col("location_zipcode").alias("postal_code"),
        F.col("n_zip").alias("code_postal"),
        F.col("location_label").alias("ville"),
        F.col("location_departement").alias("departement"),
    )
    return c.select("contract_id", *_address_columns(a.address_from_context(c)))


def contract_entity(role: str = "CONTRACTING"):
    from nomenlink.schemas import EntityColumns

    return EntityColumns(name_col="stated_name", siren_col="siren", role=role, address_col="stated_address")


@check(
    "build_entity_address",
    f"with {CONTRACTS}, {ADDRESSES} select contract_id, street, zip_code, city, department_hint from addresses",
)
def build_entity_address(spark, sf):
    c = b.contracts(spark, sf)
    return c.select("contract_id", *_address_columns(a.entity_address(c, contract_entity())))


@check(
    "build_offer_address",
    f"""with {OFFERS} select offer_id, cast(null as varchar) as street, {number_text('location_zipcode')} as zip_code,
    location_label as city, location_departement as department_hint from offers""",
)
def build_offer_address(spark, sf):
    o = b.offers(spark, sf)
    return o.select("offer_id", *_address_columns(a.offer_address(o)))


@check(
    "department_of",
    f"""with {OFFERS} select offer_id, {department(number_text('location_zipcode'), 'location_departement')} as with_hint,
    {department(number_text('location_zipcode'))} as from_zip,
    {department("cast(97000 + offer_id % 2000 as varchar)")} as overseas from offers""",
)
def department_of(spark, sf):
    o = b.offers(spark, sf)
    zipcode = i.clean_numeric_of(o, "location_zipcode")
    return o.select(
        "offer_id",
        i.department_of(zipcode, F.col("location_departement")).alias("with_hint"),
        i.department_of(zipcode).alias("from_zip"),
        i.department_of((97000 + F.col("offer_id") % 2000).cast("string")).alias("overseas"),
    )


@check(
    "address_is_empty",
    f"""with {CONTRACTS}, {ADDRESSES} select contract_id, street is null and zip_code is null and city is null as stated_empty
    from parsed""",
)
def address_is_empty(spark, sf):
    parsed = a.parse_address(F.col("stated_address"))
    return b.contracts(spark, sf).select("contract_id", a.address_is_empty(parsed).alias("stated_empty"))


@check(
    "address_string",
    f"with {CONTRACTS}, {ADDRESSES} select contract_id, concat_ws(' ', street, zip_code, city) as address_text from addresses",
)
def address_string(spark, sf):
    c = b.contracts(spark, sf)
    return c.select("contract_id", a.address_string(a.entity_address(c, contract_entity())).alias("address_text"))


@check(
    "cache_key",
    f"""with {CONTRACTS}, {ADDRESSES} select contract_id, lower(trim(stated_name)) as name_key,
    lower(trim(concat_ws(' ', street, zip_code, city))) as address_key from addresses""",
)
def cache_key(spark, sf):
    c = b.contracts(spark, sf)
    name, addr = a.cache_key(F.col("stated_name"), a.address_string(a.entity_address(c, contract_entity())))
    return c.select("contract_id", name.alias("name_key"), addr.alias("address_key"))


@check(
    "address_repr_norm",
    f"""with {CONTRACTS}, {ADDRESSES} select contract_id, lower(concat_ws(' ', street, zip_code, city)) as address_key
    from parsed""",
)
def address_repr_norm(spark, sf):
    c = b.contracts(spark, sf)
    return c.select("contract_id", a.address_repr_norm(F.col("stated_address")).alias("address_key"))


_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"


def _siren_of(c: str) -> str:
    digits = _DIGITS.format(c=c)
    return f"case when length({digits}) in (9, 14) then substr({digits}, 1, 9) end"


@check(
    "siren_from_id",
    f"""with {REGISTER} select 'register' as kind, siret as id, {_siren_of("substr(siret, 1, 3) || ' ' || substr(siret, 4)")} as siren from register
    union all select 'document', cast(doc_id as varchar), {_siren_of('text')} from documents""",
)
def siren_from_id(spark, sf):
    siret = F.concat_ws(" ", F.substring("siret", 1, 3), F.substring("siret", 4, 99))
    r = b.register(spark, sf).select(
        F.lit("register").alias("kind"), F.col("siret").alias("id"), i.siren_from_id(siret).alias("siren")
    )
    d = b.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), i.siren_from_id(F.col("text")).alias("siren")
    )
    return r.unionByName(d)


_LINK = """url || case page_id % 4 when 0 then '/' || cast(12345678900000 + page_id as varchar(20)) || '/'
    when 1 then '/' || cast(123456000 + page_id as varchar(20)) when 2 then '-9' || cast(123456000 + page_id as varchar(20)) || '/' else '' end"""


@check(
    "siren_from_url",
    f"""with links as (select page_id, {_LINK} as link from pages)
    select page_id, coalesce(nullif(substr(regexp_extract(link, '([0-9]{{14}})/?$', 1), 1, 9), ''),
    nullif(regexp_extract(link, '([0-9]{{9}})/?$', 1), '')) as siren from links""",
)
def siren_from_url(spark, sf):
    p = b.table(spark, sf, "pages").withColumn("link", F.expr(_LINK))
    return p.select("page_id", i.siren_from_url(F.col("link")).alias("siren"))


@check(
    "is_headquarters",
    """select p_partkey, p_size % 2 = 0 as from_flag, upper(trim(p_type)) in ('OUI', '1', 'TRUE') as from_type,
    p_size = 1 as from_number from part""",
)
def is_headquarters(spark, sf):
    p = b.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        i.is_headquarters(F.col("p_size") % 2 == 0).alias("from_flag"),
        i.is_headquarters(F.col("p_type")).alias("from_type"),
        i.is_headquarters(F.col("p_size")).alias("from_number"),
    )


@check(
    "blank_to_null",
    f"with {OFFERS} select offer_id, nullif(trim(entity_name), '') as name from offers",
)
def blank_to_null(spark, sf):
    return b.offers(spark, sf).select("offer_id", i.blank_to_null(F.col("entity_name")).alias("name"))


@check(
    "ascii_fold",
    r"select doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') as folded from documents",
)
def ascii_fold(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", n.ascii_fold(F.col("text")).alias("folded"))


@check(
    "zip_ok_weight",
    f"""with {OFFERS} select offer_id, cast(case when length({number_text('location_zipcode')}) = 5 then 1.0 else 0.5 end as double) as weight
    from offers""",
)
def zip_ok_weight(spark, sf):
    o = b.offers(spark, sf)
    return o.select("offer_id", i.zip_ok_weight(i.clean_numeric_of(o, "location_zipcode")).alias("weight"))


@check("safe_text", f"with {OFFERS} select offer_id, coalesce(entity_name, '') as name from offers")
def safe_text(spark, sf):
    return b.offers(spark, sf).select("offer_id", i.safe_text(F.col("entity_name")).alias("name"))


@check("drop_artifact_columns", f"with {OFFERS} select * from offers")
def drop_artifact(spark, sf):
    o = b.offers(spark, sf)
    return drop_artifact_columns(o.withColumn("__index_level_0__", F.col("offer_id")))
