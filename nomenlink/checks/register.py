"""Register preparation: nested pages and bulk files."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import REGISTER, check, department
from nomenlink.functions.registers import current_period, official_name
from nomenlink.plans.register_preparation import prepare_register
from nomenlink.session import run_dir
from nomenlink.sources import register as r

# What the nested pages hold, by construction.
PAGES = f"""nested as (select p_partkey as k, p_size, p_type, p_brand,
    lpad(cast(100000000 + p_partkey as varchar), 9, '0') as siren,
    case when p_partkey % 7 = 0 then upper(p_name) || ' SAS' else upper(p_name) end as name,
    case when p_partkey % 13 <> 0 then cast(1000 + (p_partkey % 25) * 1000 + p_partkey % 5 as varchar) end as zip from part),
flat as (select k, case when k % 41 <> 0 then siren end as siren, siren || lpad(cast(k % 100000 as varchar), 5, '0') as siret,
    case when k % 3 in (0, 1) then name when k % 11 = 0 then p_brand end as raison_sociale,
    case when k % 11 = 0 then p_brand end as sigle,
    case when k % 4 <> 0 then p_type end as enseigne,
    case when k % 4 <> 0 then cast(p_size as varchar) end as naf_ape,
    cast(null as varchar) as naf_label, zip as code_postal, 'COMMUNE ' || cast(k % 5 as varchar) as commune,
    {department('zip')} as code_departement, p_size % 2 = 0 as is_headquarters from nested),
establishments as (select * exclude (k) from flat where siren is not null and raison_sociale is not null)"""


def _establishments(spark, sf):
    return b.register_pages(spark, sf).select(F.explode("etablissements").alias("e"))


@check(
    "official_name",
    f"with {PAGES} select siret, raison_sociale as official_name from flat",
)
def official_name_(spark, sf):
    e = F.col("e")
    return _establishments(spark, sf).select(
        e["siret"].alias("siret"), official_name(e["uniteLegale"]).alias("official_name")
    )


@check("current_period", f"with {PAGES} select siret, enseigne, naf_ape from flat")
def current_period_(spark, sf):
    period = current_period(F.col("e")["periodesEtablissement"])
    return _establishments(spark, sf).select(
        F.col("e")["siret"].alias("siret"),
        period["enseigne1Etablissement"].alias("enseigne"),
        period["activitePrincipaleEtablissement"].alias("naf_ape"),
    )


@check("flatten_establishment", f"with {PAGES} select * from establishments")
def flatten_establishment(spark, sf):
    return r.flatten_pages(b.register_pages(spark, sf))


_STATUS = "case p_partkey % 5 when 0 then 'A' when 1 then 'actif' when 2 then 'F' when 3 then 'a' end"


@check(
    "active_only",
    f"""select p_partkey, upper(coalesce({_STATUS}, '')) in ('A', 'ACTIF') as kept from part""",
)
def active_only(spark, sf):
    from nomenlink.functions.identifiers import is_active

    return b.table(spark, sf, "part").select("p_partkey", is_active(F.expr(_STATUS)).alias("kept"))


def _bulk(spark, sf):
    """A bulk register under other column names, with gaps and closed rows."""
    number = F.col("siren").cast("long")
    return b.register(spark, sf).select(
        F.when(number % 17 != 0, F.concat(F.lit(" "), F.col("siren"))).alias("SIREN"),
        F.when(number % 19 != 0, F.col("siret")).alias("siret"),
        F.when(number % 5 == 0, "A").when(number % 5 == 1, "actif").when(number % 5 != 4, "a").otherwise("F").alias(
            "etat_administratif"
        ),
        F.col("raison_sociale").alias("Denomination_Unite_Legale"),
        "sigle",
        F.when(number % 2 == 0, F.lit(" ")).otherwise(F.col("enseigne")).alias("enseigne_1"),
        F.col("naf_ape").alias("code_naf"),
        "code_postal",
        F.when(number % 3 == 0, F.col("code_departement")).alias("department_code"),
        F.col("commune").alias("libelle_commune"),
        F.when(F.col("is_headquarters"), "oui").otherwise("non").alias("est_siege"),
    )


_BULK = f"""cleaned as (select siren, siret, raison_sociale, sigle,
    case when cast(siren as bigint) % 2 = 0 then null else enseigne end as enseigne, naf_ape,
    cast(null as varchar) as naf_label, code_postal, commune,
    case when cast(siren as bigint) % 3 = 0 then code_departement else {department('code_postal')} end as code_departement,
    is_headquarters
  from register where cast(siren as bigint) % 17 <> 0 and cast(siren as bigint) % 19 <> 0 and cast(siren as bigint) % 5 <> 4)"""


@check("keys_present", f"with {REGISTER}, {_BULK} select * from cleaned")
def keys_present(spark, sf):
    return r.clean_bulk_register(_bulk(spark, sf))


_SEARCH = "select siren, siret, raison_sociale, enseigne, code_postal, commune from"


@check(
    "register_search",
    f"""with {REGISTER} {_SEARCH} register where code_departement = '05' and lower(raison_sociale) like '%ring%'
    order by siret, siren limit 20""",
)
def register_search(spark, sf):
    return r.register_search(b.register(spark, sf), "05", "ring")


@check(
    "prepare_register",
    f"""with {REGISTER}, {_BULK} {_SEARCH} cleaned where code_departement = '20' and lower(raison_sociale) like '%bolt%'
    order by siret, siren limit 20""",
)
def prepare_register_(spark, sf):
    source, target = run_dir(spark, "bulk"), run_dir(spark, "register")
    _bulk(spark, sf).write.parquet(source)
    return prepare_register(spark, source, target, "20", "Bolt")
