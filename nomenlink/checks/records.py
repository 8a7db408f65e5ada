"""Sources and sinks: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import CONTRACTS, KNOWN_GROUPS, NORM, OFFERS, REGISTER, check, digest, positives
from nomenlink.checks.reports import ENRICHED_SQL, enriched
from nomenlink.operators import silver as s
from nomenlink.operators.sampling import audit_sample
from nomenlink.schemas import CACHE_SCHEMA, OFFER_COLUMNS
from nomenlink.session import materialise, run_dir
from nomenlink.sources import files, offers, register

_NAMES = {target: source for source, target in OFFER_COLUMNS.items()}


@check(
    "scan_offers",
    f"""with {OFFERS} select offers.*, cast(year(o_orderdate) as varchar) as annee, cast(month(o_orderdate) as varchar) as mois
    from offers join orders on offer_id = o_orderkey""",
)
def scan_offers(spark, sf):
    """Files of two layouts under year and month folders, read as one table."""
    dated = (
        b.offers(spark, sf)
        .join(b.table(spark, sf, "orders"), F.col("offer_id") == F.col("o_orderkey"))
        .withColumns({"annee": F.year("o_orderdate"), "mois": F.month("o_orderdate")})
        .withColumnsRenamed(_NAMES)
        .select("offer_id", *_NAMES.values(), "annee", "mois")
    )
    root = run_dir(spark, "offers")
    even = dated.where(F.col("annee") % 2 == 0).withColumn("__index_level_0__", F.col("offer_id"))
    even.write.partitionBy("annee", "mois").parquet(root)
    odd = dated.where(F.col("annee") % 2 == 1).select(*reversed(dated.columns))
    odd.write.mode("append").partitionBy("annee", "mois").parquet(root)
    return offers.drop_artifact_columns(offers.scan_offers(spark, root))


def _written_register(spark, sf):
    root = run_dir(spark, "register")
    register.write_register_partitioned(b.register(spark, sf), root)
    return root


@check("write_register_partitioned", f"with {REGISTER} select * from register")
def write_register_partitioned(spark, sf):
    return register.scan_register(spark, _written_register(spark, sf))


@check("scan_register_all", f"with {REGISTER} select siret, code_departement from register")
def scan_register_all(spark, sf):
    return register.scan_register(spark, _written_register(spark, sf)).select("siret", "code_departement")


@check("scan_register_partition", f"with {REGISTER} select * from register where code_departement = '05'")
def scan_register_partition(spark, sf):
    return register.scan_register(spark, _written_register(spark, sf), "05")


@check("scan_missing_partition_empty", f"with {REGISTER} select * from register where code_departement = '2A'")
def scan_missing_partition_empty(spark, sf):
    return register.scan_register(spark, _written_register(spark, sf), "2A")


@check(
    "append_register_batch",
    f"""with {REGISTER} select * replace (case when cast(siren as bigint) % 10 = 0 then 'inconnu' else code_departement end as code_departement)
    from register""",
)
def append_register_batch(spark, sf):
    number = F.col("siren").cast("long")
    rows = b.register(spark, sf).withColumn("code_departement", F.when(number % 10 != 0, F.col("code_departement")))
    root = run_dir(spark, "batches")
    register.append_register_batch(rows.where(number % 2 == 0), root)
    register.append_register_batch(rows.where(number % 2 == 1), root)
    return register.scan_register(spark, root)


@check(
    "scan_cache",
    f"with {CONTRACTS} select stated_name as name, n_zip as address, location_departement as siren from contracts",
)
def scan_cache(spark, sf):
    path = run_dir(spark, "cache")
    absent = files.scan_cache(spark, path)
    rows = b.contracts(spark, sf).select(
        F.col("stated_name").alias("name"), F.col("n_zip").alias("address"), F.col("location_departement").alias("siren")
    )
    absent.unionByName(rows).write.parquet(path)
    return files.scan_cache(spark, path).select(*CACHE_SCHEMA.fieldNames())


@check(
    "scan_work_list",
    f"""with {CONTRACTS} select contract_id, stated_name, stated_address, 'CONTRACTING' as role from contracts
    union all select contract_id, s_name, null, 'AWARDED' from contracts""",
)
def scan_work_list(spark, sf):
    c = b.contracts(spark, sf)
    paths = {"CONTRACTING": run_dir(spark, "contracting"), "AWARDED": run_dir(spark, "awarded")}
    c.select("contract_id", "stated_name", "stated_address").write.parquet(paths["CONTRACTING"])
    c.select("contract_id", F.col("s_name").alias("stated_name")).write.parquet(paths["AWARDED"])
    return offers.scan_work_list(spark, paths)


def written_norm(spark, sf):
    """The normalised offers, written once for operators that read them several times."""
    return materialise(s.normalised_offers(b.offers(spark, sf), "offer_id"), "norm")


def silver_pairs(spark, sf):
    return s.silver_positives(written_norm(spark, sf))


SILVER_SQL = f"with {OFFERS}, {NORM}, {KNOWN_GROUPS}, {positives()}"

_AUDIT_COLUMNS = """missing_row_id, missing_entreprise_nom, missing_location_label, zipcode_norm, dept_norm,
  target_siren, known_entreprise_nom, known_location_label, n_known_rows, n_sirens_at_grain"""
AUDIT_SQL = f"""{SILVER_SQL}, audit as (select {_AUDIT_COLUMNS}, '' as audit_decision, '' as audit_comment from positives
  order by {digest(42, *[c.strip() for c in _AUDIT_COLUMNS.split(',')])} limit 1000)"""


@check(
    "csv_roundtrip",
    f"{AUDIT_SQL} select nullif(columns(*)::varchar, '') from audit",
)
def csv_roundtrip(spark, sf):
    path = run_dir(spark, "audit") + ".csv"
    files.write_csv(audit_sample(silver_pairs(spark, sf)), path)
    return files.read_csv(spark, path)


@check(
    "load_gold_pairs",
    f"""{SILVER_SQL} select missing_entreprise_nom, known_entreprise_nom, target_siren, label,
    cast(null as varchar) as missing_location_label, cast(null as varchar) as known_location_label,
    cast(null as varchar) as city_key, cast(null as varchar) as zipcode_norm, cast(null as varchar) as dept_norm,
    cast(1 as bigint) as n_known_rows, lower(missing_entreprise_nom) as nom_key from positives""",
)
def load_gold_pairs(spark, sf):
    path = run_dir(spark, "gold") + ".csv"
    gold = silver_pairs(spark, sf).select(
        "missing_entreprise_nom",
        F.col("known_entreprise_nom").alias("candidate_name"),
        F.col("target_siren").alias("candidate_siren"),
        "label",
    )
    files.write_csv(gold, path)
    return files.load_gold_pairs(spark, path)


@check("write_pairs", f"{SILVER_SQL} select * from positives")
def write_pairs(spark, sf):
    path = run_dir(spark, "pairs")
    files.write_pairs(silver_pairs(spark, sf), path)
    return spark.read.parquet(path)


@check("write_enriched", ENRICHED_SQL)
def write_enriched(spark, sf):
    path = run_dir(spark, "enriched")
    offers.write_enriched(enriched(spark, sf), path)
    return spark.read.parquet(path)


@check("write_all_string", f"with {REGISTER} select columns(*)::varchar from register")
def write_all_string(spark, sf):
    path = run_dir(spark, "strings")
    offers.write_all_string(b.register(spark, sf), path)
    return spark.read.parquet(path)
