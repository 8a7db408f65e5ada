"""The job-offer, register and contract tables, derived from the star schema.

The SQL of offers, register and contracts runs unchanged on Spark and on the
engine used for checks, so both start from the same rows. Keys of ``part`` and
``supplier`` run from 0 without gaps, so every row of them is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a spread table that one task takes.
_ROWS_PER_PART = 250_000

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

OFFERS_SQL = """
select o_orderkey as offer_id,
  case when o_orderkey % 23 = 0 then 'Confidentiel'
       when o_orderkey % 29 = 0 then ' '
       when o_orderkey % 31 = 0 then null
       when o_orderkey % 37 = 0 then 'Adecco ' || p_name
       else p_name end as entity_name,
  case when o_orderkey % 3 = 0 then cast(100000000 + ascii(p_name)*100 + length(p_name)
       + case when c_nationkey % 5 = 0 then p_partkey % 3 else 0 end as double) end as entity_siren,
  c_mktsegment as location_label,
  case when o_orderkey % 19 <> 0 then cast(1000 + c_nationkey*1000 + c_custkey % 5 as double) end as location_zipcode,
  lpad(cast(c_nationkey+1 as varchar(2)),2,'0') as location_departement
from (select *, o_orderkey % (select count(*) from part) as part_no from orders) o
join customer on o_custkey = c_custkey join part on part_no = p_partkey
"""

REGISTER_SQL = """
select lpad(cast(100000000+p_partkey as varchar(12)),9,'0') as siren,
  concat(lpad(cast(100000000+p_partkey as varchar(12)),9,'0'), lpad(cast(p_partkey % 100000 as varchar(12)),5,'0')) as siret,
  case when p_partkey % 7 = 0 then concat(upper(p_name),' SAS') else upper(p_name) end as raison_sociale,
  case when p_partkey % 11 = 0 then p_brand end as sigle,
  p_type as enseigne,
  cast(p_size as varchar(12)) as naf_ape,
  cast(null as varchar(12)) as naf_label,
  cast(1000 + (p_partkey % 25)*1000 + p_partkey % 5 as varchar(12)) as code_postal,
  case p_partkey % 5 when 0 then 'BUILDING' when 1 then 'MACHINERY' when 2 then 'FURNITURE'
       when 3 then 'HOUSEHOLD' else 'AUTOMOBILE' end as commune,
  lpad(cast(p_partkey % 25 + 1 as varchar(12)),2,'0') as code_departement,
  p_size % 2 = 0 as is_headquarters
from part
"""

# Public contracts: consortium, slash and ranked names, address texts as JSON,
# as a printed dictionary, as plain text and empty.
CONTRACTS_SQL = """
select l_rowid as contract_id,
  case when k % 13 = 0 then 'Groupement solidaire ' || p_name || ' (mandataire) / ' || p_brand || ' et ' || p_type
       when k % 11 = 0 then 'Groupement conjoint "' || p_name || '" - ' || p_type || ', ' || p_brand || ' & ' || p_name
       when k % 7 = 0 then p_name || ' / ' || p_brand
       when k % 5 = 0 then 'Rang 1  ' || upper(p_name)
       when k % 17 = 0 then 'Groupement public ' || p_name || '/' || p_type
       else p_name end as stated_name,
  case when k % 4 = 0 then '{"StreetName": {"#text": "' || s_name || '"}, "CityName": "' || n_name || '", "PostalZone": "' || cast(1000 + n_nationkey*1000 + k % 5 as varchar(12)) || '"}'
       when k % 4 = 1 then '{''StreetName'': ''' || s_name || ''', ''CityName'': None, ''PostalZone'': ''' || cast(1000 + n_nationkey*1000 + k % 5 as varchar(12)) || '''}'
       when k % 12 = 2 then ''
       when k % 4 = 2 or k % 8 = 3 then s_name || ' ' || n_name
       else null end as stated_address,
  s_name, n_name, cast(1000 + n_nationkey*1000 + k % 5 as varchar(12)) as n_zip,
  case when k % 3 = 0 then cast(1000 + n_nationkey*1000 + k % 5 as varchar(12)) || '.0' end as location_zipcode,
  case when k % 2 = 0 then n_name else 'nan' end as location_label,
  lpad(cast(n_nationkey+1 as varchar(2)),2,'0') as location_departement
from (select o_orderkey as l_rowid, o_orderkey as k, o_custkey, o_orderkey % (select count(*) from part) as part_no,
    o_orderkey % (select count(*) from supplier) as supplier_no from orders) o
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join part on part_no = p_partkey
join supplier on supplier_no = s_suppkey
"""

# Offers of many employers, most of them without an identifier anywhere.
EMPLOYER_OFFERS_SQL = """
select o_orderkey as offer_id,
  case when o_orderkey % 23 = 0 then 'Confidentiel'
       when o_orderkey % 29 = 0 then ' '
       when o_orderkey % 31 = 0 then null
       when o_orderkey % 37 = 0 then 'Crit ' || c_name
       when o_orderkey % 3 = 0 then 'Établissements ' || c_name
       when o_orderkey % 3 = 1 then ' ETABLISSEMENTS ' || upper(c_name)
       else c_name end as entity_name,
  case when o_custkey % 3 = 0 and o_orderkey % 2 = 0 then cast(5000000 + o_custkey as double) end as entity_siren,
  c_mktsegment as location_label,
  case when o_orderkey % 19 <> 0 then cast(1000 + c_nationkey*1000 + c_custkey % 5 as double) end as location_zipcode,
  lpad(cast(c_nationkey+1 as varchar(2)),2,'0') as location_departement
from orders join customer on o_custkey = c_custkey
"""

# Pairs of an offer's name and the name of an item of the same order.
NAME_PAIRS_SQL = """
select distinct lower(coalesce(entity_name, '')) as a, p_name || ' ' || lower(p_type) as b
from lineitem join offers_b on l_orderkey = offer_id join part on l_partkey = p_partkey
"""

# A classifier's output with many equal scores.
SCORED_SQL = """
select o_orderkey as pair_id, lower(o_orderpriority) as nom_key,
  case when o_orderkey % 101 = 7 then null else cast((o_orderkey * 7919) % 101 + (o_custkey % 13) * 5 > 80 as int) end as label,
  cast((o_orderkey * 7919) % 101 as double) / 100 as pred
from orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run a query on the given tables through prefixed temporary views."""

    def view(match: re.Match) -> str:
        keyword, name = match.groups()
        if name not in TABLES:
            return match.group(0)
        table(spark, sf_dir, name).createOrReplaceTempView(f"nomenlink_{name}")
        return f"{keyword} nomenlink_{name}"

    return spark.sql(re.sub(r"\b(from|join) (\w+)\b", view, query))


def _spread(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when their table is fewer files than there are cores.

    A table of one file and one row group is read by one task, however much
    work follows. Tables of many files are left as they are. A long table in
    few files becomes more parts than cores, so that no part grows with it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(source.inputFiles()) >= cores:
        return rows
    return rows.repartition(max(cores, -(-source.count() // _ROWS_PER_PART)), key)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(from_sql(spark, sf_dir, OFFERS_SQL), table(spark, sf_dir, "orders"), "offer_id")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, REGISTER_SQL)


def employer_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(from_sql(spark, sf_dir, EMPLOYER_OFFERS_SQL), table(spark, sf_dir, "orders"), "offer_id")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, NAME_PAIRS_SQL.replace("offers_b", f"({OFFERS_SQL}) offers_b"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, SCORED_SQL)


def register_pages(spark: SparkSession, sf_dir: str, page_size: int = 1000) -> DataFrame:
    """Nested register pages of bounded size, derived from the part table."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    siren = F.lpad((100000000 + key).cast("string"), 9, "0")
    name = F.when(key % 7 == 0, F.concat(F.upper("p_name"), F.lit(" SAS"))).otherwise(F.upper("p_name"))
    establishment = F.struct(
        F.when(key % 41 != 0, siren).alias("siren"),
        F.concat(siren, F.lpad((key % 100000).cast("string"), 5, "0")).alias("siret"),
        (F.col("p_size") % 2 == 0).alias("etablissementSiege"),
        F.struct(
            F.when(key % 3 == 0, name).alias("denominationUniteLegale"),
            F.when(key % 3 == 1, name).when(key % 3 == 0, F.lit("")).alias("nomUniteLegale"),
            F.when(key % 11 == 0, F.col("p_brand")).alias("sigleUniteLegale"),
        ).alias("uniteLegale"),
        F.when(
            key % 4 != 0,
            F.array(
                F.struct(
                    F.col("p_type").alias("enseigne1Etablissement"),
                    F.col("p_size").cast("string").alias("activitePrincipaleEtablissement"),
                )
            ),
        ).alias("periodesEtablissement"),
        F.struct(
            F.when(key % 13 != 0, (1000 + (key % 25) * 1000 + key % 5).cast("string")).alias("codePostalEtablissement"),
            F.concat(F.lit("COMMUNE "), (key % 5).cast("string")).alias("libelleCommuneEtablissement"),
        ).alias("adresseEtablissement"),
    )
    pages = p.groupBy(F.floor(key / page_size).alias("page")).agg(F.collect_list(establishment).alias("etablissements"))
    total = p.agg(F.count(F.lit(1))).scalar()
    header = F.struct(total.alias("total"), F.col("page").cast("string").alias("curseurSuivant")).alias("header")
    return pages.select("page", header, "etablissements")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(from_sql(spark, sf_dir, CONTRACTS_SQL), table(spark, sf_dir, "orders"), "contract_id")
