"""The register of establishments: cleaning, partitioned files, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import blank_to_null, department_of, is_active, is_headquarters
from nomenlink.functions.registers import establishment_fields
from nomenlink.schemas import BULK_SYNONYMS, REGISTER_SCHEMA, UNKNOWN_DEPARTMENT
from nomenlink.sources.columns import choose_column, require_columns, text_partitions

# --- fixed value: rows shown by a search
SEARCH_LIMIT = 20

REGISTER_COLUMNS = REGISTER_SCHEMA.fieldNames()


def scan_register(spark: SparkSession, root: str, department: str | None = None) -> DataFrame:
    """The register, or one department of it; a department without files is empty."""
    with text_partitions(spark):
        rows = spark.read.schema(REGISTER_SCHEMA).parquet(root).select(*REGISTER_COLUMNS)
    return rows if department is None else rows.where(F.col("code_departement") == department)


def clean_bulk_register(raw: DataFrame) -> DataFrame:
    """The eleven register columns from a bulk file with columns of many names.

    Closed establishments and rows without identifiers are dropped; the
    department comes from its own column or from the postal code.
    """
    spelled = {name: choose_column(raw.columns, synonyms) for name, synonyms in BULK_SYNONYMS.items()}
    absent = [name for name in ("siren", "siret", "raison_sociale") if spelled[name] is None]
    if absent:
        raise ValueError(f"no column for {absent} among {raw.columns}")

    def field(name: str) -> Column | None:
        return F.col(spelled[name]) if spelled[name] else None

    def text(name: str) -> Column:
        column = field(name)
        return F.lit(None).cast("string") if column is None else blank_to_null(column.cast("string"))

    department = F.coalesce(text("code_departement"), department_of(text("code_postal")))
    kept = is_active(field("status")) & field("siren").isNotNull() & field("siret").isNotNull()
    return raw.where(kept).select(
        F.trim(field("siren").cast("string")).alias("siren"),
        F.trim(field("siret").cast("string")).alias("siret"),
        F.trim(field("raison_sociale")).alias("raison_sociale"),
        *[text(name).alias(name) for name in ("sigle", "enseigne", "naf_ape", "naf_label", "code_postal", "commune")],
        department.alias("code_departement"),
        is_headquarters(field("is_headquarters")).alias("is_headquarters"),
    )


def flatten_pages(pages: DataFrame, *kept: str) -> DataFrame:
    """Register rows of landed pages, without those that lack id or name; ``kept`` columns of the page stay."""
    nested = pages.select(F.explode("etablissements").alias("e"), *kept)
    rows = nested.select(*[c.alias(name) for name, c in establishment_fields(F.col("e")).items()], *kept)
    return rows.dropna(subset=["siren", "siret", "raison_sociale"])


def _by_department(rows: DataFrame) -> DataFrame:
    """Rows ready for a partitioned write.

    The rebalance hint gathers each department in few files and lets the
    engine cut a department that is too large for one task.
    """
    known = rows.select(*REGISTER_COLUMNS).fillna({"code_departement": UNKNOWN_DEPARTMENT})
    return known.hint("rebalance", F.col("code_departement"))


def write_register_partitioned(rows: DataFrame, root: str) -> None:
    _by_department(rows).write.mode("overwrite").partitionBy("code_departement").parquet(root)


def append_register_batch(rows: DataFrame, root: str) -> None:
    """Add a batch; unknown departments go to a partition of their own."""
    _by_department(rows).write.mode("append").partitionBy("code_departement").parquet(root)


def register_search(register: DataFrame, department: str, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Some establishments of a department whose name contains a text."""
    require_columns(register, ["code_departement", "raison_sociale"])
    hits = register.where(
        (F.col("code_departement") == department) & F.contains(F.lower("raison_sociale"), F.lower(F.lit(text)))
    )
    columns = ["siren", "siret", "raison_sociale", "enseigne", "code_postal", "commune"]
    return hits.select(*columns).orderBy("siret", "siren").limit(limit)
