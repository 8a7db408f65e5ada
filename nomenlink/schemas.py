"""Schemas and column maps of the inputs and outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

# --- fixed values: names of the columns in the source files -----------------

# offers file column -> name used throughout this package
OFFER_COLUMNS = {
    "entreprise_nom": "entity_name",
    "entreprise_siren": "entity_siren",
    "location_label": "location_label",
    "location_zipcode": "location_zipcode",
    "location_departement": "location_departement",
}

# index columns that some writers leave in the offers files
ARTIFACT_COLUMNS = ("__index_level_0__", "__null_dask_index__")

REGISTER_SCHEMA = T.StructType(
    [
        T.StructField("siren", T.StringType()),
        T.StructField("siret", T.StringType()),
        T.StructField("raison_sociale", T.StringType()),
        T.StructField("sigle", T.StringType()),
        T.StructField("enseigne", T.StringType()),
        T.StructField("naf_ape", T.StringType()),
        T.StructField("naf_label", T.StringType()),
        T.StructField("code_postal", T.StringType()),
        T.StructField("commune", T.StringType()),
        T.StructField("code_departement", T.StringType()),
        T.StructField("is_headquarters", T.BooleanType()),
    ]
)

# one page of the register interface, as landed JSON
_TEXT = T.StringType()
_UNIT = (
    T.StructType().add("denominationUniteLegale", _TEXT).add("nomUniteLegale", _TEXT).add("sigleUniteLegale", _TEXT)
)
_PERIOD = T.StructType().add("enseigne1Etablissement", _TEXT).add("activitePrincipaleEtablissement", _TEXT)
_PLACE = T.StructType().add("codePostalEtablissement", _TEXT).add("libelleCommuneEtablissement", _TEXT)
_ESTABLISHMENT = (
    T.StructType()
    .add("siren", _TEXT)
    .add("siret", _TEXT)
    .add("etablissementSiege", T.BooleanType())
    .add("uniteLegale", _UNIT)
    .add("periodesEtablissement", T.ArrayType(_PERIOD))
    .add("adresseEtablissement", _PLACE)
)
REGISTER_PAGE_SCHEMA = (
    T.StructType()
    .add("header", T.StructType().add("total", T.LongType()).add("curseurSuivant", _TEXT))
    .add("etablissements", T.ArrayType(_ESTABLISHMENT))
)

# bulk register: synonyms per output column, the first one present wins
BULK_SYNONYMS = {
    "siren": ("siren",),
    "siret": ("siret",),
    "status": (
        "etat_administratif_etablissement",
        "etat_administratif_siret",
        "etat_administratif",
        "etat_administratif_unite_legale",
    ),
    "code_postal": ("code_postal", "postal_code"),
    "code_departement": ("code_departement", "department_code"),
    "commune": ("libelle_commune", "nom_commune", "commune"),
    "raison_sociale": (
        "denomination_unite_legale",
        "raison_sociale",
        "nom_raison_sociale",
        "denomination_raison_sociale",
        "denomination",
    ),
    "sigle": ("sigle", "sigle_unite_legale"),
    "enseigne": ("enseigne", "enseigne_1", "enseigne_2", "nom_commercial"),
    "naf_ape": ("activite_principale", "code_naf", "naf_ape"),
    "naf_label": ("libelle_activite_principale", "libelle_naf"),
    "is_headquarters": ("est_siege", "siege", "siege_etablissement"),
}

UNKNOWN_DEPARTMENT = "inconnu"

CONFIDENCE_CACHE = "cache"
CONFIDENCE_OFFICIAL = "official_api"
CONFIDENCE_WEB = "google_cse"
CONFIDENCE_NONE = "none"

# --- end of fixed values -----------------------------------------------------

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("siren", T.StringType()),
    ]
)

ADDRESS_TYPE = T.StructType(
    [
        T.StructField("street", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("department_hint", T.StringType()),
    ]
)


@dataclass(frozen=True)
class EntityColumns:
    """Where a source keeps names, identifiers and addresses.

    Give either ``address_col`` (one JSON-like text column) or
    ``address_builder`` (a function from the DataFrame to an address struct).
    """

    name_col: str
    siren_col: str
    role: str
    address_col: str | None = None
    address_builder: Callable[[DataFrame], Column] | None = None
    zip_code_col: str | None = None
    city_col: str | None = None
    department_col: str | None = None

    def __post_init__(self) -> None:
        if (self.address_col is None) == (self.address_builder is None):
            raise ValueError("give exactly one of address_col and address_builder")
