"""Fields of a register establishment, nested or flat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import department_of, strip_whitespace


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def official_name(unit: Column) -> Column:
    """First filled of company name, surname and acronym."""
    return F.coalesce(
        _filled(unit["denominationUniteLegale"]), _filled(unit["nomUniteLegale"]), _filled(unit["sigleUniteLegale"])
    )


def current_period(periods: Column) -> Column:
    return F.get(periods, F.lit(0))


def establishment_fields(e: Column) -> dict[str, Column]:
    """The eleven register columns of one nested establishment."""
    unit, place = e["uniteLegale"], e["adresseEtablissement"]
    period = current_period(e["periodesEtablissement"])
    zip_code = place["codePostalEtablissement"]
    return {
        "siren": _filled(strip_whitespace(e["siren"])),
        "siret": _filled(strip_whitespace(e["siret"])),
        "raison_sociale": strip_whitespace(official_name(unit)),
        "sigle": strip_whitespace(_filled(unit["sigleUniteLegale"])),
        "enseigne": period["enseigne1Etablissement"],
        "naf_ape": period["activitePrincipaleEtablissement"],
        "naf_label": F.lit(None).cast("string"),
        "code_postal": zip_code,
        "commune": place["libelleCommuneEtablissement"],
        "code_departement": department_of(zip_code),
        "is_headquarters": F.coalesce(e["etablissementSiege"], F.lit(False)),
    }
