"""Numbers stored as text or double, business identifiers, department codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIREN_LENGTH = 9
SIRET_LENGTH = 14
EMPTY_SIREN = "0" * SIREN_LENGTH
# Overseas areas are told apart by three characters instead of two.
OVERSEAS_PREFIXES = ("97", "98")


def strip_whitespace(c: Column) -> Column:
    """Remove white space of every kind, not only blanks, from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_numeric(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text form of a code that may have been promoted to a floating number.

    Spark prints large doubles with an exponent, so whole numbers take the
    way through ``decimal``; text just loses a trailing ``.0``.
    """
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        whole = F.isnotnull(c) & ~F.isnan(c) & (F.abs(c) < 1e18) & (c == F.floor(c))
        return F.when(whole, c.cast("decimal(20,0)").cast("string")).when(~F.isnan(c), c.cast("string"))
    if isinstance(dtype, T.IntegralType):
        return c.cast("string")
    return F.regexp_replace(c.cast("string"), r"\.0+\z", "")


def siren_norm(c: Column, dtype: T.DataType | None = None, strict: bool = True) -> Column:
    """Nine-character identifier, zero padded; null when empty or all zeros.

    Longer text is cut to nine characters, so an establishment number yields
    its company number. ``strict`` also turns anything but digits into null;
    without it text such as ``nan`` is padded like a number.
    """
    text = clean_numeric(c, dtype)
    padded = F.nullif(F.lpad(text, SIREN_LENGTH, "0"), F.lit(EMPTY_SIREN))
    return F.when(text.rlike(r"^[0-9]+\z"), padded) if strict else padded


def clean_numeric_of(df: DataFrame, name: str) -> Column:
    return clean_numeric(F.col(name), df.schema[name].dataType)


def siren_norm_of(df: DataFrame, name: str, strict: bool = True) -> Column:
    return siren_norm(F.col(name), df.schema[name].dataType, strict)


def clean_numeric_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """Trimmed text without one ``.0`` suffix; blank and ``nan`` become null."""
    if isinstance(dtype, T.NumericType):
        return clean_numeric(c, dtype)
    text = strip_whitespace(c.cast("string"))
    bare = F.regexp_replace(text, r"\.0\z", "")
    return F.when(F.lower(text) != "nan", F.nullif(bare, F.lit("")))


def zip_ok_weight(zipcode: Column) -> Column:
    return F.when(F.length(zipcode) == 5, F.lit(1.0)).otherwise(F.lit(0.5))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def safe_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def siren_from_id(c: Column) -> Column:
    """Company number inside a text that holds 9 or 14 digits in all."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits).isin(SIREN_LENGTH, SIRET_LENGTH), F.substring(digits, 1, SIREN_LENGTH))


def siren_from_url(url: Column) -> Column:
    """Company number at the end of a link, from 14 digits or else from 9."""
    tail14 = F.regexp_extract(url, r"([0-9]{14})/?\z", 1)
    tail9 = F.regexp_extract(url, r"([0-9]{9})/?\z", 1)
    return F.coalesce(siren_from_id(F.nullif(tail14, F.lit(""))), siren_from_id(F.nullif(tail9, F.lit(""))))


def department_of(zipcode: Column, hint: Column | None = None) -> Column:
    """Department of a postal code, or the hint when the code is too short."""
    code = F.trim(zipcode)
    derived = F.when(
        (F.length(code) >= 3) & F.substring(code, 1, 2).isin(*OVERSEAS_PREFIXES), F.substring(code, 1, 3)
    ).when(F.length(code) >= 2, F.substring(code, 1, 2))
    return derived if hint is None else F.coalesce(derived, hint)


def is_headquarters(c: Column | None) -> Column:
    if c is None:
        return F.lit(False)
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin("OUI", "1", "TRUE"), F.lit(False))


def is_active(status: Column | None) -> Column:
    """Open establishments; every row counts as open when there is no status."""
    if status is None:
        return F.lit(True)
    return F.coalesce(F.upper(status), F.lit("")).isin("A", "ACTIF")
