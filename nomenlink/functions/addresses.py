"""Postal addresses as a struct of street, zip code, city, department hint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import clean_numeric_text, department_of, strip_whitespace
from nomenlink.schemas import ADDRESS_TYPE, EntityColumns

# --- fixed values: field names of address texts and synonyms of columns ------

STREET_FIELD, CITY_FIELD, ZIP_FIELD, TEXT_FIELD = "StreetName", "CityName", "PostalZone", "#text"

ZIP_FALLBACKS = ("location_zipcode", "LOCATION_ZIPCODE")
CITY_FALLBACKS = ("location_label", "location_city", "LOCATION_LABEL", "LOCATION_CITY")
DEPARTMENT_FALLBACKS = (
    "location_departement",
    "location_department",
    "LOCATION_DEPARTEMENT",
    "LOCATION_DEPARTMENT",
)

CONTEXT_SYNONYMS = {
    "street": ("street",),
    "zip_code": ("zip_code", "postal_code", "code_postal"),
    "city": ("city", "ville"),
    "department_hint": ("department", "departement", "department_hint"),
}

# --- end of fixed values -----------------------------------------------------

_JSON_OPTIONS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "columnNameOfCorruptRecord": "_bad",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address(street=None, zip_code=None, city=None, department_hint=None) -> Column:
    parts = {"street": street, "zip_code": zip_code, "city": city, "department_hint": department_hint}
    return F.struct(
        *[(F.lit(None).cast("string") if c is None else c.cast("string")).alias(name) for name, c in parts.items()]
    ).cast(ADDRESS_TYPE)


def address_component(c: Column) -> Column:
    """Trimmed text; blank, ``nan`` and ``none`` are null, ``75001.0`` is ``75001``."""
    text = strip_whitespace(c.cast("string"))
    bare = F.when(text.rlike(r"^[0-9]+\.0\z"), F.regexp_replace(text, r"\.0\z", "")).otherwise(text)
    return F.when(~F.lower(text).isin("", "nan", "none"), bare)


def _field(c: Column) -> Column:
    return F.nullif(strip_whitespace(c), F.lit(""))


def parse_address(c: Column, empty_object_as_street: bool = False) -> Column:
    """Address from JSON text or from the printed form of a Python dictionary.

    Text that is neither is kept whole as the street, and so are bare JSON
    numbers. An empty object gives an empty address, or its own text as the
    street with ``empty_object_as_street``.
    """
    fields = f"`{STREET_FIELD}` string, `{CITY_FIELD}` string, `{ZIP_FIELD}` string, `_bad` string"

    def fields_of(text: Column, parsed: Column) -> Column:
        is_object = text.rlike(r"^\{") & parsed["_bad"].isNull()
        if empty_object_as_street:
            is_object = is_object & ~text.rlike(r"^\{\s*\}\z")
        found = address(_street(parsed[STREET_FIELD]), _field(parsed[ZIP_FIELD]), _field(parsed[CITY_FIELD]))
        return F.when(is_object, found).otherwise(address(street=F.nullif(text, F.lit(""))))

    def parse(text: Column) -> Column:
        # Python's None is the one word in a printed dictionary that JSON does
        # not know; single quotes are accepted by the reader.
        named = F.regexp_replace(text, r"(?<=[:,\[{]\s{0,8})None(?=\s*[,}\]])", "null")
        # Only objects reach the reader: it raises an error inside for each text that is none.
        json_text = F.when(text.startswith("{"), F.when(text.contains("None"), named).otherwise(text))
        return let(F.from_json(json_text, fields, _JSON_OPTIONS), lambda parsed: fields_of(text, parsed))

    return let(strip_whitespace(c), parse)


def _street(raw: Column) -> Column:
    """A street is text, or an object that holds the text."""
    nested = F.from_json(raw, f"`{TEXT_FIELD}` string, `_bad` string", _JSON_OPTIONS)
    return let(F.when(raw.rlike(r"^\{"), nested[TEXT_FIELD]).otherwise(raw), _field)


def address_is_empty(addr: Column) -> Column:
    """No street, zip code or city; a department hint alone does not count."""
    blank = [F.coalesce(addr[part], F.lit("")) == "" for part in ("street", "zip_code", "city")]
    return blank[0] & blank[1] & blank[2]


def address_string(addr: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(addr[part], F.lit("")) for part in ("street", "zip_code", "city")])


def address_department(addr: Column) -> Column:
    return department_of(addr["zip_code"], addr["department_hint"])


def address_repr_norm(c: Column) -> Column:
    """Canonical lower-case text of an address, whatever form it came in."""
    plain = F.lower(strip_whitespace(F.coalesce(c, F.lit(""))))

    def canonical(parsed: Column) -> Column:
        return F.when(address_is_empty(parsed), plain).otherwise(F.lower(F.trim(address_string(parsed))))

    return let(parse_address(c), canonical)


def cache_key(name: Column, addr_text: Column) -> tuple[Column, Column]:
    return F.lower(strip_whitespace(name)), F.lower(strip_whitespace(addr_text))


def address_from_context(df: DataFrame) -> Column:
    """Address from whichever synonym columns the DataFrame has."""

    def first_of(names: tuple[str, ...]) -> Column | None:
        present = [F.nullif(F.col(name).cast("string"), F.lit("")) for name in names if name in df.columns]
        return address_component(F.coalesce(*present)) if present else None

    return address(**{part: first_of(names) for part, names in CONTEXT_SYNONYMS.items()})


def offer_address(df: DataFrame) -> Column:
    """Address of a job offer: no street, the location label is the city."""
    types = {field.name: field.dataType for field in df.schema.fields}
    return address(
        zip_code=clean_numeric_text(F.col("location_zipcode"), types["location_zipcode"]),
        city=address_component(F.col("location_label")),
        department_hint=clean_numeric_text(F.col("location_departement"), types["location_departement"]),
    )


def entity_address(df: DataFrame, columns: EntityColumns) -> Column:
    """Address of an entity from its address text and location columns.

    Fields inside the text win over the columns. A text that is a street only
    is taken as the city when the columns place the entity.
    """
    if columns.address_builder is not None:
        return columns.address_builder(df)

    def from_columns(named: str | None, fallbacks: tuple[str, ...]) -> Column:
        for name in (named, *fallbacks):
            if name and name in df.columns:
                return address_component(F.col(name))
        return F.lit(None).cast("string")

    zip_code = from_columns(columns.zip_code_col, ZIP_FALLBACKS)
    city = from_columns(columns.city_col, CITY_FALLBACKS)
    hint = from_columns(columns.department_col, DEPARTMENT_FALLBACKS)
    placed = F.coalesce(zip_code, city, hint).isNotNull()

    def merged(stated: Column) -> Column:
        street_only = stated["street"].isNotNull() & F.coalesce(stated["city"], stated["zip_code"]).isNull() & placed
        return address(
            street=F.when(~street_only, stated["street"]),
            zip_code=F.coalesce(stated["zip_code"], zip_code),
            city=F.coalesce(stated["city"], city, F.when(street_only, stated["street"])),
            department_hint=hint,
        )

    return let(parse_address(F.col(columns.address_col)), merged)


OFFER_ENTITY = EntityColumns(
    name_col="entity_name", siren_col="entity_siren", role="ENTREPRISE", address_builder=offer_address
)
CONTRACTING = EntityColumns(
    name_col="CONTRACTING_STATED_NAME",
    siren_col="CONTRACTING_SIREN",
    role="CONTRACTING",
    address_col="CONTRACTING_ADDRESS",
)
AWARDED = EntityColumns(
    name_col="AWARDED_STATED_NAME", siren_col="AWARDED_SIREN", role="AWARDED", address_col="AWARDED_ADDRESS"
)
