import unicodedata

import pytest
from pyspark.sql import types as T

from nomenlink.functions import addresses as a
from nomenlink.functions import identifiers as i
from nomenlink.functions import names as n
from nomenlink.schemas import EntityColumns


def test_clean_numeric(apply):
    assert apply(i.clean_numeric, "34130.0", "75.00", "2A", None, "100") == ["34130", "75", "2A", None, "100"]
    doubles = apply(lambda c: i.clean_numeric(c, T.DoubleType()), 34130.0, 123456789.0, 1.5, None, kind="double")
    assert doubles == ["34130", "123456789", "1.5", None]
    assert apply(lambda c: i.clean_numeric(c, T.LongType()), 10, kind="bigint") == ["10"]


def test_siren_norm(apply):
    assert apply(lambda c: i.siren_norm(c, T.DoubleType()), 123456789.0, 5420120.0, kind="double") == [
        "123456789",
        "005420120",
    ]
    texts = ["5420120", "", "0", "12345678901234", "nan", None]
    assert apply(i.siren_norm, *texts) == ["005420120", None, None, "123456789", None, None]
    assert apply(lambda c: i.siren_norm(c, strict=False), "nan") == ["000000nan"]
    assert apply(lambda c: i.siren_norm(i.siren_norm(c)), "5420120") == ["005420120"]


def test_name_norm(apply):
    assert apply(n.name_norm, " Pôle Emploi ", "Œuvre", None) == ["pole emploi", "œuvre", None]


def test_is_blacklisted(apply):
    names = ["Pôle emploi", "Adecco Medical", "a", "Écritures SA", "SHIVA GROUPE SAS", "Boulangerie"]
    assert apply(n.is_blacklisted, *names) == [True, True, True, True, True, False]
    assert apply(lambda c: n.is_blacklisted(c, normalise_entries=False), *names)[4] is False
    assert apply(lambda c: n.is_blacklisted(c, whole_word=True), "Écritures SA", "Crit Paris") == [False, True]


def test_codes_as_text(apply):
    assert apply(a.address_component, "75001.0", "a.0", "None", " x ", "") == ["75001", "a.0", None, "x", None]
    assert apply(i.clean_numeric_text, "a.0", " nan ", "75001.0", "", ".0") == ["a", None, "75001", None, None]


def test_departments(apply):
    zips = ["97110", "98800", "75001", "97", "7"]
    assert apply(i.department_of, *zips) == ["971", "988", "75", "97", None]
    assert apply(lambda z, h: i.department_of(z, h), (None, "2A"), ("75001", "2A")) == ["2A", "75"]


def test_consortium(apply):
    assert apply(n.is_consortium, "Groupement A / B", "Groupement public A/B", "Groupement A", "A et B") == [
        True,
        False,
        False,
        False,
    ]
    many = "Groupement " + " / ".join(f"m{k}" for k in range(12))
    split = apply(n.split_consortium, "Groupement solidaire A (mandataire) / B et C", "A - B", many, "Jean-Luc")
    assert split[0] == ["A", "B", "C"]
    assert split[1] == ["A", "B"]
    assert len(split[2]) == 10
    assert split[3] == ["Jean", "Luc"]
    assert apply(lambda c: n.split_consortium(c, spaced_hyphen_only=True), "Jean-Luc - B") == [["Jean-Luc", "B"]]
    assert apply(n.split_consortium, r"A \\ B", r"A \ B") == [["A", "B"], [r"A \ B"]]
    assert apply(n.split_slash, "A (x) / «B» / ") == [["A", "B"]]


def test_company_name(apply):
    assert apply(n.company_name_norm, "Rang 1  ACME", "RANG-1 B C") == ["acme", "b c"]
    assert apply(n.strip_rank_marker, "rang1 X") == ["X"]


def test_ascii_fold(apply):
    texts = ["Éà", "straße", "ﬁn", "½", "a b", "plain", None, "𝐀œ²…"]
    expected = [
        None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts
    ]
    assert apply(n.ascii_fold, *texts) == expected


def _address(row):
    return (row["street"], row["zip_code"], row["city"])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"CityName":"Paris","PostalZone":"75001"}', (None, "75001", "Paris")),
        ('{"PostalZone":75001}', (None, "75001", None)),
        ("{'StreetName': {'#text': 'x'}, 'CityName': null}", ("x", None, None)),
        ("{'StreetName': {'#text': 'x'}, 'CityName': None}", ("x", None, None)),
        ("{'StreetName': \"rue de l'If\", 'CityName': ' Lyon '}", ("rue de l'If", None, "Lyon")),
        ("rue X", ("rue X", None, None)),
        ("75001", ("75001", None, None)),
        ("{broken", ("{broken", None, None)),
        ("{}", (None, None, None)),
        ("  ", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_parse_address(apply, text, expected):
    assert _address(apply(a.parse_address, text)[0]) == expected


def test_empty_object_may_be_a_street(apply):
    assert apply(lambda c: a.parse_address(c, empty_object_as_street=True), "{}")[0]["street"] == "{}"


def test_address_text(apply):
    texts = apply(
        lambda s, z, c: a.address_string(a.address(s, z, c)), (None, "75001", "Paris"), ("", "1", None)
    )
    assert texts == ["75001 Paris", "1"]
    assert apply(a.address_repr_norm, '{"CityName":"Paris"}', " 75001 PARIS ", None) == ["paris", "75001 paris", ""]


def test_street_becomes_city_when_columns_place_the_entity(spark):
    columns = EntityColumns(name_col="n", siren_col="s", role="R", address_col="a")
    df = spark.createDataFrame(
        [(1, "Lyon", "69001.0", None), (2, "Lyon", None, None), (3, "rue X", "1", "Nice"), (4, '{"CityName":"P"}', "2", "Q")],
        "k int, a string, location_zipcode string, location_label string",
    )
    rows = {r["k"]: _address(r["x"]) for r in df.select("k", a.entity_address(df, columns).alias("x")).collect()}
    assert rows == {
        1: (None, "69001", "Lyon"),
        2: ("Lyon", None, None),
        3: (None, "1", "Nice"),
        4: (None, "2", "P"),
    }


def test_entity_columns_need_one_address():
    with pytest.raises(ValueError):
        EntityColumns(name_col="n", siren_col="s", role="R")


def test_identifiers_in_text(apply):
    assert apply(i.siren_from_id, "123 456 789 00012", "123456789", "12345678", None) == [
        "123456789",
        "123456789",
        None,
        None,
    ]
    links = ["http://x/12345678900012/", "http://x/123456789", "http://x/", "http://x/1234567890"]
    assert apply(i.siren_from_url, *links) == ["123456789", "123456789", None, "234567890"]


def test_headquarters_and_status(apply):
    assert apply(i.is_headquarters, "oui", "1", "true", "non", None) == [True, True, True, False, False]
    assert apply(i.is_active, "a", "Actif", "F", None) == [True, True, False, False]


def test_flags_without_columns(spark):
    row = spark.range(1).select(i.is_headquarters(None).alias("hq"), i.is_active(None).alias("open")).first()
    assert (row["hq"], row["open"]) == (False, True)


def test_accent_table_is_one_to_one():
    source, target = n.accent_table()
    assert len(source) == len(target) == len(set(source))
