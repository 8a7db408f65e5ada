"""Company names: keys, placeholder test, consortium handling."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nomenlink.functions.identifiers import strip_whitespace

# --- fixed values ------------------------------------------------------------

PLACEHOLDER_NAMES = (
    "pole emploi",
    "confidentiel",
    "entreprise confidentielle",
    "non communique",
    "non renseigne",
    "non precise",
    "employeur non precise",
    "employeur non communique",
    "entreprise non precisee",
    "anonyme",
    "sans nom",
    "inconnu",
    "n/a",
    "na",
    "nc",
    "-",
    "--",
    "*",
    ".",
    "communes",
    "place-de-l-emploi-public",
    "Adecco Medical",
    "Adecco",
    "Randstad",
    "Samsic",
    "Samsic Emploi",
    "Manpower",
    "SHIVA GROUPE SAS",
    "Temporis Interim",
    "",
)

AGENCY_PATTERNS = (
    "adecco",
    "manpower",
    "randstad",
    "samsic",
    "temporis",
    "crit",
    "synergie",
    "proman",
    "start people",
    "interaction",
    "actual",
    "partnaire",
    "leader",
    "triangle",
    "supplay",
    "sup interim",
    "ras interim",
    "welljob",
    "iziwork",
    "ergalis",
    "menway",
    "adwork",
    "groupe morgan services",
    "metier interim",
    "abalone",
)

RANK_MARKER = r"rang[\s\-]?1"
PARENTHESES = r"\([^)]*\)"
QUOTE_MARKS = r'["“”«»]'
CONSORTIUM_WORDS = r"groupement( (solidaire|conjoint))?"
CONSORTIUM_MARKS = ("/", "-", ",", "&", "\\")
MEMBER_SEPARATORS = (r"\s*/\s*", r"\s*-\s*", r"\s*,\s*", r"\s+et\s+", r"\s*&\s*", r"\s*\\\\\s*")
SPACED_HYPHEN = r"\s+-\s+"
MEMBER_LIMIT = 10

# --- end of fixed values -----------------------------------------------------


@cache
def accent_table() -> tuple[str, str]:
    """Accented Latin letters and the letters they decompose to."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = [ch for ch in unicodedata.normalize("NFD", letter) if not unicodedata.combining(ch)]
        if len(base) == 1 and base[0] != letter:
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    source, target = accent_table()
    return F.translate(c, source, target)


def name_norm(c: Column) -> Column:
    """Key of a name: trimmed, without accents, lower case."""
    return F.lower(strip_accents(F.trim(c)))


@F.pandas_udf(StringType())
def _compatibility_ascii(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD").str.encode("ascii", errors="ignore").str.decode("ascii")


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition with everything outside ASCII dropped.

    Spark has no such function. Only texts that need it cross into Python.
    """
    return F.coalesce(_compatibility_ascii(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def _plain_key(text: str) -> str:
    decomposed = unicodedata.normalize("NFD", text.strip(" "))
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).lower()


def placeholder_keys(normalise_entries: bool = True) -> list[str]:
    """Placeholder names as keys.

    Entries in mixed case can never equal a lower-case key. They are folded by
    default; ``normalise_entries=False`` leaves them out, which gives the same
    answers as comparing them unfolded.
    """
    if normalise_entries:
        return sorted({_plain_key(name) for name in PLACEHOLDER_NAMES})
    return sorted({name for name in PLACEHOLDER_NAMES if _plain_key(name) == name})


def key_is_blacklisted(key: Column, normalise_entries: bool = True, whole_word: bool = False) -> Column:
    """Placeholder, temporary-work agency or one-letter name, given the key."""
    agencies = "|".join(re.escape(pattern) for pattern in AGENCY_PATTERNS)
    if whole_word:
        agencies = rf"(?<![\p{{L}}\p{{N}}])(?:{agencies})(?![\p{{L}}\p{{N}}])"
    return key.isin(*placeholder_keys(normalise_entries)) | key.rlike(agencies) | (F.length(key) <= 1)


def is_blacklisted(c: Column, normalise_entries: bool = True, whole_word: bool = False) -> Column:
    return key_is_blacklisted(name_norm(c), normalise_entries, whole_word)


def has_name(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def strip_rank_marker(c: Column) -> Column:
    return strip_whitespace(F.regexp_replace(c, "(?iU)" + RANK_MARKER, ""))


def collapse_spaces(c: Column) -> Column:
    return strip_whitespace(F.regexp_replace(c, r"(?U)\s+", " "))


def company_name_norm(c: Column) -> Column:
    return F.lower(collapse_spaces(strip_rank_marker(c)))


def is_consortium(c: Column) -> Column:
    low = F.lower(c)
    joined = F.contains(low, F.lit(" et "))
    for mark in CONSORTIUM_MARKS:
        joined = joined | F.contains(low, F.lit(mark))
    return F.contains(low, F.lit("groupement")) & ~F.contains(low, F.lit("public")) & joined


def is_slash_name(c: Column) -> Column:
    """Several names joined by a slash, outside an explicit consortium."""
    return F.contains(c, F.lit("/")) & ~F.contains(F.lower(c), F.lit("groupement"))


def _members(cleaned: Column, separator: str, limit: int | None) -> Column:
    parts = F.transform(F.split(cleaned, separator, -1), strip_whitespace)
    named = F.filter(parts, lambda part: part != "")
    return named if limit is None else F.slice(named, 1, limit)


def _without_brackets(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, PARENTHESES, ""), QUOTE_MARKS, "")


def split_consortium(
    c: Column, spaced_hyphen_only: bool = False, limit: int | None = MEMBER_LIMIT
) -> Column:
    """Names of the members of a consortium, at most ``limit``, in their order.

    Hyphens split by default, also inside names; ``spaced_hyphen_only`` keeps
    compound names whole. A limit of None gives all members.
    """
    separators = [
        SPACED_HYPHEN if spaced_hyphen_only and "-" in pattern else pattern for pattern in MEMBER_SEPARATORS
    ]
    bare = _without_brackets(F.regexp_replace(c, "(?i)" + CONSORTIUM_WORDS, ""))
    return _members(collapse_spaces(bare), "(?iU)" + "|".join(separators), limit)


def split_slash(c: Column, limit: int | None = MEMBER_LIMIT) -> Column:
    return _members(collapse_spaces(_without_brackets(c)), "/", limit)


def members_of(c: Column, spaced_hyphen_only: bool = False, limit: int | None = None) -> Column:
    """Names to look up for a stated name: all its members, or the name itself."""
    return (
        F.when(is_consortium(c), split_consortium(c, spaced_hyphen_only, limit))
        .when(is_slash_name(c), split_slash(c, limit))
        .otherwise(F.array(c))
    )
