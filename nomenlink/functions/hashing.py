"""Repeatable pseudo-random choices that any SQL engine can reproduce.

All of them read the MD5 digest of a seed and a key, so the same rows are
chosen on every run, on every cluster size and after every retry of a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Eight hexadecimal digits: 32 bits, exact in a double.
_DIGITS = 8
_SPAN = 16**_DIGITS


def digest(seed: int | str, *keys: Column) -> Column:
    texts = [F.coalesce(key.cast("string"), F.lit("")) for key in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def digest_number(seed: int | str, *keys: Column) -> Column:
    """Whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(digest(seed, *keys), 1, _DIGITS), 16, 10).cast("long")


def wide_number(seed: int | str, *keys: Column) -> Column:
    """Whole number from 0 to 2**60 - 1."""
    return F.conv(F.substring(digest(seed, *keys), 1, 15), 16, 10).cast("long")


def fraction(seed: int | str, *keys: Column) -> Column:
    """Number from 0 inclusive to 1 exclusive."""
    return digest_number(seed, *keys) / F.lit(float(_SPAN))
