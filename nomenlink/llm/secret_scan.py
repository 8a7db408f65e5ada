"""Secret scan: keyword automaton, expressions anchored at its hits, checksums.

An Aho-Corasick automaton finds all keywords in one pass over a text; regular
expressions are tried only at those places. Tokens that carry a checksum count
only if it is right. Runs of hexadecimal digits have no keyword; one linear
expression finds them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of findings, in the order in which equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("checked",)
KINDS = BASE_KINDS + CHECKED_KINDS

# Keywords, in lower case, and what must match from there on.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS_WORDS = ("akia",)
_CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_LEAST = {"assign": 6, "access": 20}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, keywords in (("assign", _ASSIGN_WORDS), ("access", _ACCESS_WORDS), ("checked", _CHECKED_WORDS)):
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """Six digits in base 62 of the CRC-32 of the body of a token."""
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = _DIGITS[digit] + digits
    return digits


def _sound(match: re.Match) -> bool:
    return checksum(match.group(1)) == match.group(2)


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and stop of each finding, in code points, in order."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer
        lowered = text.translate(_LOWER)
    hits = sorted((stop - size + 1, kind) for stop, (kind, size) in _automaton().iter(lowered))
    free = dict.fromkeys(KINDS, 0)
    found = [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    for start, kind in hits:
        if start < free[kind]:
            continue
        pattern = _ASSIGN if kind == "assign" else _ACCESS if kind == "access" else _CHECKED
        match = pattern.match(text, start)
        if not match:
            continue
        if kind == "checked":
            good = _sound(match)
        else:
            good = len(match.group(2) if kind == "assign" else match.group()) >= _LEAST[kind]
        free[kind] = match.end()  # a match that fails still takes its place
        if good:
            found.append((start, kind, match.end()))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        spans = [
            [{"kind": k, "start": a, "stop": b} for a, k, b in find_secrets(text.as_py())] for text in batch.column(1)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each document: ``doc_id`` and ``spans`` (kind, start, stop in code points).

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Kinds are ``assign``, ``access`` and ``hex``, leftmost and not
    overlapping within a kind, and ``checked`` for tokens whose checksum is
    right. Spans are ordered by start, then kind as listed here.

    Null and empty texts have no spans; a null ``doc_id`` stays null; rows that
    repeat are scanned each; long texts are scanned whole; no rows give none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as counts and digests."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(_of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = _of_kinds(*BASE_KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
