"""Exact deduplication that no hot text can overload.

Equal texts are combined three times: within each task, within salted groups
of their digest, and across the salts. The text itself is a grouping key each
time, so texts are compared in full and a digest is never trusted alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch

SALTS = 32


def _prepared(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, text.alias("text")).withColumn("text_sha256", F.sha2("text", 256))


def text_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct text: ``text_sha256``, ``keep_id``, ``group_size``, ``variants``, ``text``.

    ``variants`` counts the texts of one digest; ``text`` is null while that
    is one, as the digest then names the text.
    """
    facts = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    salted = _prepared(docs, "doc_id").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    # Partial sums run in each task before the shuffle: a text leaves a task once.
    by_salt = salted.groupBy("text_sha256", "salt", "text").agg(*facts)
    # Dealt by digest alone, so that texts and then digests combine without moving again.
    merged = by_salt.repartition("text_sha256").groupBy("text_sha256", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    by_digest = merged.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("variants"), F.collect_list(F.struct("text", "keep_id", "group_size")).alias("texts")
    )
    one = by_digest.select("text_sha256", "variants", F.explode("texts").alias("x")).select(
        "text_sha256",
        "variants",
        F.when(F.col("variants") > 1, F.col("x.text")).alias("text"),
        F.col("x.keep_id").alias("keep_id"),
        F.col("x.group_size").alias("group_size"),
    )
    return scratch.keep(one, "groups")


def label_copies(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the row that stays for its text.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. Returns ``doc_id``, ``keep_id`` (largest id of the equal texts),
    ``group_size`` (rows, repeated ones included), ``kept`` and
    ``text_sha256``.

    Null counts as the empty text, which is a text like any other. Rows that
    repeat with one id are one document: all are marked alike. A null id never
    wins over another and is kept only if its group has no other id. Long texts
    are compared whole. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact-copies")
    groups = text_groups(docs, scratch)
    single = groups.where("variants = 1").drop("text")
    rows = _prepared(docs, "doc_id")
    if groups.where("variants > 1").isEmpty():
        found = rows.drop("text").join(single, "text_sha256")
    else:  # different texts of one digest: the text decides
        twins = groups.where("variants > 1")
        found = (
            rows.join(single, "text_sha256")
            .select("doc_id", "text_sha256", "keep_id", "group_size")
            .unionByName(
                rows.join(twins, ["text_sha256", "text"]).select("doc_id", "text_sha256", "keep_id", "group_size")
            )
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row per text, that of the largest ``doc_id``, with all columns of ``docs``.

    Nulls stay null in the output; among rows of one id and text, the greatest
    in the order of the other columns is taken.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("doc_id").alias("a"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("b"), F.isnotnull("text").alias("c"))
    rows = docs.select(
        digest.alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"), row.alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
    )
    by_salt = rows.groupBy("digest", "salt", "text").agg(F.max("row").alias("row"))
    best = by_salt.groupBy("digest", "text").agg(F.max("row").alias("row"))
    fields = {c: F.col(f"row.b.`{c}`") for c in others}
    fields |= {"doc_id": F.col("row.a"), "text": F.when(F.col("row.c"), F.col("text"))}
    return best.select(*[fields[c].alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return label_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
