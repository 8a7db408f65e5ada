"""Corpus preparation: documents of quality, without copies or test items, packed.

Each stage takes the documents the one before kept, and its decisions take
effect. All but the last return the columns of ``documents``.

Nulls, empty and long texts, repeated rows, empty tables and further columns
are handled as each operator says: a null text is scored, compared and packed
as an empty one, and a document without an id is dropped only for its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.attention_quality import THRESHOLD, quality_model, score_quality
from nomenlink.llm.decontaminate import drop_leaking
from nomenlink.llm.exact_copies import drop_copies
from nomenlink.llm.packing import CAPACITY, VOCABULARY, pack_documents
from nomenlink.llm.scratch import Scratch
from nomenlink.llm.sketch_join import Rule, drop_near_copies

NEAR = Rule(words=5, least=80, scale=100)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the learning folds, accepts.

    The score stands beside the columns under a name that none of them has, so
    all come back as they were, a ``score`` included. A null text is scored as
    an empty one and a long one whole; rows that repeat get one decision; no
    rows give none.
    """
    taken = {c.lower() for c in docs.columns}
    into = next(name for n in range(len(taken) + 1) if (name := f"quality_score_{n}") not in taken)
    scored = score_quality(docs, quality_model(spark, docs, sf_dir), into)
    return scored.where(F.col(into) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the row of the largest ``doc_id``.

    Among rows of one id and text the greatest in the order of the other
    columns stays; null counts as the empty text; further columns come back
    as they were.
    """
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the least ``doc_id``.

    Texts without words are linked with nothing and stay; further columns come
    back as they were.
    """
    return drop_near_copies(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item.

    Null and empty texts hold none and stay, as do all rows where the benchmark
    is empty; further columns come back as they were.
    """
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens.

    Null texts are the closing token alone; pieces of equal length are placed
    in the order in which tasks read them.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(VOCABULARY), CAPACITY)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# The classifier, the tokenizer and the alignment cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
