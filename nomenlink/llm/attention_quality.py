"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label. Every passage
is encoded by a learned layer; gated attention, learned from the documents'
labels, weighs the passages; the weighted representation is scored. Passages
are described by what their characters and words look like, never by where
they come from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from nomenlink.llm import units
from nomenlink.llm.scratch import giving_back

PASSAGE_WORDS = 64
THRESHOLD = 0.3
# The model is fitted on at most so many labelled documents, those with the
# least hashes of their ids, and on all passages of each.
TRAINING_DOCUMENTS = 4000
_CLASSES = 40
_BUCKETS = 32
FEATURES = _CLASSES + _BUCKETS + 7


def _class_table() -> np.ndarray:
    """Class of each byte: letter, upper-case letter, digit, kind of sign, other."""
    table = np.full(256, 39)
    table[128:] = 38
    for code in range(26):
        table[97 + code] = code
        table[65 + code] = 26
    table[48:58] = 27
    for number, signs in enumerate((" \t\r", "\n", ".", ",", "!", "?;:", "\"'()-", "|", "#$%&*", "@/\\=_+<>[]{}~^`")):
        for sign in signs:
            table[ord(sign)] = 28 + number
    return table


_BYTE_CLASS = _class_table()


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the rows, and the bounds of the rows in them.

    A passage is 64 words, the last of a text what is left; a text without
    words is one passage of zeros.
    """
    starts, ends, hashes, rows = units.words(data, bounds, lower=True)
    counts = np.diff(rows)
    number = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.append(0, np.cumsum(number))
    total = int(first[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(starts):
        return out, first
    row_of = np.repeat(np.arange(len(counts)), counts)
    of_word = first[row_of] + (np.arange(len(starts)) - rows[row_of]) // PASSAGE_WORDS
    size = np.bincount(of_word, minlength=total)

    # The bytes of a passage reach to the next one of the text.
    change = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
    mark = np.zeros(len(data) + 1, dtype=np.int64)
    mark[starts[change]] = 1
    of_byte = of_word[change][np.maximum(np.cumsum(mark[:-1]) - 1, 0)]
    kinds = np.bincount(of_byte * _CLASSES + _BYTE_CLASS[data], minlength=total * _CLASSES)
    kinds = kinds.reshape(total, _CLASSES)
    out[:, :_CLASSES] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))

    bucket = (hashes >> np.uint64(40)) % np.uint64(_BUCKETS)
    bags = np.bincount(of_word * _BUCKETS + bucket.astype(np.int64), minlength=total * _BUCKETS)
    some = np.maximum(size, 1)
    out[:, _CLASSES : _CLASSES + _BUCKETS] = np.sqrt(bags.reshape(total, _BUCKETS) / some[:, None])

    length = (ends - starts).astype(np.float64)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((hashes, of_word))
    fresh = np.ones(len(order))
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order], weights=fresh, minlength=total)
    mean = np.bincount(of_word, weights=length, minlength=total) / some
    spread = np.bincount(of_word, weights=length**2, minlength=total) / some - mean**2
    rest = np.column_stack(
        [
            np.log1p(size),
            mean / 10,
            np.sqrt(np.maximum(spread, 0)) / 10,
            np.bincount(of_word, weights=same, minlength=total) / some,
            distinct / some,
            np.log1p(counts)[np.repeat(np.arange(len(counts)), number)] / 10,
            np.bincount(of_word, weights=length > 24, minlength=total) / some,
        ]
    )
    out[:, _CLASSES + _BUCKETS :] = rest
    return out, first


@dataclass
class AttentionModel:
    """Weights of the encoder, the gated attention and the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        v, u = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (v * u) @ w["attend"]
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, first[:-1])[of])
        a /= np.add.reduceat(a, first[:-1])[of]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        logit = z @ w["score"] + w["score_bias"][0]
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "of": of, "p": 1 / (1 + np.exp(-logit))}

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(features.astype(np.float64), first)["p"]


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, hidden: int = 24, steps: int = 250) -> AttentionModel:
    """Fit by gradient descent (Adam) on the log loss of whole documents."""
    rng = np.random.default_rng(7)
    width = features.shape[1]
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "encode": draw(width, hidden), "encode_bias": np.zeros(hidden), "value": draw(hidden, hidden),
        "gate": draw(hidden, hidden), "attend": draw(hidden), "score": draw(hidden), "score_bias": np.zeros(1),
    }
    x = features.astype(np.float64)
    model = AttentionModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), weights)
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in weights.items()}
    for step in range(1, steps + 1):
        f = model.forward(x, first)
        of, a, h, v, u = f["of"], f["a"], f["h"], f["v"], f["u"]
        d_logit = (f["p"] - labels) / len(labels)
        d_z = d_logit[:, None] * weights["score"]
        d_a = (d_z[of] * h).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[of])
        d_vu = d_e[:, None] * weights["attend"]
        d_v, d_u = d_vu * u * (1 - v**2), d_vu * v * u * (1 - u)
        d_h = (a[:, None] * d_z[of] + d_v @ weights["value"].T + d_u @ weights["gate"].T) * (1 - h**2)
        grads = {
            "encode": f["x"].T @ d_h, "encode_bias": d_h.sum(axis=0), "value": h.T @ d_v, "gate": h.T @ d_u,
            "attend": (v * u).T @ d_e, "score": f["z"].T @ d_logit, "score_bias": d_logit.sum(keepdims=True),
        }
        for name, grad in grads.items():
            grad = grad + 1e-4 * weights[name]
            m, s = moments[name]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, data, bounds in units.blocks(batch.column(1)):
            features, first = passages(data, bounds)
            rows = []
            for row in range(len(bounds) - 1):
                mine = features[first[row] : first[row + 1]]
                rows.append(mine.astype("<f4").tobytes())
            labels = batch.column(0).slice(begin, len(rows))
            yield pa.RecordBatch.from_arrays([labels, pa.array(rows, pa.binary())], names=["label", "bag"])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> AttentionModel | None:
    """Learn ``label`` of ``labels`` (``doc_id``, ``label`` 0 or 1) from the texts.

    At most ``most`` labelled documents are read; the features of all their
    passages are what the driver fits on. Null labels and ids are left out; a
    document labelled twice counts with its lower label, one of several texts
    with the first in their order. None if there are not both labels.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # A repeated row is the same document; more rows than ids must not grow the sample.
    texts = texts.groupBy("doc_id").agg(F.min(F.col("label").cast("long")).alias("label"), F.min("text").alias("text"))
    texts = texts.select("label", "text")
    rows = texts.mapInArrow(giving_back(_bags), "label long, bag binary").collect()
    rows = sorted((row["label"], bytes(row["bag"])) for row in rows)
    if len({label for label, _ in rows}) < 2:
        return None
    bags = [np.frombuffer(bag, dtype="<f4").reshape(-1, FEATURES) for _, bag in rows]
    first = np.append(0, np.cumsum([len(bag) for bag in bags]))
    return train(np.concatenate(bags), first, np.array([label for label, _ in rows], dtype=np.float64))


def _scored(batches: Iterator[pa.RecordBatch], model: AttentionModel | None, text: int, names: list[str], into: str) -> Iterator[pa.RecordBatch]:
    """Rows with their scores, a block of text at a time: only one block is held twice."""
    for batch in batches:
        for begin, data, bounds in units.blocks(batch.column(text).fill_null("")):
            rows = batch.slice(begin, len(bounds) - 1)
            scores = np.full(rows.num_rows, 0.5) if model is None else model.scores(*passages(data, bounds))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], names=[*names, into])


def score_quality(docs: DataFrame, model: AttentionModel | None, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, from 0 to 1, of every whole text.

    Reads ``text``; all columns are kept, and one of the name ``into``, in
    whatever case, is replaced.
    Null and empty texts are scored as one passage without words; every passage
    of a long text takes part. Rows that repeat get equal scores. Without a
    model every score is 0.5. No rows give no rows.
    """
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    text = next(at for at, c in enumerate(kept) if c.lower() == "text")
    schema = StructType([*source.schema.fields, StructField(into, DoubleType())])
    return source.mapInArrow(giving_back(lambda batches: _scored(batches, model, text, kept, into)), schema)


def held_out(doc_id):
    """Whether labels of a document must not be learned: a fifth of the ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> AttentionModel | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return fit_quality(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
