"""Quality of scored pairs: ``label`` 0 or 1, ``pred`` between 0 and 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.operators.ordering import in_order, running_sums
from nomenlink.operators.silver import positive_rate
from nomenlink.session import materialise

# --- fixed values
DECISION_THRESHOLD = 0.5
MAX_ERRORS = 2000
LOW_POSITIVE, HIGH_NEGATIVE, NO_ERROR = "silver_positive_low_score", "negative_high_score", "ok"


def with_decision(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    return scored.withColumn("pred_label", (F.col("pred") >= threshold).cast("int"))


def confusion_matrix(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """One row per true label with the counts of both decisions."""
    decided = with_decision(scored, threshold)
    return decided.groupBy("label").agg(
        F.count_if(F.col("pred_label") == 0).alias("pred_0"), F.count_if(F.col("pred_label") == 1).alias("pred_1")
    )


def classification_report(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    decided = with_decision(scored, threshold)
    hits = {
        (truth, guess): F.count_if((F.col("label") == truth) & (F.col("pred_label") == guess)).alias(f"n{truth}{guess}")
        for truth in (0, 1)
        for guess in (0, 1)
    }
    counts = decided.agg(*hits.values())

    def n(truth: int, guess: int) -> Column:
        return F.col(f"n{truth}{guess}")

    def over(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    per_class = {}
    for c in (0, 1):
        per_class[f"p{c}"] = over(n(c, c), n(0, c) + n(1, c))
        per_class[f"r{c}"] = over(n(c, c), n(c, 0) + n(c, 1))
        per_class[f"s{c}"] = n(c, 0) + n(c, 1)
    rates = counts.withColumns(per_class)
    rates = rates.withColumns(
        {f"f{c}": over(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")) for c in (0, 1)}
    ).withColumn("total", F.col("s0") + F.col("s1"))

    def line(label: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(label).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1_score"),
            support.alias("support"),
        )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return over(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), F.col("total"))

    accuracy = over(n(0, 0) + n(1, 1), F.col("total"))
    lines = [line(str(c), *[F.col(f"{m}{c}") for m in "prf"], F.col(f"s{c}")) for c in (0, 1)]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, F.col("total")))
    lines.append(line("macro avg", *[macro(m) for m in "prf"], F.col("total")))
    lines.append(line("weighted avg", *[weighted(m) for m in "prf"], F.col("total")))
    return rates.select(F.inline(F.array(*lines)))


def score_table(scored: DataFrame) -> DataFrame:
    """Per distinct score: its positives and negatives, those at lower scores, all.

    Scores are counted, dealt by range and summed part by part, so crowded
    scores make no large task. The counts are written to the shared folder.
    """
    scores = scored.groupBy(F.col("pred").cast("double").alias("pred")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    placed = materialise(in_order(scores, "pred"), "scores")
    whole = placed.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pos", "neg")]).first()
    summed = running_sums(placed, {"pos_upto": "pos", "neg_upto": "neg"})
    return summed.select(
        "pred",
        "pos",
        "neg",
        (F.col("pos_upto") - F.col("pos")).alias("pos_below"),
        (F.col("neg_upto") - F.col("neg")).alias("neg_below"),
        F.lit(whole["pos"]).cast("long").alias("pos_all"),
        F.lit(whole["neg"]).cast("long").alias("neg_all"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve: chance that a positive outranks a negative."""
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    pairs = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return score_table(scored).agg((F.sum(won) / pairs).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Precision at every distinct score, weighted by the recall it adds."""
    table = score_table(scored)
    above_pos, above_neg = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    step = F.col("pos") * above_pos / F.nullif(above_pos + above_neg, F.lit(0))
    return table.agg((F.sum(step) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def error_types(scored: DataFrame, threshold: float = DECISION_THRESHOLD) -> DataFrame:
    kind = (
        F.when((F.col("label") == 1) & (F.col("pred_label") == 0), LOW_POSITIVE)
        .when((F.col("label") == 0) & (F.col("pred_label") == 1), HIGH_NEGATIVE)
        .otherwise(NO_ERROR)
    )
    return with_decision(scored, threshold).withColumn("error_type", kind)


def error_list(scored: DataFrame, n: int = MAX_ERRORS, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The n worst decisions by falling score."""
    errors = error_types(scored).where(F.col("error_type") != NO_ERROR)
    return errors.orderBy(F.desc("pred"), *tie_break).limit(n)


def experiment_summary(pairs: DataFrame, scored: DataFrame, facts: dict[str, str | int | float]) -> DataFrame:
    """One row: given facts, pair count, positive rate, AUC and average precision."""
    parts = [positive_rate(pairs), roc_auc(scored), average_precision(scored)]
    columns = [part.select(name).scalar().alias(name) for part in parts for name in part.columns]
    one = pairs.sparkSession.range(1)
    return one.select(*[F.lit(value).alias(name) for name, value in facts.items()], *columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
