"""Training, scoring and checking of the pair classifier with Spark ML."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.operators import metrics
from nomenlink.operators.boosting import GBTClassifier, best_round
from nomenlink.operators.features import FEATURE_COLUMNS, labelled_only, pair_features
from nomenlink.operators.sampling import SEED, group_split
from nomenlink.operators.resolve import mean_score
from nomenlink.operators.skew import salted_join, small_join
from nomenlink.session import materialise

# --- fixed values of the classifier and of the text score
LEARNING_RATE = 0.05
MAX_ROUNDS = 500
PATIENCE = 50
MIN_ROWS_PER_LEAF = 100
FEATURE_SHARE = "0.9"
ROW_SHARE = 0.9
# --- end of fixed values

# 31 leaves grown leaf by leaf are close to a full tree of depth five.
MAX_DEPTH = 5
# Rows of one part that is binned for a fit.
ROWS_PER_PART = 250_000


@dataclass(frozen=True)
class Boosted:
    """A fitted matcher, cut to its best round, and the log loss on the validation side after each round."""

    model: PipelineModel
    best_round: int
    curve: list[float]


def first_rounds(trees: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees."""
    if rounds >= trees.getNumTrees:
        return trees
    # Spark's public constructor of (uid, trees, weights); Python has no call for it.
    gateway = SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, tree in enumerate(trees.trees[:rounds]):
        kept[i], weights[i] = tree._java_obj, trees.treeWeights[i]
    cut = ml.classification.GBTClassificationModel(f"{trees.uid}-{rounds}", kept, weights)
    return GBTClassificationModel(cut).setFeaturesCol(trees.getFeaturesCol())


def train_boosted(
    features: DataFrame,
    rounds: int = MAX_ROUNDS,
    seed: int = SEED,
    min_rows_per_leaf: int = MIN_ROWS_PER_LEAF,
    columns: list[str] | None = None,
    patience: int = PATIENCE,
) -> Boosted:
    """Boosted trees on pair features, stopped and cut by the loss on names kept out of fitting.

    Classes are weighted to balance. If the curve has stalled within twice the
    patience the fit ends there, else all rounds are fitted. Without a row on
    the validation side nothing can stall and all rounds are kept.
    """
    rows = group_split(labelled_only(features), seed=seed).withColumn("label", F.col("label").cast("double"))
    assembler = VectorAssembler(inputCols=columns or FEATURE_COLUMNS, outputCol="features")
    rows = materialise(rows, "boosting")
    training = rows.where(~F.col("is_validation"))
    n = training.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    total = n["pos"] + n["neg"]
    cores = features.sparkSession.sparkContext.defaultParallelism
    balance = F.when(F.col("label") == 1, total / (2 * max(1, n["pos"]))).otherwise(total / (2 * max(1, n["neg"])))
    used = [*(columns or FEATURE_COLUMNS), "label", "is_validation"]
    dealt = rows.select(*used)
    if len(rows.inputFiles()) < cores:
        # Few files are read by few tasks, in which all rows would be binned.
        dealt = dealt.repartition(max(cores, total // ROWS_PER_PART))
    weighted = assembler.transform(dealt.withColumn("weight", balance))
    trees = GBTClassifier(
        patience=patience,
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        validationIndicatorCol="is_validation",
        stepSize=LEARNING_RATE,
        maxIter=rounds,
        maxDepth=MAX_DEPTH,
        minInstancesPerNode=min_rows_per_leaf,
        subsamplingRate=ROW_SHARE,
        featureSubsetStrategy=FEATURE_SHARE,
        seed=seed,
    ).fit(weighted)
    curve = trees.curve
    best = best_round(curve, patience)[0] if curve else trees.getNumTrees
    return Boosted(PipelineModel([assembler, first_rounds(trees, best)]), best, curve)


def train_matcher(
    features: DataFrame,
    rounds: int = MAX_ROUNDS,
    seed: int = SEED,
    min_rows_per_leaf: int = MIN_ROWS_PER_LEAF,
    columns: list[str] | None = None,
    patience: int = PATIENCE,
) -> PipelineModel:
    """The model of ``train_boosted`` alone."""
    return train_boosted(features, rounds, seed, min_rows_per_leaf, columns, patience).model


def score_pairs(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Pairs with the probability ``pred`` and the decision ``pred_label``."""
    scored = model.transform(features)
    scored = scored.withColumn("pred", vector_to_array("probability")[1])
    return metrics.with_decision(scored.drop("features", "rawPrediction", "probability", "prediction"))


def arbitrate(features: DataFrame, model: PipelineModel | None, similarities: list[Column]) -> DataFrame:
    """``score`` by the model if there is one, else the mean of similarities."""
    if model is None:
        return features.withColumn("score", mean_score(*similarities))
    return score_pairs(model, features).withColumnRenamed("pred", "score").drop("pred_label")


def _trees(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def feature_importance(model: PipelineModel, spark, columns: list[str] | None = None) -> DataFrame:
    """Gain and number of splits per feature; the model is small by design."""
    columns = columns or FEATURE_COLUMNS
    gain = [0.0] * len(columns)
    importances = _trees(model).featureImportances
    for i, value in zip(importances.indices, importances.values):
        gain[int(i)] = value
    # Every split is printed once with its condition and once with the opposite.
    tested = Counter(int(i) for i in re.findall(r"If \(feature (\d+) ", _trees(model).toDebugString))
    splits = [tested[i] for i in range(len(columns))]
    rows = [(name, float(g), int(n)) for name, g, n in zip(columns, gain, splits)]
    return spark.createDataFrame(rows, "feature string, gain double, split long").orderBy(F.desc("gain"), "feature")


def evaluate(scored: DataFrame) -> DataFrame:
    """AUC, average precision and the report, as (metric, class, value) lines."""
    report = metrics.classification_report(scored)
    lines = report.select(
        F.col("class"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
                    for name in ("precision", "recall", "f1_score", "support")
                ]
            )
        ),
    )
    curves = [
        frame.select(F.lit("all").alias("class"), F.lit(frame.columns[0]).alias("metric"), F.col(frame.columns[0]).alias("value"))
        for frame in (metrics.roc_auc(scored), metrics.average_precision(scored))
    ]
    return metrics.union_all([*curves, lines])


def evaluate_gold(model: PipelineModel, gold: DataFrame) -> DataFrame:
    """Metrics on reviewed pairs that were kept out of training."""
    return evaluate(score_pairs(model, pair_features(gold)))


def _counted(values: Column) -> Column:
    """The different values of a sorted array with their counts, without leaving the row."""
    begins = F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0) | (F.get(values, i) != F.get(values, F.greatest(i - 1, F.lit(0)))),
    )
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))), F.array(F.size(values)))
    runs = F.zip_with(
        begins, ends, lambda i, j: F.struct(F.get(values, i).alias("_term"), (j - i).cast("double").alias("_count"))
    )
    return F.when(F.size(values) > 0, runs)


def naf_text_score(df: DataFrame, text_col: str = "naf_label", terms: int | None = None) -> DataFrame:
    """Sum of the scaled TF-IDF weights of an activity label; zero without one.

    The vocabulary is learnt from the distinct labels of ``df``: all terms, or
    the ``terms`` most frequent ones, the first by name among equal ones. A
    weight is divided by its deviation over the labels, so the inverse document
    frequency cancels out, and only terms of all labels have none.
    """
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    stops = StopWordsRemover(
        inputCol="_words", outputCol="_terms", stopWords=StopWordsRemover.loadDefaultStopWords("french")
    )
    key = F.unhex(F.sha2(F.col(text_col), 256)).alias("_key")
    labels = df.where(F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("_text")).dropDuplicates(["_key"])
    number = F.count(F.lit(1))
    listed = stops.transform(words.transform(labels)).select("_key", F.array_sort("_terms").alias("_sorted"))
    counted = listed.select("_key", F.inline(_counted(F.col("_sorted"))))
    counts = materialise(counted, "terms")
    every = df.agg(F.count_distinct(key)).first()[0]
    table = counts.groupBy("_term").agg(
        number.alias("_labels"), F.sum("_count").alias("_total"), F.sum(F.col("_count") ** 2).alias("_squares")
    )
    if terms is not None:
        table = table.orderBy(F.desc("_total"), "_term").limit(terms)
    # The deviation of a count over all labels, those without the term included.
    spread = F.sqrt((F.col("_squares") - F.col("_total") ** 2 / every) / (every - 1)) if every > 1 else F.lit(0.0)
    weights = table.where(F.col("_labels") < every).select("_term", (1 / spread).alias("_weight"))
    weighted = small_join(counts, materialise(weights, "weights"), ["_term"])
    scores = weighted.groupBy("_key").agg(F.sum(F.col("_count") * F.col("_weight")).alias("_score"))
    scored = salted_join(df.withColumn("_key", key), scores, ["_key"], "left")
    return scored.select(*df.columns, F.coalesce("_score", F.lit(0.0)).alias("naf_semantic_score"))
