"""Silver pairs, negatives, classifier, evaluation, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenlink.operators import matcher, metrics, negatives, silver
from nomenlink.operators.features import pair_features
from nomenlink.operators.sampling import SEED, audit_sample, group_split, limit_pairs
from nomenlink.operators.silver import MAX_PAIRS, GeoLevel
from nomenlink.session import materialise


@dataclass(frozen=True)
class Experiment:
    reports: dict[str, DataFrame]
    pairs: DataFrame
    audit: DataFrame
    model: PipelineModel
    scored: DataFrame
    errors: DataFrame
    summary: DataFrame


def silver_experiment(
    offers: DataFrame,
    level: GeoLevel = GeoLevel.DEPARTMENT,
    id_col: str | None = None,
    max_pairs: int = MAX_PAIRS,
    rounds: int = matcher.MAX_ROUNDS,
    audit_size: int = 1000,
    seed: int = SEED,
) -> Experiment:
    """The whole experiment; pairs and features are written at their borders.

    ``max_pairs`` bounds the labelled pairs the classifier is fitted on; reports
    and audit see all positives.
    """
    norm = materialise(silver.normalised_offers(offers, id_col), "norm")
    positives = materialise(silver.silver_positives(norm, level), "positives")
    fitted = limit_pairs(positives, max_pairs, seed, written=True)
    hard = negatives.hard_negatives(positives, norm, level, max(1, max_pairs // 2), seed)
    random = negatives.random_negatives(positives, norm, max(1, max_pairs // 2), seed + 1)
    pairs = materialise(
        silver.training_pairs(fitted, negatives.all_negatives(hard, random, max_pairs, seed)), "pairs"
    )
    features = materialise(pair_features(pairs), "features")
    boosted = matcher.train_boosted(features, rounds, seed)
    model = boosted.model
    validation = group_split(features, seed=seed).where(F.col("is_validation"))
    scored = materialise(matcher.score_pairs(model, validation), "scored")
    return Experiment(
        reports={
            "overview": silver.norm_overview(norm),
            "ambiguity": silver.ambiguity_report(norm),
            "ambiguous_names": silver.ambiguous_names(norm),
            "positives": silver.positive_summary(positives),
            "negatives": silver.negative_summary(pairs.where(F.col("label") == 0)),
            "labels": silver.label_counts(pairs),
            "importance": matcher.feature_importance(model, offers.sparkSession),
            "evaluation": matcher.evaluate(scored),
        },
        pairs=pairs,
        audit=audit_sample(positives, audit_size, seed),
        model=model,
        scored=scored,
        errors=metrics.error_list(scored, tie_break=("missing_row_id", "target_siren")),
        summary=metrics.experiment_summary(
            pairs, scored, {"strict_geo_level": level.value, "best_iteration": boosted.best_round}
        ),
    )
