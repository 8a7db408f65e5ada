"""Features, classifier and metrics."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import SCORED, check
from nomenlink.checks.silver import TRAINING_SQL, training
from nomenlink.operators import features as f
from nomenlink.operators import matcher, metrics
from nomenlink.plans.silver_experiment import silver_experiment
from nomenlink.session import materialise, run_dir
from nomenlink.sources import files

_SCORED = f"with {SCORED}, labelled as (select * from scored where label is not null)"


def _scored(spark, sf):
    return f.labelled_only(b.scored(spark, sf))


@check("labelled_only", f"{_SCORED} select * from labelled")
def labelled_only(spark, sf):
    return _scored(spark, sf)


_DECIDED = f"{_SCORED}, decided as (select *, cast(pred >= 0.5 as int) as pred_label from labelled)"


@check(
    "confusion_matrix",
    f"""{_DECIDED} select label, count(*) filter (where pred_label = 0) as pred_0,
    count(*) filter (where pred_label = 1) as pred_1 from decided group by label""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_scored(spark, sf))


def _class_sql(c: int) -> str:
    return f"""select {c} as c, count(*) filter (where label = {c} and pred_label = {c}) as tp,
    count(*) filter (where pred_label = {c}) as predicted, count(*) filter (where label = {c}) as support from decided"""


_REPORT = f"""{_DECIDED}, counts as ({_class_sql(0)} union all {_class_sql(1)}),
rates as (select *, coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r from counts),
classes as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from rates),
report as (select cast(c as varchar) as class, p as precision, r as recall, f as f1_score, support from classes
  union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) from classes
  union all select 'macro avg', avg(p), avg(r), avg(f), sum(support) from classes
  union all select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) from classes)"""


@check(
    "classification_report",
    f"""{_REPORT} select class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1_score, 9) as f1_score,
    cast(support as bigint) as support from report""",
)
def classification_report(spark, sf):
    report = metrics.classification_report(_scored(spark, sf))
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


_CURVES = f"""{_SCORED}, by_score as (select pred, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg
    from labelled group by pred),
running as (select *, sum(neg) over (order by pred) - neg as neg_below, sum(pos) over (order by pred desc) as tp,
    sum(neg) over (order by pred desc) as fp from by_score),
curves as (select round(sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)), 9) as roc_auc,
    round(sum(pos * tp / (tp + fp)) / sum(pos), 9) as average_precision from running)"""


@check("roc_auc", f"{_CURVES} select roc_auc from curves")
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


@check("average_precision", f"{_CURVES} select average_precision from curves")
def average_precision(spark, sf):
    curve = metrics.average_precision(_scored(spark, sf))
    return curve.select(F.round("average_precision", 9).alias("average_precision"))


_ERRORS = f"""{_DECIDED}, typed as (select *, case when label = 1 and pred_label = 0 then 'silver_positive_low_score'
    when label = 0 and pred_label = 1 then 'negative_high_score' else 'ok' end as error_type from decided)"""


@check("error_types", f"{_ERRORS} select * from typed")
def error_types(spark, sf):
    return metrics.error_types(_scored(spark, sf))


@check(
    "error_list",
    f"{_ERRORS} select * from typed where error_type <> 'ok' order by pred desc, pair_id limit 2000",
)
def error_list(spark, sf):
    return metrics.error_list(_scored(spark, sf), tie_break=("pair_id",))


@check(
    "write_summary",
    f"""{_CURVES} select 'department' as strict_geo_level, count(*) as n_pairs, round(avg(label), 9) as positive_rate,
    any_value(roc_auc) as roc_auc, any_value(average_precision) as average_precision from labelled, curves""",
)
def write_summary(spark, sf):
    scored = _scored(spark, sf)
    path = run_dir(spark, "summary")
    files.write_summary(metrics.experiment_summary(scored, scored, {"strict_geo_level": "department"}), path)
    schema = "strict_geo_level string, n_pairs bigint, positive_rate double, roc_auc double, average_precision double"
    summary = spark.read.schema(schema).json(path)
    rates = [F.round(c, 9).alias(c) for c in ("positive_rate", "roc_auc", "average_precision")]
    return summary.select("strict_geo_level", "n_pairs", *rates)


# ---------------------------------------------------------------------------
# Features

_KEY = ["missing_row_id", "target_siren", "known_entreprise_nom", "n_known_rows", "negative_type"]


@check(
    "pair_flags",
    f"""{TRAINING_SQL} select {', '.join(_KEY)},
    cast(lower(coalesce(nom_key, '')) = lower(strip_accents(coalesce(known_entreprise_nom, ''))) as int) as name_exact_key,
    cast(dept_norm is not null as int) as has_dept, cast(zipcode_norm is not null as int) as has_zipcode,
    cast(city_key is not null as int) as has_city from training""",
)
def pair_flags(spark, sf):
    right = f.ascii_fold(F.lower(f.safe_text(F.col("known_entreprise_nom"))))
    flags = f.pair_flags(F.lower(f.safe_text(F.col("nom_key"))), right)
    return training(spark, sf).select(*_KEY, *[c.alias(name) for name, c in flags.items()])


_LEFT, _RIGHT = "length(coalesce(missing_entreprise_nom, ''))", "length(coalesce(known_entreprise_nom, ''))"


@check(
    "pair_lengths",
    f"""{TRAINING_SQL} select {', '.join(_KEY)}, round(ln(1 + coalesce(n_known_rows, 0)), 9) as log_known_rows,
    cast({_LEFT} as int) as left_len, cast({_RIGHT} as int) as right_len,
    round(least(greatest({_LEFT}, 1) / greatest({_RIGHT}, 1), 5), 9) as len_ratio from training""",
)
def pair_lengths(spark, sf):
    left, right = (F.lower(f.safe_text(F.col(c))) for c in ("missing_entreprise_nom", "known_entreprise_nom"))
    lengths = f.pair_lengths(left, right)
    exact = {"left_len", "right_len"}
    return training(spark, sf).select(
        *_KEY, *[(c if name in exact else F.round(c, 9)).alias(name) for name, c in lengths.items()]
    )


def features(spark, sf):
    return materialise(f.pair_features(training(spark, sf)), "features")


@check("pair_features")
def pair_features(spark, sf):
    return f.pair_features(training(spark, sf)).select(*_KEY, "label", *f.FEATURE_COLUMNS)


# ---------------------------------------------------------------------------
# Classifier

@lru_cache(maxsize=4)
def _trained_once(app_id: str, sf: str):
    rows = features(SparkSession.getActiveSession(), sf)
    return matcher.train_boosted(rows.where(~_gold())), rows


def _gold():
    """Whether a pair is kept out of fitting: those of a fifth of the names."""
    return F.pmod(F.crc32(F.coalesce("nom_key", F.lit(""))), F.lit(5)) == 0


def _boosted(spark, sf):
    """One classifier per session and table folder, for all queries that use one."""
    return _trained_once(spark.sparkContext.applicationId, sf)


def _trained(spark, sf):
    boosted, rows = _boosted(spark, sf)
    return boosted.model, rows


@check("train_matcher")
def train_matcher(spark, sf):
    """The classifier's metrics on the pairs it was not trained on."""
    model, rows = _trained(spark, sf)
    validation = matcher.group_split(rows.where(~_gold())).where("is_validation")
    return matcher.evaluate(matcher.score_pairs(model, validation))


@check("validation_curve")
def validation_curve(spark, sf):
    """The loss on names kept out of fitting after each round, and the round the classifier is cut at."""
    boosted, _ = _boosted(spark, sf)
    rows = [(i, loss, i == boosted.best_round) for i, loss in enumerate(boosted.curve, 1)]
    return spark.createDataFrame(rows, "round int, log_loss double, is_best boolean")


@check("score_pairs")
def score_pairs(spark, sf):
    model, rows = _trained(spark, sf)
    return matcher.score_pairs(model, rows).select(*_KEY, "label", "pred", "pred_label")


@check("feature_importance")
def feature_importance(spark, sf):
    return matcher.feature_importance(_trained(spark, sf)[0], spark)


@check("arbitrate")
def arbitrate(spark, sf):
    model, rows = _trained(spark, sf)
    similarities = [F.col("fuzz_token_sort"), F.col("levenshtein_norm"), F.col("jaro_winkler")]
    keys = [*_KEY, "label"]
    by_model = matcher.arbitrate(rows, model, similarities).select(*keys, "score", F.lit("model").alias("by"))
    by_mean = matcher.arbitrate(rows, None, similarities).select(*keys, "score", F.lit("mean").alias("by"))
    return by_model.unionByName(by_mean)


@check("evaluate_gold")
def evaluate_gold(spark, sf):
    """The classifier's metrics on pairs of names it has never seen."""
    model, rows = _trained(spark, sf)
    path = run_dir(spark, "gold")
    gold = rows.where(_gold()).select(
        "missing_entreprise_nom",
        F.col("known_entreprise_nom").alias("candidate_name"),
        F.col("target_siren").alias("candidate_siren"),
        "label",
    )
    gold.write.parquet(path)
    return matcher.evaluate_gold(model, files.load_gold_pairs(spark, path))


@check("naf_text_score")
def naf_text_score(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("naf_label"))
    scored = matcher.naf_text_score(d)
    return scored.select("doc_id", F.round("naf_semantic_score", 6).alias("naf_semantic_score"))


@check("silver_experiment")
def silver_experiment_(spark, sf):
    done = silver_experiment(b.offers(spark, sf), id_col="offer_id", max_pairs=40_000)
    return done.summary
