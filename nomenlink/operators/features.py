"""The fourteen features of a training pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.functions import similarity as sim
from nomenlink.functions.identifiers import safe_text
from nomenlink.functions.names import ascii_fold
from nomenlink.operators.skew import small_join
from nomenlink.session import materialise

# --- fixed values: feature names in the order of the model's input
FEATURE_COLUMNS = [
    "fuzz_ratio",
    "fuzz_token_sort",
    "fuzz_token_set",
    "partial_ratio",
    "levenshtein_norm",
    "jaro_winkler",
    "name_exact_key",
    "has_dept",
    "has_zipcode",
    "has_city",
    "log_known_rows",
    "left_len",
    "right_len",
    "len_ratio",
]
MAX_LENGTH_RATIO = 5.0


def pair_flags(left_key: Column, right_key: Column) -> dict[str, Column]:
    """Equal keys, and which parts of the place are known."""
    return {
        "name_exact_key": (left_key == right_key).cast("int"),
        "has_dept": F.col("dept_norm").isNotNull().cast("int"),
        "has_zipcode": F.col("zipcode_norm").isNotNull().cast("int"),
        "has_city": F.col("city_key").isNotNull().cast("int"),
    }


def pair_lengths(left: Column, right: Column) -> dict[str, Column]:
    floor = [F.greatest(F.length(c), F.lit(1)) for c in (left, right)]
    return {
        "log_known_rows": F.log1p(F.coalesce(F.col("n_known_rows"), F.lit(0)).cast("double")),
        "left_len": F.length(left),
        "right_len": F.length(right),
        "len_ratio": F.least(floor[0] / floor[1], F.lit(MAX_LENGTH_RATIO)),
    }


def pair_similarities(left: Column, right: Column) -> dict[str, Column]:
    return {
        "fuzz_ratio": sim.ratio(left, right),
        "fuzz_token_sort": sim.token_sort(left, right),
        "fuzz_token_set": sim.token_set(left, right),
        "partial_ratio": sim.partial(left, right),
        "levenshtein_norm": sim.levenshtein_sim(left, right),
        "jaro_winkler": F.when((left == "") & (right == ""), F.lit(1.0)).otherwise(sim.jaro_winkler(left, right)),
    }


def _similarities(keyed: DataFrame) -> DataFrame:
    """The similarities of each pair of texts, once, dealt to all cores whatever their size."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.select("_left", "_right").distinct().repartition(parts, "_left", "_right")
    return texts.withColumns(pair_similarities(F.col("_left"), F.col("_right")))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Pairs with their features as doubles; nothing is null or not a number.

    An offer meets all known entities of its name, so texts are compared once
    per pair of texts and not once per row. ``pairs`` is read twice.
    """
    keyed = pairs.withColumns(
        {
            "_left": F.lower(safe_text(F.col("missing_entreprise_nom"))),
            "_right": F.lower(safe_text(F.col("known_entreprise_nom"))),
        }
    )
    left, right = F.col("_left"), F.col("_right")
    columns = {
        **pair_flags(F.lower(safe_text(F.col("nom_key"))), ascii_fold(right)),
        **pair_lengths(left, right),
    }
    finite = {
        name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) for name in FEATURE_COLUMNS
    }
    compared = small_join(keyed, materialise(_similarities(keyed), "similarities"), ["_left", "_right"])
    featured = compared.withColumns(columns).withColumns(finite)
    return featured.select(*pairs.columns, *[name for name in FEATURE_COLUMNS if name not in pairs.columns])


def labelled_only(pairs: DataFrame) -> DataFrame:
    return pairs.dropna(subset=["label"])
