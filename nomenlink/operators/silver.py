"""Distant supervision: offers without an identifier paired with known ones."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import clean_numeric_of, siren_norm_of
from nomenlink.functions.names import has_name, key_is_blacklisted, name_norm
from nomenlink.operators.sampling import SEED, limit_pairs, with_row_id
from nomenlink.operators.skew import salted_join

# --- fixed values: lengths, caps and the column names of training pairs -------
MIN_KEY_LENGTH = 3
MAX_PAIRS = 2_000_000
TOP_AMBIGUOUS = 50
AUDIT_Z = 1.96

PAIR_COLUMNS = [
    "missing_row_id",
    "missing_entreprise_nom",
    "missing_location_label",
    "nom_key",
    "city_key",
    "zipcode_norm",
    "dept_norm",
    "target_siren",
    "known_entreprise_nom",
    "known_location_label",
    "n_known_rows",
    "n_sirens_at_grain",
    "label",
]
# --- end of fixed values -----------------------------------------------------

ENTITY = ["nom_key", "city_key", "zipcode_norm", "dept_norm"]


class GeoLevel(str, Enum):
    """How close two places must be; a blank place is close to nothing."""

    DEPARTMENT = "department"
    ZIPCODE = "zipcode"
    CITY_ZIPCODE = "city_zipcode"

    @property
    def columns(self) -> list[str]:
        return {
            "department": ["dept_norm"],
            "zipcode": ["zipcode_norm"],
            "city_zipcode": ["city_key", "zipcode_norm"],
        }[self.value]

    @property
    def required(self) -> str:
        """The column that must not be blank."""
        return self.columns[-1]


def normalised_offers(offers: DataFrame, id_col: str | None = None, drop_blacklisted: bool = True) -> DataFrame:
    """Named offers with keys, codes and a placeholder flag."""
    key = name_norm(F.col("entity_name"))
    named = offers.where(has_name(F.col("entity_name")) & (F.length(key) >= MIN_KEY_LENGTH))
    blacklisted = key_is_blacklisted(F.col("nom_key")) if drop_blacklisted else F.lit(False)
    return with_row_id(named, id_col).select(
        "row_id",
        F.col("entity_name").alias("entreprise_nom"),
        key.alias("nom_key"),
        siren_norm_of(offers, "entity_siren").alias("siren_norm"),
        "location_label",
        name_norm(F.col("location_label")).alias("city_key"),
        clean_numeric_of(offers, "location_zipcode").alias("zipcode_norm"),
        clean_numeric_of(offers, "location_departement").alias("dept_norm"),
    ).withColumn("is_blacklisted", blacklisted)


def norm_overview(norm: DataFrame) -> DataFrame:
    return norm.agg(
        F.count(F.lit(1)).alias("n_rows_with_name"),
        F.count("siren_norm").alias("n_with_siren"),
        F.count_if(F.col("siren_norm").isNull()).alias("n_without_siren"),
        F.count_if("is_blacklisted").alias("n_blacklisted"),
        F.count_distinct("nom_key").alias("n_distinct_names"),
    )


# Grain of a report line -> columns it groups by.
GRAINS = {
    "name": ["nom_key"],
    "name+department": ["nom_key", "dept_norm"],
    "name+zipcode": ["nom_key", "zipcode_norm"],
    "name+city+zipcode": ["nom_key", "city_key", "zipcode_norm"],
}


def ambiguity_report(norm: DataFrame) -> DataFrame:
    """Groups with one and with several identifiers, at four grains.

    The offers are aggregated once to (entity, identifiers seen); the four
    grains regroup that small table. A group has several identifiers exactly
    when its lowest and highest differ, so nothing distinct is collected.
    """
    entities = (
        norm.where(~F.col("is_blacklisted"))
        .groupBy(*ENTITY)
        .agg(F.count(F.lit(1)).alias("n"), F.min("siren_norm").alias("lo"), F.max("siren_norm").alias("hi"))
    )
    grouped = entities.groupingSets([[F.col(c) for c in columns] for columns in GRAINS.values()], *ENTITY).agg(
        F.grouping_id().alias("grain_id"),
        F.sum("n").alias("n_rows"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    # grouping_id has one bit per column of ENTITY, set when it is left out.
    width = len(ENTITY)
    grain = F.lit(None).cast("string")
    for label, columns in GRAINS.items():
        bits = sum(1 << (width - 1 - i) for i, name in enumerate(ENTITY) if name not in columns)
        grain = F.when(F.col("grain_id") == bits, label).otherwise(grain)
    several = F.col("lo") != F.col("hi")
    return (
        grouped.withColumn("grain", grain)
        .groupBy("grain")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(F.col("lo") == F.col("hi")).alias("n_unambiguous_groups"),
            F.count_if(several).alias("n_ambiguous_groups"),
            F.sum("n_rows").alias("n_rows"),
            F.sum(F.when(several, F.col("n_rows"))).alias("rows_ambiguous"),
        )
    )


def ambiguous_names(norm: DataFrame, top: int = TOP_AMBIGUOUS) -> DataFrame:
    """Names with several identifiers, the most frequent ones, with the list.

    Only the names of the report have their identifiers gathered.
    """
    pairs = (
        norm.where(~F.col("is_blacklisted")).groupBy("nom_key", "siren_norm").agg(F.count(F.lit(1)).alias("n"))
    )
    names = (
        pairs.groupBy("nom_key")
        .agg(F.sum("n").alias("n_rows"), F.count("siren_norm").alias("n_sirens"))
        .where(F.col("n_sirens") > 1)
        .orderBy(F.desc("n_rows"), F.desc("n_sirens"), "nom_key")
        .limit(top)
    )
    listed = (
        pairs.where(F.col("siren_norm").isNotNull())
        .join(F.broadcast(names), "nom_key")
        .groupBy("nom_key", "n_rows", "n_sirens")
        .agg(F.array_join(F.array_sort(F.collect_list("siren_norm")), ", ").alias("sirens"))
    )
    return listed.orderBy(F.desc("n_rows"), F.desc("n_sirens"), "nom_key")


def known_groups(norm: DataFrame) -> DataFrame:
    """Distinct known entities with an example name and their row count."""
    return (
        norm.where(F.col("siren_norm").isNotNull() & ~F.col("is_blacklisted"))
        .groupBy("nom_key", F.col("siren_norm").alias("target_siren"), "city_key", "zipcode_norm", "dept_norm")
        .agg(
            F.min("entreprise_nom").alias("known_entreprise_nom"),
            F.min("location_label").alias("known_location_label"),
            F.count(F.lit(1)).alias("n_known_rows"),
        )
    )


def missing_offers(norm: DataFrame) -> DataFrame:
    return norm.where(F.col("siren_norm").isNull() & ~F.col("is_blacklisted")).select(
        F.col("row_id").alias("missing_row_id"),
        F.col("entreprise_nom").alias("missing_entreprise_nom"),
        F.col("location_label").alias("missing_location_label"),
        *ENTITY,
    )


def unambiguous_grain(known: DataFrame, level: GeoLevel = GeoLevel.DEPARTMENT) -> DataFrame:
    """Distinct identifiers per name and place."""
    return known.groupBy("nom_key", *level.columns).agg(F.count_distinct("target_siren").alias("n_sirens_at_grain"))


def null_safe_grain_join(pairs: DataFrame, grains: DataFrame, level: GeoLevel) -> DataFrame:
    """Attach the grain counts to rows of the same grain; nulls match nulls.

    Each key is joined as its value and a mark for null, neither of which is
    ever null, so that frequent grains, those of nulls included, are salted.
    """
    keys = ["nom_key", *level.columns]
    marks = [f"_null_{key}" for key in keys]

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_value_{key}": F.coalesce(F.col(key), F.lit("")) for key in keys}).withColumns(
            {f"_null_{key}": F.col(key).isNull() for key in keys}
        )

    on = [f"_value_{key}" for key in keys] + marks
    joined = salted_join(marked(pairs), marked(grains).drop(*keys), on)
    return joined.drop(*on)


def _place_key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def silver_positives(
    norm: DataFrame,
    level: GeoLevel = GeoLevel.DEPARTMENT,
    require_unambiguous: bool = True,
    limit: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Offers without an identifier next to known entities of the same name and place.

    Only the small aggregated sides are joined to each other; the offers are
    shuffled once, on name and place, with frequent names spread. Blank places
    are kept out of that shuffle, where they would all meet. ``norm`` is read
    four times: pass a written table.
    """
    known = known_groups(norm)
    grains = unambiguous_grain(known, level)
    if require_unambiguous:
        grains = grains.where(F.col("n_sirens_at_grain") == 1)
    joined_on = [f"_{name}" for name in level.columns]

    def keyed(df: DataFrame) -> DataFrame:
        return df.where(_place_key(level.required) != "").withColumns(
            {f"_{name}": _place_key(name) for name in level.columns}
        )

    # A blank city equals a missing one between the two offers but not at the
    # grain, so the grain's own columns are compared once more at the end.
    grain_columns = {name: f"grain_{name}" for name in level.columns}
    targets = keyed(known.select("nom_key", *level.columns, "target_siren", "known_entreprise_nom",
                                 "known_location_label", "n_known_rows")).drop(*level.columns).join(
        keyed(grains).withColumnsRenamed(grain_columns), ["nom_key", *joined_on]
    )
    pairs = salted_join(keyed(missing_offers(norm)), targets, ["nom_key", *joined_on], grows=True)
    for name, grain_name in grain_columns.items():
        pairs = pairs.where(F.col(name).eqNullSafe(F.col(grain_name)))
    return limit_pairs(pairs.withColumn("label", F.lit(1)).select(*PAIR_COLUMNS), limit, seed)


def positive_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n_positive_pairs"),
        F.count_distinct("missing_row_id").alias("n_missing_rows_covered"),
        F.count_distinct("nom_key").alias("n_names_covered"),
        F.count_distinct("target_siren").alias("n_target_sirens"),
    )


def noise_estimate(reviewed: DataFrame) -> DataFrame:
    """Share of wrong pairs among decided ones, with a 95 % half-width."""
    decision = F.trim(F.col("audit_decision"))
    decided = reviewed.where(decision.isin("0", "1"))
    n = F.count(F.lit(1))
    noise = 1 - F.avg(decision.cast("int"))
    return decided.agg(n.alias("n_audited"), noise.alias("noise")).withColumn(
        "half_width",
        F.lit(AUDIT_Z) * F.sqrt(F.col("noise") * (1 - F.col("noise")) / F.nullif(F.col("n_audited"), F.lit(0))),
    )


def training_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.withColumn("negative_type", F.lit("positive")).unionByName(negatives)


def negative_summary(negatives: DataFrame) -> DataFrame:
    return negatives.groupBy("label", "negative_type").agg(F.count(F.lit(1)).alias("n"))


def label_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def positive_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("label").cast("double")).alias("positive_rate")
    )
