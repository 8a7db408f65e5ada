"""Negative pairs, drawn without listing all pairs.

The reference set of a kind of negative is every positive next to every known
entity with another name and another identifier, in the same place or
anywhere. That set is quadratic, so it is never built. All its pairs have a
number: positives stand in one order, those of equal name and identifier have
equally many partners, and partners stand in the order of the candidates. The
wanted numbers are drawn, one out of each of n equal stretches of the whole
range, and each is turned back into its pair: the positive by a range join on
running counts of offers, the candidate by counting what of its place is left out before
it. So a draw has exactly n pairs, none twice, and the whole set if it is no
larger. Work is linear in positives, candidates and n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomenlink.functions.hashing import wide_number
from nomenlink.operators.ordering import counts_upto, in_order, running_sums
from nomenlink.operators.sampling import SEED, hash_sample
from nomenlink.operators.silver import MAX_PAIRS, PAIR_COLUMNS, GeoLevel, known_groups
from nomenlink.operators.skew import salted_join, small_join
from nomenlink.session import materialise

_POSITIVE_KEY = ["missing_row_id", "target_siren", "known_entreprise_nom", "known_location_label", "n_known_rows"]
_CANDIDATE_PLACES = ["cand_city", "cand_zip", "cand_dept"]
# Numbers of positives that are looked up together.
_STRETCH = 1024


def _candidates(norm: DataFrame) -> DataFrame:
    return known_groups(norm).select(
        F.col("nom_key").alias("cand_nom_key"),
        F.col("target_siren").alias("cand_siren"),
        F.col("city_key").alias("cand_city"),
        F.col("zipcode_norm").alias("cand_zip"),
        F.col("dept_norm").alias("cand_dept"),
        F.col("known_entreprise_nom").alias("cand_name"),
        F.col("known_location_label").alias("cand_label"),
        F.col("n_known_rows").alias("cand_rows"),
    )


_CANDIDATE_PLACE = {"city_key": "cand_city", "zipcode_norm": "cand_zip", "dept_norm": "cand_dept"}


def _numbers(spark: SparkSession, total: int, n: int, seed: int) -> DataFrame:
    """n different numbers below ``total``, one of each of n stretches of equal length; all if there are no more."""
    i = F.col("id")
    if total <= n:
        return spark.range(total).select(i.alias("_value"))
    length, longer = divmod(total, n)
    start = i * length + F.least(i, F.lit(longer))
    width = F.lit(length).cast("long") + (i < longer).cast("long")
    return spark.range(n).select((start + F.pmod(wide_number(seed, i), width)).alias("_value"))


def _numbered(candidates: DataFrame, on: list[str], kind: str) -> DataFrame:
    """Candidates with their number ``_pos`` inside their place, by name, identifier and place."""
    rows = candidates.where(F.col("_name").isNotNull() & F.col("_siren").isNotNull()).withColumn("_one", F.lit(1))
    placed = materialise(in_order(rows, *on, "_name", "_siren", *_CANDIDATE_PLACES), f"{kind}-candidates")
    numbered = running_sums(placed, {"_pos": "_one"}, on).withColumn("_pos", F.col("_pos") - 1)
    return materialise(numbered.drop("_one", "at", "part"), f"{kind}-numbered")


def _partners(spans: DataFrame, numbered: DataFrame, on: list[str]) -> DataFrame:
    """How many candidates a positive of each place, name and identifier has, and which numbers are left out.

    Left out are the candidates of the name, which are ``_n_name`` numbers from
    ``_from`` on, and those of the identifier, of which ``_before`` stand ahead
    of that and ``_n_both`` in it.
    """
    kind = [*on, "_name", "_siren"]
    kinds = materialise(spans.select(*kind).distinct(), "kinds")
    rows = F.count(F.lit(1))
    sized = kinds
    for keys, counts in (
        (on, [rows.alias("_n_all")]),
        ([*on, "_name"], [rows.alias("_n_name"), F.min("_pos").alias("_from")]),
        ([*on, "_siren"], [rows.alias("_n_siren")]),
    ):
        sized = salted_join(sized, numbered.groupBy(*keys).agg(*counts), keys, "left", counted=kinds)
    sized = sized.join(numbered.groupBy(*kind).agg(rows.alias("_n_both")), kind, "left")
    sized = sized.fillna(0, ["_n_all", "_n_name", "_from", "_n_siren", "_n_both"])
    same = [*on, "_siren"]
    marks = numbered.select(*same, F.col("_pos").alias("_value"))
    sized = counts_upto(marks, sized.withColumn("_value", F.col("_from") - 1), "_value", same, "_before")
    left = F.col("_n_all") - F.col("_n_name") - F.col("_n_siren") + F.col("_n_both")
    return sized.withColumn("_partners", left).where(left > 0).drop("_value", "_n_all", "_n_siren")


def _positives_at(left: DataFrame, placed: DataFrame, chosen: DataFrame, same: list[str], kind: str) -> DataFrame:
    """``chosen`` with the positive at its number ``_row`` of the part ``_span`` of ``placed``.

    The offer is found first; only the positives of such offers are ordered.
    """
    # An offer is listed in every stretch of numbers it reaches into, a number in the one it lies in.
    stretch = F.lit(_STRETCH)
    last = F.col("_first") + F.col("_rows") - 1
    listed = placed.withColumn(
        "_stretch", F.explode(F.sequence(F.floor(F.col("_first") / stretch), F.floor(last / stretch)))
    ).withColumnRenamed("part", "_span")
    asked = chosen.withColumn("_stretch", F.floor(F.col("_row") / stretch))
    met = small_join(listed, asked, ["_span", "_stretch"], unique=False)
    hit = met.where(F.col("_row").between(F.col("_first"), last))
    hit = hit.withColumn("_nth", F.col("_row") - F.col("_first") + 1).withColumn("_no_id", F.col("missing_row_id").isNull())
    unit = [*same, "_no_id", "_id"]
    hit = materialise(
        hit.withColumn("_id", F.coalesce(F.col("missing_row_id").cast("string"), F.lit(""))).select(
            *unit, "_nth", "cand_siren", "cand_name", "cand_label", "cand_rows"
        ),
        f"{kind}-hit",
    )
    units = materialise(hit.select(*unit).distinct(), f"{kind}-offers")
    keyed = left.withColumn("_no_id", F.col("missing_row_id").isNull()).withColumn(
        "_id", F.coalesce(F.col("missing_row_id").cast("string"), F.lit(""))
    )
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy(*_POSITIVE_KEY))
    ranked = small_join(keyed, units, unit).withColumn("_nth", rank.cast("long"))
    return ranked.join(hit, [*unit, "_nth"])


def _draw(
    positives: DataFrame, candidates: DataFrame, on: list[str], kind: str, n: int, seed: int
) -> DataFrame:
    spark = positives.sparkSession
    if not on:
        on = ["_anywhere"]
        positives, candidates = (side.withColumn("_anywhere", F.lit(0)) for side in (positives, candidates))
    numbered = _numbered(
        candidates.withColumns({"_name": F.col("cand_nom_key"), "_siren": F.col("cand_siren")}), on, kind
    )
    left = positives.withColumns({"_name": F.col("nom_key"), "_siren": F.col("target_siren")}).where(
        F.col("_name").isNotNull() & F.col("_siren").isNotNull()
    )
    same = [*on, "_name", "_siren"]
    # Positives are placed by offer: those of one offer are counted here and told apart only where one is drawn.
    units = left.groupBy(*same, "missing_row_id").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = materialise(in_order(units, *same, "missing_row_id"), f"{kind}-units")
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.withColumn("_first", F.sum("_rows").over(inside) - F.col("_rows"))
    placed = materialise(placed.drop("at"), f"{kind}-positives")
    # Rows of one place, name and identifier are neighbours inside a part.
    spans = placed.groupBy(*same, F.col("part").alias("_span")).agg(
        F.sum("_rows").alias("_rows"), F.min("_first").alias("_first")
    )
    spans = materialise(spans, f"{kind}-spans")
    partners = _partners(spans, numbered, on)
    weighted = spans.join(partners, same).withColumns(
        {"_weight": F.col("_rows") * F.col("_partners"), "_one": F.lit(1)}
    )
    ordered = materialise(in_order(weighted, *same, "_span"), f"{kind}-ordered")
    sums = running_sums(ordered, {"_upto": "_weight", "_number": "_one"}).drop("at", "part")
    spans = materialise(sums.withColumn("_start", F.col("_upto") - F.col("_weight")), f"{kind}-weighted")
    total = spans.agg(F.coalesce(F.max("_upto"), F.lit(0)).alias("n")).first()["n"]

    # Which span, which positive of it, which of its partners.
    drawn = counts_upto(spans.select(F.col("_start").alias("_value")), _numbers(spark, total, n, seed), "_value", name="_number")
    drawn = drawn.join(spans, "_number").withColumn("_value", F.col("_value") - F.col("_start"))
    drawn = drawn.withColumns(
        {"_row": F.col("_first") + F.expr("_value div _partners"), "_value": F.col("_value") % F.col("_partners")}
    )
    # Past the candidates of the name: count as if only those of the identifier were left out.
    passed = F.when(F.col("_value") >= F.col("_from") - F.col("_before"), F.col("_n_name") - F.col("_n_both"))
    drawn = drawn.select(*on, "_siren", "_span", "_row", (F.col("_value") + F.coalesce(passed, F.lit(0))).alias("_value"))
    # The j-th number left out, less j, says how many are kept ahead of it.
    by = [*on, "_siren"]
    ranked = in_order(numbered.select(*by, "_pos", F.lit(1).alias("_one")), *by, "_pos")
    ranked = running_sums(materialise(ranked, f"{kind}-ranked"), {"_rank": "_one"}, by)
    marks = ranked.select(*by, (F.col("_pos") - F.col("_rank") + 1).alias("_value"))
    found = counts_upto(marks, drawn, "_value", by, "_skipped")
    found = found.select(*on, "_span", "_row", (F.col("_value") + F.col("_skipped")).alias("_pos"))
    partner = numbered.select(*on, "_pos", "cand_siren", "cand_name", "cand_label", "cand_rows")
    chosen = materialise(found.join(partner, [*on, "_pos"]).drop(*on, "_pos"), f"{kind}-chosen")
    sampled = _positives_at(left, placed, chosen, same, kind)
    return sampled.select(
        *PAIR_COLUMNS[:7],
        F.col("cand_siren").alias("target_siren"),
        F.col("cand_name").alias("known_entreprise_nom"),
        F.col("cand_label").alias("known_location_label"),
        F.col("cand_rows").alias("n_known_rows"),
        F.lit(0).cast("long").alias("n_sirens_at_grain"),
        F.lit(0).alias("label"),
        F.lit(kind).alias("negative_type"),
    )


def hard_negatives(
    positives: DataFrame,
    norm: DataFrame,
    level: GeoLevel = GeoLevel.DEPARTMENT,
    n: int = MAX_PAIRS // 2,
    seed: int = SEED,
) -> DataFrame:
    """At most n pairs of the same place with another name and identifier."""
    joined_on = [f"_{name}" for name in level.columns]

    def place(df: DataFrame, names: dict[str, str]) -> DataFrame:
        required = F.coalesce(F.col(names[level.required]), F.lit(""))
        return df.where(required != "").withColumns(
            {f"_{name}": F.coalesce(F.col(names[name]), F.lit("")) for name in level.columns}
        )

    left = place(positives, {name: name for name in level.columns})
    right = place(_candidates(norm), _CANDIDATE_PLACE)
    return _draw(left, right, joined_on, "hard_geo", n, seed)


def random_negatives(
    positives: DataFrame, norm: DataFrame, n: int = MAX_PAIRS // 2, seed: int = SEED + 1
) -> DataFrame:
    """At most n pairs from anywhere with another name and identifier."""
    return _draw(positives, _candidates(norm), [], "random", n, seed)


def all_negatives(hard: DataFrame, random: DataFrame, limit: int | None = MAX_PAIRS, seed: int = SEED) -> DataFrame:
    both = hard.unionByName(random)
    return both if limit is None else hash_sample(both, limit, seed)
