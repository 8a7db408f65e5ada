"""Plans and hot keys: what must hold when the tables are large."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.matching import offer_queries
from nomenlink.operators import blocking, coverage, enrich, matcher, negatives, silver, skew, worklist
from nomenlink.session import materialise
from nomenlink.sources import files


@contextmanager
def settings(spark, **values):
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_offers(spark, n=30_000):
    """A third of all offers share one name and place."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 6).select(
        F.col("id").alias("offer_id"),
        F.when(hot, "Hot Company").otherwise(F.concat(F.lit("Company "), (F.col("id") % 997).cast("string"))).alias("entity_name"),
        F.when(F.col("id") % 10 == 1, F.when(hot, "100000001").otherwise((200000000 + F.col("id") % 997).cast("string"))).alias("entity_siren"),
        F.lit("Paris").alias("location_label"),
        F.when(hot, "75001").otherwise((75000 + F.col("id") % 20).cast("string")).alias("location_zipcode"),
        F.lit("75").alias("location_departement"),
    )


def largest_share(df) -> float:
    """Part of all rows that the fullest task puts out."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


SPREAD = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__enabled": "false",
    "spark__sql__shuffle__partitions": "40",
}


def _job(spark, offers, job):
    if job == "positives":
        return silver.silver_positives(silver.normalised_offers(offers, "offer_id"), limit=None)
    if job == "enrich":
        known = "entity_name string, location_label string, location_zipcode string, siren string"
        return enrich.enrich_offers(
            offers.withColumn("entity_siren", F.lit(None).cast("string")),
            spark.createDataFrame([("Hot Company", "Paris", "75001", "1")], known),
        )
    if job == "unrecoverable":
        return coverage.unrecoverable_offers(offers.withColumn("entity_siren", F.lit(None).cast("string")))
    return coverage.recoverable_by_name(offers)


@pytest.mark.parametrize("job", ["positives", "enrich", "recoverable", "unrecoverable"])
def test_a_hot_name_is_spread_over_tasks(spark, monkeypatch, job):
    offers = hot_offers(spark)
    with settings(spark, **SPREAD):
        whole = _job(spark, offers, job)
        expected = sorted(map(str, whole.collect()))
        assert largest_share(whole) > 0.2
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 300)
        spread = _job(spark, offers, job)
        assert largest_share(spread) < 0.12
        assert sorted(map(str, spread.collect())) == expected


def test_null_keys_do_not_meet(spark):
    with settings(spark, **SPREAD):
        rows = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") > 3990, F.col("id").cast("string")).alias("k"))
        lookup = spark.range(3995, 4100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
        joined = skew.salted_join(rows, lookup, ["k"], "left")
        assert joined.count() == 4000
        assert largest_share(joined) < 0.12


def test_null_grains_match_and_are_spread(spark, monkeypatch):
    with settings(spark, **SPREAD):
        zipcode = F.when(F.col("id") % 3 == 1, "").when(F.col("id") % 3 == 2, (F.col("id") % 50).cast("string"))
        rows = spark.range(0, 6000, 1, 4).select("id", F.lit("acme").alias("nom_key"), zipcode.alias("zipcode_norm"))
        grains = rows.groupBy("nom_key", "zipcode_norm").agg(F.count(F.lit(1)).alias("n"))
        monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
        joined = silver.null_safe_grain_join(rows, grains, silver.GeoLevel.ZIPCODE)
        assert joined.columns == ["id", "nom_key", "zipcode_norm", "n"]
        assert joined.count() == 6000
        assert {r["n"] for r in joined.where("zipcode_norm is null").collect()} == {2000}
        assert {r["n"] for r in joined.where("zipcode_norm = ''").collect()} == {2000}
        assert largest_share(joined) < 0.15


def test_reports_read_two_columns(spark, sf, tmp_path):
    path = str(tmp_path / "offers")
    b.offers(spark, sf).write.parquet(path)
    text = plan(coverage.coverage(spark.read.parquet(path)))
    assert "ReadSchema: struct<entity_name:string,entity_siren:double>" in text
    assert "Join" not in text


def test_top_lists_are_not_full_sorts(spark, sf):
    assert "TakeOrderedAndProject" in plan(worklist.work_list(b.offers(spark, sf)))
    assert "TakeOrderedAndProject" in plan(coverage.top_entities(b.employer_offers(spark, sf)))


def test_ranking_limits_before_the_shuffle_and_never_multiplies_rows(spark, sf):
    asked = blocking._query_profiles(offer_queries(spark, sf))
    listed = blocking._register_profiles(b.register(spark, sf))
    text = plan(blocking._top_profiles(asked, listed, 64))
    assert "WindowGroupLimit" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_query_plans_a_cross_join(spark, sf):
    from nomenlink.checks import QUERIES

    for name in ("coverage", "yield_curve", "candidate_blocking", "provider_chain", "ambiguity_report", "roc_auc"):
        text = plan(QUERIES[name](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_one_department_becomes_many_tile_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "QUERY_TILE", 50)
    monkeypatch.setattr(blocking, "PROFILE_TILE", 50)
    offers = hot_offers(spark, 3000)
    register = offers.select(
        F.format_string("%09d", "offer_id").alias("siren"),
        F.format_string("%014d", "offer_id").alias("siret"),
        F.concat_ws(" ", "entity_name", (F.col("offer_id") % 40).cast("string")).alias("raison_sociale"),
        F.lit(None).cast("string").alias("sigle"),
        F.lit(None).cast("string").alias("enseigne"),
        F.lit(None).cast("string").alias("naf_ape"),
        F.col("location_zipcode").alias("code_postal"),
        F.col("location_label").alias("commune"),
        F.col("location_departement").alias("code_departement"),
        F.lit(True).alias("is_headquarters"),
    )
    queries = offers.select(
        F.col("entity_name").alias("name"),
        F.col("location_zipcode").alias("zip_code"),
        F.col("location_label").alias("city"),
        F.col("location_departement").alias("department"),
    ).distinct().withColumn("query_id", F.xxhash64("name", "zip_code"))
    seen = blocking.rank_candidates(queries, register, 4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r"))
    assert seen.where("n != 4 or r != 4").count() == 0
    assert seen.count() == queries.count()


def test_rounds_run_on_all_cores(spark, monkeypatch):
    seen = []

    class Spy(matcher.GBTClassifier):
        def fit(self, dataset):
            seen.append(dataset.rdd.glom().map(len).collect())
            return super().fit(dataset)

    monkeypatch.setattr(matcher, "GBTClassifier", Spy)
    rows = spark.range(0, 4000, 1, 1).select(
        F.concat(F.lit("n"), F.col("id") % 97).alias("nom_key"), (F.col("id") % 10 / 10.0).alias("a"),
        (F.col("id") % 10 > 4).cast("int").alias("label"),
    )
    matcher.train_boosted(rows, rounds=2, columns=["a"], patience=1)
    parts = seen[0]
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts) < 0.5 * sum(parts)


def test_positives_are_placed_by_offer(spark, monkeypatch):
    written = {}

    def spy(df, label):
        written[label] = materialise(df, label)
        return written[label]

    monkeypatch.setattr(negatives, "materialise", spy)
    # One name of 20 offers meets 30 known entities of another place each, a second name the same.
    row = "row_id long, entreprise_nom string, nom_key string, siren_norm string, location_label string, " \
        "city_key string, zipcode_norm string, dept_norm string, is_blacklisted boolean"
    rows = []
    for name, siren in (("acme", "1"), ("other", "2")):
        rows += [(len(rows) + k, name, name, None, None, None, None, "75", False) for k in range(20)]
        rows += [(len(rows) + k, name, name, siren, None, f"c{k}", None, "75", False) for k in range(30)]
    norm = spark.createDataFrame(rows, row)
    positives = silver.silver_positives(norm)
    assert positives.count() == 1200
    drawn = negatives.hard_negatives(positives, norm, n=100)
    assert drawn.count() == 100
    assert written["hard_geo-positives"].count() == 40
    assert negatives.hard_negatives(positives, norm, n=100_000).count() == 1200 * 30


def test_the_join_of_positives_keeps_its_tasks(spark):
    row = "row_id long, entreprise_nom string, nom_key string, siren_norm string, location_label string, " \
        "city_key string, zipcode_norm string, dept_norm string, is_blacklisted boolean"
    rows = [(k, f"n{k % 40}", f"n{k % 40}", "1" if k % 2 else None, None, None, None, "75", False) for k in range(400)]
    rows += [(k + 400, f"n{k % 40}", f"n{k % 40}", None, None, None, None, "75", False) for k in range(400)]
    with settings(spark, spark__sql__adaptive__enabled="true", spark__sql__shuffle__partitions="16"):
        pairs = silver.silver_positives(spark.createDataFrame(rows, row))
        pairs.collect()
        assert pairs.rdd.getNumPartitions() == 16


def test_csv_files_stay_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_CSV_FILE", 10)
    rows = spark.range(0, 95, 1, 1).select(F.lit("a\nb").alias("missing_entreprise_nom"), F.col("id").alias("label"))
    path = str(tmp_path / "gold.csv")
    files.write_csv(rows, path)
    assert len(list((tmp_path / "gold.csv").glob("part-*.csv"))) == 10
    gold = files.load_gold_pairs(spark, path)
    assert gold.where("nom_key = 'a\nb'").count() == 95
    assert "Subquery" not in plan(gold)
