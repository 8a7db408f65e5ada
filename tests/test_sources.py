import json
import os

import pytest
from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.operators import sampling, silver
from nomenlink.session import run_dir, shared_dir
from nomenlink.sources import columns, files, offers, register


def test_choose_column_ignores_case():
    names = ["SIREN", "Code_Postal"]
    assert columns.choose_column(names, ["postal_code", "code_postal"]) == "Code_Postal"
    assert columns.choose_column(names, ["x"]) is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="siret"):
        columns.require_columns(spark.createDataFrame([("1",)], "siren string"), ["SIREN", "siret"])
    with pytest.raises(ValueError, match="raison_sociale"):
        register.clean_bulk_register(spark.createDataFrame([("1", "2")], "siren string, siret string"))


def test_discover_columns(spark):
    assert columns.discover_columns(spark.createDataFrame([(1, "a")], "x int, Y string")) == ["x", "Y"]


def test_bulk_register_without_optional_columns(spark):
    raw = spark.createDataFrame(
        [(" 1", "10", " A ", "97110"), (None, "11", "B", "75001"), ("2", "12", "C", None)],
        "siren string, siret string, denomination string, postal_code string",
    )
    got = {r["siret"]: r for r in register.clean_bulk_register(raw).collect()}
    assert set(got) == {"10", "12"}
    assert (got["10"]["siren"], got["10"]["raison_sociale"], got["10"]["code_departement"]) == ("1", "A", "971")
    assert got["10"]["is_headquarters"] is False and got["12"]["code_departement"] is None
    assert list(got["10"].asDict()) == register.REGISTER_COLUMNS


def test_status_and_keys_are_both_required(spark):
    raw = spark.createDataFrame(
        [(None, "1", "A", "A"), ("1", "2", "A", "actif"), ("2", "3", "A", "F"), ("3", "4", "A", None)],
        "siren string, siret string, denomination string, etat_administratif string",
    )
    assert [r["siret"] for r in register.clean_bulk_register(raw).collect()] == ["2"]


def test_partition_codes_stay_text_and_are_pruned(spark, sf):
    root = run_dir(spark, "register")
    register.write_register_partitioned(b.register(spark, sf), root)
    one = register.scan_register(spark, root, "05")
    assert {r[0] for r in one.select("code_departement").distinct().collect()} == {"05"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(code_departement" in plan
    assert register.scan_register(spark, root, "2A").count() == 0
    found = register.register_search(register.scan_register(spark, root), "05", "RI")
    assert all("ri" in r["raison_sociale"].lower() for r in found.collect())


def test_absent_cache_is_empty(spark):
    assert files.scan_cache(spark, run_dir(spark, "absent")).count() == 0


def test_reviewed_decisions_stay_text(spark):
    path = run_dir(spark, "audit") + ".csv"
    reviewed = spark.createDataFrame([("1", 'a "b", c'), ("0", None), (None, "x\ny")], "audit_decision string, audit_comment string")
    files.write_csv(reviewed, path)
    back = files.read_csv(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, reviewed.collect()))
    assert silver.noise_estimate(back).first()["n_audited"] == 2


def test_gold_pairs_keep_their_own_keys(spark):
    path = run_dir(spark, "gold")
    gold = spark.createDataFrame([("A", "b", "1", 1, "k")], "missing_entreprise_nom string, candidate_name string, candidate_siren string, label int, nom_key string")
    gold.write.parquet(path)
    row = files.load_gold_pairs(spark, path).first()
    assert (row["nom_key"], row["n_known_rows"], row["known_entreprise_nom"], row["target_siren"]) == ("k", 1, "b", "1")


def test_text_export_keeps_nulls(spark):
    path = run_dir(spark, "text")
    offers.write_all_string(spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double"), path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == ["Row(a='1', b=None)", "Row(a='2', b='0.5')"]


def test_summary_is_one_json_object(spark):
    path = run_dir(spark, "summary")
    files.write_summary(spark.range(1).select(F.lit(0.5).alias("auc"), F.lit("x").alias("level")), path)
    parts = [name for name in os.listdir(path) if name.endswith(".json")]
    with open(os.path.join(path, parts[0]), encoding="utf-8") as handle:
        assert json.loads(handle.read()) == {"auc": 0.5, "level": "x"}


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or shared_dir(spark))
    assert run_dir(spark, "x").startswith(shared_dir(spark))


def test_audit_columns(spark, sf):
    norm = silver.normalised_offers(b.offers(spark, sf), "offer_id")
    audit = sampling.audit_sample(silver.silver_positives(norm), 20)
    assert audit.count() == 20
    assert audit.columns[-2:] == ["audit_decision", "audit_comment"]
