"""The search for best names next to brute force over all rows of a department."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.functions import similarity as sim
from nomenlink.operators import name_search as search
from nomenlink.operators import resolve

REGISTER = (
    "siren string, siret string, raison_sociale string, enseigne string, sigle string, naf_ape string, "
    "code_postal string, commune string, code_departement string, is_headquarters boolean"
)
QUERIES = "query_id long, name string, zip_code string, city string, department string"


def _fixture(spark, seed=4, rows=260, asked=90):
    rng = random.Random(seed)
    words = ["gare", "garage", "boulangerie", "du", "nord", "sud", "société", "transports", "martin", "marin", "et", "fils"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    bend = lambda t: t if rng.random() < 0.5 or not t else t.replace(rng.choice(t), rng.choice("aeimx "), 1)
    register = []
    for i in range(rows):
        siren = None if i % 17 == 0 else f"{i % 200:09d}"
        dept = rng.choice(["01", "01", "01", "2A", None])
        texts = (rng.choice([name().upper(), name(), None]), rng.choice([name(), None]), rng.choice(["GN", "sf", None, ""]))
        register.append((siren, f"s{i}", *texts, "1", rng.choice(["01000", "01100", None]), rng.choice(["Bourg", "Oyonnax", None]), dept, rng.choice([True, False, None])))
    queries = []
    for i in range(asked):
        known = rng.choice(register)[2] or name()
        city = rng.choice(["bourg", "OYONNAX", None, ""])
        queries.append((i, bend(rng.choice([known, known.lower(), name(), "GN", None, ""]) or ""), rng.choice(["01000", "01100", None, ""]), city, rng.choice(["01", "01", "2A", "75", None])))
    return spark.createDataFrame(queries, QUERIES).repartition(3), spark.createDataFrame(register, REGISTER).repartition(3)


def _pairs(queries, register, score):
    """Every query beside every row of its department, with the score of both names."""
    both = queries.join(register, F.col("department") == F.col("code_departement"))
    x = score.text(F.col("name"))
    texts = [score.text(F.col(c)) for c in ("raison_sociale", "enseigne", "sigle")]
    own = {
        "sim_levenshtein": lambda: sim.levenshtein_sim(x, texts[0]),
        "sim_token_sort": lambda: sim.token_sort(x, texts[0]),
        "name_sim": lambda: sim.greatest_name_sim(x, *texts),
        "sim_sequence": lambda: sim.sequence_sim(x, texts[0]),
    }
    total = sum((own[p]() for p in score.parts), F.lit(0.0)) / len(score.parts)
    acronym = F.lower(F.coalesce("sigle", F.lit("")))
    same_zip = (F.coalesce("zip_code", F.lit("")) != "") & F.col("code_postal").eqNullSafe(F.col("zip_code"))
    same_city = (F.coalesce("city", F.lit("")) != "") & F.lower("commune").eqNullSafe(F.lower("city"))
    priority = (
        F.when((acronym != "") & (acronym == F.lower(F.coalesce("name", F.lit("")))), 0)
        .when(same_zip & same_city, 1).when(same_zip, 2).otherwise(3)
    )
    return both.withColumns({"plain": F.round(total, 9), "priority": priority, "at_home": same_zip})


@pytest.mark.parametrize("parts", [("sim_token_sort", "sim_levenshtein"), ("name_sim", "sim_levenshtein"), ("name_sim",)])
@pytest.mark.parametrize("threshold, case", [(0.85, False), (0.3, True)])
def test_best_rows_against_all_pairs(spark, parts, threshold, case):
    score = search.NameScore(parts, case)
    queries, register = _fixture(spark)
    key = lambda r: (-r["plain"], r["priority"], not r["is_headquarters"], r["siren"] is not None, r["siren"] or "", r["siret"])
    expected = {}
    for row in _pairs(queries, register, score).where((F.col("plain") >= threshold) & (F.col("plain") > 0)).collect():
        best = expected.get(row["query_id"])
        expected[row["query_id"]] = row if best is None or key(row) < key(best) else best
    found = search.best_rows(queries, register, score, threshold).collect()
    assert {(r["query_id"], r["score"], r["priority"], r["siret"]) for r in found} == {
        (q, r["plain"], r["priority"], r["siret"]) for q, r in expected.items()
    }
    assert len(found) == len(expected) > 5


def test_best_lookup_against_all_pairs(spark):
    queries, register = _fixture(spark, 7)
    score = search.NameScore(("sim_sequence",))
    expected = {}
    for row in _pairs(queries, register.where("siren is not null"), score).collect():
        lifted = min(1.0, round(row["plain"] + 0.1, 9)) if row["is_headquarters"] and row["at_home"] else row["plain"]
        if lifted >= 0.55:
            key = (-lifted, not row["is_headquarters"], row["siren"], row["siret"])
            expected[row["query_id"]] = min(expected.get(row["query_id"], key), key)
    found = search.best_lookup(queries, register, 0.55, 0.1).collect()
    assert {r["query_id"]: (-r["score"], not r["is_headquarters"], r["siren"], r["siret"]) for r in found} == expected


def test_cosine_enters_the_mean_where_both_names_have_one(spark):
    queries, register = _fixture(spark, 9, rows=120, asked=40)
    names = queries.select(F.col("name").alias("text")).union(register.select("raison_sociale")).distinct()
    number = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long")
    vectors = names.where("text is not null").where(number % 4 != 0).select(
        "text", F.array(*[F.cos(number * (i + 1)) for i in range(3)]).alias("vector")
    )
    score = search.NameScore(("sim_token_sort", "sim_levenshtein"))
    own = vectors.select(F.col("text").alias("name"), F.col("vector").alias("x"))
    held = vectors.select(F.col("text").alias("raison_sociale"), F.col("vector").alias("y"))
    pairs = _pairs(queries, register, score).join(own, "name", "left").join(held, "raison_sociale", "left")
    cosine = sim.cosine(F.col("x"), F.col("y"))
    # The mean of two similarities is known, so is their sum.
    total = F.when(cosine.isNull(), F.col("plain")).otherwise((2 * F.col("plain") + cosine) / 3)
    expected = {
        r["query_id"]: r["s"] for r in pairs.groupBy("query_id").agg(F.max(total).alias("s")).where("s >= 0.6").collect()
    }
    found = {r["query_id"]: r["score"] for r in search.best_rows(queries, register, score, 0.6, vectors).collect()}
    assert found == pytest.approx(expected, abs=1e-8)


def test_a_better_name_beyond_the_first_64_rows_wins(spark):
    """Closer places come first in a ranking; the score decides here."""
    near = [(f"{i:09d}", f"s{i}", f"société numéro {i}", None, None, "1", "01000", "Bourg", "01", True) for i in range(80)]
    far = [("999999999", "far", "Transports Martin", None, None, "1", "01500", "Autre", "01", False)]
    register = spark.createDataFrame(near + far, REGISTER)
    asked = spark.createDataFrame([("transports martin", "a", "Transports Martin", ("1 rue", "01000", "Bourg", "01"))],
        "name_key string, address_key string, name string, addr struct<street:string,zip_code:string,city:string,department_hint:string>")
    for provider in (resolve.register_provider(register), resolve.name_lookup_provider(register)):
        assert [r["siren"] for r in provider.resolve(asked).collect()] == ["999999999"]


def test_comparisons_grow_far_slower_than_pairs(spark):
    """Random names: what can still win is a shrinking share of all pairs."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def effort(number):
        names = ["".join(letters[rng.integers(0, 26, 14)]) for _ in range(number)]
        queries = spark.createDataFrame([(i, n[:-1] + "z", "01000", "b", "01") for i, n in enumerate(names)], QUERIES)
        register = spark.createDataFrame([(f"{i:09d}", f"s{i}", n, None, None, "1", "01000", "b", "01", True) for i, n in enumerate(names)], REGISTER)
        row = search.search_effort(queries, register, search.NameScore(), 0.85).first()
        return row["possible"], row["compared"]

    (few_possible, few), (many_possible, many) = effort(300), effort(3000)
    assert many_possible == 100 * few_possible
    assert many < 0.01 * many_possible and many < 60 * few


def test_only_asked_departments_are_read(spark, tmp_path):
    _, register = _fixture(spark)
    register.write.partitionBy("code_departement").parquet(str(tmp_path / "register"))
    listed = spark.read.parquet(str(tmp_path / "register"))
    asked = spark.createDataFrame([("2A",)], "dept string")
    plan = search._text_rows(listed, asked, search.NameScore())._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(code_departement" in plan


def test_pair_kernels_equal_the_columns(apply):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé 𝒜") for _ in range(rng.randint(0, 30)))
    pairs = [(word(), word()) for _ in range(300)]
    pairs += [(a, a[1:] + "x") for a, _ in pairs[:100]]
    a, b = map(list, zip(*pairs))
    assert np.allclose(sim.levenshtein_sims(a, b), apply(sim.levenshtein_sim, *pairs))
    one_by_one = [sim.jaro_winkler_to(x, *sim.encode([y]))[0] for x, y in pairs]
    assert np.allclose(sim.jaro_winkler_pairs(a, b), one_by_one)


def test_token_mode_recalls_the_exact_matches(spark):
    queries, register = _fixture(spark, 11, rows=600, asked=400)
    queries = queries.where("name like '% %'")  # a single misspelt word is not found by words
    score = search.NameScore(case_sensitive=False)
    exact = {r["query_id"]: r["siret"] for r in search.best_rows(queries, register, score, 0.85).collect()}
    token = {r["query_id"]: r["siret"] for r in search.best_rows(queries, register, score, 0.85, mode="token").collect()}
    assert len(exact) > 20
    assert sum(token.get(q) == siret for q, siret in exact.items()) >= 0.9 * len(exact)
    # What it finds is a match of the exact mode, or a lesser one of the same query.
    assert set(token) <= set(exact)
    with pytest.raises(ValueError):
        search.best_rows(queries, register, score, 0.85, mode="other")
