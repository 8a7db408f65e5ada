import random
from collections import Counter

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.functions import similarity as sim
from nomenlink.operators import blocking, cache, enrich, features, matcher, metrics, negatives, resolve, sampling, silver
from nomenlink.operators.ordering import counts_upto
from nomenlink.operators.features import FEATURE_COLUMNS, pair_features
from nomenlink.schemas import CACHE_SCHEMA, CONFIDENCE_NONE

OFFER = "entity_name string, entity_siren string, location_label string, location_zipcode string, location_departement string"


def test_enrich_prefers_own_then_known_then_resolved(spark):
    offers = spark.createDataFrame(
        [
            ("Acme", "1", "Paris", "75001", "75"),
            ("ACME ", None, "Paris", "75001", "75"),
            ("acme", None, "Paris", "75001", "75"),
            ("Beta", None, None, None, None),
            (None, None, "Paris", "75001", "75"),
        ],
        OFFER,
    )
    resolved = spark.createDataFrame(
        [("Acme", "Paris", "75001", "2"), ("beta", None, None, "3"), ("Beta ", None, None, "3")],
        "entity_name string, location_label string, location_zipcode string, siren string",
    )
    rows = enrich.enrich_offers(offers, resolved).collect()
    assert len(rows) == 5
    got = sorted((r["entity_name"] or "", r["entity_siren"]) for r in rows)
    assert got == [
        ("", None),
        ("ACME ", "000000001"),
        ("Acme", "000000001"),
        ("Beta", "000000003"),
        ("acme", "000000001"),
    ]


def _norm(spark, rows):
    columns = "offer_id bigint, entity_name string, entity_siren string, location_label string, location_zipcode string, location_departement string"
    return silver.normalised_offers(spark.createDataFrame(rows, columns), "offer_id")


def test_blank_places_never_join_but_blank_cities_do(spark):
    norm = _norm(
        spark,
        [
            (1, "acme", None, None, "75001", ""),
            (2, "acme", "11", "", "75001", ""),
            (3, "acme", None, "", "75001", "75"),
        ],
    )
    assert silver.silver_positives(norm).count() == 0
    by_city = silver.silver_positives(norm, silver.GeoLevel.CITY_ZIPCODE)
    # A missing city meets a blank one, but has no grain of its own.
    assert [r["missing_row_id"] for r in by_city.collect()] == [3]


def test_negatives_are_exact_when_they_fit(spark):
    random.seed(5)
    rows = []
    for k in range(120):
        siren = None if (k // 6) % 2 else str(1 + k % 14)
        rows.append((k, f"name{k % 6}", siren, "c", "75001", f"{k % 3:02d}"))
    norm = _norm(spark, rows)
    positives = silver.silver_positives(norm, require_unambiguous=False).cache()
    known = silver.known_groups(norm).collect()
    expected = sorted(
        (p["missing_row_id"], k["target_siren"], k["nom_key"])
        for p in positives.collect()
        for k in known
        if p["dept_norm"] == k["dept_norm"] and p["nom_key"] != k["nom_key"] and p["target_siren"] != k["target_siren"]
    )
    assert len(expected) > 100
    hard = negatives.hard_negatives(positives, norm).collect()
    assert sorted((r["missing_row_id"], r["target_siren"], r["known_entreprise_nom"]) for r in hard) == expected
    assert all(r["label"] == 0 and r["nom_key"] != r["known_entreprise_nom"] for r in hard)
    small = negatives.hard_negatives(positives, norm, n=10)
    assert small.count() == 10
    assert sorted(map(tuple, small.collect())) == sorted(
        map(tuple, negatives.hard_negatives(positives, norm, n=10).collect())
    )


def test_draws_have_the_wanted_number_and_no_pair_twice(spark):
    random.seed(11)
    # One name and one identifier hold a third of the rows each.
    rows = []
    for k in range(240):
        name = "hot" if k % 3 == 0 else f"name{k % 11}"
        siren = None if k % 4 == 1 else "9" if k % 3 == 1 else str(1 + k % 13)
        rows.append((k, name, siren, f"city{k % 5}", f"{75001 + k % 7}", f"{k % 2:02d}"))
    norm = _norm(spark, rows).cache()
    positives = silver.silver_positives(norm, require_unambiguous=False).cache()
    known, left = silver.known_groups(norm).collect(), positives.collect()

    for draw, same_place in ((negatives.hard_negatives, True), (negatives.random_negatives, False)):
        listed = Counter(
            (p["missing_row_id"], p["nom_key"], k["target_siren"], k["known_entreprise_nom"], k["known_location_label"])
            for p in left
            for k in known
            if (not same_place or p["dept_norm"] == k["dept_norm"])
            and p["nom_key"] != k["nom_key"]
            and p["target_siren"] != k["target_siren"]
        )
        for n in (listed.total(), listed.total() // 2):
            pairs = draw(positives, norm, n=n).select(
                "missing_row_id", "nom_key", "target_siren", "known_entreprise_nom", "known_location_label"
            )
            drawn = Counter(map(tuple, pairs.collect()))
            assert drawn.total() == n and drawn <= listed
    assert negatives.random_negatives(positives.limit(0), norm).count() == 0


def test_drawn_numbers_differ_and_span_the_range(spark):
    for total, n in ((0, 5), (5, 5), (7, 5), (1000, 7), (10**17, 50)):
        numbers = [r[0] for r in negatives._numbers(spark, total, n, 1).collect()]
        assert len(set(numbers)) == len(numbers) == min(n, total)
        assert all(i * total // n - 1 <= x <= (i + 1) * total // n + 1 for i, x in enumerate(sorted(numbers)) if total > n)
        assert all(0 <= x < total for x in numbers)


def test_counting_marks_up_to_a_value(spark):
    random.seed(3)
    marks = [(random.choice("ab"), random.randrange(30)) for _ in range(400)]
    asks = [(n, random.choice("abc"), random.randrange(-2, 33)) for n in range(90)]
    counted = counts_upto(
        spark.createDataFrame(marks, "g string, v long"), spark.createDataFrame(asks, "n long, g string, v long"), "v", ["g"]
    )
    expected = [(n, g, v, sum(h == g and w <= v for h, w in marks)) for n, g, v in asks]
    assert sorted(map(tuple, counted.collect())) == expected


def test_large_samples_equal_a_sorted_limit(spark, monkeypatch):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    expected = sorted(r["id"] for r in sampling.hash_sample(df, 1234, 3).collect())
    monkeypatch.setattr(sampling, "SORTED_LIMIT", 10)
    assert sorted(r["id"] for r in sampling.hash_sample(df, 1234, 3).collect()) == expected
    assert sampling.hash_sample(df, 6000, 3).count() == 5000


def test_a_large_sample_reads_the_rows_at_most_twice(spark, monkeypatch):
    seen, write = spark.sparkContext.accumulator(0), sampling.materialise

    @F.udf("long")
    def same(number):
        seen.add(1)
        return number

    def counted(df, label):
        stored = write(df, label)
        return stored.withColumn("id", same.asNondeterministic()("id")) if label == "sample" else stored

    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    expected = sorted(r["id"] for r in sampling.hash_sample(df, 1234, 3).collect())
    monkeypatch.setattr(sampling, "SORTED_LIMIT", 10)
    monkeypatch.setattr(sampling, "materialise", counted)
    assert sorted(r["id"] for r in sampling.hash_sample(df, 1234, 3).collect()) == expected
    assert 5000 <= seen.value <= 2 * 5000


def test_a_sample_by_keys_that_repeat_is_whole(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SORTED_LIMIT", 10)
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    ranked = sorted(range(7), key=lambda x: spark.range(1).select(sampling.digest(3, F.lit(x))).first()[0])
    for n in (20, 700, 2000):
        found = [r["x"] for r in sampling.hash_sample(df, n, 3, keys=["x"]).collect()]
        whole = n // 715  # a value has 714 or 715 rows
        assert len(found) == n and set(found) == set(ranked[: whole + 1])


def test_row_ids_are_unique_and_stable(spark):
    df = spark.createDataFrame([("a", 1)] * 250 + [("b", None)] * 3, "x string, y int")
    first = sorted(map(tuple, sampling.with_row_id(df, chunk=100).collect()), key=str)
    again = sorted(map(tuple, sampling.with_row_id(df.repartition(3), chunk=7).collect()), key=str)
    assert len({r[2] for r in first}) == 253
    assert first == again


def test_split_keeps_names_together(spark):
    df = spark.range(4000).select(F.concat(F.lit("n"), (F.col("id") % 500).cast("string")).alias("nom_key"))
    sides = sampling.group_split(df).groupBy("nom_key").agg(F.count_distinct("is_validation").alias("n"))
    assert sides.where("n > 1").count() == 0
    share = sampling.group_split(df).agg(F.avg(F.col("is_validation").cast("int"))).first()[0]
    assert 0.1 < share < 0.3


def test_noise(spark):
    reviewed = spark.createDataFrame([("1",), (" 1",), ("0",), ("?",), ("",), (None,)], "audit_decision string")
    row = silver.noise_estimate(reviewed).first()
    assert row["n_audited"] == 3
    assert row["noise"] == pytest.approx(1 / 3)
    assert row["half_width"] == pytest.approx(1.96 * (2 / 27) ** 0.5)
    none = silver.noise_estimate(reviewed.where("audit_decision = '?'")).first()
    assert (none["n_audited"], none["noise"], none["half_width"]) == (0, None, None)


def _scored(spark, rows):
    return spark.createDataFrame(rows, "label int, pred double")


def test_curves(spark):
    falling = _scored(spark, [(1, 0.9), (0, 0.5), (1, 0.1)])
    assert metrics.average_precision(falling).first()[0] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.roc_auc(falling).first()[0] == pytest.approx(0.5)
    tied = _scored(spark, [(1, 0.4), (0, 0.4), (1, 0.4), (0, 0.4)])
    assert metrics.roc_auc(tied).first()[0] == 0.5


def test_curves_equal_brute_force(spark):
    random.seed(1)
    rows = [(random.randint(0, 1), random.choice([random.random(), 0.25, 1.0, 0.0])) for _ in range(400)]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(p for _, p in rows), reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp - seen) / len(pos) * tp / (tp + sum(q >= t for q in neg))
        seen = tp
    assert metrics.roc_auc(_scored(spark, rows)).first()[0] == pytest.approx(auc)
    assert metrics.average_precision(_scored(spark, rows)).first()[0] == pytest.approx(ap)


def _brute_force(queries, rows, k):
    result = {}
    for q in queries:
        ranked = []
        for r in rows:
            if q["department"] is None or r["code_departement"] != q["department"]:
                continue
            texts = [(r[c] or "").lower() for c in ("raison_sociale", "enseigne", "sigle")]
            score = max(round(float(x), 9) for x in sim.jaro_winkler_to(q["name"].lower(), *sim.encode(texts)))
            same_zip = q["zip_code"] and r["code_postal"] == q["zip_code"]
            same_city = q["city"] and (r["commune"] or "").lower() == q["city"].lower()
            if texts[2] and texts[2] == q["name"].lower():
                priority = 0
            elif same_zip and same_city:
                priority = 1
            else:
                priority = 2 if same_zip else 3
            ranked.append((priority, -score, not r["is_headquarters"], r["siren"], r["siret"]))
        result[q["query_id"]] = [(p, -s, siret) for p, s, _, _, siret in sorted(ranked)[:k]]
    return result


@pytest.mark.parametrize(("k", "q_tile", "p_tile"), [(5, 1024, 2048), (3, 4, 5), (64, 3, 7)])
def test_ranking_equals_brute_force(spark, monkeypatch, k, q_tile, p_tile):
    monkeypatch.setattr(blocking, "QUERY_TILE", q_tile)
    monkeypatch.setattr(blocking, "PROFILE_TILE", p_tile)
    random.seed(k)
    words = ["acme", "beta", "gamma", "ring", "sas", "b1"]

    def name():
        return " ".join(random.choices(words, k=2))

    register = [
        {
            "siren": f"{i % 90:09d}", "siret": f"{i:014d}", "raison_sociale": name().upper(),
            "sigle": random.choice([None, "B1", ""]), "enseigne": random.choice([None, name()]), "naf_ape": None,
            "code_postal": random.choice(["75001", "75002", None]), "commune": random.choice(["Paris", "LYON", None]),
            "code_departement": random.choice(["75", "75", "69", None]), "is_headquarters": random.random() < 0.4,
        }
        for i in range(150)
    ]
    register += [dict(register[0], siret=f"9{i:013d}", code_departement="75") for i in range(80)]
    queries = [
        {
            "query_id": i, "name": random.choice(["b1", name()]), "zip_code": random.choice(["75001", "", None]),
            "city": random.choice(["paris", "Lyon", None]), "department": random.choice(["75", "69", "2A", None]),
        }
        for i in range(40)
    ]
    q_schema = "query_id int, name string, zip_code string, city string, department string"
    from nomenlink.schemas import REGISTER_SCHEMA

    listed = spark.createDataFrame([{**r, "naf_label": None} for r in register], REGISTER_SCHEMA)
    got = {}
    for row in blocking.rank_candidates(spark.createDataFrame(queries, q_schema), listed, k).orderBy("rank").collect():
        got.setdefault(row["query_id"], []).append((row["priority"], row["name_sim"], row["siret"]))
    expected = {q: rows for q, rows in _brute_force(queries, register, k).items() if rows}
    assert got == expected


def test_best_match_takes_the_earlier_of_equal_scores(spark):
    scored = spark.createDataFrame(
        [("a", 1, "x", 0.9), ("a", 2, "y", 0.9), ("a", 3, "z", 0.86), ("b", 1, "w", 0.5)],
        "query_id string, rank int, siren string, score double",
    )
    assert [(r["query_id"], r["siren"]) for r in resolve.best_match(scored).collect()] == [("a", "x")]


def test_mean_score_ignores_what_is_missing(spark):
    row = spark.range(1).select(
        resolve.mean_score(F.lit(0.5), F.lit(1.0), F.lit(None).cast("double")).alias("two"),
        resolve.mean_score(F.lit(None).cast("double")).alias("none"),
    )
    assert tuple(row.first()) == (0.75, None)


def test_last_cache_row_wins_and_unusable_ones_are_ignored(spark):
    rows = [("A ", '{"CityName":"P"}', "1", 1), ("a", "p", "2", 2), ("a", "P", "nan", 3), ("b", None, "", 4)]
    df = spark.createDataFrame(rows, "name string, address string, siren string, version int")
    index = cache.cache_index(df, F.col("version")).collect()
    assert [tuple(r) for r in index] == [("a", "p", "2")]


def test_cache_upsert_and_prune(spark):
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    new = spark.createDataFrame([("a", "p", "1"), ("a", "p", "1"), ("b", "q", None)], CACHE_SCHEMA)
    assert cache.cache_upsert(empty, new).count() == 1
    many = spark.range(5000).select(F.col("id").cast("string").alias("name"), F.lit("").alias("address"), F.lit("1").alias("siren"))
    kept = cache.cache_prune(many)
    assert 4900 < kept.count() < 4990
    assert kept.exceptAll(cache.cache_prune(many)).count() == 0


def _queries(spark, rows):
    df = spark.createDataFrame(rows, "name string, zip string")
    from nomenlink.functions.addresses import address, address_string

    df = df.withColumns({"addr": address(zip_code=F.col("zip")), "role": F.lit("R")})
    return cache.with_keys(df.withColumn("address_text", address_string(F.col("addr"))))


def _names(spark, known, label="names"):
    table = spark.createDataFrame(list(known.items()), "name_key string, siren string")
    return resolve.Provider(
        label, lambda q: q.join(table, "name_key").withColumn("score", F.lit(1.0)).select(*resolve.QUERY_KEY, "siren", "score")
    )


def test_members_answer_in_order_and_empty_addresses_do_not(spark):
    queries = _queries(
        spark, [("Groupement x / acme et beta", None), ("beta / acme", "1"), ("acme", None), ("acme", "1"), ("zzz", "1")]
    )
    got = {
        (r["name"], r["address_key"]): (r["siren"], r["confidence"], r["matched_name"])
        for r in resolve.resolve(queries, [_names(spark, {"acme": "A", "beta": "B"})]).collect()
    }
    assert got == {
        ("Groupement x / acme et beta", ""): ("A", "official_api", "acme"),
        ("beta / acme", "1"): ("B", "official_api", "beta"),
        ("acme", ""): (None, CONFIDENCE_NONE, None),
        ("acme", "1"): ("A", "official_api", None),
        ("zzz", "1"): (None, CONFIDENCE_NONE, None),
    }


def test_members_after_the_tenth_are_looked_up(spark):
    names = [f"m{k}" for k in range(12)]
    queries = _queries(spark, [("Groupement " + " / ".join(names), "1"), (" / ".join(names), "1")])
    got = resolve.resolve(queries, [_names(spark, {"m10": "A"})]).collect()
    assert [(r["siren"], r["matched_name"]) for r in got] == [("A", "m10")] * 2


def test_whole_consortium_is_found_in_the_cache(spark):
    known = spark.createDataFrame([("Groupement a / b", "1", "777")], CACHE_SCHEMA)
    queries = _queries(spark, [("Groupement a / b", "1"), ("a", "1")])
    got = {r["name"]: (r["siren"], r["confidence"]) for r in resolve.resolve(queries, [_names(spark, {"a": "A"})], known).collect()}
    assert got == {"Groupement a / b": ("777", "cache"), "a": ("A", "official_api")}


def test_chain_needs_a_provider(spark):
    with pytest.raises(ValueError):
        resolve.provider_chain(_queries(spark, [("a", "1")]), [])


def test_later_providers_see_what_is_left(spark):
    queries = _queries(spark, [("a", "1"), ("b", "1")])
    chain = [_names(spark, {"a": "1"}, "first"), _names(spark, {"a": "2", "b": "3"}, "second")]
    got = {r["name_key"]: (r["siren"], r["provider"]) for r in resolve.provider_chain(queries, chain).collect()}
    assert got == {"a": ("1", "first"), "b": ("3", "second")}


def test_features_are_finite(spark):
    pairs = spark.createDataFrame(
        [("Acmé", "acme", None, None, None, None, None), (None, None, "k", "75", "1", "c", 3)],
        "missing_entreprise_nom string, known_entreprise_nom string, nom_key string, dept_norm string, "
        "zipcode_norm string, city_key string, n_known_rows bigint",
    )
    for row in pair_features(pairs).collect():
        values = [row[c] for c in FEATURE_COLUMNS]
        assert all(v is not None and v == v for v in values)


def test_binding_figures(spark, sf):
    if not sf.endswith("sf0.001"):
        pytest.skip("figures of the smallest tables")
    offers = b.offers(spark, sf)
    assert offers.count() == 1500
    norm = silver.normalised_offers(offers, "offer_id", drop_blacklisted=False)
    assert silver.ambiguity_report(norm).count() == 4
    assert b.register(spark, sf).select("code_departement").distinct().count() == 25


def test_vectors_and_a_fitted_model_reach_the_resolver(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from nomenlink.operators import resolve as r

    listed = "siren string, siret string, raison_sociale string, enseigne string, sigle string, naf_ape string,"
    listed += "code_postal string, commune string, code_departement string, is_headquarters boolean"
    register = spark.createDataFrame(
        [(f"{n}", f"{n}1", name, None, None, None, "75001", "Paris", "75", True) for n, name in enumerate(("alpha", "omega"))],
        listed,
    )
    asked = "name_key string, address_key string, name string, addr struct<street:string, zip_code:string, city:string, department_hint:string>"
    queries = spark.createDataFrame([("bakery", "x", "bakery", (None, "75001", "Paris", None))], asked)
    vectors = spark.createDataFrame([("bakery", [1.0, 0.0]), ("alpha", [0.0, 1.0]), ("omega", [2.0, 0.0])], "text string, vector array<double>")

    by_cosine = r.register_provider(register, 0.9, scorer=lambda features: F.col("sim_cosine"), vectors=vectors)
    assert [(x.siren, round(x.score, 9)) for x in by_cosine.resolve(queries).collect()] == [("1", 1.0)]
    assert r.register_provider(register, 0.9, scorer=lambda f: F.col("sim_cosine")).resolve(queries).collect() == []

    seen = spark.createDataFrame([(c, float(c > 0.5)) for c in (0.0, 0.1, 0.2, 0.8, 0.9, 1.0)], "sim_cosine double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["sim_cosine"], outputCol="x"), LogisticRegression(featuresCol="x")]).fit(seen)

    def fitted(features):
        return model.transform(features).withColumn("score", vector_to_array("probability")[1])

    by_model = r.register_provider(register, 0.5, scorer=fitted, vectors=vectors)
    assert [x.siren for x in by_model.resolve(queries).collect()] == ["1"]


def test_all_terms_of_labels_count(spark):
    from nomenlink.operators import matcher

    texts = [" ".join(["shared", "dup dup"] + [f"t{n}x{k}" for k in range(150)]) for n in range(5)] + [None, "", "le de"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, texts[0])], "id int, naf_label string")
    got = {r["id"]: r["naf_semantic_score"] for r in matcher.naf_text_score(df).collect()}
    # Seven distinct labels: a term of one has the deviation sqrt((1 - 1/7) / 6), one of five sqrt((5 - 25/7) / 6).
    alone, shared = ((1 - 1 / 7) / 6) ** -0.5, ((5 - 25 / 7) / 6) ** -0.5
    # Two equal words deviate twice as much, so both terms weigh the same.
    assert all(abs(got[n] - (150 * alone + 2 * shared)) < 1e-6 for n in (0, 1, 2, 3, 4, 9))
    assert got[5] == got[6] == got[7] == 0.0
    few = {r["id"]: r["naf_semantic_score"] for r in matcher.naf_text_score(df, terms=2).collect()}
    assert abs(few[0] - 2 * shared) < 1e-6


def test_best_round_waits_for_the_patience_and_no_longer():
    assert matcher.best_round([5.0, 4.0, 4.5, 3.0, 3.5], 3) == (4, False)
    assert matcher.best_round([5.0, 4.0, 4.5, 4.0, 4.2, 1.0], 3) == (2, True)
    assert matcher.best_round([1.0], 3) == (1, False)
    assert matcher.best_round([2.0, 2.0, 2.0], 2) == (1, True)


def test_boosting_is_cut_at_the_best_round_of_unseen_names(spark, tmp_path):
    # The rule is the opposite one for unseen names, so their loss rises with every round.
    random.seed(1)
    rows = [(f"n{k % 40}", random.random(), random.random()) for k in range(400)]
    noise = sampling.group_split(spark.createDataFrame(rows, "nom_key string, a double, b double"))
    noise = noise.withColumn("label", ((F.col("a") > 0.5) != F.col("is_validation")).cast("int")).drop("is_validation")
    boosted = matcher.train_boosted(noise, rounds=30, min_rows_per_leaf=1, columns=["a", "b"], patience=3)
    assert len(boosted.curve) == 6 and boosted.curve == sorted(boosted.curve)
    trees = boosted.model.stages[-1]
    assert trees.getNumTrees == boosted.best_round == 1
    rows = boosted.model.stages[0].transform(noise.withColumn("label", F.col("label").cast("double")))
    whole = GBTClassifier(maxIter=4, seed=1).fit(rows)
    first = matcher.first_rounds(whole, 2)
    assert first.evaluateEachIteration(rows) == pytest.approx(whole.evaluateEachIteration(rows)[:2])
    unseen = sampling.group_split(noise).where("is_validation")
    assert matcher.feature_importance(boosted.model, spark, ["a", "b"]).count() == 2
    boosted.model.write().save(str(tmp_path / "model"))
    loaded = type(boosted.model).load(str(tmp_path / "model"))
    expected = [r["pred"] for r in matcher.score_pairs(boosted.model, unseen).orderBy("a").collect()]
    assert [r["pred"] for r in matcher.score_pairs(loaded, unseen).orderBy("a").collect()] == expected


def test_terms_are_counted_inside_their_row(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), (["x"],), ([],), (None,)], "t array<string>")
    got = [r["c"] for r in df.select(matcher._counted(F.col("t")).alias("c")).collect()]
    assert [[tuple(c) for c in runs or []] for runs in got] == [[("a", 2.0), ("b", 1.0), ("c", 3.0)], [("x", 1.0)], [], []]


def test_equal_texts_are_compared_once(spark):
    columns = "missing_entreprise_nom string, known_entreprise_nom string, nom_key string, dept_norm string, " \
        "zipcode_norm string, city_key string, n_known_rows long, label int"
    rows = [("Acme", "ACME", "acme", str(k), None, None, k, 1) for k in range(50)] + [(None, "x", None, None, None, None, None, 0)]
    pairs = spark.createDataFrame(rows, columns)
    texts = pairs.select(F.lower(F.coalesce("missing_entreprise_nom", F.lit(""))).alias("_left"),
                         F.lower("known_entreprise_nom").alias("_right"))
    assert features._similarities(texts).count() == 2
    got = features.pair_features(pairs)
    assert got.columns == [*pairs.columns, *features.FEATURE_COLUMNS]
    assert got.count() == 51 and got.where("label = 1 and fuzz_ratio > 0 or label = 0 and fuzz_ratio = 0").count() == 51
