"""The fit over binned rows against Spark's own estimator and against itself in parts."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from nomenlink.operators import boosting

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 30, 3000), rng.integers(0, 20, 3000) / 7, rng.normal(size=3000).round(1).clip(-1.2, 1.2)
    label = (np.sin(a / 4) + b * c + rng.normal(size=3000) * 0.7 > 0.5).astype(float)
    values = zip(a.astype(float).tolist(), b.tolist(), c.tolist(), label.tolist(), (rng.random(3000) < 0.2).tolist())
    df = spark.createDataFrame(list(values), "a double, b double, c double, label double, held boolean")
    df = df.withColumn("weight", F.when(F.col("label") == 1, 1.7).otherwise(0.6))
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df).repartition(4).cache()


PARAMS = dict(labelCol="label", weightCol="weight", maxIter=25, maxDepth=4, stepSize=0.2, minInstancesPerNode=10, seed=3)


def _scores(model, rows):
    scored = model.transform(rows).orderBy(*COLUMNS, "label").select("probability").collect()
    return np.array([r["probability"][1] for r in scored])


def test_fit_equals_sparks_where_nothing_is_drawn(spark, rows):
    ours = boosting.GBTClassifier(validationIndicatorCol="held", featureSubsetStrategy="all", **PARAMS).fit(rows)
    theirs = GBTClassifier(featureSubsetStrategy="all", **PARAMS).fit(rows.where("not held"))
    assert ours.getNumTrees == theirs.getNumTrees == 25 and ours.treeWeights == theirs.treeWeights
    assert np.abs(_scores(ours, rows) - _scores(theirs, rows)).max() < 1e-6
    held = rows.where("held")
    assert ours.curve == pytest.approx(theirs.evaluateEachIteration(held), abs=1e-6)
    assert ours.curve == pytest.approx(ours.evaluateEachIteration(held), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-6)
    for mine, other in zip(ours.trees[:5], theirs.trees[:5]):
        splits = [[x for x in tree.toDebugString.split("\n")[1:] if "Predict" not in x] for tree in (mine, other)]
        assert splits[0] == splits[1] and mine.numNodes == other.numNodes > 20


def test_parts_give_the_fit_of_one_block(spark, rows, monkeypatch):
    estimator = boosting.GBTClassifier(validationIndicatorCol="held", featureSubsetStrategy="0.6", **PARAMS)
    here = estimator.fit(rows)
    monkeypatch.setattr(boosting, "ROWS_PER_PART", 500)
    spread = estimator.fit(rows)
    assert np.abs(_scores(here, rows) - _scores(spread, rows)).max() < 1e-6
    assert spread.curve == pytest.approx(here.curve, abs=1e-6)
    assert np.abs(_scores(estimator.fit(rows.repartition(7)), rows) - _scores(spread, rows)).max() < 1e-9


def test_equal_rows_are_drawn_one_by_one():
    settings = boosting.Settings(1, 2, 2, 0.1, 1, 0.0, 0.9, 1, 7, None, (2,))
    block = boosting.Block(0, np.zeros((1, 2), np.uint8), np.array([1.0, -1.0]), np.ones(2), np.array([10**6, 10**6]), np.array([False, True]))
    drawn = [boosting._advance(block, None, 1.0, k, settings).drawn for k in range(20)]
    assert all(d[1] == 0 and abs(d[0] - 900_000) < 2_000 for d in drawn) and len({int(d[0]) for d in drawn}) > 10


def test_a_pass_goes_over_binned_rows_and_not_over_rows(spark, monkeypatch):
    seen = []
    settings = boosting.GBTClassifier._settings

    def spy(self, cuts):
        seen.append([len(cut) + 1 for cut in cuts])
        return settings(self, cuts)

    monkeypatch.setattr(boosting.GBTClassifier, "_settings", spy)
    stored = {}
    written = boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df, label: stored.setdefault(label, written(df, label)))
    rows = spark.range(0, 20_000, 1, 4).select((F.col("id") % 100 / 10).alias("a"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    model = boosting.GBTClassifier(maxIter=2, subsamplingRate=0.9).fit(rows)
    assert model.getNumTrees == 2 and seen == [[32]]
    assert stored["binned"].count() <= 64 and stored["binned"].agg(F.sum("_count")).first()[0] == 20_000


def test_bins_of_a_rare_class_are_as_fine_as_its_weight():
    values = np.concatenate([np.full(1001, 1.0), np.linspace(0, 0.9, 1001)])
    cuts = boosting._cuts_of(values, np.full(2002, 0.5), 32)
    assert len(cuts) >= 14 and (np.diff(cuts) > 0).all() and cuts[-1] > 0.85


def test_many_values_are_thinned_by_weight(spark, monkeypatch):
    values = spark.range(0, 40_000, 1, 4).select(
        F.array((F.col("id") / 40_000).alias("a"), (F.col("id") % 3).cast("double").alias("b")).alias("_values"),
        F.when(F.col("id") < 400, 99.0).otherwise(1.0).alias("_weight"),
    )
    exact = boosting._cuts(values, 2, 32)
    monkeypatch.setattr(boosting, "_VALUES", 1000)
    monkeypatch.setattr(boosting, "_POINTS", 2000)
    thinned = boosting._cuts(values, 2, 32)
    assert [len(c) for c in exact] == [len(c) for c in thinned] == [31, 2]
    assert np.abs(exact[0] - thinned[0]).max() < 0.002 and list(thinned[1]) == [0.5, 1.5]
    # Half of the weight lies in the first hundredth of the rows, and so does half of the bins.
    assert abs(int((thinned[0] < 0.01).sum()) - 16) <= 1
