"""Trained models on the deterministic cohort of the smallest data folder."""

import datetime as dt

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.operators import models as ML
from kinchart.operators import risk as S
from kinchart.plans import load
from kinchart.plans.risk_queries import features
from kinchart.sources.fixtures import Tables


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    load()
    table = features(Tables(spark, "/root/testdata/sf0.01"))
    noisy = S.diabetes_score() + (F.col("user_id") * 7919 % 1000) / 10000 - 0.05
    path = str(tmp_path_factory.mktemp("cohort") / "c")
    table.withColumn("s", noisy).write.parquet(path)
    stored = spark.read.parquet(path)
    median = stored.agg(F.percentile("s", 0.5)).first()[0]
    labelled = stored.withColumn("label", (F.col("s") >= median).cast("double")).drop("s")
    split = S.stratified_split(labelled, "label", "user_id")
    split.write.parquet(path + "s")
    return spark.read.parquet(path + "s")


def test_vectors_follow_the_input_order(spark, cohort):
    for model, names in ML.INPUTS.items():
        row = ML.feature_vector(cohort, model).select("x", *names).first()
        assert list(row["x"].toArray()) == pytest.approx([float(row[n]) for n in names])
    assert [len(ML.INPUTS[m]) for m in ("diabetes", "hypertension", "thyroid", "heart_disease")] == [16, 18, 10, 21]


def test_fit_predict_evaluate_and_catalog(spark, cohort, tmp_path):
    train, test = cohort.filter("part = 'train'"), cohort.filter("part <> 'train'")
    settings = [{"maxIter": 8, "maxDepth": 3, "stepSize": 0.15, "subsamplingRate": 0.9}, {"maxIter": 8, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8}]
    trees = ML.fit_trees(train, "diabetes", settings=settings)
    net = ML.fit_net(train, "diabetes", epochs=40)
    scored = ML.predict_batch(test, "diabetes", trees, net).join(test.select("user_id", "label"), "user_id")
    scored = scored.withColumn("probability", C.ensemble(F.col("tree_p"), F.col("net_p"), F.lit(0.0)))
    report = ML.evaluate(scored)
    assert report["passed"], report
    assert report["report"][0]["support"] + report["report"][1]["support"] == test.count()
    only_net = ML.predict_batch(test, "diabetes", None, net).filter("tree_p is null and net_p is not null")
    assert only_net.count() == test.count()

    path = ML.save_model(trees, str(tmp_path), "diabetes", "trees", 1)
    again = ML.predict_batch(test, "diabetes", PipelineModel.load(path), None).select("user_id", "tree_p")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.select("user_id", "tree_p").collect()))
    at = dt.datetime(2024, 1, 1)
    catalog = ML.catalog_rows(spark, [("diabetes", "trees", "old", at, {}), ("diabetes", "trees", path, at + dt.timedelta(1), {"auc": report["auc"]}), ("diabetes", "net", "n", at, {})])
    assert {r["path"] for r in ML.model_catalog(catalog).collect()} == {path, "n"}
    ready = {r["name"]: r["fully_trained"] for r in ML.model_readiness(catalog).collect()}
    assert ready == {"diabetes": True, "hypertension": False, "thyroid": False, "heart_disease": False}


SCORES = {"hypertension": S.hypertension_score, "thyroid": S.thyroid_score, "heart_disease": S.heart_score}


@pytest.mark.parametrize("model", SCORES)
def test_models_of_the_other_diseases_pass_their_gates(spark, cohort, model):
    noisy = SCORES[model]() + (F.col("user_id") * 7919 % 1000) / 20000
    table = cohort.drop("label", "part").withColumn("s", noisy)
    median = table.agg(F.percentile("s", 0.5)).first()[0]
    labelled = table.withColumn("label", (F.col("s") >= median).cast("double")).drop("s")
    split = S.stratified_split(labelled, "label", "user_id")
    train, test = split.filter("part = 'train'"), split.filter("part <> 'train'")
    settings = [{"maxIter": 10, "maxDepth": 4, "stepSize": 0.15, "subsamplingRate": 0.9}]
    trees = ML.fit_trees(train, model, settings=settings)
    net = ML.fit_net(train, model, epochs=60)
    scored = ML.predict_batch(test, model, trees, net).join(test.select("user_id", "label"), "user_id")
    scored = scored.withColumn("probability", C.ensemble(F.col("tree_p"), F.col("net_p"), F.lit(0.0)))
    report = ML.evaluate(scored)
    assert report["passed"], (model, report)


def test_exact_area_under_the_curve(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.1), ("a", 1, 0.10001), ("a", 0, 1.7), ("b", 1, 0.5), ("c", 1, 0.3), ("c", 0, 0.3)]
    df = spark.createDataFrame(rows, "k string, label int, probability double")
    got = {r["k"]: r["auc"] for r in ML.auc(df, keys=("k",)).collect()}
    assert got == {"a": pytest.approx((1.5 + 1) / 6), "b": None, "c": 0.5}


def test_search_space_is_bounded_and_repeatable():
    space = ML.search_space(50)
    assert space == ML.search_space(50) and len(space) == 50
    assert all(40 <= s["maxIter"] <= 150 and 3 <= s["maxDepth"] <= 6 and 0.01 <= s["stepSize"] <= 0.15 and 0.6 <= s["subsamplingRate"] <= 0.9 for s in space)
