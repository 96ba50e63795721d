"""Finders go over a text once per pattern, and sides of one extraction share it."""

import pytest
from pyspark.sql import functions as F

from kinchart.functions import dates as D
from kinchart.functions import spans as SP
from kinchart.operators import extract as X
from kinchart.operators import normalize as N
from kinchart.plans import text_queries as Q
from kinchart.sources import dimensions as dims


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_mark_in_the_text_does_not_move_spans(spark):
    docs = spark.createDataFrame([(1, f"5{SP.MARK}mg 7mg")], "doc_id long, text string")
    found = docs.select(SP.regex_spans(F.col("text"), dims.pattern("dosage")).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["text"]) for s in found] == [(5, 8, "7mg")]


@pytest.mark.parametrize("name", ["dosage", "frequency", "duration", "lab_value", "blood_pressure", "numeric_date", "written_date"])
def test_a_pattern_is_matched_once(spark, name):
    docs = spark.createDataFrame([(1, "5 mg")], "doc_id long, text string")
    plan = optimized(docs.select(SP.regex_spans(F.col("text"), dims.pattern(name)).alias("s")))
    assert plan.count("regexp_extract_all(") == 0 and plan.count("regexp_replace(") == 1


def test_tests_in_front_let_every_match_through(spark):
    """Letters that are like ASCII ones when case is ignored, and digits of other scripts."""
    text = "5 mg ſtat x2 days ıNR 2.1 Kidney ſTROKE ٣mg éod 12 ſep 2024 hypertenſion Aſpirin TAB aspirin"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for name in dims.STARTS:
        bare = "(?iU)" + dict(dims.rows("PATTERNS", 2))[name]
        a, b = docs.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (dims.pattern(name), bare)]).first()
        assert a == b, name
    drugs = docs.select(X.find_drugs(F.col("text")).alias("e")).first()["e"]
    assert [(e["text"], e["normalized"], e["atc_code"]) for e in drugs][0] == ("aspirin", "Aspirin", dict((r[0], r[1]) for r in N.DRUGS)["aspirin"])
    assert [e["text"] for e in drugs] == ["aspirin", "Aſpirin"]


def test_two_words_before_a_degree(spark):
    texts = ["xAsha Rao, MD", "Asha Rao, MDJane Doe, PhD", "one two three four, MBBS", "xDr. Rao and Prof. Dr. Ravi Kumar", "A Rao, MD"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").orderBy("doc_id")
    bare = "(?iU)" + "|".join(r[0] for r in dims.rows("DOCTOR_FORMS", 1))
    for a, b in docs.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (X.doctor_pattern(), bare)]).collect():
        assert a == b


def test_fragments_fold_the_text_once(spark):
    docs = spark.createDataFrame([(1, "Type 2 DIABETES and Gout"), (2, "well"), (3, None)], "doc_id long, text string")
    found = X.disease_fragments(docs).select("doc_id", "fragments", "mentions_disease")
    assert optimized(found).count("lower(text") == 1
    assert [tuple(r) for r in found.orderBy("doc_id").collect()][:2] == [(1, ["diabetes", "gout"], True), (2, [], False)]


def test_dates_without_a_month_or_day_are_null(spark):
    texts = [("31/02/2024",), ("12/06/2025",), ("5.11.24",), ("2024-13-40",), ("0007/01/02",), ("12 Foo 2024",), ("12-foo-2024",)]
    df = spark.createDataFrame(texts, "t string").select("t", D.normalize_date(F.col("t")).cast("string").alias("d"))
    assert [r["d"] for r in df.collect()] == [None, "2025-06-12", "2024-11-05", None, "0007-01-02", None, None]


def test_both_sides_of_a_merge_share_one_extraction(spark):
    docs = spark.createDataFrame([(1, "Tab metformin 500mg BD"), (2, "gout")], "doc_id long, text string")
    merged = X.merge_entities(*Q.both_sides(docs))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 1
    assert merged.count() >= 4
