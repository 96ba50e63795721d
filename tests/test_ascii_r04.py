"""Texts of ASCII alone are searched by smaller patterns, and finders give their entities in normal form at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinchart.functions import dates as D
from kinchart.functions import spans as SP
from kinchart.operators import extract as X
from kinchart.operators import normalize as N
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

SAID = [
    "5 mg", "12.5mcg", "1.mg", "10..5 ml", "٣ mg", "2 μg", "once daily", "BD", "at  bedtime", "ſtat", "for 7 days", "×3 weeks", "FBS: 109 mg/dL",
    "ınr 2.1", "Vitamin D3 = 20 ng/mL", "BP: 120/80 mmHg", "bp=12/٣٣", "Dr. Asha Rao", "Prof. Dr. Ravi Kumar", "Jane Doe, MD", "Jane Doe\n,PhD",
    "Aſha Rao, DM", "City Hospital", "aiimſ", "nimhanſ clinic", "7clinic", "é hospital", "allergic to dust", "nKDA", "4/1/2025", "25/13/2025",
    "2024-02-30", "05.11.24", "٣/٣/٢٠٢٤", "12th June 2024", "12 ſep 2024", "31 Feb 2020", "metformin", "Aſpirin", "TB", "type 2 diabetes", "é", "-",
]


def texts() -> list[tuple]:
    draw = random.Random(4)
    made = ["".join(draw.choice(SAID) + draw.choice([" ", "", ". ", ", ", "\n"]) for _ in range(draw.randrange(1, 9))) for _ in range(300)]
    return list(enumerate(made + [m.encode("ascii", "ignore").decode() for m in made] + ["", None]))


def patterns() -> dict[str, tuple[str, str]]:
    """Name = pattern and the bare one."""
    told = {n: (dims.pattern(n), "(?iU)" + dict(dims.rows("PATTERNS", 2))[n]) for n in dims.STARTS}
    for name, names in (("drug", X.DRUG_NAMES), ("disease", X.DISEASE_NAMES)):
        for i, layer in enumerate(SP.vocabulary_layers(names)):
            tree = SP._tree(list(layer))
            told[f"{name}{i}"] = (SP.vocabulary_patterns(names)[i], rf"(?iu)(?<!\p{{L}})(?=({tree})(?!\p{{L}}))")
    return told


@pytest.mark.parametrize("name", list(patterns()))
def test_plain_patterns_find_what_bare_ones_find(spark, name):
    told, bare = patterns()[name]
    group = 1 if "?=(" in bare[:20] else 0
    docs = spark.createDataFrame(texts(), "i int, t string")
    turns = SP._by_kind(F.col("t"), told, group, None), SP._by_turns(F.col("t"), bare, group)
    rows = docs.select(*[t.alias(n) for t, n in zip(turns, "ab")]).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert len(SP.in_ascii(told)) < len(told) and r"\x{10FFFF}-" not in told


def test_first_signs_of_expressions():
    fits = lambda expression, t: bool(re.match(SP.in_ascii(SP.opening(expression)).replace("(?-iU:", "(?:").replace(r"\x{10FFFF}", r"\U0010FFFF"), t))
    for expression, yes, no in (
        (r"\b(tb|gout)\b", ["tb", "TB x", "Gou"], ["t", "tx", "gox", "ou"]),
        (r"(?:a{2,3}|b?c)+d", ["aad", "aaa", "bcd", "cd", "cca"], ["ad", "bd", "abc"]),
        (r"(\d+\.?\d*)\s*(mg|g)", ["5 m", "5.g", "12.", "5g"], ["5 d", "mg", "5/"]),
        (r"(a)\1b", ["a", "aab", "ax"], ["b"]),
        (r"[^a]b", ["cb", "Ab"], ["cc"]),
    ):
        assert all(fits(expression, t) for t in yes) and not any(fits(expression, t) for t in no), expression
    assert SP.opening(r"a*") == ""


def test_finders_give_what_normalization_gives(spark):
    docs = spark.createDataFrame(texts(), "i int, t string")
    whole = X.rule_entities(docs, "t").withColumn("entities", X.normalize_entities(F.col("entities")))
    want, got = whole, X.extract_documents(docs, "t")
    rows = [[r["entities"] for r in df.orderBy("i").select("entities").collect()] for df in (want, got)]
    assert rows[0] == rows[1]
    assert {e["type"] for r in rows[0] for e in r} >= {"MEDICINE", "DISEASE", "DATE", "FREQUENCY", "HOSPITAL", "DOCTOR", "ALLERGY"}
    assert min(e["confidence"] for r in rows[0] for e in r) == X.LEAST
    sure = X.extract_documents(docs, "t", min_confidence=0.9).orderBy("i").select("entities").collect()
    assert [r["entities"] for r in sure] == [[e for e in r if e["confidence"] >= 0.9] for r in rows[0]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("octet_length(t") < plan.count("split(") and len(plan) < 2 * len(whole._jdf.queryExecution().optimizedPlan().toString())


def test_runs_of_letters_with_and_without_a_hospital(spark):
    rows = [("Dr X. ab7aster 9", []), ("ab aster 9", ["ab aster"]), ("aiimſ", ["aiimſ"]), ("City  Hospital, max healthcare é", ["City  Hospital", "max healthcare"]),
            ("7clinic clinic", ["clinic clinic"]), ("xhospital hospita", []), ("éclinic", []), ("a b c", [])]
    docs = spark.createDataFrame(rows, "t string, want array<string>")
    got = docs.select("want", F.transform(SP.hospital_spans(F.col("t"), dims.words(fixed.HOSPITAL_WORDS)), lambda s: s["text"]).alias("g"))
    for r in got.collect():
        assert r["g"] == r["want"], r


def test_a_follow_up_phrase_is_looked_for_once(spark):
    rows = [("Review after 5 weeks", "2001-09-06"), ("F/U: 05.11.24 x", "2024-11-05"), ("review on 31/02/2024", None), ("revıew after 2 days", "2001-08-04"),
            ("é follow up in 3 months", "2001-11-02"), ("come  back @1 day, review 2 days", "2001-08-03"), ("well", None), (None, None)]
    docs = spark.createDataFrame(rows, "t string, want string")
    got = docs.select("want", D.follow_up_date(F.col("t"), "2001-08-02").cast("string").alias("d"))
    assert [r["d"] for r in got.collect()] == [want for _, want in rows]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(t#") == 2


def test_the_next_dose_is_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "Tab metformin 500 mg BD for 7 days")], "doc_id int, text string")
    made = X.structured_prescription(X.extract_documents(docs), "2001-08-02").select("medications")
    assert [tuple(m)[4:7] for m in made.first()["medications"]] == [("500 mg", "Twice daily", "for 7 days")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n", 1)[0].count("LOG2") == 3
    assert len(N.medicine_facts()) > 100 and set(X.normal_drugs()) <= set(X.DRUG_NAMES)
