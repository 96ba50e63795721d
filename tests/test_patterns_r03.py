"""Patterns tell their names apart by first letters and find what the bare ones find; lines are shuffled once a column."""

import pytest
from pyspark.sql import functions as F

from kinchart.functions import spans as SP
from kinchart.operators import extract as X
from kinchart.sources import dimensions as dims
from kinchart.sources import fixtures as FX

TEXTS = [
    "OD od, once daily;once weekly twice  daily ONCE\tMonthly bd BD. xbd bd_ 1od od1 before meal before mealsx after meals",
    "ſtat hſ aſ needed tıd QİD éod od́ —bd bd— ́bd Kbd sos prn at bedtime at  bedtimes dailyweekly monthly",
    "HbA1c: 6.5% Hb 12.1 g/dL Hbx 3 hgb=9 TG 150mg/dLTC 200 T3 1.2 T4:8 tsh - 2.5 mIU/L PT 12 PTT 30 INR 1.1.2 FBS: 90",
    "ınr 2.1 ſgot 30 IU/L ſodium 140 Potaſſium 4 Vitamin D3 30 ng/mL vitamin  b12 = 200 Uric  Acid 5 µFBS 9 éLDL 3 —HDL 4 HDL٣",
    f"FBS{SP.MARK}90 FBS 90{SP.MARK}mg/dL TSH٣ LDL:\n10.5pg/mL HDL 5.mEq/L eGFR 90 Triglycerides 1 cholesterol", "", None,
]


def bare(name: str) -> str:
    return "(?iU)" + dict(dims.rows("PATTERNS", 2))[name]


@pytest.mark.parametrize("name", list(dims.STARTS))
def test_patterns_find_what_bare_ones_find(spark, name):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    told, plain = (SP.regex_spans(F.col("t"), p) for p in (dims.pattern(name), bare(name)))
    rows = docs.select(told.alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert name not in ("frequency", "lab_value") or sum(len(r["a"]) for r in rows) > 20


def test_names_are_told_apart_by_first_letters():
    assert SP.by_letter(r"\b(od|bd|once\s+a|Bid)\b") == (r"\b(o(?:d|nce\s+a)|b(?:d|id))\b", "din")
    for other in (r"\b(od?|bd)\b", r"\b(o|bd)\b", r"\b(\d+|bd)", r"(od|bd)", r"\b(?:od|bd)", r"\b(od|(a|b)d)"):
        assert SP.by_letter(other) == (other, "")
    assert r"\b(o(?:nce" in dims.pattern("frequency") and r"\b(h(?:bA1c" in dims.pattern("lab_value")


def test_parts_of_lab_values(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    part = lambda m, i: F.regexp_extract(m, bare("lab_value"), i)
    found = X.find_lab_values(F.col("t"))
    want = F.transform(found, lambda e: F.struct(part(e["text"], 1), part(e["text"], 2).try_cast("double"), part(e["text"], 3)))
    got = F.transform(found, lambda e: F.struct(e["lab_name"], e["lab_value"], e["lab_unit"]))
    for r in docs.select(got.alias("a"), want.alias("b")).collect():
        assert [tuple(x) for x in r["a"] or []] == [tuple(x) for x in r["b"] or []]
    plan = docs.select(found.alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan


LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"


def test_lines_are_shuffled_once_a_column(spark, tmp_path):
    rows = [
        (1, 1, 5, 7, 3.0), (1, 1, 5, 7, 2.5), (1, None, 9, 9, 1.0), (1, 2, None, 4, 1.0), (2, 1, 1, None, None), (2, 1, 1, 1, 1.9),
        (None, 1, 1, 1, 1.0), (None, 2, 1, 1, 1.0), (3, 1, 2, 2, 4.0), (3, 1, 2, 2, 4.0),
    ]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = FX.Tables(spark, str(tmp_path))
    plain = spark.sql(FX.view_text("fx_lines", "spark"), lineitem=t.lineitem)
    assert t.lines.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(str, t.lines.collect())) == sorted(map(str, plain.collect()))
    window = t.lines._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert " AS " not in window.split("\n", 1)[1]
