"""What lets the work of a query grow no faster than its input."""

import random

import pytest
from pyspark.sql import functions as F

from kinchart.functions import spans as SP
from kinchart.operators import extract as X
from kinchart.operators import insights as I
from kinchart.operators import ocr as O
from kinchart.sources import dimensions as dims


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_corrections_equal_all_rules_in_a_row(spark):
    """Rules that are passed over for want of their letters change nothing, whatever the letters look like."""
    texts = [
        "Tab Metforrn 50 rnq bd, 0 mg od O5 tds", "5 . 2 rnl 1U lU 1,250", "", None, "pRN Prn qıd soſ SOS K hs ac", "0mg0 ml 10 mg",
        "é ſoſ bd", "O0 mg", "0 mcg 1,2345 a.b", "Atorvastatln AmIodipine Levothyroxlne pc PC",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plain = F.col("text")
    for expression, replacement in dims.rows("OCR_FIXES", 2):
        plain = F.regexp_replace(plain, F.lit("(?iU)" + expression), F.lit(replacement))
    rows = docs.select(X.fix_ocr_text(F.col("text")).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


@pytest.mark.parametrize(
    "expression, needed",
    [(r"\brnq\b", "rnq"), (r"(?<!\d)0(?=\s*(?:mg|ml))", "0"), (r"(\d),(\d{3})", ","), (r"(\d)\s+\.\s*(\d)", "."),
     (r"\bO(?=\d)", None), (r"a{2,}", None), (r"\ba\b|b", None), (r"(?<!\d)0(?=a)|(b)", None), (r"(\d).(\d)", None)],
)
def test_what_an_expression_needs(expression, needed):
    assert SP.needs(expression) == needed


def test_a_later_layer_of_names_waits_for_the_one_before(spark):
    names = ("gout", "gout attack", "gout attack acute", "heart")
    assert [len(layer) for layer in SP.vocabulary_layers(names)] == [2, 1, 1]
    texts = ["heart", "gout", "GOUT Attack", "a gout attack acute heart", "gouty gout-attack", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    found = docs.select(SP.vocabulary_spans(F.col("t"), names).alias("s"))
    got = [[s["text"] for s in r["s"] or []] for r in found.collect()]
    assert got == [["heart"], ["gout"], ["GOUT Attack"], ["gout attack acute", "heart"], ["gout"], []]


def test_nearest_target_reads_each_side_once(spark):
    a = [(1, 0, 0, 10), (1, 1, 50, 60), (2, 0, 0, 5), (None, 0, 0, 5), (3, 0, 0, 5), (3, 0, 0, 9), (4, 0, 0, None), (5, None, 0, 5)]
    b = [(1, 10, "x"), (1, 10, "w"), (1, 160, "y"), (2, 106, "far"), (None, 6, "n"), (3, 7, "p"), (3, 9, "q"), (4, 1, "r"), (5, 6, "t"), (1, None, "u")]
    anchors = spark.createDataFrame(a, "doc_id int, ord int, start int, end int")
    targets = spark.createDataFrame(b, "doc_id int, start int, text string")
    near = X.nearest_following(anchors, targets, 100)
    got = sorted(near.select("doc_id", "ord", "end", "target_start", "target_text").collect(), key=str)
    want = [
        (1, 0, 10, 10, "w"), (1, 1, 60, 160, "y"), (2, 0, 5, None, None), (None, 0, 5, None, None), (3, 0, 5, 7, "p"), (3, 0, 9, 7, "p"),
        (4, 0, None, None, None), (5, None, 5, None, None),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert "Join" not in plan(near) and plan(near).count("LogicalRDD") == 2


WORD = "doc_id int, page int, word_no int, engine string, text string, x_min double, y_min double, x_max double, y_max double, confidence double"


def test_pages_of_one_row_equal_islands(spark):
    draw = random.Random(4)
    words = []
    for page in range(6):
        for engine in (O.FIRST, O.SECOND) if page < 4 else (O.SECOND,) if page == 4 else (O.FIRST,):
            for i in range(40):
                x, y = draw.randrange(0, 200), draw.randrange(0, 90)
                box = [float(x), float(y), float(x + draw.randrange(-2, 60)), float(y + draw.randrange(5, 20))]
                if draw.random() < 0.1:
                    box[draw.randrange(4)] = None
                words.append((None if i == 7 else 1, None if i == 8 else page, i, engine, f"w{i}", *box, draw.random()))
    words.append((1, 2, 99, O.FIRST, "nan", 1.0, float("nan"), 5.0, 5.0, 0.5))
    df = spark.createDataFrame(words, WORD)

    def rows(sides):
        return sorted(
            (r["page"], r["has_first"], r["has_second"], s["ord"], None if p < 0 else r["first"][p]["ord"])
            for r in sides.collect()
            for s, p in zip(r["second"], r["m"]["partner"])
        )

    small = rows(O._matched_pages(df, 0.3, 40.0))
    assert small == rows(O._matched_pages(df, 0.3, 40.0, most=0))
    placed = {w[1] for w in words if w[3] == O.SECOND and w[0] and None not in (w[1], w[5], w[6])}
    assert {r[0] for r in small} == placed and len(small) == sum(w[3] == O.SECOND and None not in (w[0], w[1], w[5], w[6]) for w in words)


def test_predictions_are_dealt_out_before_they_are_sorted(spark):
    factor = "struct<factor:string,weight:double,source:string>"
    rows = [(i % 7, i, "d", "c", i / 100, "low", True, [("age", 1.0, "demographic"), ("father", 1.0, "family")]) for i in range(50)]
    df = spark.createDataFrame(
        rows, f"user_id int, id int, disease_name string, icd10_code string, probability double, risk_level string, is_active boolean, contributing_factors array<{factor}>"
    )
    top = I.watchlist(df, 2)
    assert sorted((r["user_id"], r["rank"], r["probability"], r["family_members_affected"]) for r in top.collect())[:2] == [
        (0, 1, 0.49, ["father"]), (0, 2, 0.42, ["father"])
    ]
    executed = top._jdf.queryExecution().sparkPlan().toString()
    assert executed.index("WindowGroupLimit") < executed.index("REPARTITION_BY_COL")
