"""Long texts are searched only where they hold what a pattern needs, with the same spans."""

import pytest
from pyspark.sql import functions as F

from kinchart.functions import spans as SP
from kinchart.operators import extract as X

FOUND = {
    "dosages": ["5 mg", "٣ mg", "12.5mcg"],
    "durations": ["for 7 days", "× ٣ weeks"],
    "dates": ["12/06/2025", "12th June 2024", "May 4, 2023"],
    "lab_values": ["FBS: 90 mg/dL", "ınr 2.1", "Vitamin D3 = 20"],
    "blood_pressure": ["BP: 120/80 mmHg"],
    "doctors": ["Dr. Asha Rao", "dr Ravi Kumar", "Jane Doe, PhD", "Prof. Dr. Ravi Kumar", "Jane Doe\n, md"],
    "hospitals": ["Apollo Hospital", "HOSPITAL"],
    "allergies": ["Allergic to dust", "NKDA", "nKDA", "no known drug allergy", "contraındicated"],
}
FILL = "Thent wh, edre an; ther oning érer Ñu. " * 40


@pytest.mark.parametrize("name", list(FOUND))
def test_long_texts_give_what_short_ones_do(spark, name):
    rows = []
    for said in FOUND[name] + ["nothing", "children, drain", ""]:
        short = f"; {said}."
        rows += [(len(rows), 0, short), (len(rows) + 1, len(FILL), FILL + short), (len(rows) + 2, 0, short + " " + FILL)]
    docs = spark.createDataFrame(rows, "i int, at int, text string")
    assert all(len(r[2]) > SP.SHORT for r in rows if r[0] % 3)
    found = docs.select("i", "at", X.EXTRACTORS[name](F.col("text")).alias("e")).orderBy("i").collect()
    starts = [[e["start"] - r["at"] for e in r["e"]] for r in found]
    said = len(FOUND[name]) * 3
    assert all(starts[i] for i in range(0, said, 3)) and not any(starts[said:])
    assert starts[1::3] == starts[::3] == starts[2::3]


def test_a_long_text_without_digits_is_not_searched(spark):
    rows = [(0, FILL), (1, FILL + "٣"), (2, "7" + FILL), (3, "short"), (4, None), (5, "\n" * 600)]
    docs = spark.createDataFrame(rows, "i int, text string").orderBy("i")
    held = docs.select(SP.with_digits(F.col("text")).isNotNull().alias("h")).collect()
    assert [r["h"] for r in held] == [False, True, True, True, False, False]


def test_many_and_few_matches_are_placed_alike(spark):
    rows = [(n, "é 5 mg, " * n) for n in (0, 1, 2, 7, 8, 9, 300)]
    docs = spark.createDataFrame(rows, "n int, text string")
    for r in docs.select("n", X.find_dosages(F.col("text")).alias("e")).collect():
        assert [(e["start"], e["end"]) for e in r["e"]] == [(2 + 8 * i, 6 + 8 * i) for i in range(r["n"])]
