"""Small lookup dimensions built from the fixed values.

A dimension is a ``VALUES`` relation with an ``ord`` column (its line number).  None has more than
200 rows whatever the size of the data, which is why they may be broadcast without a size check.
Where one value per key is enough, ``lookup`` gives the same table as a constant map expression, so
that the lookup stays inside the projection and needs no join at all.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinchart.functions.spans import by_letter, opening
from kinchart.sources import fixed_values as fixed


@cache
def rows(table: str, width: int) -> tuple[tuple[str, ...], ...]:
    """Lines of a fixed table as tuples of ``width`` fields ("-" stands for no value)."""
    lines = [line for line in getattr(fixed, table).splitlines() if line.strip()]
    return tuple(
        tuple(None if part == "-" else part for part in line.split(" = ", width - 1)) for line in lines
    )


def words(text: str | None) -> list[str]:
    """Entries of a comma- or line-separated list."""
    return [w.strip() for w in (text or "").replace("\n", ",").split(",") if w.strip()]


# Patterns with a test of their first signs, and whether they start behind a word boundary.
STARTS = {
    "dosage": True,
    "frequency": True,
    "duration": False,
    "lab_value": True,
    "blood_pressure": True,
    "allergy": False,
    "numeric_date": True,
    "written_date": True,
    "follow_up": True,
    "relative_date": True,
}


@cache
def pattern(name: str) -> str:
    """An extraction pattern in Java form, case-folded and Unicode-aware, behind a test of its first signs."""
    expression = dict(rows("PATTERNS", 2))[name]
    if name not in STARTS:
        return "(?iU)" + expression
    # a number is whole before a unit: nothing of it is given back
    whole = expression.replace(r"(\d+\.?\d*)\s*(mg|", r"(\d++\.?+\d*+)\s*+(mg|")
    told, _ = by_letter(whole)
    return f"(?iU){opening(expression, behind=r'(?<!\w)' * STARTS[name])}(?:{told})"


def title(name: str) -> str:
    """``columns.py_title`` of a fixed name."""
    return re.sub(r"[^\W\d_]+", lambda run: run[0].capitalize(), name)


def quote(value: str | None) -> str:
    if value is None:
        return "null"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(spark: SparkSession, entries, columns: str) -> DataFrame:
    """A ``VALUES`` relation; ``columns`` is "name type, ..." and an ``ord`` column comes first."""
    names = [c.split()[0] for c in columns.split(", ")]
    body = ", ".join(
        "(" + ", ".join([str(i), *map(quote, entry)]) + ")" for i, entry in enumerate(entries)
    )
    df = spark.sql(f"select * from values {body} as t(ord, {', '.join(names)})")
    return df.select("ord", *[F.col(c.split()[0]).cast(c.split()[1]) for c in columns.split(", ")])


def lookup(entries, key: int = 0, value: int = 1) -> Column:
    """A constant map from one field to another."""
    parts = ", ".join(f"{quote(e[key])}, {quote(e[value])}" for e in entries if e[value] is not None)
    return F.expr(f"map({parts})")


def lookup_all(entries: dict[str, tuple], names: str) -> Column:
    """A constant map from a key to a struct of all that is known of it."""
    fields = names.split()
    literal = lambda v: f"cast({v} as double)" if isinstance(v, float) else quote(v)
    struct = lambda values: "named_struct(" + ", ".join(f"'{n}', {literal(v)}" for n, v in zip(fields, values)) + ")"
    return F.expr("map(" + ", ".join(f"{quote(key)}, {struct(values)}" for key, values in entries.items()) + ")")


def conditions(spark: SparkSession) -> DataFrame:
    return table(spark, rows("CONDITIONS", 2), "name string, icd10_code string")


def drugs(spark: SparkSession) -> DataFrame:
    return table(
        spark, rows("DRUGS", 4), "name string, atc_code string, generic_name string, drug_class string"
    )


def brands(spark: SparkSession) -> DataFrame:
    return table(spark, rows("BRANDS", 2), "brand string, generic string")


def frequencies(spark: SparkSession) -> DataFrame:
    return table(spark, rows("FREQUENCIES", 2), "term string, phrase string")


def lab_ranges(spark: SparkSession) -> DataFrame:
    return table(
        spark,
        rows("LAB_RANGES", 8),
        "test string, sex string, low double, high double, borderline double, high_from double, "
        "deficient_below double, unit string",
    )


def relationships(spark: SparkSession) -> DataFrame:
    """Generation and shared-risk weight of each relationship."""
    weights = dict(rows("SHARED_RISK_WEIGHTS", 2))
    entries = [(rel, gen, weights.get(rel, "0.05")) for rel, gen in rows("GENERATIONS", 2)]
    return table(spark, entries, "relationship string, generation int, weight decimal(4,2)")


def hereditary_diseases(spark: SparkSession) -> DataFrame:
    entries = [r[:5] for r in rows("HEREDITARY_DISEASES", 6)]
    return table(
        spark,
        entries,
        "disease_key string, disease string, icd10 string, heritability decimal(4,2), model_key string",
    )


def annotation_labels(spark: SparkSession) -> DataFrame:
    return table(spark, rows("ANNOTATION_LABELS", 2), "label string, entity_type string")


def recommendation_templates(spark: SparkSession) -> DataFrame:
    return table(
        spark,
        rows("RECOMMENDATIONS", 7),
        "category string, priority string, levels string, words string, title string, "
        "description string, action string",
    )


def category_labels(spark: SparkSession) -> DataFrame:
    return table(spark, rows("CATEGORY_LABELS", 2), "category string, category_label string")
