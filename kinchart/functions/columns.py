"""Column expressions shared by the operators.  All are built-in functions: no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinchart.sources import fixed_values as fixed
from kinchart.sources.dimensions import words


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_value() -> Column:
    """What the user corrected the entity to, else what was extracted."""
    return F.when(F.col("user_corrected"), F.col("corrected_value")).otherwise(F.col("entity_value"))


def any_word(text: Column, keywords: list[str]) -> Column:
    """True where the folded text contains any of the keywords (one alternation, no join)."""
    alternation = "|".join(f"\\Q{k.lower()}\\E" for k in keywords)
    return F.lower(text).rlike(alternation)


def py_title(text: Column | str) -> Column:
    """Capitalise every run of letters; ``initcap`` alone starts a new word only after white space."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def risk_level(p: Column | str, moderate: float = 0.30, high: float = 0.60) -> Column:
    p = col(p)
    return F.when(p >= high, "high").when(p >= moderate, "moderate").otherwise("low")


def ocr_quality(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c >= 0.90, "excellent").when(c >= 0.75, "good").when(c >= 0.55, "fair").otherwise("poor")
    )


def confidence_label(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c >= 0.90, "Very High")
        .when(c >= 0.75, "High")
        .when(c >= 0.55, "Moderate")
        .when(c >= 0.35, "Low")
        .otherwise("Very Low")
    )


def canonical_entity_type(t: Column | str) -> Column:
    folded = F.lower(col(t))
    return F.when(folded.isin(words(fixed.STORED_ENTITY_TYPES)), folded).otherwise(F.lit("other"))


def entity_confidence(rule: Column, ml: Column, code_matched: Column) -> Column:
    """Combine the two signals; a code match adds 0.05.  Decimal, so that halves round up exactly."""
    r, m = rule.cast("decimal(12,6)"), ml.cast("decimal(12,6)")
    share = lambda text: F.lit(text).cast("decimal(4,2)")
    base = (
        F.when(r.isNotNull() & m.isNotNull(), share("0.4") * r + share("0.6") * m)
        .when(m.isNotNull(), m * share("0.95"))
        .when(r.isNotNull(), r * share("0.85"))
        .otherwise(share("0.5"))
    )
    final = F.when(code_matched, F.least(share("1.0"), base + share("0.05"))).otherwise(base)
    return F.round(final, 3).cast("double")


def ensemble(tree_p: Column, net_p: Column, fallback: Column) -> Column:
    """Weighted mean of both models; a missing side takes the other's value, both missing the fallback."""
    a, b = F.coalesce(tree_p, net_p, fallback), F.coalesce(net_p, tree_p, fallback)
    return F.round(0.6 * a + 0.4 * b, 4)


def model_confidence(tree_p: Column, net_p: Column, fallback: Column) -> Column:
    a, b = F.coalesce(tree_p, net_p, fallback), F.coalesce(net_p, tree_p, fallback)
    return clamp(F.round(1 - F.abs(a - b) * 1.5, 3), 0.30, 1.0)


def platt_scale(score: Column, a: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * score + F.lit(b)))


def day(as_of) -> Column:
    """A date literal."""
    return F.lit(str(as_of)).cast("date")


def days_before(as_of, days: int) -> Column:
    return F.date_sub(day(as_of), days)


def sentence(form: str, **values: Column) -> Column:
    """A sentence with ``{name}`` places filled by columns."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])
