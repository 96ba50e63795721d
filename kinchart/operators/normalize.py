"""Mapping of free text to codes: exact, fuzzy and substring steps in one lazy expression.

The steps are alternatives of a ``coalesce``, so a text that is in the dictionary pays for one map
lookup only; the comparison with all keys (fewer than 200) runs for unknown texts.  A table repeats
its texts, so ``per_distinct`` maps every distinct text once and joins the results back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.functions.dates import normalize_date
from kinchart.sources import dimensions as dims

CONDITIONS = dims.rows("CONDITIONS", 2)
DRUGS = dims.rows("DRUGS", 4)
BRANDS = dims.rows("BRANDS", 2)
FREQUENCIES = dims.rows("FREQUENCIES", 2)
FUZZY = 0.85


def _keys(entries) -> Column:
    return F.expr("array(" + ", ".join(dims.quote(e[0]) for e in entries) + ")")


def _fuzzy(query: Column, entries) -> Column:
    """Most similar key (edit distance over the longer length), the first one on ties, if close enough."""
    longest = max(len(e[0]) for e in entries)
    size = F.length(query)

    def near(k: Column) -> Column:
        return F.abs(F.length(k) - size) <= (1 - FUZZY) * F.greatest(F.length(k), size)

    def score(k: Column) -> Column:
        d = F.levenshtein(query, k, int(longest * (1 - FUZZY) / FUZZY) + 1)
        similar = 1 - d / F.greatest(F.length(k), size)
        return F.struct(F.when(d >= 0, similar).otherwise(0.0).alias("score"), k.alias("key"))

    scored = F.transform(F.filter(_keys(entries), near), score)
    none = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("key"))
    best = F.aggregate(scored, none, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return F.filter(F.array(best), lambda b: b["score"] >= FUZZY)


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def per_distinct(rows: DataFrame, text: str, result: Callable[[Column], Column], name: str = "normal") -> DataFrame:
    """``rows`` with ``name``, the result of each distinct text; whether they are broadcast is decided at run time."""
    known = rows.select(F.col(text).alias("_text")).distinct()
    # a generator, not a projection: the optimizer would repeat the whole expression for each field read
    known = known.select("_text", F.explode(F.array(result(F.col("_text")))).alias(name))
    return rows.join(known, rows[text].eqNullSafe(F.col("_text")), "left").drop("_text")


def disease_facts() -> dict[str, tuple]:
    """What each name of the dictionary becomes."""
    return {name: (dims.title(name), code, 1.0, "exact") for name, code in CONDITIONS if code is not None}


def _known_diseases() -> Column:
    return dims.lookup_all(disease_facts(), "display icd10_code confidence method")


def medicine_facts() -> dict[str, tuple]:
    """What each name and each brand becomes; a name goes before a brand."""
    drugs = {name: (generic or dims.title(name), code or "", kind or "") for name, code, generic, kind in DRUGS}
    other = lambda name: (dims.title(name), "", "")
    brands = {brand: (*drugs.get(name, other(name)), 0.95, "brand") for brand, name in BRANDS if name is not None}
    exact = {name: (*drugs[name], 1.0, "exact") for name, code, _, _ in DRUGS if code is not None}
    return brands | exact


def _known_medicines() -> Column:
    return dims.lookup_all(medicine_facts(), "generic_name atc_code drug_class confidence method")


def normalize_disease(text: Column) -> Column:
    """Struct (display, icd10_code, confidence, method)."""
    query = F.trim(F.lower(text))
    codes = dims.lookup(CONDITIONS)

    def result(key: Column, confidence: Column, method: str) -> Column:
        return F.struct(
            C.py_title(key).alias("display"),
            F.coalesce(F.try_element_at(codes, key), F.lit("")).alias("icd10_code"),
            F.round(confidence, 3).alias("confidence"),
            F.lit(method).alias("method"),
        )

    exact = F.try_element_at(_known_diseases(), query)
    fuzzy = _first(F.transform(_fuzzy(query, CONDITIONS), lambda b: result(b["key"], b["score"], "fuzzy")))
    inside = F.filter(_keys(CONDITIONS), lambda k: query.contains(k) | k.contains(query))
    prefix = _first(F.transform(F.slice(inside, 1, 1), lambda k: result(k, F.lit(0.70), "prefix")))
    none = F.struct(
        C.py_title(text).alias("display"),
        F.lit("").alias("icd10_code"),
        F.lit(0.40).alias("confidence"),
        F.lit("none").alias("method"),
    )
    empty = F.struct(
        F.lit("").alias("display"), F.lit("").alias("icd10_code"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method")
    )
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.coalesce(exact, fuzzy, prefix, none))


def normalize_medicine(text: Column) -> Column:
    """Struct (generic_name, atc_code, drug_class, confidence, method)."""
    query = F.trim(F.lower(text))
    atc, names, classes = (dims.lookup(DRUGS, 0, i) for i in (1, 2, 3))

    def result(key: Column, confidence: Column, method: str) -> Column:
        return F.struct(
            F.coalesce(F.try_element_at(names, key), C.py_title(key)).alias("generic_name"),
            F.coalesce(F.try_element_at(atc, key), F.lit("")).alias("atc_code"),
            F.coalesce(F.try_element_at(classes, key), F.lit("")).alias("drug_class"),
            F.round(confidence, 3).alias("confidence"),
            F.lit(method).alias("method"),
        )

    known = F.try_element_at(_known_medicines(), query)
    fuzzy = _first(F.transform(_fuzzy(query, DRUGS), lambda b: result(b["key"], b["score"], "fuzzy")))
    missing = lambda name, confidence: F.struct(
        name.alias("generic_name"),
        F.lit("").alias("atc_code"),
        F.lit("").alias("drug_class"),
        F.lit(confidence).alias("confidence"),
        F.lit("none").alias("method"),
    )
    return F.when(F.coalesce(text, F.lit("")) == "", missing(F.lit(""), 0.0)).otherwise(
        F.coalesce(known, fuzzy, missing(C.py_title(text), 0.40))
    )


def normalize_frequency(text: Column) -> Column:
    known = dims.lookup(FREQUENCIES)
    return F.coalesce(F.try_element_at(known, F.trim(F.lower(text))), C.py_title(text))


def icd_display(code: Column) -> Column:
    """Display name of a code; several names share a code and the last one stands."""
    last = {code: name for name, code in CONDITIONS}
    return C.py_title(F.try_element_at(dims.lookup(tuple(last.items())), code))


def code_lookup(entity_type: Column, value: Column) -> Column:
    """Struct (icd10_code, atc_code) of a typed value: diseases by name, medicines by brand then name."""
    key = F.lower(value)
    generic = F.coalesce(F.try_element_at(dims.lookup(BRANDS), key), key)
    return F.struct(
        F.when(entity_type == "disease", F.try_element_at(dims.lookup(CONDITIONS), key)).alias("icd10_code"),
        F.when(entity_type == "medicine", F.try_element_at(dims.lookup(DRUGS), generic)).alias("atc_code"),
    )


def normalize_entity(e: Column) -> dict[str, Column]:
    """Fields of an entity struct that normalization sets, by type."""
    kind = F.upper(e["type"])
    disease = F.when(kind == "DISEASE", normalize_disease(e["text"]))
    medicine = F.when(kind == "MEDICINE", normalize_medicine(e["text"]))
    iso = F.when(kind == "DATE", normalize_date(e["text"]))
    return {"disease": disease, "medicine": medicine, "iso": iso}
