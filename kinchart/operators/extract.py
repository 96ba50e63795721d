"""Extraction of typed entities from documents.

Every extractor maps a text column to an array of entity structs; ``extract_entities`` puts them
together and ``explode_entities`` turns them into rows.  The whole pipeline is a projection over
the documents: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinchart.functions import columns as C
from kinchart.functions import dates as D
from kinchart.functions.spans import first_from, groups, hospital_spans, is_ascii, let, needs, opening, pattern_spans, sooner, vocabulary_spans, where_held, with_digits, without_overlap
from kinchart.functions.sweep import matched
from kinchart.operators import normalize as N
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

FIELDS = {
    "type": "string",
    "text": "string",
    "start": "int",
    "end": "int",
    "normalized": "string",
    "confidence": "double",
    "source": "string",
    "icd10_code": "string",
    "atc_code": "string",
    "drug_class": "string",
    "lab_name": "string",
    "lab_value": "double",
    "lab_unit": "string",
    "systolic": "int",
    "diastolic": "int",
    "normalization_confidence": "double",
    "normalization_method": "string",
}

ENTITIES = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">>"
BRAND_OF = dict(N.BRANDS)
DRUG_NAMES = tuple(dict.fromkeys([r[0] for r in N.DRUGS] + [r[0] for r in N.BRANDS]))
DISEASE_NAMES = tuple(r[0] for r in N.CONDITIONS)


def entity(span: Column, kind: str, confidence: float, source: str = "rule", **given: Column) -> Column:
    """A complete entity struct from a span and the fields given."""
    given |= {
        "type": F.lit(kind),
        "text": span["text"],
        "start": span["start"],
        "end": span["end"],
        "confidence": F.lit(confidence),
        "source": F.lit(source),
    }
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


# --- extractors ---------------------------------------------------------------------------------


def fix_ocr_text(text: Column, rules=None) -> Column:
    """Ordered corrections of common recognition errors, ignoring case.

    A rule goes over a text that holds the letters it needs; most texts lack those of most rules.
    """
    rules = rules or dims.rows("OCR_FIXES", 2)
    # letters that are like one of ASCII when case is ignored: such texts, and rules that may write them, pass every test
    alike = "[\u0130\u0131\u017f\u212a]"
    plain = all(replacement.isascii() for _, replacement in rules)

    def fix(t: Column, expression: str, replacement: str) -> Column:
        return F.regexp_replace(t, F.lit("(?iU)" + sooner(expression)), F.lit(replacement))

    def both(t: Column) -> Column:
        return F.struct(t.alias("text"), F.lower(t).alias("folded"))

    def tested(t: Column) -> Column:
        """All rules over a text and its folded form, which is made anew where a rule went over the text."""

        def step(rule) -> Callable[[Column], Column]:
            needed = needs(rule[0])
            after = lambda s: let(fix(s["text"], *rule), both)
            return after if needed is None else lambda s: F.when(s["folded"].contains(needed), after(s)).otherwise(s)

        state = both(t)
        for rule in rules:
            state = let(state, step(rule))
        return state["text"]

    def untested(t: Column) -> Column:
        for expression, replacement in rules:
            t = fix(t, expression, replacement)
        return t

    if not plain:
        return untested(text)
    return let(text, lambda t: F.when((F.octet_length(t) > F.length(t)) & t.rlike(alike), untested(t)).otherwise(tested(t)))


@cache
def known_drugs() -> dict[str, tuple]:
    """Name = generic name, code and class of every drug and brand."""
    codes = {r[0]: (r[1] or "", r[3] or "") for r in N.DRUGS}
    generic = {name: BRAND_OF.get(name, name) for name in DRUG_NAMES}
    return {name: (dims.title(g), *codes.get(g, ("", ""))) for name, g in generic.items()}


@cache
def known_diseases() -> dict[str, tuple]:
    return {name: (dims.title(name), code) for name, code in N.CONDITIONS}


def find_drugs(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    known = dims.lookup_all(known_drugs(), "normalized atc_code drug_class")

    def make(s: Column) -> Column:
        def of(fact: Column) -> Column:
            # a name written with characters that only look like its letters when case is ignored has no entry
            return entity(
                s, "MEDICINE", 0.90, "vocab",
                normalized=F.coalesce(fact["normalized"], C.py_title(F.lower(s["text"]))),
                atc_code=F.coalesce(fact["atc_code"], F.lit("")),
                drug_class=F.coalesce(fact["drug_class"], F.lit("")),
            )

        return let(F.try_element_at(known, F.lower(s["text"])), of)

    spans = vocabulary_spans(text, DRUG_NAMES, plain)
    return F.transform(spans, _normal(make, normal_drugs(), "MEDICINE", 0.90) if normal else make)


def find_diseases(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    known = dims.lookup_all(known_diseases(), "normalized icd10_code")

    def make(s: Column) -> Column:
        def of(fact: Column) -> Column:
            named = F.coalesce(fact["normalized"], C.py_title(F.lower(s["text"])))
            return entity(s, "DISEASE", 0.88, "vocab", normalized=named, icd10_code=fact["icd10_code"])

        return let(F.try_element_at(known, F.lower(s["text"])), of)

    spans = vocabulary_spans(text, DISEASE_NAMES, plain)
    return F.transform(spans, _normal(make, normal_diseases(), "DISEASE", 0.88) if normal else make)


NORMAL = ("normalized", "icd10_code", "atc_code", "drug_class", "normalization_confidence", "normalization_method")


@cache
def normal_drugs() -> dict[str, tuple]:
    """Name = what normalization makes of it, for names whose code is found without comparing."""
    return {name: (m[0], None, *m[1:]) for name, m in N.medicine_facts().items() if name in known_drugs()}


@cache
def normal_diseases() -> dict[str, tuple]:
    return {name: (d[0], d[1], None, None, *d[2:]) for name, d in N.disease_facts().items() if name in known_diseases()}


def _normal(make, facts: dict[str, tuple], kind: str, confidence: float):
    """Normalized entities: known names by one look, all others through the whole normalization."""
    known = dims.lookup_all(facts, " ".join(NORMAL))

    def of(s: Column) -> Column:
        def told(fact: Column) -> Column:
            here = entity(s, kind, confidence, "vocab", **{n: fact[n] for n in NORMAL})
            return F.when(fact.isNotNull(), here).otherwise(let(make(s), _normalized))

        return let(F.try_element_at(known, F.lower(s["text"])), told)

    return of


def _find(text: Column, pattern: str, kind: str, confidence: float, fields, plain: Column | None) -> Column:
    return F.transform(pattern_spans(text, pattern, plain), lambda s: entity(s, kind, confidence, **fields(s["text"])))


def _done(normal: bool, confidence: float, method: str) -> dict[str, Column]:
    """What normalization adds to an entity whose normal form is what its finder gave it."""
    return {"normalization_confidence": F.lit(confidence), "normalization_method": F.lit(method)} if normal else {}


def find_dosages(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    return _find(with_digits(text), dims.pattern("dosage"), "DOSAGE", 0.95, lambda m: {"normalized": F.upper(m)}, plain)


def find_frequencies(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    fields = lambda m: {"normalized": N.normalize_frequency(m)} | _done(normal, 0.90, "lookup")
    return _find(text, dims.pattern("frequency"), "FREQUENCY", 0.92, fields, plain)


def find_durations(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    return _find(with_digits(text), dims.pattern("duration"), "DURATION", 0.90, lambda m: {"normalized": F.trim(m)}, plain)


def find_lab_values(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    p = dims.pattern("lab_value")

    def make(s: Column) -> Column:
        def of(g: Column) -> Column:
            return entity(
                s, "LAB_VALUE", 0.93,
                normalized=F.trim(s["text"]),
                lab_name=F.get(g, F.lit(0)),
                lab_value=F.get(g, F.lit(1)).try_cast("double"),
                lab_unit=F.get(g, F.lit(2)),
            )

        return let(groups(s["text"], p, 3), of)

    return F.transform(pattern_spans(with_digits(text), p, plain), make)


def find_blood_pressure(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    p = dims.pattern("blood_pressure")

    def make(s: Column) -> Column:
        def of(g: Column) -> Column:
            high, low = (F.get(g, F.lit(i)) for i in range(2))
            return entity(
                s, "BLOOD_PRESSURE", 0.95,
                normalized=F.concat(high, F.lit("/"), low, F.lit(" mmHg")),
                systolic=high.try_cast("int"),
                diastolic=low.try_cast("int"),
            )

        return let(groups(s["text"], p, 2), of)

    return F.transform(pattern_spans(with_digits(text), p, plain), make)


DEGREE_FORM = r"[A-Z][a-z]+\s+[A-Z][a-z]+\s*,"


def doctor_pattern(degrees: bool = True) -> str:
    """All forms, or those of titles; two words before a degree are tried only where a word, or the search, starts."""
    first = r"(?:\G|(?<!(?-iU:[A-Za-z])))(?=[A-Z][a-z]++\s++[A-Z][a-z]++\s*+,)"
    forms = [r[0] for r in dims.rows("DOCTOR_FORMS", 1)]
    titles = "|".join(f for f in forms if not f.startswith(DEGREE_FORM))
    if not degrees:
        return f"(?iU){opening(titles)}(?:{titles})"
    return "(?iU)" + "|".join((first if f.startswith(DEGREE_FORM) else "") + f for f in forms)


def find_doctors(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    # a title with white space behind it, or a degree behind a comma
    degrees = dims.rows("DOCTOR_FORMS", 1)[-1][0].split(DEGREE_FORM)[1]
    held = where_held(text, rf"(?:Dr\.?\s|,{degrees})", "d,")
    # names before a degree are looked for where a degree stands
    spans = F.when(text.rlike(rf"(?iU)(?=,),{degrees}"), pattern_spans(held, doctor_pattern(), plain)).otherwise(
        pattern_spans(held, doctor_pattern(degrees=False), plain)
    )
    return F.transform(spans, lambda s: entity(s, "DOCTOR", 0.85, normalized=F.trim(s["text"])))


def find_hospitals(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    spans = hospital_spans(text, dims.words(fixed.HOSPITAL_WORDS), plain)
    return F.transform(
        spans, lambda s: entity(s, "HOSPITAL", 0.75, normalized=C.py_title(F.trim(s["text"])))
    )


def find_allergies(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    p = dims.pattern("allergy")

    def fields(m: Column) -> dict[str, Column]:
        to = F.regexp_extract(m, p, 1)
        return {"normalized": F.when(to != "", F.regexp_replace(to, r"^\s+|\s+$", "")).otherwise("NKDA")}

    held = where_held(text, dict(dims.rows("PATTERNS", 2))["allergy"].split(r"\s*:?")[0], "acn")
    return _find(held, p, "ALLERGY", 0.88, fields, plain)


def find_dates(text: Column, plain: Column | None = None, normal: bool = False) -> Column:
    """Written dates, then numeric ones clear of them; texts that are no date are left out."""

    def valid(spans: Column, confidence: float, parse) -> Column:
        more = _done(normal, 0.95, "dateparser")
        made = F.transform(
            spans,
            lambda s: entity(s, "DATE", confidence, normalized=parse(s["text"]).cast("string"), **more),
        )
        return F.when(F.size(spans) == 0, F.array().cast(ENTITIES)).otherwise(F.filter(made, lambda e: e["normalized"].isNotNull()))

    def with_numeric(written: Column) -> Column:
        def both(clear: Column) -> Column:
            numeric = valid(clear, 0.85, D.numeric_date)
            in_order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
            merged = F.when(F.size(clear) == 0, written).otherwise(F.array_sort(F.concat(written, numeric), in_order))
            return F.when(F.size(written) == 0, numeric).otherwise(merged)

        return let(pattern_spans(with_digits(text), dims.pattern("numeric_date"), plain), lambda s: let(without_overlap(s, written), both))

    return let(valid(pattern_spans(with_digits(text), dims.pattern("written_date"), plain), 0.95, D.written_date), with_numeric)


EXTRACTORS = {
    "drugs": find_drugs,
    "diseases": find_diseases,
    "dosages": find_dosages,
    "frequencies": find_frequencies,
    "durations": find_durations,
    "dates": find_dates,
    "lab_values": find_lab_values,
    "blood_pressure": find_blood_pressure,
    "doctors": find_doctors,
    "hospitals": find_hospitals,
    "allergies": find_allergies,
}


# No extractor is less sure than this.
LEAST = 0.75

# --- normalization of entity structs --------------------------------------------------------------


def normalized_entity(e: Column) -> Column:
    parts = N.normalize_entity(e)
    disease, medicine, iso = parts["disease"], parts["medicine"], parts["iso"]
    bundle = F.struct(e.alias("e"), disease.alias("d"), medicine.alias("m"), iso.alias("iso"))
    return bundle


def _apply_normalization(x: Column) -> Column:
    e, d, m = x["e"], x["d"], x["m"]
    kind = F.upper(e["type"])
    is_date, is_freq = kind == "DATE", kind == "FREQUENCY"
    changed = {
        "normalized": F.when(d.isNotNull(), d["display"])
        .when(m.isNotNull(), m["generic_name"])
        .when(is_date, F.coalesce(x["iso"].cast("string"), F.lit("")))
        .when(is_freq, N.normalize_frequency(e["text"]))
        .otherwise(e["normalized"]),
        "icd10_code": F.coalesce(d["icd10_code"], e["icd10_code"]),
        "atc_code": F.coalesce(m["atc_code"], e["atc_code"]),
        "drug_class": F.coalesce(m["drug_class"], e["drug_class"]),
        "normalization_confidence": F.when(d.isNotNull(), d["confidence"])
        .when(m.isNotNull(), m["confidence"])
        .when(is_date, F.when(x["iso"].isNotNull(), 0.95).otherwise(0.0))
        .when(is_freq, 0.90),
        "normalization_method": F.when(d.isNotNull(), d["method"])
        .when(m.isNotNull(), m["method"])
        .when(is_date, "dateparser")
        .when(is_freq, "lookup"),
    }
    return F.struct(*[changed.get(n, e[n]).cast(t).alias(n) for n, t in FIELDS.items()])


def normalize_entities(entities: Column) -> Column:
    """Codes and standard names for every entity of an array, by its type."""

    return F.transform(entities, _normalized)


def _normalized(e: Column) -> Column:
    # other types keep what they have
    kept = {n: F.lit(None) if n.startswith("normalization_") else e[n] for n in FIELDS}
    same = F.struct(*[kept[n].cast(t).alias(n) for n, t in FIELDS.items()])
    changes = F.upper(e["type"]).isin("DISEASE", "MEDICINE", "DATE", "FREQUENCY")
    return F.when(changes, let(normalized_entity(e), _apply_normalization)).otherwise(same)


# --- pipeline -------------------------------------------------------------------------------------


def rule_entities(docs: DataFrame, text: str = "text", normal: bool = False) -> DataFrame:
    """Documents with an ``entities`` array: all extractors in order, ``normal`` as ``normalize_entities`` leaves them."""
    docs = docs.withColumn("_plain", is_ascii(F.col(text)))
    found = [f(F.col(text), F.col("_plain"), normal) for f in EXTRACTORS.values()]
    return docs.withColumn("entities", F.concat(*found)).drop("_plain")


def explode_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    # The outer form keeps the optimizer from testing the size of the array first, which would
    # compute the whole array a second time; the empty row it adds is dropped again.
    rows = docs.select(key, F.posexplode_outer("entities").alias("ord", "e")).filter("ord is not null")
    return rows.select(key, "ord", "e.*")


def extract_documents(
    docs: DataFrame, text: str = "text", min_confidence: float = 0.60, fix_text: bool = False
) -> DataFrame:
    """Documents with normalized entities above the confidence threshold, still as an array.

    ``fix_text`` applies the recognition corrections first (for text that comes from word tables).
    """
    if fix_text:
        docs = docs.withColumn(text, fix_ocr_text(F.col(text)))
    docs = rule_entities(docs, text, normal=True)
    if min_confidence <= LEAST:
        return docs
    return docs.withColumn("entities", F.filter("entities", lambda e: e["confidence"] >= min_confidence))


def normalize_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Normalization of entity rows (one struct per row instead of an array)."""
    fields = [
        (F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()
    ]
    one = F.array(F.struct(*fields))
    return rows.select(*columns, F.explode(normalize_entities(one)).alias("e")).select(*columns, "e.*")


def extract_entities(
    docs: DataFrame,
    annotations: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    min_confidence: float = 0.60,
    fix_text: bool = False,
) -> DataFrame:
    """Entity rows of all documents, optionally merged with imported annotations.

    Annotations are grouped by document and meet the document's entities in one row; the texts stay where they are.
    """
    if annotations is None:
        return explode_entities(extract_documents(docs, text, min_confidence, fix_text), key)
    if fix_text:
        docs = docs.withColumn(text, fix_ocr_text(F.col(text)))
    rules = rule_entities(docs, text).select(key, F.transform("entities", _item).alias("rule"))
    sides = rules.join(_listed(annotations, key).withColumnRenamed("items", "ml"), key, "full")
    merged = _merged_rows(_matched(sides, 0.3), key).filter(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return normalize_rows(merged, [key])


# --- rule spans against annotation spans ----------------------------------------------------------


# What two spans are matched by: their place, and the order of spans that share an ``ord``.
PLACE = ("type", "text", "start", "end")


def _items(names) -> str:
    return "array<struct<ord:bigint," + ",".join(f"{n}:{FIELDS[n]}" for n in names) + ">>"


def _item(e: Column, ord_: Column) -> Column:
    return F.struct(ord_.cast("bigint").alias("ord"), *[e[n].cast(t).alias(n) for n, t in FIELDS.items()])


def _listed(rows: DataFrame, key: str, names=tuple(FIELDS)) -> DataFrame:
    """(key, items): the entity rows (ord, ...) of every document as one sorted array."""
    fields = [(F.col(n) if n in rows.columns else F.lit(None)).cast(FIELDS[n]).alias(n) for n in names]
    item = F.struct(F.col("ord").cast("bigint").alias("ord"), *fields)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _sides(rules: DataFrame, annotations: DataFrame, key: str, names=tuple(FIELDS)) -> DataFrame:
    """(key, rule, ml): both entity lists of every document in one row."""
    return (
        _listed(rules, key, names).withColumnRenamed("items", "rule")
        .join(_listed(annotations, key, names).withColumnRenamed("items", "ml"), key, "full")
    )


def _matched(sides: DataFrame, threshold: float, names=tuple(FIELDS)) -> DataFrame:
    """Both lists of a document and, in ``m``, the annotation each rule entity takes.

    Every rule entity, in order, takes the free annotation it overlaps most.
    """
    none = F.array().cast(_items(names))
    both = sides.withColumns({n: F.coalesce(n, none) for n in ("rule", "ml")})
    return both.withColumn("m", matched(F.col("rule"), F.col("ml"), threshold))


def span_overlap_join(rules: DataFrame, annotations: DataFrame, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Pairs (key, rule_ord, ml_ord, overlap) of rule and annotation spans."""
    pair = F.zip_with("rule", "m.partner", lambda r, p: F.struct(r["ord"].alias("rule_ord"), F.get("ml", p)["ord"].alias("ml_ord")))
    told = F.zip_with(pair, "m.affinity", lambda p, v: F.struct(p["rule_ord"], p["ml_ord"], v.alias("overlap")))
    rows = _matched(_sides(rules, annotations, key, PLACE), threshold, PLACE)
    return rows.select(key, F.inline(F.filter(told, lambda p: p["ml_ord"].isNotNull())))


def _merged_rows(rows: DataFrame, key: str) -> DataFrame:
    """Entities of matched documents, conflicts resolved.

    A matched annotation above 0.85 replaces the rule entity with a combined confidence; other
    matches keep the rule entity; unmatched annotations count 0.85 of their confidence, but a document
    without rule entities keeps its annotations untouched.
    """

    def out(e: Column, confidence: Column) -> Column:
        return F.struct(*[(confidence if n == "confidence" else e[n]).cast(t).alias(n) for n, t in FIELDS.items()])

    def resolve(r: Column, i: Column) -> Column:
        partner = F.get("ml", F.get("m.partner", i))
        combined = C.entity_confidence(r["confidence"], partner["confidence"], F.lit(False))
        return F.when(partner["confidence"] > 0.85, out(partner, combined)).otherwise(out(r, r["confidence"]))

    weight = F.when(F.size("rule") > 0, 0.85).otherwise(1.0)
    rest = F.filter("ml", lambda _, i: ~F.get("m.taken", i))
    merged = F.concat(F.transform("rule", resolve), F.transform(rest, lambda m: out(m, m["confidence"] * weight)))
    return rows.select(key, F.inline(merged))


def merge_entities(rules: DataFrame, annotations: DataFrame, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Rule and annotation entities of every document, conflicts resolved (see ``_merged_rows``)."""
    return _merged_rows(_matched(_sides(rules, annotations, key), threshold), key)


# --- entities near each other ---------------------------------------------------------------------


def nearest_following(
    anchors: DataFrame, targets: DataFrame, window: int, key: str = "doc_id"
) -> DataFrame:
    """For each anchor the first target that starts at its end or up to ``window`` later (else null).

    Each side is read once: anchors and targets meet by document and position bucket, a target in its own bucket
    and the one before, and are gone through from the end.  Anchors of one key and ``ord`` have one target.
    """
    bucket = lambda c: F.floor(c / (window + 1))
    found = F.struct(F.col("start").alias("target_start"), F.col("text").alias("target_text"))
    own = bucket(F.col("start"))
    a = anchors.select(
        F.col(key).alias("_key"), bucket(F.col("end")).alias("_b"), F.col("end").alias("_at"),
        F.struct(*[F.col(f"`{c}`") for c in anchors.columns]).alias("_a"),
    )
    t = targets.filter(F.col(key).isNotNull() & F.col("start").isNotNull()).select(
        F.col(key).alias("_key"), F.explode(F.array(own, own - 1)).alias("_b"), F.col("start").alias("_at"), found.alias("_t")
    )
    # a target at an anchor's end stands before it
    back = Window.partitionBy("_key", "_b").orderBy(F.desc("_at"), F.col("_a").isNotNull())
    reached = F.min("_t").over(back.rowsBetween(Window.unboundedPreceding, 0))
    met = a.unionByName(t, allowMissingColumns=True).withColumn("_t", reached).filter("_a is not null")
    near = F.when(F.col("_t.target_start") - F.col("_at") <= window, F.col("_t"))
    # a key that is listed twice gives anchors that share their number
    alike = Window.partitionBy("_key", "_a.ord")
    least = F.when(F.col("_key").isNotNull() & F.col("_a.ord").isNotNull(), F.min(near).over(alike))
    return met.withColumn("_t", least).select("_a.*", "_t.target_start", "_t.target_text")


def _of(kind: str) -> Column:
    return F.filter("entities", lambda e: e["type"] == kind)


def _next(kind: str, after: Column, window: int) -> Column:
    """First entity of a kind (``_kind`` and ``_kind_at``, in order) that starts within ``window`` after a position."""
    found = F.get(f"_{kind}", first_from(F.col(f"_{kind}_at"), after))
    return let(found, lambda e: F.when(e["start"] - after <= window, e))


def structured_prescription(docs: DataFrame, as_of, text: str = "text") -> DataFrame:
    """Prescription parts of every document from its ``entities`` array, in the row.

    The follow-up phrase is looked for in the document text.
    """
    in_order = ("dosage", "frequency", "duration")
    by_place = lambda a, b: a["start"] - b["start"]
    docs = docs.withColumns(
        {f"_{n}": F.array_sort(_of(n.upper()), by_place) for n in in_order}
        | {"_disease": _of("DISEASE"), "_lab": _of("LAB_VALUE")}
    ).withColumns({f"_{n}_at": F.transform(f"_{n}", lambda e: e["start"]) for n in in_order})

    def medication(m: Column) -> Column:
        blank = F.lit("")
        said = lambda e: F.coalesce(e["normalized"], e["text"], blank)
        return F.struct(
            m["normalized"].alias("name"),
            m["text"].alias("brand"),
            m["atc_code"].alias("atc_code"),
            m["drug_class"].alias("drug_class"),
            F.coalesce(_next("dosage", m["end"], 100)["text"], blank).alias("dosage"),
            let(_next("frequency", m["end"], 150), said).alias("frequency"),
            F.coalesce(_next("duration", m["end"], 200)["text"], blank).alias("duration"),
            m["confidence"].alias("confidence"),
        )

    normalized = lambda kind: F.transform(_of(kind), lambda e: F.coalesce(e["normalized"], e["text"]))
    first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    return docs.withColumns(
        {
            "conditions": F.array_sort(F.array_distinct(normalized("DISEASE"))),
            "icd10_code": F.try_element_at(
                F.filter(F.transform("_disease", lambda e: e["icd10_code"]), lambda c: c != ""), F.lit(1)
            ),
            "medications": F.transform(_of("MEDICINE"), medication),
            "doctor": first(normalized("DOCTOR")),
            "hospital": first(normalized("HOSPITAL")),
            "hospitals": normalized("HOSPITAL"),
            "dates": F.filter(normalized("DATE"), lambda d: d != ""),
            "lab_values": F.transform(
                "_lab",
                lambda e: F.struct(
                    F.coalesce(e["lab_name"], e["text"]).alias("name"),
                    e["lab_value"].alias("value"),
                    F.coalesce(e["lab_unit"], F.lit("")).alias("unit"),
                ),
            ),
            "allergies": normalized("ALLERGY"),
            "follow_up": D.follow_up_date(F.col(text), as_of),
        }
    ).drop("_disease", "_lab", *[f"_{n}{end}" for n in in_order for end in ("", "_at")])


def prescription_rows(structured: DataFrame, length: int | None = None) -> DataFrame:
    """Prescription columns of every structured document; ``length`` cuts the diagnosis."""
    conditions = F.array_join("conditions", ", ")
    lab = F.transform(
        "lab_values",
        lambda v: F.concat(v["name"], F.lit("="), F.coalesce(v["value"].cast("string"), F.lit("None")), v["unit"]),
    )
    lines = F.array_compact(
        F.array(
            F.when(F.size("allergies") > 0, F.concat(F.lit("Allergies: "), F.array_join("allergies", ", "))),
            F.when(F.size("lab_values") > 0, F.concat(F.lit("Lab observations: "), F.array_join(lab, ", "))),
        )
    )
    return structured.withColumns(
        {
            "diagnosis": F.when(F.size("conditions") > 0, conditions if length is None else F.substring(conditions, 1, length)),
            "prescription_date": F.to_date(F.try_element_at("dates", F.lit(1))),
            "medicines": F.transform(
                "medications", lambda m: F.struct(m["name"].alias("name"), m["atc_code"].alias("atc_code"))
            ),
            "notes": F.when(F.size(lines) > 0, F.array_join(lines, "\n")),
        }
    )


def backfill_record_date(records: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Prescription date for records that have none (prescriptions carry record_id)."""
    found = prescriptions.select(F.col("record_id").alias("id"), F.col("prescription_date").alias("_d"))
    return (
        records.join(found, "id", "left")
        .withColumn("record_date", F.coalesce("record_date", "_d"))
        .drop("_d")
    )


ENTITY_LISTS = {
    "medicines": "MEDICINE",
    "diseases": "DISEASE",
    "dates": "DATE",
    "doctors": "DOCTOR",
    "hospitals": "HOSPITAL",
    "lab_values": "LAB_VALUE",
    "dosages": "DOSAGE",
    "frequencies": "FREQUENCY",
    "allergies": "ALLERGY",
    "blood_pressure": "BLOOD_PRESSURE",
}


def entities_by_type(docs: DataFrame) -> DataFrame:
    """The ``entities`` array of every document as one list per type (and the full list)."""
    return docs.withColumns({name: _of(kind) for name, kind in ENTITY_LISTS.items()})


# --- line and document flags ----------------------------------------------------------------------


def section_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of every document with header and medicine-prefix flags."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.withColumns(
        {
            "is_diagnosis_header": F.col("line").rlike(dims.pattern("diagnosis_header")),
            "is_rx_header": F.col("line").rlike(dims.pattern("rx_header")),
            "has_medicine_prefix": F.col("line").rlike(dims.pattern("medicine_prefix")),
        }
    )


def disease_fragments(docs: DataFrame, text: str = "text") -> DataFrame:
    """Which disease fragments a document mentions, and whether any."""
    known = F.array(*[F.lit(w) for w in dims.words(fixed.DISEASE_FRAGMENTS)])
    # folded once for all words, and looked through once for both results
    found = let(F.lower(text), lambda folded: F.filter(known, lambda w: folded.contains(w)))
    both = let(found, lambda f: F.struct(f.alias("fragments"), (F.size(f) > 0).alias("mentions_disease")))
    told = docs.withColumn("_found", F.explode(F.array(both)))
    return told.withColumns({n: F.col(f"_found.{n}") for n in ("fragments", "mentions_disease")}).drop("_found")


def lab_flags(values: DataFrame) -> DataFrame:
    """Classify lab values (test, value, sex) against the reference ranges."""
    ranges = F.broadcast(dims.lab_ranges(values.sparkSession).drop("ord").withColumnRenamed("sex", "range_sex"))
    v = F.col("value")
    flag = (
        F.when(v < F.col("deficient_below"), "deficient")
        .when(v < F.col("low"), "low")
        .when((v >= F.col("high_from")) & (v > F.col("high")), "high")
        .when((v > F.col("high")) & F.col("borderline").isNotNull(), "borderline")
        .when(v > F.col("high"), "high")
        .otherwise("normal")
    )
    joined = values.join(ranges, "test").filter((F.col("range_sex") == "any") | (F.col("range_sex") == F.col("sex")))
    return joined.withColumn("flag", flag)
