"""Queries over note texts, documents and recognised words."""

from pyspark.sql import functions as F

from kinchart.functions import dates as D
from kinchart.operators import extract as X
from kinchart.operators import jobs as J
from kinchart.operators import normalize as N
from kinchart.operators import ocr as O
from kinchart.plans.record_queries import EFF, title_sql
from kinchart.plans.registry import query, relation
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed
from kinchart.sources.fixtures import AS_OF

P = dict(dims.rows("PATTERNS", 2))


def q(text: str) -> str:
    """A text literal of the oracle's dialect."""
    return "'" + text.replace("'", "''") + "'"


def values(entries, alias: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in e) + ")" for e in entries) + f") as {alias}"


def spans_sql(table: str, text: str, pattern: str) -> str:
    """Rows (doc_id, i, start, "end", m) of all matches, by the same split-and-extract identity."""
    p = q("(?i)" + pattern)
    return f"""select doc_id, i, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as int) as start,
        cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) as int) as "end", ms[i] as m
      from (select doc_id, g, ms, unnest(range(1, len(ms) + 1)) as i from (select doc_id,
        regexp_extract_all({text}, {p}) as ms, regexp_split_to_array({text}, {p}) as g from {table}) where len(ms) > 0)"""


SPAN = 'doc_id bigint, text string, start int, end int, normalized string, confidence double'
PATTERN_QUERIES = {
    "find_dosages": ("dosage", X.find_dosages, "upper(m)", 0.95),
    "find_frequencies": (
        "frequency",
        X.find_frequencies,
        "case lower(m) " + " ".join(f"when {q(a)} then {q(b)}" for a, b in dims.rows("FREQUENCIES", 2)) + f" else {title_sql('m')} end",
        0.92,
    ),
    "find_durations": ("duration", X.find_durations, "trim(m)", 0.90),
}


def rows_of(t, extractor, docs=None):
    df = (t.notes if docs is None else docs).select("doc_id", extractor(F.col("text")).alias("entities"))
    return X.explode_entities(df)


def finder_queries(suffix: str, source: str, docs) -> None:
    """The pattern finders over one table of texts, each against its span relation."""
    for name, (pattern, extractor, norm, conf) in PATTERN_QUERIES.items():
        query(
            name + suffix,
            SPAN,
            f'select doc_id, m as text, start, "end", {norm} as normalized, {conf} as confidence from '
            f'({spans_sql(source, "text", P[pattern])})',
        )(lambda t, extractor=extractor: rows_of(t, extractor, docs(t)))
    query(
        "find_lab_values" + suffix,
        "doc_id bigint, text string, start int, lab_name string, lab_value double, lab_unit string",
        f"""select doc_id, m as text, start, regexp_extract(m, {q('(?i)' + P['lab_value'])}, 1) as lab_name,
            cast(regexp_extract(m, {q('(?i)' + P['lab_value'])}, 2) as double) as lab_value,
            regexp_extract(m, {q('(?i)' + P['lab_value'])}, 3) as lab_unit
            from ({spans_sql(source, "text", P["lab_value"])})""",
    )(lambda t: rows_of(t, X.find_lab_values, docs(t)))
    query(
        "find_blood_pressure" + suffix,
        "doc_id bigint, text string, start int, systolic int, diastolic int, normalized string",
        f"""select *, concat(systolic, '/', diastolic, ' mmHg') as normalized from (select doc_id, m as text, start,
            regexp_extract(m, {q('(?i)' + P['blood_pressure'])}, 1) as systolic,
            regexp_extract(m, {q('(?i)' + P['blood_pressure'])}, 2) as diastolic
            from ({spans_sql(source, "text", P["blood_pressure"])}))""",
    )(lambda t: rows_of(t, X.find_blood_pressure, docs(t)))
    query(
        "find_doctors" + suffix,
        SPAN,
        f"""select doc_id, m as text, start, "end", trim(m) as normalized, 0.85 as confidence from
            ({spans_sql(source, "text", "|".join(r[0] for r in dims.rows("DOCTOR_FORMS", 1)))})""",
    )(lambda t: rows_of(t, X.find_doctors, docs(t)))


finder_queries("", "fx_notes", lambda t: t.notes)
# The whole documents, each twice, with lines of a prescription between and behind them.
DOC_NOTE = (
    "concat(text, ' Dr. Asha Rao. Tab metformin ', cast(doc_id % 900 as string), 'mg BD for ', cast(1 + doc_id % 14 as string), "
    "' days. Dx: ', case doc_id % 4 when 0 then 'Type 2 Diabetes Mellitus' when 1 then 'HYPERTENSION' when 2 then 'gout' "
    "else 'coronary artery disease' end, ' at the Apollo Hospital. BP: ', cast(100 + doc_id % 80 as string), '/', cast(60 + doc_id % 40 as string), ' mmHg. ', text, "
    "' FBS: ', cast(70 + doc_id % 120 as string), ' mg/dL. Syp paracetamol ', cast(1 + doc_id % 9 as string), ' ml thrice daily')"
)
relation("or_doc_notes", f"select doc_id, {DOC_NOTE} as text from documents")


def doc_notes(t):
    return t.spread(t.documents).select("doc_id", F.expr(DOC_NOTE).alias("text"))


finder_queries("_documents", "or_doc_notes", doc_notes)

# Notes that also carry allergies and more date forms.
relation(
    "or_notes2",
    """select doc_id, text || case doc_id % 5 when 0 then ' Allergic to Penicillin, sulfa drugs.' when 1 then ' NKDA.'
       when 2 then ' seen 12th June 2024; next in 3 months.' when 3 then ' Reports of May 4, 2023 and 25/13/2025, 2024-02-30.'
       else ' F/U: 05.11.24 (2024/07/09)' end as text from fx_notes""",
)


def notes2(t):
    return with_tails(t.notes)


def with_tails(docs):
    m = F.col("doc_id") % 5
    tail = (
        F.when(m == 0, " Allergic to Penicillin, sulfa drugs.")
        .when(m == 1, " NKDA.")
        .when(m == 2, " seen 12th June 2024; next in 3 months.")
        .when(m == 3, " Reports of May 4, 2023 and 25/13/2025, 2024-02-30.")
        .otherwise(" F/U: 05.11.24 (2024/07/09)")
    )
    return docs.withColumn("text", F.concat("text", tail))


def allergy_sql(source: str) -> str:
    return f"""select doc_id, m as text, start, "end", case when g <> '' then trim(g) else 'NKDA' end as normalized,
        0.88 as confidence from (select *, regexp_extract(m, {q('(?i)' + P['allergy'])}, 1) as g from
        ({spans_sql(source, "text", P["allergy"])}))"""


# Documents with allergies and dates of all forms behind the text.
relation(
    "or_doc_notes2",
    """select doc_id, text || case doc_id % 5 when 0 then ' Allergic to Penicillin, sulfa drugs.' when 1 then ' NKDA.'
       when 2 then ' seen 12th June 2024; next in 3 months.' when 3 then ' Reports of May 4, 2023 and 25/13/2025, 2024-02-30.'
       else ' F/U: 05.11.24 (2024/07/09)' end as text from documents""",
)


def doc_notes2(t):
    return with_tails(t.spread(t.documents).select("doc_id", "text"))


query("find_allergies", SPAN, allergy_sql("or_notes2"))(lambda t: rows_of(t, X.find_allergies, notes2(t)))
query("find_allergies_documents", SPAN, allergy_sql("or_doc_notes2"))(lambda t: rows_of(t, X.find_allergies, doc_notes2(t)))

NUM = q("(?i)" + P["numeric_date"])
WRI = q("(?i)" + P["written_date"])
MONTH_LIST = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def year_sql(y: str) -> str:
    return f"case when try_cast({y} as int) < 50 then try_cast({y} as int) + 2000 when try_cast({y} as int) < 100 then try_cast({y} as int) + 1900 else try_cast({y} as int) end"


def make_sql(y: str, m: str, d: str) -> str:
    return f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) as date)"


def date_sql(text: str) -> str:
    """Date of a date text (written, else numeric)."""
    w = lambda i: f"regexp_extract({text}, {WRI}, {i})"
    n = lambda i: f"regexp_extract({text}, {NUM}, {i})"
    i = lambda e: f"try_cast({e} as int)"
    mon = lambda e: f"list_position({MONTH_LIST}, lower({e})[1:3])"
    return f"""case when {w(1)} <> '' then {make_sql(year_sql(w(3)), mon(w(2)), i(w(1)))}
      when {w(4)} <> '' then {make_sql(year_sql(w(6)), mon(w(4)), i(w(5)))}
      when {i(n(1))} > 31 then {make_sql(i(n(1)), i(n(2)), i(n(3)))}
      when {n(1)} <> '' then coalesce({make_sql(year_sql(n(3)), i(n(2)), i(n(1)))}, {make_sql(year_sql(n(3)), i(n(1)), i(n(2)))})
      when {n(4)} <> '' then {make_sql(i(n(4)), i(n(5)), i(n(6)))} end"""




def dates_sql(source: str) -> str:
    return f"""select *, cast(d as varchar) as normalized from (
          select doc_id, m as text, start, "end", {date_sql('m')} as d, 0.95 as confidence from ({spans_sql(source, "text", P["written_date"])})
          union all select doc_id, m, start, "end", {date_sql('m')}, 0.85 from ({spans_sql(source, "text", P["numeric_date"])}) n
          where not exists (select 1 from ({spans_sql(source, "text", P["written_date"])}) w
            where w.doc_id = n.doc_id and w.start < n."end" and w."end" > n.start and {date_sql('w.m')} is not null))
        where d is not null"""


query("find_dates", SPAN, dates_sql("or_notes2"))(lambda t: rows_of(t, X.find_dates, notes2(t)))
query("find_dates_documents", SPAN, dates_sql("or_doc_notes2"))(lambda t: rows_of(t, X.find_dates, doc_notes2(t)))
relation(
    "or_date_texts",
    """select id, case id % 7 when 0 then strftime(created_at, '%d/%m/%Y') when 1 then strftime(created_at, '%d-%m-%y')
       when 2 then strftime(created_at, '%d %B %Y') when 3 then strftime(created_at, '%B %d, %Y')
       when 4 then strftime(created_at, '%Y.%m.%d') when 5 then '31/02/2020' else '45/12/12' end as text from fx_records""",
)


def date_texts(t):
    m = F.col("id") % 7
    f = lambda p: F.date_format("created_at", p)
    return t.records.select(
        "id",
        F.when(m == 0, f("dd/MM/yyyy"))
        .when(m == 1, f("dd-MM-yy"))
        .when(m == 2, f("dd MMMM yyyy"))
        .when(m == 3, f("MMMM dd, yyyy"))
        .when(m == 4, f("yyyy.MM.dd"))
        .when(m == 5, "31/02/2020")
        .otherwise("45/12/12")
        .alias("text"),
    )


query("normalize_dates", "id bigint, d date", f"select id, {date_sql('text')} as d from or_date_texts")(
    lambda t: date_texts(t).select("id", D.normalize_date(F.col("text")).alias("d"))
)
FUP = q("(?i)" + P["follow_up"])
REL = q("(?i)" + P["relative_date"])


def unit_sql(pat: str) -> str:
    n, u = f"try_cast(regexp_extract(text, {pat}, 1) as int)", f"rtrim(lower(regexp_extract(text, {pat}, 2)), 's')"
    return f"""case {u} when 'day' then date '{AS_OF}' + {n} when 'week' then date '{AS_OF}' + 7 * {n}
      when 'month' then cast(date '{AS_OF}' + to_months(cast({n} as int)) as date)
      when 'year' then cast(date '{AS_OF}' + to_years(cast({n} as int)) as date) end"""


query(
    "follow_up_date",
    "doc_id bigint, d date",
    f"""select doc_id, case when e <> '' then {date_sql('e')} else {unit_sql(FUP)} end as d
        from (select doc_id, text, regexp_extract(text, {FUP}, 3) as e from or_tails)""",
)(lambda t: tails(t).select("doc_id", D.follow_up_date(F.col("text"), AS_OF).alias("d")))
relation(
    "or_tails",
    """select doc_id, case doc_id % 5 when 0 then text when 1 then 'Follow-up on 5/11/24. ' || text
       when 2 then 'revisit 3 months later, within 10 days. ' || text when 3 then 'Next visit: 14/13/2025 after 2 years. ' || text
       else replace(text, 'Review after', 'about') end as text from fx_notes""",
)


def tails(t):
    m = F.col("doc_id") % 5
    return t.notes.withColumn(
        "text",
        F.when(m == 0, F.col("text"))
        .when(m == 1, F.concat(F.lit("Follow-up on 5/11/24. "), "text"))
        .when(m == 2, F.concat(F.lit("revisit 3 months later, within 10 days. "), "text"))
        .when(m == 3, F.concat(F.lit("Next visit: 14/13/2025 after 2 years. "), "text"))
        .otherwise(F.replace("text", F.lit("Review after"), F.lit("about"))),
    )


query("relative_date", "doc_id bigint, d date", f"select doc_id, {unit_sql(REL)} as d from or_tails")(
    lambda t: tails(t).select("doc_id", D.relative_date(F.col("text"), AS_OF).alias("d"))
)

# --- vocabulary -----------------------------------------------------------------------------------


def vocabulary_sql(names, docs: str = "fx_notes") -> str:
    """Every occurrence of each name between non-letters, unless a longer hit overlaps it."""
    return f"""with folded as (select doc_id, text, lower(text) as low from {docs}),
        cut as (select doc_id, text, low, name, string_split(low, name) as g from folded join
          {values([(n,) for n in names], 'voc(name)')} on contains(low, name)),
        hits as (select doc_id, text, low, name, cast(list_sum(list_transform(g[1:i], lambda x: length(x)))
          + (i - 1) * length(name) as int) as start from (select *, unnest(range(1, len(g))) as i from cut)),
        good as (select doc_id, name, substring(text, start + 1, length(name)) as m, start,
            cast(start + length(name) as int) as "end" from hits
          where not regexp_matches(substring(low, start, 1), '\\p{{L}}')
          and not regexp_matches(substring(low, start + length(name) + 1, 1), '\\p{{L}}'))
      select doc_id, name, m, start, "end" from good g where not exists (select 1 from good o where o.doc_id = g.doc_id
        and o.start < g."end" and o."end" > g.start and length(o.name) > length(g.name))"""


DRUG_SQL = values([r for r in N.DRUGS], "dr(name, atc_code, generic_name, drug_class)")
BRAND_SQL = values([r for r in N.BRANDS], "br(brand, generic)")
COND_SQL = values([(i, *r) for i, r in enumerate(N.CONDITIONS)], "co(ord, name, icd10_code)")
HOSPITAL = r"(?:[A-Za-z][A-Za-z\s]*)?\b(?:" + "|".join(dims.words(fixed.HOSPITAL_WORDS)) + r")\b"
# Notes in which the names of places vary with the note.
relation("or_places", """select doc_id, replace(text, 'City Hospital', case doc_id % 4 when 0 then 'St Mary Nursing Home and Clinic'
    when 1 then 'the clinic' when 2 then 'Ward 7, Apollo Hospital Centre of' else 'City Hospital' end) as text from fx_notes""")


def places(t):
    m = F.col("doc_id") % 4
    name = (
        F.when(m == 0, "St Mary Nursing Home and Clinic").when(m == 1, "the clinic")
        .when(m == 2, "Ward 7, Apollo Hospital Centre of").otherwise("City Hospital")
    )
    return t.notes.withColumn("text", F.replace("text", F.lit("City Hospital"), name))


def name_queries(suffix: str, source: str, place_source: str, docs, place_docs) -> None:
    """The finders of names over one table of texts."""
    query(
        "find_drugs" + suffix,
        "doc_id bigint, text string, start int, end int, normalized string, atc_code string, drug_class string",
        f"""select doc_id, m as text, start, "end", {title_sql('coalesce(generic, h.name)')} as normalized,
            coalesce(atc_code, '') as atc_code, coalesce(drug_class, '') as drug_class
            from ({vocabulary_sql(X.DRUG_NAMES, source)}) h left join {BRAND_SQL} on brand = h.name
            left join {DRUG_SQL} on dr.name = coalesce(generic, h.name)""",
    )(lambda t: rows_of(t, X.find_drugs, docs(t)))
    query(
        "find_diseases" + suffix,
        "doc_id bigint, text string, start int, end int, normalized string, icd10_code string",
        f"""select doc_id, m as text, start, "end", {title_sql('h.name')} as normalized, icd10_code
            from ({vocabulary_sql(X.DISEASE_NAMES, source)}) h join {COND_SQL} on co.name = h.name""",
    )(lambda t: rows_of(t, X.find_diseases, docs(t)))
    query(
        "find_hospitals" + suffix,
        SPAN,
        f"""select doc_id, m as text, start, "end", {title_sql('trim(m)')} as normalized, 0.75 as confidence
            from ({spans_sql(place_source, "text", HOSPITAL)})""",
    )(lambda t: rows_of(t, X.find_hospitals, place_docs(t)))


name_queries("", "fx_notes", "or_places", lambda t: t.notes, places)
name_queries("_documents", "or_doc_notes", "or_doc_notes", doc_notes, doc_notes)

# --- all finders over one table ---------------------------------------------------------------------


def entities_sql(source: str, normalized: bool = True) -> str:
    """Rows (doc_id, ord, type, text, start, "end", normalized, confidence, source) of all finders in order.

    Medicines have their generic name once they are normalized, the brand's or their own before.
    """
    generic = f"coalesce({'generic_name, ' if normalized else ''}{title_sql('coalesce(generic, h.name)')})"
    pattern = {n: spans_sql(source, "text", P[n]) for n in ("dosage", "frequency", "duration", "lab_value", "blood_pressure")}
    doctors = spans_sql(source, "text", "|".join(r[0] for r in dims.rows("DOCTOR_FORMS", 1)))
    bp = q("(?i)" + P["blood_pressure"])
    plain = "0 as k, '' as name, start"
    parts = [
        f"""select doc_id, 'MEDICINE' as type, m as text, start, "end", {generic} as normalized, 0.9 as confidence, 'vocab' as source,
            0 as finder, -length(m) as k, h.name as name, start as place from ({vocabulary_sql(X.DRUG_NAMES, source)}) h
            left join {BRAND_SQL} on brand = h.name left join {DRUG_SQL} on dr.name = coalesce(generic, h.name)""",
        f"""select doc_id, 'DISEASE', m, start, "end", {title_sql('name')}, 0.88, 'vocab', 1, -length(m), name, start
            from ({vocabulary_sql(X.DISEASE_NAMES, source)})""",
        f"""select doc_id, 'DOSAGE', m, start, "end", upper(m), 0.95, 'rule', 2, {plain} from ({pattern["dosage"]})""",
        f"""select doc_id, 'FREQUENCY', m, start, "end", {PATTERN_QUERIES["find_frequencies"][2]}, 0.92, 'rule', 3, {plain}
            from ({pattern["frequency"]})""",
        f"""select doc_id, 'DURATION', m, start, "end", trim(m), 0.9, 'rule', 4, {plain} from ({pattern["duration"]})""",
        f"""select doc_id, 'DATE', text, start, "end", normalized, confidence, 'rule', 5, {plain} from ({dates_sql(source)})""",
        f"""select doc_id, 'LAB_VALUE', m, start, "end", trim(m), 0.93, 'rule', 6, {plain} from ({pattern["lab_value"]})""",
        f"""select doc_id, 'BLOOD_PRESSURE', m, start, "end", concat(regexp_extract(m, {bp}, 1), '/', regexp_extract(m, {bp}, 2), ' mmHg'),
            0.95, 'rule', 7, {plain} from ({pattern["blood_pressure"]})""",
        f"""select doc_id, 'DOCTOR', m, start, "end", trim(m), 0.85, 'rule', 8, {plain} from ({doctors})""",
        f"""select doc_id, 'HOSPITAL', m, start, "end", {title_sql('trim(m)')}, 0.75, 'rule', 9, {plain}
            from ({spans_sql(source, "text", HOSPITAL)})""",
        f"""select doc_id, 'ALLERGY', text, start, "end", normalized, confidence, 'rule', 10, {plain} from ({allergy_sql(source)})""",
    ]
    rows = " union all ".join(parts)
    return f"""select doc_id, cast(row_number() over (partition by doc_id order by finder, k, name, place) - 1 as int) as ord,
        type, text, start, "end", normalized, confidence, source from ({rows})"""


relation("or_documents", "select doc_id, coalesce(text, '') as text from documents")
relation("or_turns", "select conv_id * 100000 + turn as doc_id, coalesce(text, '') as text from conversations")
relation("or_note_rules", entities_sql("fx_notes", normalized=False))
relation("or_note_entities", entities_sql("fx_notes"))

# --- corrections of recognised text ----------------------------------------------------------------

RE2 = {
    r"(?<!\d)0(?=\s*(?:mg|ml|mcg|IU|tablets?))": (r"(^|\D)0(\s*(?:mg|ml|mcg|IU|tablets?))", r"\1O\2"),
    r"\bO(?=\d)": (r"\bO(\d)", r"0\1"),
}


def fix_sql(expr: str) -> str:
    for pattern, replacement in dims.rows("OCR_FIXES", 2):
        p, r = RE2.get(pattern, (pattern, replacement.replace("$", "\\")))
        expr = f"regexp_replace({expr}, {q(p)}, {q(r)}, 'gi')"
    return expr


relation(
    "or_noisy",
    """select doc_id, replace(replace(text, 'metformin', 'Metforrn'), 'mg BD', case doc_id % 4 when 0 then ' rnq bd' when 1
       then '0 mg od' when 2 then ', mcq O5 tds' else '.5 ml (1U) 1,250' end) as text from fx_notes""",
)


def noisy(t):
    m = F.col("doc_id") % 4
    part = F.when(m == 0, " rnq bd").when(m == 1, "0 mg od").when(m == 2, ", mcq O5 tds").otherwise(".5 ml (1U) 1,250")
    text = F.replace("text", F.lit("metformin"), F.lit("Metforrn"))
    return t.notes.withColumn("text", F.replace(text, F.lit("mg BD"), part))


query("fix_ocr_text", "doc_id bigint, text string", f"select doc_id, {fix_sql('text')} as text from or_noisy")(
    lambda t: noisy(t).withColumn("text", X.fix_ocr_text(F.col("text")))
)

# --- normalization --------------------------------------------------------------------------------

relation(
    "or_disease_texts",
    f"""select id, case id % 4 when 0 then substring({EFF}, 1, 2) || substring({EFF}, 4) when 1 then upper({EFF})
        when 2 then {EFF} || ' nos' else {EFF} end as text from fx_entities""",
)


def texts(t):
    v = F.when(F.col("user_corrected"), F.col("corrected_value")).otherwise(F.col("entity_value"))
    m = F.col("id") % 4
    text = (
        F.when(m == 0, F.concat(F.substring(v, 1, 2), F.expr("substring(if(user_corrected, corrected_value, entity_value), 4)")))
        .when(m == 1, F.upper(v))
        .when(m == 2, F.concat(v, F.lit(" nos")))
        .otherwise(v)
    )
    return t.entities.select("id", text.alias("text"))


def cascade_sql(source: str, steps: str) -> str:
    """Normalization of the distinct texts joined back to the rows."""
    return f"""with texts as (select distinct text, trim(lower(text)) as query from {source}), {steps}
      select t.id, n.* exclude (text) from {source} t join result n on n.text = t.text"""


def fuzzy_sql(entries: str) -> str:
    return f"""fuzzy as (select text, arg_min(name, row(-score, ord)) as name, max(score) as score from (
        select text, name, ord, 1 - levenshtein(query, name) / cast(greatest(length(query), length(name)) as double) as score
        from texts join {entries} on abs(length(query) - length(name)) <= 0.15 * greatest(length(query), length(name)))
        where score >= 0.85 group by text)"""


query(
    "normalize_diseases",
    "id bigint, display string, icd10_code string, confidence double, method string",
    cascade_sql(
        "or_disease_texts",
        f"""{fuzzy_sql(COND_SQL)},
        pre as (select text, arg_min(name, ord) as name from texts join {COND_SQL} on contains(query, name)
          or contains(name, query) group by text),
        chosen as (select t.text, coalesce(e.name, f.name, p.name) as name, case when e.name is not null then 1.0
          when f.name is not null then round(f.score, 3) when p.name is not null then 0.7 else 0.4 end as confidence,
          case when e.name is not null then 'exact' when f.name is not null then 'fuzzy' when p.name is not null
          then 'prefix' else 'none' end as method from texts t left join {COND_SQL.replace('as co(', 'as e(')} on e.name = query
          left join fuzzy f on f.text = t.text left join pre p on p.text = t.text),
        result as (select text, {title_sql('coalesce(c.name, text)')} as display, coalesce(icd10_code, '') as icd10_code,
          confidence, method from chosen c left join {COND_SQL} on co.name = c.name)""",
    ),
)(lambda t: N.per_distinct(texts(t), "text", N.normalize_disease).select("id", "normal.*"))
query(
    "normalize_medicines",
    "id bigint, generic_name string, atc_code string, drug_class string, confidence double, method string",
    cascade_sql(
        "or_disease_texts",
        f"""{fuzzy_sql(values([(i, r[0]) for i, r in enumerate(N.DRUGS)], 'co(ord, name)'))},
        chosen as (select t.text, coalesce(e.name, generic, f.name) as name, case when e.name is not null then 1.0
          when generic is not null then 0.95 when f.name is not null then round(f.score, 3) else 0.4 end as confidence,
          case when e.name is not null then 'exact' when generic is not null then 'brand' when f.name is not null
          then 'fuzzy' else 'none' end as method from texts t left join {DRUG_SQL.replace('as dr(', 'as e(')} on e.name = query
          left join {BRAND_SQL} on brand = query left join fuzzy f on f.text = t.text),
        result as (select text, coalesce(generic_name, {title_sql('coalesce(c.name, text)')}) as generic_name,
          coalesce(atc_code, '') as atc_code, coalesce(drug_class, '') as drug_class, confidence, method
          from chosen c left join {DRUG_SQL} on dr.name = c.name)""",
    ),
)(lambda t: N.per_distinct(texts(t), "text", N.normalize_medicine).select("id", "normal.*"))
query(
    "normalize_frequency",
    "id bigint, phrase string",
    f"""select id, case lower(trim(term)) {" ".join(f"when {q(a)} then {q(b)}" for a, b in dims.rows("FREQUENCIES", 2))}
        else {title_sql('term')} end as phrase from (select id, case id % 4 when 0 then ' BD ' when 1 then 'Once Daily'
        when 2 then 'every 6 hours' else 'tds' end as term from fx_entities)""",
)(
    lambda t: t.entities.select(
        "id",
        N.normalize_frequency(
            F.when(F.col("id") % 4 == 0, " BD ")
            .when(F.col("id") % 4 == 1, "Once Daily")
            .when(F.col("id") % 4 == 2, "every 6 hours")
            .otherwise("tds")
        ).alias("phrase"),
    )
)
LOOKUP_SQL = f"""select e.id, case when entity_type = 'disease' then icd10_code end as icd10_code,
    case when entity_type = 'medicine' then atc_code end as atc_code from fx_entities e
    left join {COND_SQL} on co.name = lower(entity_value) left join {BRAND_SQL} on brand = lower(entity_value)
    left join {DRUG_SQL} on dr.name = coalesce(generic, lower(entity_value))"""
query("code_lookup", "id bigint, icd10_code string, atc_code string", LOOKUP_SQL)(
    lambda t: t.entities.select("id", N.code_lookup(F.col("entity_type"), F.col("entity_value")).alias("c")).select("id", "c.*")
)
query(
    "fuzzy_code_join",
    "id bigint, display string, confidence double",
    cascade_sql(
        "or_disease_texts",
        f"""{fuzzy_sql(COND_SQL)}, result as (select f.text, {title_sql('name')} as display, round(score, 3) as confidence
          from fuzzy f join texts t on t.text = f.text where not exists (select 1 from {COND_SQL} where co.name = t.query))""",
    ),
)(
    lambda t: N.per_distinct(texts(t), "text", N.normalize_disease).select("id", "normal.*").filter("method = 'fuzzy'")
)
query(
    "substring_code_join",
    "id bigint, display string, icd10_code string",
    f"""select id, {title_sql('x.name')} as display, x.icd10_code from (select e.id, min_by(co.name, ord) as name,
        min_by(icd10_code, ord) as icd10_code from fx_entities e join {COND_SQL} on contains(lower(corrected_value), co.name)
        or contains(co.name, lower(corrected_value)) group by 1) x""",
)(
    lambda t: N.per_distinct(t.entities.filter("corrected_value is not null"), "corrected_value", N.normalize_disease)
    .select("id", "normal.*")
    .filter("method = 'prefix'")
)
query(
    "icd_display",
    "id bigint, display string",
    f"""select id, {title_sql('name')} as display from (select id, case id % 3 when 0 then 'E11' when 1 then 'N20.0'
        else icd10_code end as code from fx_predictions) join (select icd10_code, arg_max(name, ord) as name
        from {COND_SQL} group by 1) l on l.icd10_code = code""",
)(
    lambda t: t.predictions.select(
        "id",
        N.icd_display(F.when(F.col("id") % 3 == 0, "E11").when(F.col("id") % 3 == 1, "N20.0").otherwise(F.col("icd10_code"))).alias(
            "display"
        ),
    )
)
query(
    "normalize_entities",
    "id bigint, type string, normalized string, icd10_code string, atc_code string, normalization_confidence double, "
    "normalization_method string",
    f"""select e.id, upper(entity_type) as type, case entity_type when 'disease' then {title_sql('entity_value')}
        when 'medicine' then generic_name end as normalized, case when entity_type = 'disease' then icd10_code end as icd10_code,
        case when entity_type = 'medicine' then coalesce(atc_code, '') end as atc_code, case when entity_type = 'disease' or
        brand is null and entity_type = 'medicine' then 1.0 when entity_type = 'medicine' then 0.95 end as normalization_confidence,
        case when entity_type = 'disease' or brand is null and entity_type = 'medicine' then 'exact'
        when entity_type = 'medicine' then 'brand' end as normalization_method from fx_entities e
        left join {COND_SQL} on co.name = lower(entity_value) left join {BRAND_SQL} on brand = lower(entity_value)
        left join {DRUG_SQL} on dr.name = coalesce(generic, lower(entity_value))""",
)(
    lambda t: X.normalize_rows(
        t.entities.select("id", F.upper("entity_type").alias("type"), F.col("entity_value").alias("text"), "confidence"), ["id"]
    )
)

# --- prescriptions and the pipeline ---------------------------------------------------------------

PARTS = """select record_id * 100 + n as doc_id, disease, medicine, qty, 1 + pk % 14 as days, 70 + pk % 120 as fbs,
  1 + pk % 28 as dd, 1 + sk % 12 as mm, 1 + sk % 8 as weeks, 100 + pk % 80 as sys, 60 + sk % 40 as dia from fx_lines join """


def parts_sql() -> str:
    from kinchart.sources.fixtures import _DISEASES, _MEDICINES

    return PARTS + f"{_DISEASES} on pk % 10 = di join {_MEDICINES} on sk % 10 = mi"


relation("or_parts", parts_sql())
relation(
    "or_structured",
    f"""select doc_id, {title_sql('disease')} as conditions, icd10_code, generic_name || '|' || medicine || '|' || atc_code
          || '|' || cast(qty as varchar) || 'mg|Twice daily|for ' || cast(days as varchar) || ' days' as medications,
        'Dr. Asha Rao' as doctor, 'City Hospital' as hospital, printf('2025-%02d-%02d', mm, dd) as dates,
        'FBS=' || cast(fbs as varchar) || '.0mg/dL' as lab_values, date '{AS_OF}' + cast(7 * weeks as int) as follow_up,
        generic_name, atc_code, mm, dd
        from or_parts join {COND_SQL} on co.name = disease left join {BRAND_SQL} on brand = medicine
        join {DRUG_SQL} on dr.name = coalesce(generic, medicine)""",
)


def extracted(t):
    return X.extract_documents(t.notes)


def flat(column, *fields):
    return F.array_join(F.transform(column, lambda m: F.concat_ws("|", *[m[f] for f in fields])), ";")


query(
    "structured_prescription",
    "doc_id bigint, conditions string, icd10_code string, medications string, doctor string, hospital string, "
    "dates string, follow_up date",
    "select * from or_structured",
)(
    lambda t: X.structured_prescription(extracted(t), AS_OF).select(
        "doc_id",
        F.array_join("conditions", ";").alias("conditions"),
        "icd10_code",
        flat("medications", "name", "brand", "atc_code", "dosage", "frequency", "duration").alias("medications"),
        "doctor",
        "hospital",
        F.array_join("dates", ";").alias("dates"),
        "follow_up",
    )
)
query(
    "prescription_rows",
    "doc_id bigint, diagnosis string, icd10_code string, prescription_date date, medicines string, notes string",
    """select doc_id, conditions as diagnosis, icd10_code, make_date(2025, cast(mm as int), cast(dd as int)) as prescription_date,
       generic_name || '|' || atc_code as medicines, 'Lab observations: ' || lab_values as notes from or_structured""",
)(
    lambda t: X.prescription_rows(X.structured_prescription(extracted(t), AS_OF)).withColumn(
        "medicines", flat("medicines", "name", "atc_code")
    )
)
query(
    "entities_by_type",
    "doc_id bigint, medicines int, diseases int, dates int, doctors int, hospitals int, lab_values int, dosages int, "
    "frequencies int, allergies int, blood_pressure int, all_entities int",
    "select doc_id, " + ", ".join(f"count(*) filter (type = '{k}') as {n}" for n, k in X.ENTITY_LISTS.items())
    + ", count(*) as all_entities from or_note_entities group by 1",
)(
    lambda t: X.entities_by_type(extracted(t)).select(
        "doc_id", *[F.size(n).alias(n) for n in X.ENTITY_LISTS], F.size("entities").alias("all_entities")
    )
)
ENTITY = "doc_id bigint, type string, text string, start int, end int, normalized string, confidence double"
query(
    "extract_entities",
    "doc_id bigint, type string, text string, normalized string, confidence double",
    f"""select doc_id, k as type, x as text, nm as normalized, c as confidence from (
        select s.doc_id, unnest(['MEDICINE', 'DISEASE', 'DOSAGE', 'DOSAGE', 'FREQUENCY', 'DURATION', 'DATE', 'LAB_VALUE',
          'BLOOD_PRESSURE', 'DOCTOR', 'HOSPITAL']) as k,
        unnest([medicine, disease, qty || 'mg', fbs || ' mg', 'BD', 'for ' || days || ' days', p.dd || '/' || p.mm || '/2025',
          'FBS: ' || fbs || ' mg/dL', 'BP: ' || sys || '/' || dia || ' mmHg', 'Dr. Asha Rao', 'City Hospital']) as x,
        unnest([generic_name, conditions, qty || 'MG', fbs || ' MG', 'Twice daily', 'for ' || days || ' days', dates,
          'FBS: ' || fbs || ' mg/dL', sys || '/' || dia || ' mmHg', 'Dr. Asha Rao', 'City Hospital']) as nm,
        unnest([0.9, 0.88, 0.95, 0.95, 0.92, 0.9, 0.85, 0.93, 0.95, 0.85, 0.75]) as c
        from or_structured s join or_parts p on p.doc_id = s.doc_id)""",
)(lambda t: X.extract_entities(t.notes))
query("extract_documents_entities", ENTITY, entities_sql("or_documents"))(lambda t: X.extract_entities(t.spread(t.documents)))
query("extract_note_documents", ENTITY, entities_sql("or_doc_notes"))(lambda t: X.extract_entities(doc_notes(t)))
query(
    "extract_conversation_entities",
    "conv_id bigint, turn bigint, type string, text string, start int, normalized string",
    f"select doc_id // 100000 as conv_id, doc_id % 100000 as turn, * from ({entities_sql('or_turns')})",
)(
    lambda t: X.extract_documents(t.spread(t.conversations))
    .select("conv_id", "turn", F.inline_outer("entities"))
    .filter("type is not null")
)


def near_tables(t):
    return rows_of(t, X.find_drugs), rows_of(t, X.find_dosages)


relation("or_dose_spans", spans_sql("fx_notes", "text", P["dosage"]))
query(
    "nearest_following",
    "doc_id bigint, start int, target_start int, target_text string",
    f"""select h.doc_id, h.start, min(d.start) as target_start, arg_min(d.m, d.start) as target_text
        from ({vocabulary_sql(X.DRUG_NAMES)}) h left join or_dose_spans d on d.doc_id = h.doc_id
        and d.start >= h."end" and d.start - h."end" <= 100 group by 1, 2""",
)(lambda t: X.nearest_following(*near_tables(t), 100))


relation("or_frequency_spans", spans_sql("fx_notes", "text", P["frequency"]))
relation("or_duration_spans", spans_sql("fx_notes", "text", P["duration"]))
for kind, reach, extractor in (("frequency", 150, X.find_frequencies), ("duration", 200, X.find_durations)):
    query(
        f"nearest_following_{kind}",
        "doc_id bigint, start int, target_start int, target_text string",
        f"""select h.doc_id, h.start, min(d.start) as target_start, arg_min(d.m, d.start) as target_text
            from ({vocabulary_sql(X.DRUG_NAMES)}) h left join or_{kind}_spans d on d.doc_id = h.doc_id
            and d.start >= h."end" and d.start - h."end" <= {reach} group by 1, 2""",
    )(
        lambda t, extractor=extractor, reach=reach: X.nearest_following(
            rows_of(t, X.find_drugs), rows_of(t, extractor), reach
        )
    )


def moved(rows):
    """Stand-in for annotation rows: entities moved by up to three characters, with confidences of their own."""
    by = (F.col("doc_id") % 4).cast("int")
    return rows.withColumns(
        {
            "start": F.col("start") + by,
            "end": F.col("end") + by,
            # read from the row, so that both sides need the same columns and one exchange serves them
            "confidence": F.when(F.col("confidence").isNotNull(), (70 + F.col("start") % 30) / 100.0),
            "source": F.when(F.col("source").isNotNull(), "ml"),
        }
    )


def moved_sql(rules: str) -> str:
    return f"""select doc_id, ord, type, text, cast(start + doc_id % 4 as int) as start, cast("end" + doc_id % 4 as int) as "end",
        normalized, cast(70 + start % 30 as double) / 100.0 as confidence, 'ml' as source from {rules}"""


def walk_sql(rules: str, ml: str) -> str:
    """Rows (doc_id, ro, ao, v): every rule entity, in order, takes the free annotation it overlaps most."""
    return f"""with recursive cand as materialized (
        select r.doc_id, r.ord as ro, a.ord as ao, cast(least(r."end", a."end") - greatest(r.start, a.start) as double)
          / least(r."end" - r.start, a."end" - a.start) as v
        from {rules} r join {ml} a on a.doc_id = r.doc_id and a.start < r."end" and a."end" > r.start),
      ranked as materialized (select *, dense_rank() over (partition by doc_id order by ro) as k from cand where v > 0.3),
      walk as (
        select distinct doc_id, cast(0 as bigint) as k, cast([] as int[]) as taken, cast(null as int) as ro, cast(null as int) as ao,
          cast(null as double) as v from ranked
        union all
        select doc_id, k, case when ao is null then taken else list_append(taken, ao) end, ro, ao, v from (
          select w.doc_id, c.k, any_value(w.taken) as taken, any_value(c.ro) as ro,
            arg_max(c.ao, row(c.v, -c.ao)) filter (where not list_contains(w.taken, c.ao)) as ao,
            max(c.v) filter (where not list_contains(w.taken, c.ao)) as v
          from walk w join ranked c on c.doc_id = w.doc_id and c.k = w.k + 1 group by w.doc_id, c.k))
      select doc_id, ro, ao, v from walk where ao is not null"""


def merged_sql(rules: str, ml: str, pairs: str) -> str:
    """Rows of both sides with conflicts resolved."""
    pick = "p.ao is not null and a.confidence > 0.85"
    field = lambda n: f'case when {pick} then a."{n}" else r."{n}" end as "{n}"'
    names = ("type", "text", "start", "end", "normalized", "source")
    return f"""select r.doc_id, {", ".join(field(n) for n in names)},
        case when {pick} then cast(round(cast(0.4 as decimal(4,2)) * cast(r.confidence as decimal(12,6))
          + cast(0.6 as decimal(4,2)) * cast(a.confidence as decimal(12,6)), 3) as double) else r.confidence end as confidence
      from {rules} r left join {pairs} p on p.doc_id = r.doc_id and p.ro = r.ord
        left join {ml} a on a.doc_id = r.doc_id and a.ord = p.ao
      union all
      select a.doc_id, {", ".join(f'a."{n}"' for n in names)}, case when exists (select 1 from {rules} r where r.doc_id = a.doc_id)
        then a.confidence * cast(0.85 as double) else a.confidence end
      from {ml} a left join {pairs} p on p.doc_id = a.doc_id and p.ao = a.ord where p.ao is null"""


def rule_rows(docs):
    """Entity rows by document: whoever reads them twice shares the exchange, and with it the extraction."""
    return X.explode_entities(X.rule_entities(docs)).repartition("doc_id")


def both_sides(docs):
    rules = rule_rows(docs)
    return rules, moved(rules)


def located_pairs(rules, ml):
    """Pairs with the start positions of both spans."""
    place = lambda df, side: df.select("doc_id", F.col("ord").alias(f"{side}_ord"), F.col("start").alias(f"{side}_start"))
    pairs = X.span_overlap_join(rules, ml)
    return pairs.join(place(rules, "rule"), ["doc_id", "rule_ord"]).join(place(ml, "ml"), ["doc_id", "ml_ord"])


relation("or_doc_rules", entities_sql("or_doc_notes", normalized=False))
for name in ("note", "doc"):
    relation(f"or_{name}_ml", moved_sql(f"or_{name}_rules"))
    relation(f"or_{name}_pairs", walk_sql(f"or_{name}_rules", f"or_{name}_ml"))

query(
    "span_overlap_join",
    "doc_id bigint, rule_start int, ml_start int, overlap double",
    """select p.doc_id, r.start as rule_start, a.start as ml_start, v as overlap from or_doc_pairs p
       join or_doc_rules r on r.doc_id = p.doc_id and r.ord = p.ro join or_doc_ml a on a.doc_id = p.doc_id and a.ord = p.ao""",
)(lambda t: located_pairs(*both_sides(doc_notes(t))))
MERGED = ENTITY + ", source string"
query("merge_entities", MERGED, merged_sql("or_note_rules", "or_note_ml", "or_note_pairs"))(
    lambda t: X.merge_entities(*both_sides(t.notes))
)
query(
    "extract_merged_entities",
    MERGED,
    f"""select m.doc_id, type, text, start, "end", case when type = 'MEDICINE' then coalesce(dr.generic_name, m.normalized) else normalized end
        as normalized, confidence, source from ({merged_sql("or_doc_rules", "or_doc_ml", "or_doc_pairs")}) m
        left join {BRAND_SQL} on brand = lower(m.text) left join {DRUG_SQL} on dr.name = coalesce(generic, lower(m.text))
        where confidence >= 0.6""",
)(lambda t: X.extract_entities(doc_notes(t), annotations=moved(rule_rows(doc_notes(t)))))

# --- flags ----------------------------------------------------------------------------------------

query(
    "section_split",
    "doc_id bigint, line_no int, is_diagnosis_header boolean, is_rx_header boolean, has_medicine_prefix boolean",
    f"""select doc_id, i - 1 as line_no, regexp_matches(l[i], {q('(?i)' + P['diagnosis_header'])}) as is_diagnosis_header,
        regexp_matches(l[i], {q('(?i)' + P['rx_header'])}) as is_rx_header,
        regexp_matches(l[i], {q('(?i)' + P['medicine_prefix'])}) as has_medicine_prefix from (
        select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) as l
        from fx_notes))""",
)(lambda t: X.section_lines(t.notes.withColumn("text", F.replace("text", F.lit(". "), F.lit("\n")))))
FRAGMENTS = values([(w,) for w in dims.words(fixed.DISEASE_FRAGMENTS)], "fr(word)")
for name, source in (("disease_keyword_flags", "fx_notes"), ("disease_keyword_flags_documents", "documents")):
    query(
        name,
        "doc_id bigint, n_fragments int, mentions_disease boolean",
        f"""select d.doc_id, count(word) as n_fragments, count(word) > 0 as mentions_disease from {source} d
            left join {FRAGMENTS} on contains(lower(d.text), word) group by 1""",
    )(
        lambda t, source=source: X.disease_fragments(t.notes if source == "fx_notes" else t.spread(t.documents)).select(
            "doc_id", F.size("fragments").alias("n_fragments"), "mentions_disease"
        )
    )
RANGE_SQL = "(values " + ", ".join(
    "(" + ", ".join(["'" + r[0] + "'", "'" + r[1] + "'", *[v or "null" for v in r[2:7]]]) + ")" for r in dims.rows("LAB_RANGES", 8)
) + ") as lr(test, rsex, low, high, borderline, high_from, deficient)"
LAB_TESTS = "['blood_sugar_fasting', 'hba1c', 'tsh', 'hdl', 'creatinine', 'vitamin_d', 'systolic_bp']"
relation(
    "or_lab_values",
    f"""select e.id, {LAB_TESTS}[1 + e.id % 7] as test, lab_numeric_value / 2 as value, case when e.id % 2 = 0 then 'male'
        else 'female' end as sex from fx_entities e where lab_numeric_value is not null""",
)


def lab_values(t):
    tests = F.array(*[F.lit(x.strip(" '")) for x in LAB_TESTS.strip("[]").split(",")])
    return t.entities.filter("lab_numeric_value is not null").select(
        "id",
        F.get(tests, (F.col("id") % 7).cast("int")).alias("test"),
        (F.col("lab_numeric_value") / 2).alias("value"),
        F.when(F.col("id") % 2 == 0, "male").otherwise("female").alias("sex"),
    )


query(
    "lab_flags",
    "id bigint, test string, value double, flag string",
    f"""select id, v.test, value, case when value < deficient then 'deficient' when value < low then 'low'
        when value >= high_from and value > high then 'high' when value > high and borderline is not null then 'borderline'
        when value > high then 'high' else 'normal' end as flag from or_lab_values v join {RANGE_SQL}
        on lr.test = v.test and rsex in ('any', sex)""",
)(lambda t: X.lab_flags(lab_values(t)))

# --- recognised words -----------------------------------------------------------------------------

IOU_SQL = """(least(s.x_max, f.x_max) - greatest(s.x_min, f.x_min)) * (least(s.y_max, f.y_max) - greatest(s.y_min, f.y_min))"""
relation(
    "or_iou",
    f"""select s.doc_id, s.page, s.word_no as second_no, f.word_no as first_no, {IOU_SQL} / ((s.x_max - s.x_min) * (s.y_max - s.y_min)
        + (f.x_max - f.x_min) * (f.y_max - f.y_min) - {IOU_SQL}) as iou from fx_words s join fx_words f
        on f.doc_id = s.doc_id and f.page = s.page and s.engine = 'easyocr' and f.engine = 'tesseract'
        where s.x_min < f.x_max and s.x_max > f.x_min and s.y_min < f.y_max and s.y_max > f.y_min""",
)
query(
    "bbox_iou_join",
    "doc_id bigint, page int, second_no bigint, first_no bigint, iou double",
    "select doc_id, page, second_no, first_no, round(iou, 6) as iou from or_iou where iou >= 0.3",
)(lambda t: O.bbox_iou_join(t.words).withColumn("iou", F.round("iou", 6)))
query(
    "merge_ocr_words",
    "doc_id bigint, page int, word_no bigint, engine string, x_min double, confidence double",
    """with m as (select * from or_iou where iou >= 0.3),
       sides as (select doc_id, bool_or(engine = 'tesseract') as has_f, bool_or(engine = 'easyocr') as has_s from fx_words group by 1)
       select s.doc_id, s.page, s.word_no, case when s.confidence >= f.confidence then 'easyocr' else 'tesseract' end as engine,
         case when s.confidence >= f.confidence then s.x_min else f.x_min end as x_min,
         greatest(s.confidence, f.confidence) as confidence
       from m i join fx_words s on s.doc_id = i.doc_id and s.word_no = second_no and s.engine = 'easyocr'
       join fx_words f on f.doc_id = i.doc_id and f.word_no = first_no and f.engine = 'tesseract'
       union all
       select w.doc_id, w.page, word_no, case when has_f then 'easyocr_unmatched' else 'easyocr' end, x_min,
         case when has_f then confidence * 0.85 else confidence end
       from fx_words w join sides on sides.doc_id = w.doc_id left join m on m.doc_id = w.doc_id and second_no = word_no
       where engine = 'easyocr' and m.doc_id is null
       union all
       select w.doc_id, w.page, word_no, case when has_s then 'tesseract_unmatched' else 'tesseract' end, x_min, confidence
       from fx_words w join sides on sides.doc_id = w.doc_id left join m on m.doc_id = w.doc_id and first_no = word_no
       where engine = 'tesseract' and m.doc_id is null""",
)(lambda t: O.merge_ocr_words(t.words))
query(
    "document_confidence",
    "doc_id bigint, overall_confidence double",
    """select doc_id, round(case when sum(confidence) > 0 then least(1.0, sum(confidence * confidence) / sum(confidence))
       else 0 end + cast(1e-9 as double), 4) as overall_confidence from fx_words group by 1""",
)(lambda t: O.document_confidence(t.words).withColumn("overall_confidence", F.round(F.col("overall_confidence") + 1e-9, 4)))


def paged(t):
    """Words of both engines spread over three pages; those of the second engine stand behind the first's."""
    return t.words.withColumn("page", 1 + F.col("word_no") % 3)


relation(
    "or_pages",
    """select doc_id, 1 + word_no % 3 as page, string_agg(text, ' ' order by floor(y_min / 20), x_min, word_no) as raw_text,
       least(1.0, coalesce(sum(confidence * confidence) / nullif(sum(confidence), 0), 0.0)) as c from fx_words group by 1, 2""",
)
query(
    "reading_order_text",
    "doc_id bigint, page int, raw_text string",
    "select * from or_pages",
)(lambda t: O.reading_order_text(paged(t)))
query(
    "merge_pages",
    "doc_id bigint, raw_text string, overall_confidence double, page_count bigint",
    """select doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || raw_text, chr(10) || chr(10) order by page) as raw_text,
       round(avg(c), 3) as overall_confidence, count(*) as page_count from or_pages group by 1""",
)(
    lambda t: O.merge_pages(
        O.reading_order_text(paged(t)).join(
            O.document_confidence(paged(t), keys=("doc_id", "page")).withColumnRenamed("overall_confidence", "confidence"), ["doc_id", "page"]
        )
    )
)


def archived(t):
    heads = t.words.select(F.col("doc_id").alias("record_id")).distinct().withColumn("owner_id", F.col("record_id") % 100)
    return O.archive_ocr_result(t.words.withColumn("page", 1 + F.col("word_no") % 3), heads)


query(
    "archive_ocr_result",
    "record_id bigint, page int, engine string, word_no bigint, text string, x_min double, y_max double, confidence double",
    """select doc_id as record_id, 1 + word_no % 3 as page, engine, word_no, text, x_min, y_max, confidence from fx_words""",
)(lambda t: archived(t)["words"].withColumns({"x_min": F.col("bbox")[0], "y_max": F.col("bbox")[3]}))
query(
    "archive_ocr_heads",
    "record_id bigint, owner_id bigint, word_count bigint, page_count bigint",
    """select doc_id as record_id, doc_id % 100 as owner_id, count(*) as word_count, count(distinct word_no % 3) as page_count
       from fx_words group by 1""",
)(lambda t: archived(t)["heads"])


def nested_results(t):
    """Documents of the recognition archive as the original stores them: one words array per record."""
    word = F.struct("word_no", "engine", "page", "text", F.array("x_min", "y_min", "x_max", "y_max").alias("bbox"), "confidence")
    return t.words.groupBy(F.col("doc_id").alias("record_id")).agg(F.array_sort(F.collect_list(word)).alias("words"))


query(
    "ocr_words",
    "record_id bigint, page int, engine string, text string, x_min double, y_max double, confidence double",
    "select doc_id as record_id, page, engine, text, x_min, y_max, confidence from fx_words",
)(lambda t: O.ocr_words(nested_results(t)))

# --- the upload job as a whole ------------------------------------------------------------------------

# Every turn of a conversation with a prescription behind it, as two engines read it: forty words a page, eight a line; the
# second engine misses every fourth word and stands a little aside.
TURN_NOTE = (
    "concat(coalesce(text, ''), ' Dr. Asha Rao, at Apollo Hospital. Dx: gout and asthma. Tab Metforrn ', cast(1 + turn % 900 as string), "
    "' rnq bd for ', cast(1 + conv_id % 14 as string), ' days. BP: 130/85 mmHg. FBS: ', cast(70 + conv_id % 120 as string), "
    "' mg/dL. Date ', cast(1 + conv_id % 28 as string), '/', cast(1 + turn % 12 as string), '/2025. NKDA')"
)
relation(
    "or_job_words",
    f"""select doc_id, i, ws[i + 1] as w, 1 + i // 40 as page, cast((doc_id + i * 7) % 101 as double) / 100 as ct,
        case when i % 4 <> 3 then cast((doc_id + i * 11) % 101 as double) / 100 end as ce
        from (select doc_id, ws, unnest(range(len(ws))) as i from (
          select conv_id * 1000 + turn as doc_id,
            string_split(trim(regexp_replace({TURN_NOTE}, '\\s+', ' ', 'g')), ' ') as ws from conversations))""",
)
relation(
    "or_job_pages",
    """select doc_id, page, string_agg(w, ' ' order by i) as raw_text, sum(c * c) / sum(c) as confidence from (
         select *, case when ce >= ct then ce else ct end as c from or_job_words) group by 1, 2""",
)
relation(
    "or_job_raw",
    """select doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || raw_text, chr(10) || chr(10) order by page) as raw_text,
       round(avg(least(1.0, confidence)), 3) as confidence from or_job_pages group by 1""",
)
relation("or_job_texts", f"select doc_id, {fix_sql('raw_text')} as text from or_job_raw")
relation("or_job_entities", entities_sql("or_job_texts"))


def job_words(t):
    turns = t.spread(t.conversations)
    text = F.trim(F.regexp_replace(F.expr(TURN_NOTE), r"\s+", " "))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split(text, " ")).alias("i", "text"))
    i = F.col("i")
    engines = F.array(*[
        F.struct(F.lit(name).alias("engine"), F.lit(off).alias("off"), F.lit(mul).alias("mul"))
        for name, off, mul in ((O.FIRST, 0.0, 7), (O.SECOND, 6.0, 11))
    ])
    both = rows.select("doc_id", "i", "text", F.inline(engines)).filter((F.col("engine") == O.FIRST) | (i % 4 != 3))
    x, y = (i % 8) * 60 + F.col("off"), F.floor(i % 40 / 8) * 40 + F.col("off")
    return both.select(
        "doc_id", (1 + F.floor(i / 40)).cast("int").alias("page"), i.cast("bigint").alias("word_no"), "engine", "text",
        x.alias("x_min"), y.alias("y_min"), (x + 50).alias("x_max"), (y + 18).alias("y_max"),
        (((F.col("doc_id") + i * F.col("mul")) % 101).cast("double") / 100).alias("confidence"),
    )


def processed(t):
    """The job over pending records, half of them prescriptions, with rows of an earlier run and of other records."""
    ids = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    records = ids.select(
        "id", (F.col("id") % 100).alias("owner_id"), F.when(F.col("turn") % 2 == 0, "prescription").otherwise("lab_report").alias("record_type"),
        F.when(F.col("id") % 3 == 0, F.to_date(F.lit("2020-02-02"))).alias("record_date"), F.lit("pending").alias("extraction_status"),
        F.lit(None).cast("double").alias("confidence_score"),
    )
    waiting = records.withColumn("id", -F.col("id") - 1)
    old = ids.select(F.explode(F.array(F.col("id"), -F.col("id") - 1)).alias("record_id"))
    entities = old.select("record_id", F.lit("disease").alias("entity_type"), F.lit("earlier").alias("entity_value"), F.lit(0.5).alias("confidence"))
    prescriptions = old.select("record_id", F.lit("earlier").alias("diagnosis"))
    return J.process_documents(records.unionByName(waiting), job_words(t), entities, prescriptions, AS_OF)


STORED = ", ".join(q(w) for w in dims.words(fixed.STORED_ENTITY_TYPES))
query(
    "process_documents_entities",
    "record_id bigint, entity_type string, entity_value string, confidence double, start_index int, end_index int",
    f"""select doc_id as record_id, case when lower(type) in ({STORED}) then lower(type) else 'other' end as entity_type,
        text as entity_value, confidence, start as start_index, "end" as end_index from or_job_entities
        union all select -(conv_id * 1000 + turn) - 1, 'disease', 'earlier', 0.5, null, null from conversations""",
)(lambda t: processed(t)["entities"])
query(
    "process_documents_prescriptions",
    "record_id bigint, diagnosis string, prescription_date date, medicines string",
    f"""select doc_id as record_id, string_agg(distinct normalized, ', ' order by normalized) filter (type = 'DISEASE') as diagnosis,
        arg_min(case when type = 'DATE' then cast(normalized as date) end, ord) as prescription_date,
        coalesce(string_agg(normalized, ';' order by ord) filter (type = 'MEDICINE'), '') as medicines
        from or_job_entities where doc_id % 1000 % 2 = 0 group by 1
        union all select -(conv_id * 1000 + turn) - 1, 'earlier', null, null from conversations""",
)(lambda t: processed(t)["prescriptions"].withColumn("medicines", F.array_join(F.transform("medicines", lambda m: m["name"]), ";")))
query(
    "process_documents_records",
    "id bigint, extraction_status string, confidence_score double, record_date date, raw_ocr_text string",
    """select doc_id as id, 'done' as extraction_status, confidence as confidence_score, case when doc_id % 3 = 0 then date '2020-02-02'
         when doc_id % 1000 % 2 = 0 then d end as record_date, raw_text as raw_ocr_text
       from or_job_raw left join (select doc_id, arg_min(cast(normalized as date), ord) as d from or_job_entities where type = 'DATE' group by 1)
         using (doc_id)
       union all select -(conv_id * 1000 + turn) - 1, 'pending', null,
         case when (conv_id * 1000 + turn) % 3 = 0 then date '2020-02-02' end, null from conversations""",
)(lambda t: processed(t)["records"])
