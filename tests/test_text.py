"""Text operators against plain Python on small inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kinchart.functions import dates as D
from kinchart.functions import spans as SP
from kinchart.functions import sweep
from kinchart.functions.islands import with_islands
from kinchart.operators import extract as X
from kinchart.operators import limits as L
from kinchart.operators import normalize as N
from kinchart.operators import ocr as O
from kinchart.sources import dimensions as dims
from kinchart.sources import fixed_values as fixed

SAMPLES = [
    "",
    "Tab Metformin 500mg BD for 7 days, Glycomet 2.5 mcg od × 10 days x 2 weeks. HbA1c: 7.2% TSH-4.5 mIU/L",
    "insulin glargine 10 IU HS; Pan 40 mg before meals. BP: 130/80 mmHg, Blood Pressure = 120 / 70. Dr. Asha Rao Mehta, MD",
    "type 2 diabetes mellitus and diabetes; vitamin b12 deficiency, vitamin d3 vitamin b12. covid-19 uti. thyroxines",
    "Größe 5 mg für ihn – 3 µg/dL. Allergic to Penicillin, dust\nNKDA. diabetes",
    "diabetes mellitus type 1 diabetes mellitus, hepatitis b, hepatitis bc, ADHD! omega 3",
    "Seen at Apollo Hospital and City Care Clinic on 12/06/2025; The Max Healthcare, 3hospital x_hospital hospital.",
    "hospital",
    "Prof. Dr. Ravi Kumar, Jane Doe, PhD fibre 5 g stat daily once  daily allergy to  : ",
]


def texts(spark, more=()):
    rows = list(enumerate([*SAMPLES, *more]))
    return spark.createDataFrame(rows, "doc_id int, text string")


def documents(spark, n=25):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n)
    return [r["text"] for r in df.collect()]


def python_pattern(name):
    return re.compile(dict(dims.rows("PATTERNS", 2))[name], re.IGNORECASE)


@pytest.mark.parametrize(
    "name, find",
    [
        ("dosage", X.find_dosages),
        ("frequency", X.find_frequencies),
        ("duration", X.find_durations),
        ("lab_value", X.find_lab_values),
        ("blood_pressure", X.find_blood_pressure),
        ("allergy", X.find_allergies),
    ],
)
def test_pattern_spans_equal_finditer(spark, name, find):
    more = documents(spark)
    df = texts(spark, more).select("doc_id", find(F.col("text")).alias("entities"))
    got = {}
    for r in df.collect():
        got[r["doc_id"]] = [(e["start"], e["end"], e["text"]) for e in r["entities"]]
    for i, text in enumerate([*SAMPLES, *more]):
        want = [(m.start(), m.end(), m.group(0)) for m in python_pattern(name).finditer(text)]
        assert got[i] == want, (i, text[:80])


def test_doctor_spans_equal_finditer(spark):
    pattern = re.compile("|".join(r[0] for r in dims.rows("DOCTOR_FORMS", 1)), re.IGNORECASE)
    df = texts(spark).select("doc_id", X.find_doctors(F.col("text")).alias("entities")).orderBy("doc_id")
    for r, text in zip(df.collect(), SAMPLES):
        assert [(e["start"], e["text"]) for e in r["entities"]] == [(m.start(), m.group(0)) for m in pattern.finditer(text)]


def test_hospital_spans_equal_the_single_expression(spark):
    words = dims.words(fixed.HOSPITAL_WORDS)
    pattern = re.compile(r"(?:[A-Z][a-zA-Z\s]+)?\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    more = [t[:3000] for t in documents(spark, 10)] + ["a clinic b. Clinic; the old city hospital clinic then home, 9 aster x"]
    df = texts(spark, more).select("doc_id", X.find_hospitals(F.col("text")).alias("entities")).orderBy("doc_id")
    for r, text in zip(df.collect(), [*SAMPLES, *more]):
        want = [(m.start(), m.group(0)) for m in pattern.finditer(text)]
        assert [(e["start"], e["text"]) for e in r["entities"]] == want, text[:100]


def greedy_vocabulary(text, names):
    lower = text.lower()
    taken, out = [], []
    for name in sorted(names, key=lambda n: (-len(n), n)):
        for m in re.finditer(f"(?={re.escape(name)})", lower):
            s, e = m.start(), m.start() + len(name)
            if (s and lower[s - 1].isalpha()) or (e < len(lower) and lower[e].isalpha()):
                continue
            if not any(s < b and e > a for a, b in taken):
                taken.append((s, e))
                out.append((s, e))
    return out


@pytest.mark.parametrize("names, find", [(X.DRUG_NAMES, X.find_drugs), (X.DISEASE_NAMES, X.find_diseases)])
def test_vocabulary_spans_equal_brute_force(spark, names, find):
    draw = random.Random(5)
    glue = [" ", ", ", "-", "1", " of ", "\n"]
    more = ["".join(draw.choice(names) + draw.choice(glue) for _ in range(30)) for _ in range(8)] + documents(spark, 8)
    df = texts(spark, more).select("doc_id", find(F.col("text")).alias("entities")).orderBy("doc_id")
    for r, text in zip(df.collect(), [*SAMPLES, *more]):
        assert [(e["start"], e["end"]) for e in r["entities"]] == greedy_vocabulary(text, names)


def test_longest_first_is_global(spark):
    """With "a b" and "b c d" the text "a b c d" keeps the longer one, and a shorter start survives."""
    df = spark.createDataFrame([("a b c d a",)], "text string")
    spans = df.select(SP.vocabulary_spans(F.col("text"), ("a b", "b c d", "a")).alias("s")).first()["s"]
    assert [(s["start"], s["text"]) for s in spans] == [(2, "b c d"), (0, "a"), (8, "a")]


def test_dates(spark):
    cases = {
        "12/06/2025": "2025-06-12",
        "25/13/2025": None,
        "06/25/2025": "2025-06-25",
        "1.2.49": "2049-02-01",
        "1-2-50": "1950-02-01",
        "12th June 2025": "2025-06-12",
        "June 12, 2025": "2025-06-12",
        "45/12/12": "0045-12-12",
        "2024-02-30": None,
        "31 Feb 2024": None,
        "20240709": "2024-07-09",
        "9-Jul-24": "2024-07-09",
        "soon": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", F.date_format(D.normalize_date(F.col("t")), "yyyy-MM-dd").alias("d")).collect()}
    assert got == cases


def test_relative_dates_do_not_overflow(spark):
    df = spark.createDataFrame([("after 99999999999 days",), ("in 1 months",), ("within 2 years",)], "t string")
    far = spark.createDataFrame([("after 7900 years",), ("after 7999 years",), ("within 2920000 days",)], "t string")
    assert [str(r[0]) for r in far.select(D.relative_date(F.col("t"), "2001-08-02")).collect()] == ["9901-08-02", "None", "9996-04-10"]
    got = [str(r[0]) for r in df.select(D.relative_date(F.col("t"), "2024-01-31")).collect()]
    assert got == ["None", "2024-02-29", "2026-01-31"]


def test_normalization_cascade(spark):
    df = spark.createDataFrame([("Diabetes",), ("hypertensoin",), ("severe asthma attack",), ("zzz",), ("",)], "t string")
    got = [tuple(r["n"]) for r in df.select(N.normalize_disease(F.col("t")).alias("n")).collect()]
    assert got[0] == ("Diabetes", "E11", 1.0, "exact")
    assert got[2] == ("Asthma", "J45.9", 0.7, "prefix")
    assert got[3] == ("Zzz", "", 0.4, "none")
    assert got[4] == ("", "", 0.0, "none")
    drugs = spark.createDataFrame([("synjardy",), ("Metformim",), ("thyrox",)], "t string")
    got = [tuple(r["n"]) for r in drugs.select(N.normalize_medicine(F.col("t")).alias("n")).collect()]
    assert got[0] == ("Empagliflozin+Metformin", "", "", 0.95, "brand")
    assert got[1][0] == "Metformin" and got[1][4] == "fuzzy"
    assert got[2][:2] == ("Levothyroxine", "H03AA01")


def test_fix_ocr_text(spark):
    df = spark.createDataFrame([("Metforrn 5 rnq bd 3 . 5 1,250 O5 0 mg lU",)], "t string")
    assert df.select(X.fix_ocr_text(F.col("t"))).first()[0] == "Metformin 5 mg BD 3.5 1250 05 O mg IU"


def overlap(a, b):
    shared = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    shorter = min(a[1] - a[0], b[1] - b[0])
    return shared / shorter if shorter > 0 else 0.0


def test_greedy_span_matching_equals_brute_force(spark):
    draw = random.Random(3)
    rules, ml = [], []
    for doc in range(6):
        for side in (rules, ml):
            for i in range(40):
                s = draw.randrange(0, 900)
                side.append((doc, i, s, s + draw.randrange(1, 25), 0.7 + draw.randrange(0, 30) / 100))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, ord int, start int, end int, confidence double")
    got = {
        (r["doc_id"], r["rule_ord"], r["ml_ord"])
        for r in X.span_overlap_join(frame(rules), frame(ml)).collect()
    }
    want, merged = set(), []
    for doc in range(6):
        used = set()
        items = [m for m in ml if m[0] == doc]
        for r in [r for r in rules if r[0] == doc]:
            best, at = 0.0, None
            for m in items:
                v = overlap(r[2:4], m[2:4])
                if m[1] not in used and v > best:
                    best, at = v, m
            if at is not None and best > 0.3:
                used.add(at[1])
                want.add((doc, r[1], at[1]))
                conf = round(0.4 * r[4] + 0.6 * at[4], 3) if at[4] > 0.85 else r[4]
                merged.append((doc, at[2] if at[4] > 0.85 else r[2], round(conf, 6)))
            else:
                merged.append((doc, r[2], round(r[4], 6)))
        merged += [(doc, m[2], round(m[4] * 0.85, 6)) for m in items if m[1] not in used]
    assert got == want
    rows = X.merge_entities(frame(rules), frame(ml)).select("doc_id", "start", F.round("confidence", 6)).collect()
    assert sorted(map(tuple, rows)) == sorted(merged)


def test_one_sided_documents_stay_untouched(spark):
    schema = "doc_id int, ord int, start int, end int, confidence double"
    rules = spark.createDataFrame([(1, 0, 0, 5, 0.9)], schema)
    ml = spark.createDataFrame([(2, 0, 0, 5, 0.8)], schema)
    got = sorted(tuple(r) for r in X.merge_entities(rules, ml).select("doc_id", "confidence").collect())
    assert got == [(1, 0.9), (2, 0.8)]


def test_box_matching_equals_brute_force(spark):
    draw = random.Random(9)
    words = []
    for page in range(4):
        for engine in ("tesseract", "easyocr"):
            for i in range(30):
                x, y = draw.randrange(0, 300), draw.randrange(0, 120)
                words.append(("d", page, i, engine, f"w{i}", float(x), float(y), float(x + draw.randrange(5, 60)), float(y + draw.randrange(5, 20)), draw.random()))
    df = spark.createDataFrame(
        words, "doc_id string, page int, word_no int, engine string, text string, x_min double, y_min double, x_max double, y_max double, confidence double"
    )
    got = {(r["page"], r["second_no"], r["first_no"]) for r in O.bbox_iou_join(df, width=40.0).collect()}

    def iou(a, b):
        w = max(0.0, min(a[7], b[7]) - max(a[5], b[5]))
        h = max(0.0, min(a[8], b[8]) - max(a[6], b[6]))
        area = lambda c: (c[7] - c[5]) * (c[8] - c[6])
        return w * h / (area(a) + area(b) - w * h)

    want = set()
    for page in range(4):
        used = set()
        first = [w for w in words if w[1] == page and w[3] == "tesseract"]
        for e in [w for w in words if w[1] == page and w[3] == "easyocr"]:
            best, at = 0.0, None
            for f in first:
                if f[2] not in used and iou(e, f) > best:
                    best, at = iou(e, f), f
            if at is not None and best >= 0.3:
                used.add(at[2])
                want.add((page, e[2], at[2]))
    assert got == want
    assert O.merge_ocr_words(df).count() == len(words) - len(want)


def test_islands_over_bucket_borders(spark):
    rows = [(0, 0, 25), (0, 3, 4), (0, 12, 13), (0, 24, 31), (0, 31, 32), (0, 45, 46), (1, 5, 6)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = {(r["k"], r["a"]): r["island"] for r in with_islands(df, ["k"], "a", "b", 10, "island").collect()}
    assert got == {(0, 0): 0, (0, 3): 0, (0, 12): 0, (0, 24): 0, (0, 31): 31, (0, 45): 45, (1, 5): 5}


def test_anchored_windows_equal_a_sequential_pass(spark):
    draw = random.Random(1)
    events = []
    for key in ("a", "b", "c"):
        at = 0.0
        for i in range(300):
            at += draw.choice([0.0, 1.0, 5.0, 20.0, 70.0, 300.0])
            events.append((key, f"{i:04d}", 1704067200.0 + at))
    df = spark.createDataFrame(events, "key string, id string, s double").select(
        "key", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("ts")
    )
    got = {
        (r["key"], r["id"]): r["w"]
        for r in L.anchored_windows(df, 60, 150).select("key", "id", (F.unix_micros("window_start") / 1e6).alias("w")).collect()
    }
    want = {}
    for key in ("a", "b", "c"):
        start = None
        for _, ident, s in [e for e in events if e[0] == key]:
            if start is None or s >= start + 60:
                start = s
            want[key, ident] = start
    assert got == want


def test_nearest_following_is_bounded(spark):
    a = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 50, 60), (2, 0, 0, 5)], "doc_id int, ord int, start int, end int")
    b = spark.createDataFrame([(1, 10, "x"), (1, 160, "y"), (1, 161, "z"), (2, 106, "far")], "doc_id int, start int, text string")
    got = sorted((r["doc_id"], r["ord"], r["target_text"]) for r in X.nearest_following(a, b, 100).collect())
    assert got == [(1, 0, "x"), (1, 1, "y"), (2, 0, None)]


def test_diagnosis_is_cut_and_notes_are_built(spark):
    text = "Allergic to Penicillin. Dx: gout, asthma. TSH: 4.5 mIU/L seen 12 June 2024. Review after 2 weeks"
    docs = X.extract_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    row = X.prescription_rows(X.structured_prescription(docs, "2024-06-12")).first()
    assert row["diagnosis"] == "Asthma, Gout"
    assert row["notes"] == "Allergies: Penicillin\nLab observations: TSH=4.5mIU/L"
    assert str(row["prescription_date"]) == "2024-06-12" and str(row["follow_up"]) == "2024-06-26"


def sequential_windows(events, span):
    start, out = {}, {}
    for key, ident, at in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if key not in start or at >= start[key] + span:
            start[key] = at
        out[key, ident] = start[key]
    return out


@pytest.mark.parametrize("fan", [2, 3, 60])
def test_windows_of_a_hot_key_over_many_levels(spark, fan):
    """One key has half of the events, dense and with gaps of many windows."""
    draw = random.Random(fan)
    events, at = [], 0
    for i in range(6000):
        at += draw.choice([0, 0, 1, 1, 2, 3, 7] if i % 500 else [4000])
        events.append(("hot" if i % 2 else f"k{draw.randrange(300)}", i, at))
    events += [("edge", 10_000 + i, 60 * i) for i in range(50)] + [("twice", 20_000 + i, 5) for i in range(3)]
    df = spark.createDataFrame(events, "key string, id long, s long").select("key", "id", F.timestamp_seconds("s").alias("ts"))
    rows = L.anchored_windows(df, 60, fan).select("key", "id", F.unix_seconds("window_start").alias("w")).collect()
    assert len(rows) == len(events)
    assert {(r["key"], r["id"]): r["w"] for r in rows} == sequential_windows(events, 60)
    found = {(r["key"], r["id"]) for r in L.violations(df, limit=5, seconds=60, fan=fan).collect()}
    count, want = {}, set()
    windows = sequential_windows(events, 60)
    for key, ident, at in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        w = key, windows[key, ident]
        count[w] = count.get(w, 0) + 1
        if count[w] > 5:
            want.add((key, ident))
    assert found == want


def test_windows_without_events(spark):
    assert L.violations(spark.createDataFrame([], "key string, id long, ts timestamp")).collect() == []


def plain_greedy(left, right, value, fits):
    taken, out = set(), []
    for a in left:
        best, at = None, -1
        for i, b in enumerate(right):
            v = value(a, b)
            if i not in taken and (best is None or v > best):
                best, at = v, i
        if at >= 0 and fits(best):
            taken.add(at)
            out.append(at)
        else:
            out.append(-1)
    return out


def test_sweeps_equal_plain_greedy_matching():
    draw = random.Random(17)
    for size, reach in ((5, 20), (60, 100), (200, 60)):
        spans = lambda n: [(s, s + draw.randrange(0, 15)) for s in (draw.randrange(reach) for _ in range(n))]
        for _ in range(20):
            left, right = spans(size), spans(size)
            partner, affinity, taken = sweep.greedy(left, right, 0.3)
            assert partner == plain_greedy(left, right, lambda a, b: sweep.overlap(*a, *b), lambda v: v > 0.3)
            assert [i for i, t in enumerate(taken) if t] == sorted(p for p in partner if p >= 0)
            boxes = lambda: [(float(a), float(c), float(b), float(d)) for (a, b), (c, d) in zip(spans(size), spans(size))]
            left, right = boxes(), boxes()
            partner = sweep.greedy_boxes(left, right, 0.3)[0]
            assert partner == plain_greedy(left, right, sweep.box_overlap, lambda v: v >= 0.3)


def test_very_many_boxes_on_one_spot(spark):
    """A pile of boxes is one island; every one of the second engine still finds a partner."""
    n = 4000
    rows = spark.range(2 * n).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % n).alias("word_no"),
        F.when(F.col("id") < n, O.FIRST).otherwise(O.SECOND).alias("engine"), F.lit("w").alias("text"), F.lit(0.9).alias("confidence"),
        *[F.lit(float(v)).alias(c) for c, v in (("x_min", 5), ("y_min", 5), ("x_max", 50), ("y_max", 20))],
    )
    got = O.bbox_iou_join(rows).agg(F.count("*"), F.count_if(F.col("second_no") == F.col("first_no")), F.min("iou")).first()
    assert tuple(got) == (n, n, 1.0)


def test_spans_of_long_texts_take_time_in_proportion(spark):
    """Twice the text, with its doses, names, dates and diseases, takes about twice the time."""
    line = "Tab metformin 500mg BD for 5 days, type 2 diabetes mellitus on 12/06/2024 and 3rd May 2024 at Apollo Hospital. "

    def seconds(n):
        docs = spark.createDataFrame([(1, line * n)], "doc_id int, text string")
        began = time.perf_counter()
        rows = X.extract_entities(docs).groupBy("type").count().collect()
        return time.perf_counter() - began, {r["type"]: r["count"] for r in rows}

    seconds(10)
    (half, few), (whole, many) = seconds(3500), seconds(7000)
    assert few["MEDICINE"] == few["DOSAGE"] == few["DISEASE"] == few["HOSPITAL"] == 3500 and few["DATE"] == 7000
    assert many == {k: 2 * n for k, n in few.items()}
    assert whole < 3 * half


def test_vocabulary_hits_inside_clusters(spark):
    """Longer hits win over those that overlap them, also in chains; the order is by length, name and place."""
    names = ("heart", "heart disease", "disease of heart", "disease")
    text = "Heart disease of heart, heart. disease of heart disease; HEART"
    got = spark.createDataFrame([(text,)], "t string").select(SP.vocabulary_spans(F.col("t"), names).alias("s")).first()["s"]
    hits = [(m.start(), m.end(), n) for n in names for m in re.finditer(rf"(?i)(?<![^\W\d_])(?={n}(?![^\W\d_]))", text)]
    hits = sorted(((s, s + len(n), n) for s, _, n in hits), key=lambda h: (-len(h[2]), h[2], h[0]))
    want = []
    for s, e, _ in hits:
        if not any(s < b and a < e for a, b in want):
            want.append((s, e))
    assert [(s["start"], s["end"]) for s in got] == want
