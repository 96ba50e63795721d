"""Vector codes, fill-in-middle and repeated strings against plain versions, and their defined cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinchart.llm import middles, queries, repeats, vector_codes
from tests.llm.test_texts import ROWS, SCHEMA

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# --- vector codes ----------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label) and all components of the codebooks, by exact loops over differences."""
    kept = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [(k, [math.floor(x * 1024) for x in v] + [0] * (parts * size - len(v)), label) for k, v, label in kept]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * size : (p + 1) * size] for r in first] for p in range(parts)]

    def assigned(p):
        points = np.array([r[1][p * size : (p + 1) * size] for r in whole], object).reshape(len(whole), size)
        book = np.array(books[p], object).reshape(len(first), size)
        apart = [((points - e) ** 2).sum(1) if size else np.zeros(len(whole), object) for e in book]
        return [min((apart[e][i], e) for e in range(len(first))) for i in range(len(whole))]

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for (_, e), r in zip(assigned(p), whole):
                groups.setdefault(e, []).append(r[1][p * size : (p + 1) * size])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = [assigned(p) for p in range(parts)]
    out = [
        (r[0], "".join(f"{found[p][i][1]:02x}" for p in range(parts)), min(sum(found[p][i][0] for p in range(parts)), 2**63 - 1), r[2])
        for i, r in enumerate(whole)
    ]
    return out, ",".join(str(x) for p in books for e in p for x in e)


def check_codes(spark, rows, schema="vec_id long, embedding array<double>, label int", **given):
    want, books = plain_codes(rows, **given)
    sums = Counter()
    for _, _, error, label in want:
        sums[label] += error
    digest = hashlib.sha256(books.encode()).hexdigest()
    df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
    got = vector_codes.vector_codes(df, **given).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"], r["label_error"]) for r in got), key=key) == sorted(
        ((k, c, e, label, min(sums[label], 2**63 - 1)) for k, c, e, label in want), key=key
    )
    assert {r["codebooks_sha256"] for r in got} <= {digest}


def test_codes_equal_plain_codes(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.table(spark, FOLDER, "embeddings").collect()]
    want, books = plain_codes(rows)
    sums = Counter()
    for _, _, error, label in want:
        sums[label] += error
    got = {r["vec_id"]: r for r in queries.op11_vector_codes(spark, FOLDER).collect()}
    assert len(got) == len(want)
    for k, code, error, label in want:
        assert (got[k]["code"], got[k]["error"], got[k]["label_error"]) == (code, error, sums[label])
        assert got[k]["codebooks_sha256"] == hashlib.sha256(books.encode()).hexdigest()


def test_codes_of_odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), draw.normal(size=6).round(1).tolist(), int(i) % 3) for i in range(40)]
    rows += [(1, None, 1), (2, [1.0, None], 1), (3, [math.nan] * 6, 1), (4, [math.inf] * 6, 2), (5, [], None), (5, [0.5], None)]
    rows += [(None, [1.0] * 6, None), (7, rows[7][1], 1), (7, rows[7][1], 1), (41, [-0.0004] * 6, 2)]
    check_codes(spark, rows, entries=16)
    check_codes(spark, rows, parts=3, entries=5, rounds=2)
    check_codes(spark, rows + [(50, [3e6] * 6, 1), (51, [1e15, -1e15], 1)], entries=8)  # 64 bits, then unbounded numbers
    check_codes(spark, [(1, [], 1), (2, [], 2)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string")
    assert vector_codes.vector_codes(empty).collect() == []


def test_transform_keeps_distances_in_sequency_order():
    rows = np.random.default_rng(1).integers(-50, 50, (20, 11))
    out = vector_codes.walsh(rows, 16)
    assert ((out[:, None] - out[None]) ** 2).sum(2).tolist() == (16 * ((rows[:, None] - rows[None]) ** 2).sum(2)).tolist()
    signs = vector_codes.walsh(np.eye(16, dtype=np.int64), 16).T
    assert [(np.diff(np.sign(s)) != 0).sum() for s in signs] == list(range(16))


# --- fill-in-middle --------------------------------------------------------------------------------


def test_middles_round_trip_over_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, FOLDER, "documents").collect()}
    forms = Counter()
    for r in queries.op12_fill_middle(spark, FOLDER).collect():
        text = texts[r["doc_id"]]
        forms[r["form"]] += 1
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n"] == len(text)
        h = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        h1, h2 = int(h[:8], 16) % (len(text) + 1), int(h[8:16], 16) % (len(text) + 1)
        if r["form"] == "plain":
            assert r["prefix_chars"] is None and r["output_sha256"] == r["restored_sha256"]
            continue
        a, b = sorted((h1, h2))
        assert (r["prefix_chars"], r["middle_chars"]) == (a, b - a)
        parts = ["<S>" + text[b:], "<P>" + text[:a]] if r["form"] == "spm" else ["<P>" + text[:a], "<S>" + text[b:]]
        assert r["output_sha256"] == hashlib.sha256(("".join(parts) + "<M>" + text[a:b]).encode()).hexdigest()
    assert forms["psm"] > 3 * forms["spm"] > 3 * forms["plain"] / 2 > 0


def test_middles_of_odd_rows(spark):
    more = [(8, "holds <P> a marker", "a", 1, "b", "c", 2), (9, "<", "a", 1, "b", "c", 2), (10, "<S" * 40, "a", 1, "b", "c", 2)]
    df = spark.createDataFrame(ROWS + more, SCHEMA).withColumn("form", F.lit(1)).withColumn("n", F.lit(2))
    for unit in middles.UNITS:
        for form in (middles.Form(cut_percent=100), middles.Form(cut_percent=100, suffix_first_percent=100), middles.Form(seed=3)):
            out = middles.fill_in_middle(df, unit=unit, form=form)
            rows = out.withColumn("back", middles.restored(F.col("output"), F.col("form"), form)).collect()
            assert len(rows) == len(ROWS) + len(more)
            for r in rows:
                assert r["back"] == (r["text"] or "") and r["x"] in (2, None)
                assert (r["form"] == "plain") == (r["prefix_units"] is None)
                assert r["n"] == (len(r["text"] or "") if unit == "character" else len((r["text"] or "").split()))
                if not r["text"] or "<P>" in r["text"]:
                    assert r["form"] == "plain"
    assert middles.fill_in_middle(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        middles.Form("<a", "a>", "b")


def test_ranks_and_cuts_equal_counting():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 4, 1000).astype(np.uint8)
    matrix = middles.WaveletMatrix(symbols)
    start = draw.integers(0, 500, 300)
    end = start + draw.integers(0, 500, 300)
    for c in range(4):
        assert matrix.rank(c, start, end).tolist() == [int((symbols[a:b] == c).sum()) for a, b in zip(start, end)]
    words = matrix.rank(middles.WORD_START, start, end)
    places = middles.cuts(matrix, "word", start, end, words // 2)
    for a, b, n, at in zip(start, end, words // 2, places):
        assert (symbols[a:at] == middles.WORD_START).sum() == n
        assert at == b or symbols[at] == middles.WORD_START


# --- repeated strings ------------------------------------------------------------------------------


def plain_repeats(texts, length):
    """Per text (n_bytes, n_removed, n_spans, kept): every string of the length as text, counted over all."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not b for g, b in zip(gone, [0, *gone]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_repeats_equal_plain_repeats(spark):
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in queries.table(spark, SMALL, "documents").collect())
    want = plain_repeats([t for _, t in rows], 400)
    got = {r["doc_id"]: r for r in queries.op13_sampled_suffixes(spark, SMALL).collect()}
    assert len(got) == len(rows) and any(w[1] for w in want)
    for (i, _), (n, removed, spans, kept) in zip(rows, want):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("length,window,alphabet", [(24, 16, "ab"), (24, 3, "abcdefgh"), (40, 16, "aé"), (9, 2, "ab"), (30, 20, "abcd")])
def test_repeats_of_random_texts(spark, length, window, alphabet):
    """Passages of all sizes around the length, in changing surroundings, overlapping, and runs of one letter."""
    draw = np.random.default_rng(length * window)

    def some(n):
        return "".join(draw.choice(list(alphabet), n)) if n else ""

    shared = [some(n) for n in range(length - 3, length + 2 * window + 2)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(draw.integers(0, 5)):
            parts += [some(draw.integers(0, 30)), shared[draw.integers(0, len(shared))][draw.integers(0, 4) :]]
        texts.append("".join(parts))
    texts += ["a" * 200, "a" * (length + 1), "a" * length, "a" * (length - 1), "ab" * 100, "", texts[3], texts[3]]
    rows = [(i % 100, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[5]), (5, texts[5])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, k string")
    got = repeats.without_repeats(df, length=length, window=window).collect()
    want = plain_repeats([(t or "").encode() for _, t in rows], length)
    told = [
        (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept_bytes"]), r["k"]) for r in got
    ]
    assert sorted(told) == sorted((*w, "x") for w in want)


def test_repeats_of_long_and_no_texts(spark):
    draw = np.random.default_rng(9)
    long = bytes(draw.integers(97, 123, 3 * repeats.BLOCK // 2, np.uint8)).decode()
    at = repeats.BLOCK - 300
    df = spark.createDataFrame([(1, long), (2, "z" + long[at : at + 700] + "z"), (3, long[:399])], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in repeats.without_repeats(df).collect()}
    assert got == {1: [(at, at + 700)], 2: [(1, 701)], 3: []}
    assert repeats.without_repeats(df.limit(0)).collect() == []
