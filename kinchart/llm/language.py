"""Language identification by error-correcting output codes.

Each language has a code word of bits; each bit has one binary n-gram classifier that predicts it.
A classifier is the log ratio of the n-gram frequencies of the languages whose bit is set and of
those whose bit is not, over hashed byte trigrams.  A text is given the language whose code word
loses least: the logistic loss of every bit is weighted by how reliably that bit is predicted for
that language.  Where the runner-up is close, the row is flagged as ambiguous.

The frequencies come from a sample of about ``max_rows`` labelled rows (drawn by a hash of text and row,
so copies are drawn one by one), summed in every task and then by key; the model is a table of n-grams by bits.

Defined cases: a null text and a text without a letter are ``und`` with score 0; rows without a
language teach nothing; with one language learned every text with a letter gets it; without any,
``und``.  Ties go to the first language in alphabetical order.  Repeated rows and extra columns
change nothing; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import map_batches, map_partitions, stored, texts_of

MAX_ROWS = 20_000
BUCKET_BITS = 13
BUCKETS = 2**BUCKET_BITS
_HASH_RANGE = 2**30
_AMBIGUOUS = 0.2

# ASCII letters in lower case, other ASCII signs as blanks, bytes of other letters as they are.
_FOLD = bytes(b if b >= 128 else (ord(chr(b).lower()) if chr(b).isalpha() else 32) for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return re.search(rb"[A-Za-z]", text) is not None or _LETTER.search(text.decode("utf-8", "replace")) is not None


def trigram_shares(text: bytes) -> np.ndarray:
    """Share of each hashed byte trigram; a blank stands before and after the text."""
    signs = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    codes = (signs[:-2] << np.uint32(16)) | (signs[1:-1] << np.uint32(8)) | signs[2:]
    codes = codes[codes != 0x202020]
    if not len(codes):
        return np.zeros(BUCKETS, np.float32)
    hashed = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return (np.bincount(hashed, minlength=BUCKETS) / len(codes)).astype(np.float32)


def code_words(n: int, seed: int = 7) -> np.ndarray:
    """Code words of n languages as rows of -1 and 1: all splits up to six, chosen random ones beyond."""
    if n < 2:  # nothing to tell apart
        return np.zeros((n, 0), np.float32)
    if n <= 6:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 2 ** max(n - 1, 0))]
        return np.array(splits, np.float32).reshape(-1, n).T
    draw = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(64):
        code = draw.choice(np.array([-1, 1], np.float32), (n, width))
        gap = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # n-grams by bits
    trust: np.ndarray  # languages by bits
    scale: np.ndarray  # per bit

    def margins(self, shares: np.ndarray) -> np.ndarray:
        return (shares @ self.weights) * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every text and language."""
        each = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (each * self.trust[None]).sum(2)


def _sums(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Sum of the trigram shares by language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS))
        for batch in batches:
            for language, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                if has_letter(t):
                    total[language] += trigram_shares(t)
        for language, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], ["lang", "bucket", "w"]
            )

    rows = map_partitions(docs.select(lang, text), run, "lang string, bucket int, w double")
    return rows.groupBy("lang", "bucket").agg(F.sum("w").alias("w"))


def train(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS
) -> Model:
    """The model of a bounded sample of the rows that ``learn`` admits."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    wanted = int(_HASH_RANGE * min(1.0, max_rows / max(1, docs.where(learn & F.col(lang).isNotNull()).count())))
    drawn = F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(_HASH_RANGE))
    sample = stored(known.where(drawn < wanted))
    sums = _sums(sample, text, lang).toPandas()
    languages = sorted(sums["lang"].unique())
    n = len(languages)
    share = np.zeros((n, BUCKETS))
    row = sums["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(np.int64)
    share[row, sums["bucket"].to_numpy(np.int64)] = sums["w"].to_numpy(float)
    share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
    code = code_words(n)
    on, off = (code.T == 1).astype(float), (code.T == -1).astype(float)
    smooth = 0.05 / BUCKETS
    up = on @ share / np.maximum(on.sum(1, keepdims=True), 1)
    down = off @ share / np.maximum(off.sum(1, keepdims=True), 1)
    weights = (np.log(up + smooth) - np.log(down + smooth)).T.astype(np.float32)
    bits = code.shape[1]
    model = Model(languages, code, weights, np.full((n, bits), 1 / max(bits, 1)), np.ones(bits, np.float32))
    if n < 2:
        return model
    # how often each bit is right, and how far from zero it is, for each language
    bit_columns = [F.avg((F.col("margin")[b] * F.col("sign")[b] > 0).cast("double")).alias(f"right{b}") for b in range(bits)]
    size_columns = [F.avg(F.abs(F.col("margin")[b])).alias(f"size{b}") for b in range(bits)]
    judged = _margins(sample, model, text, lang).groupBy("lang").agg(*bit_columns, *size_columns).toPandas()
    judged = judged.set_index("lang").reindex(languages)
    right = judged[[f"right{b}" for b in range(bits)]].fillna(0.5).to_numpy()
    size = judged[[f"size{b}" for b in range(bits)]].fillna(1.0).to_numpy().mean(0)
    trust = np.maximum(right, 1e-3)
    model.trust = trust / trust.sum(1, keepdims=True)
    model.scale = (4 / np.maximum(size, 1e-6)).astype(np.float32)
    return model


def _margins(sample: DataFrame, model: Model, text: str, lang: str) -> DataFrame:
    row = {v: i for i, v in enumerate(model.languages)}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(v, t) for v, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) if v in row and has_letter(t)]
        shares = np.array([trigram_shares(t) for _, t in pairs], np.float32).reshape(-1, BUCKETS)
        margin = model.margins(shares).astype(np.float64)
        sign = model.code[[row[v] for v, _ in pairs]].astype(np.float64).reshape(-1, model.code.shape[1])
        kind = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array([v for v, _ in pairs], pa.string()), pa.array(list(margin), kind), pa.array(list(sign), kind)],
            ["lang", "margin", "sign"],
        )

    return map_batches(sample.select(lang, text), each, "lang string, margin array<double>, sign array<double>")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``lang_pred``, ``score`` and ``ambiguous``."""
    new_names = ["lang_pred", "score", "ambiguous"]
    rest = [c for c in docs.columns if c not in (text, *new_names)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]
    names = np.array([*model.languages, "und"], dtype=object)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(len(rest)))
        n = len(texts)
        best, chance, close = np.full(n, len(model.languages)), np.zeros(n), np.zeros(n, bool)
        at = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64)
        if len(at) and model.languages:
            shares = np.array([trigram_shares(texts[i]) for i in at], np.float32)
            p = np.exp(-model.losses(model.margins(shares)))
            p /= p.sum(1, keepdims=True)
            order = np.sort(p, 1)
            best[at], chance[at] = p.argmax(1), order[:, -1]
            if len(model.languages) > 1:
                close[at] = order[:, -1] - order[:, -2] < _AMBIGUOUS
        new = [pa.array(names[best], pa.string()), pa.array(chance), pa.array(close)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, *new_names])

    out = ", ".join([*fields, "lang_pred string, score double, ambiguous boolean"])
    return map_batches(docs.select(*rest, text), each, out)
