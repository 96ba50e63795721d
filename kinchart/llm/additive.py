"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins.  Boosting goes round the features: each turn fits one shallow tree
to the gradient, over the bins of one feature, and adds its leaves to that feature's lookup table;
pairs of features that explain what is left get tables of their own.  A score is the sum of one
entry per table, so a batch of texts is scored by a few vectorised additions.

The features of all texts come from one pass over Arrow batches.  The model is fitted on a bounded
sample of labelled rows (``max_rows``, taken by a hash of the id); its size does not depend on the data.

Defined cases: a null or empty text has the features of no words and gets a score like any other; a
label given several times counts once (the highest value); null labels and ids teach nothing; without
labels of both kinds every score is the share of good labels (0.5 without any).  Extra columns are
left alone, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import map_batches, texts_of, word_ids

FEATURES = (
    "words", "word_length", "distinct_words", "same_as_before", "upper", "digits", "symbols", "exclamations",
    "stops", "commas", "words_per_line", "repeated_lines", "short_words", "top_word", "bare_signs", "wide_bytes",
    "sign_entropy",
)
MAX_ROWS = 20_000
_HASH_RANGE = 2**30


def _marks(signs: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(signs, np.uint8)] = 1
    return out


_CLASSES = np.stack(
    [
        _marks(bytes(range(65, 91))),
        _marks(b"0123456789"),
        _marks(b"#*$%&|<>@^~_={}[]\\/+"),
        _marks(b"!?"),
        _marks(b"."),
        _marks(b",;:"),
        _marks(bytes(range(128, 256))),
    ]
)


def features(text: bytes) -> list[float]:
    """The numbers in ``FEATURES`` of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    signs = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, symbols, loud, stops, commas, wide = _CLASSES @ signs
    size = float(len(text))
    ids = word_ids(words)
    often = np.bincount(ids)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = signs[signs > 0] / size
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        len(often) / n,
        float(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        upper / size,
        digits / size,
        symbols / size,
        loud / size,
        stops / n,
        commas / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        float(np.count_nonzero(lengths <= 3)) / n,
        float(often.max()) / n,
        sum(not w.isalnum() for w in set(words)) / len(often),
        wide / size,
        float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        logit = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            logit += table[at[j]]
        for j, k, table in self.pairs:
            logit += table[at[j], at[k]]
        return 1 / (1 + np.exp(-logit))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values per bin of a tree of the given depth over ordered bins, from gradient sums."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
        return out
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, ridge), _tree(g[cut:], h[cut:], depth - 1, ridge)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cross of one cut on either axis: leaf values over the grid, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c: np.ndarray) -> np.ndarray:
        a = c[:-1, :-1]
        return np.stack([a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a])

    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    fg, fh = four(cg), four(ch)
    gain = (fg**2 / (fh + ridge)).sum(0)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = fg[:, r, c] / (fh[:, r, c] + ridge)
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = leaf
    return out, float(gain[r, c])


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, depth: int = 2, bins: int = 32,
    n_pairs: int = 6, ridge: float = 5.0,
) -> Model:
    """Cyclic boosting of the single tables, then of the tables of the best pairs."""
    good = float(y.mean()) if len(y) else 0.5
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], cuts)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if good in (0.0, 1.0) or not len(y):
        good = min(max(good, 1e-3), 1 - 1e-3)
        return Model(edges, float(np.log(good / (1 - good))), tables, [])
    model = Model(edges, float(np.log(good / (1 - good))), tables, [])
    at = model.bins(x)
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = slopes()
            size = len(table)
            step = rate * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), depth, ridge)
            table += step
            logit += step[at[j]]

    def grid(j: int, k: int, v: np.ndarray) -> np.ndarray:
        shape = (len(tables[j]), len(tables[k]))
        return np.bincount(at[j] * shape[1] + at[k], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {(j, k): _quadrants(grid(j, k, g), grid(j, k, h), ridge)[1] for j, k in combinations(range(len(tables)), 2)}
    best = sorted(gains, key=lambda jk: (-gains[jk], jk))[:n_pairs]
    model.pairs = [(j, k, np.zeros((len(tables[j]), len(tables[k])))) for j, k in best]
    for _ in range(rounds):
        for j, k, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(j, k, g), grid(j, k, h), ridge)[0]
            table += step
            logit += step[at[j], at[k]]
    return model


def _features_of(docs: DataFrame, rest: list[str], text: str) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t) for t in texts_of(batch.column(len(rest)))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    return map_batches(docs.select(*rest, text), each, ", ".join([*fields, "x array<double>"]))


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_rows: int = MAX_ROWS,
) -> Model:
    """The model of a bounded sample of the labels that ``learn`` (a condition on the key) admits."""
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(key).agg((F.max(label) > 0).cast("double").alias("_label"))
    wanted = int(_HASH_RANGE * min(1.0, max_rows / max(1, known.count())))
    sample = known.where(F.pmod(F.xxhash64(key), F.lit(_HASH_RANGE)) < wanted).limit(2 * max_rows)
    found = docs.select(key, text).join(F.broadcast(sample), key)
    # texts stay where they are; what comes to the driver is a bounded number of feature rows
    rows = _features_of(found, ["_label"], text).limit(2 * max_rows).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``score`` and ``predicted``."""
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts_of(batch.column(len(rest)))])
        s = model.score(x)
        new = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, "score", "predicted"])

    return map_batches(docs.select(*rest, text), each, ", ".join([*fields, "score double", "predicted int"]))
