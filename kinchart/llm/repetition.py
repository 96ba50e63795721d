"""Quality rules: how much of a text lies inside n-grams and lines that it repeats.

Words are runs of anything but blanks (``[^\\x20\\x09-\\x0D]+``).  For each length n a rolling hash
``h_n[i] = h_(n-1)[i] * B + r[word i+n-1]`` is extended from the one before it, so several lengths
cost one multiplication a word each; a repeated window of n words holds one of n-1 words, so the
lengths end at the first one without a repeat.

Defined cases: a null or blank text has no words, zeros everywhere, and fails the base rule; rows
are judged one by one, so repeated rows, null keys and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinchart.llm.common import map_batches, mix64, texts_of, word_ids

# Largest share of characters inside repeated n-grams of n words (all their places count), and
# inside lines that repeat an earlier line.  One line of up to nine words may stand twice in a text of
# fifty; longer windows are passages pasted again.
LIMITS = {5: 0.44, 6: 0.43, 7: 0.42, 8: 0.41, 9: 0.40, 10: 0.30}
LINE_LIMIT = 0.22
MIN_WORDS = 50
# Per cent of the words that may stand in repeated windows of three words.
MAX_REPEAT_PERCENT = 50

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, gram_coverage double, line_coverage double, kept boolean"
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = np.zeros(256, np.bool_)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _repeated(codes: np.ndarray) -> np.ndarray | None:
    """Which codes occur twice or more; None where no code does."""
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(codes, twice) if len(twice) else None


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside the windows that begin where ``starts`` is true."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _triples(ids: np.ndarray) -> np.ndarray:
    """Exact codes of the windows of three words."""
    pairs = ids[:-1] * (ids.max() + 1) + ids[1:]
    if ids.max() >= 2**21:
        pairs = np.unique(pairs, return_inverse=True)[1]
        return pairs[:-1] * (ids.max() + 1) + ids[2:]
    return (pairs[:-1] << np.int64(21)) | ids[2:]


def measure(text: bytes, limits: dict[int, float], line_limit: float) -> tuple:
    """The counts and the verdict of one text."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()  # bytes split at the six ASCII blanks only
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    unlike = set(lines)
    symbols = int(np.count_nonzero(_SYMBOL[raw]))
    if not n:
        return 0, 0, symbols, 0, 0, True, 0.0, 0.0, False
    blank = _BLANK[raw]
    letter = ~blank & ((raw & 0xC0) != 0x80)
    chars = np.concatenate(([0], np.cumsum(letter)))
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    width = chars[np.flatnonzero(edges == 1)] - chars[np.flatnonzero(edges == -1)]
    total = int(chars[-1])

    ids = word_ids(words)
    repeat = _repeated(_triples(ids)) if n >= 3 else None
    n_repeat = 0 if repeat is None else int(np.count_nonzero(_covered(repeat, 3, n)))

    coverage, excess = 0.0, False
    if repeat is not None:
        word_hash = mix64(ids + 1)
        rolled = word_hash
        for size in range(2, min(max(limits), n) + 1):
            rolled = rolled[:-1] * _BASE + word_hash[size - 1 :]
            if size in limits:
                again = _repeated(rolled)
                if again is None:
                    break
                share = float(width[_covered(again, size, n)].sum()) / total
                coverage = max(coverage, share)
                excess |= share > limits[size]

    line_share = 0.0
    if len(unlike) < len(lines):
        seen: set[bytes] = set()
        in_repeats = 0
        for line in lines:
            if line in seen:
                in_repeats += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
        line_share = in_repeats / total
    base_failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    kept = not (base_failed or excess or line_share > line_limit)
    return n, total, symbols, len(lines) - len(unlike), n_repeat, base_failed, coverage, line_share, kept


def repetition_coverage(
    docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT
) -> DataFrame:
    """Every row of ``docs`` without its text, with the counts, the coverages and ``kept``.

    ``limits`` maps a window length to the largest share of characters inside repeated windows of
    that length.  Columns of the input that have a name of the result are replaced.
    """
    bounds = dict(limits or LIMITS)
    added = [part.split(" ")[0] for part in COLUMNS.split(", ")]
    rest = [c for c in docs.columns if c != text and c not in added]
    kept_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t, bounds, line_limit) for t in texts_of(batch.column(len(rest)))]
        new = [pa.array(list(v), kind) for v, kind in zip(zip(*found), _KINDS)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, *added])

    return map_batches(docs.select(*[docs[c] for c in rest], docs[text]), each, f"{kept_fields}, {COLUMNS}".lstrip(", "))


_KINDS = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]


def passes(docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    bounds = dict(limits or LIMITS)
    where = docs.columns.index(text)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([measure(t, bounds, line_limit)[-1] for t in texts_of(batch.column(where))]))

    return map_batches(docs, each, docs.schema)
