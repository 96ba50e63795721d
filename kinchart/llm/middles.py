"""Fill-in-middle: documents cut in prefix, middle and suffix, and put in another order.

The cuts are counted in units (characters, or words) from left to right.  A wavelet matrix over the
classes of the UTF-8 bytes answers how many bytes of a class come before a place; such ranks, added
over the classes that begin a unit, count the boundaries of a stretch, and bisection on them finds
the byte where a cut lies.  One matrix serves all documents of an Arrow batch, and all cuts of the
batch are bisected side by side.  Nothing is shuffled.

Which documents are cut, where and in which order, follows from the SHA-256 of seed and key alone, so
it is the same on every cluster and in every run.

Defined cases: a null text is an empty one; empty texts, and texts that hold a marker, stay plain; a
null key is hashed as an empty one; repeated rows get equal results; very long texts are cut as
wholes; result columns replace columns of the same name, other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import free_name, map_batches, texts_of

# Classes of bytes.
INSIDE, BLANK, WORD_START, WORD = range(4)
LEVELS = 2
#: Classes whose bytes begin a unit.
UNITS = {"character": (BLANK, WORD_START, WORD), "word": (WORD_START,)}
BLANKS = b" \t\n\x0b\x0c\r"

_CLASS = np.full(256, WORD, np.uint8)
_CLASS[0x80:0xC0] = INSIDE
_CLASS[list(BLANKS)] = BLANK


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte; documents begin at ``starts``."""
    found = _CLASS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = found[:-1] == BLANK
    fresh[starts[starts < len(data)]] = True
    found[fresh & (found == WORD)] = WORD_START
    return found


class WaveletMatrix:
    """Ranks of the classes of a sequence: per level the bits in stable order, zeros first."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for level in reversed(range(levels)):
            bits = (symbols >> level) & 1
            packed = np.packbits(bits, bitorder="little")
            words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)))
            self.levels.append((level, words, before, len(bits) - int(before[-1])))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of the class at places from ``start`` up to ``end``, exclusive."""
        for level, words, before, zeros in self.levels:
            one_start, one_end = _ones(words, before, start), _ones(words, before, end)
            if symbol >> level & 1:
                start, end = zeros + one_start, zeros + one_end
            else:
                start, end = start - one_start, end - one_end
        return end - start


def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each place."""
    word = at >> 6
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(words[word] & below).astype(np.int64)


def boundaries(matrix: WaveletMatrix, unit: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Units that begin in [start, end)."""
    return sum(matrix.rank(c, start, end) for c in UNITS[unit])


def cuts(matrix: WaveletMatrix, unit: str, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The last place of [start, end] with at most ``count`` units before it: where the next unit begins."""
    low, high = start.copy(), end.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = boundaries(matrix, unit, start, middle) <= count
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


@dataclass(frozen=True)
class Form:
    """Markers, the share of documents that are cut, and of these the share with the suffix first (per cent)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    suffix_first_percent: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        marks = self.marks
        # no end of a text and marker may look like a marker: then each is found where it was set
        if any(a.endswith(b[:n]) for a in marks for b in marks for n in range(1, len(b)) if n < len(a) or a != b):
            raise ValueError("a marker begins with what a marker ends with")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def draws(self, key) -> tuple[int, ...]:
        text = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).hexdigest()
        return tuple(int(text[i : i + 8], 16) for i in range(0, 32, 8))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "character", form: Form = Form(), keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units`` (null if plain) and ``output``."""
    marks = [m.encode() for m in form.marks]
    p, s, m = marks
    name, of = free_name(docs, "_text"), free_name(docs, "_key")
    new = "n bigint, form string, prefix_units bigint, middle_units bigint, output string"
    added = [field.split()[0] for field in new.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in added and (keep_text or c != text)]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(batch.num_columns - 1))
        keys = batch.column(batch.num_columns - 2).to_pylist()
        end = np.cumsum([len(t) for t in texts], dtype=np.int64)
        start = np.concatenate(([0], end[:-1]))
        matrix = WaveletMatrix(classes(np.frombuffer(b"".join(texts), np.uint8), start))
        n = boundaries(matrix, unit, start, end)
        draws = np.array([form.draws(k) for k in keys], np.int64)
        first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
        less, more = np.minimum(first, second), np.maximum(first, second)
        both = [cuts(matrix, unit, start, end, k) - start for k in (less, more)]
        forms, outputs = [], []
        for t, a, b, share, order in zip(texts, *both, draws[:, 2].tolist(), draws[:, 3].tolist()):
            if not t or share % 100 >= form.cut_percent or any(mark in t for mark in marks):
                forms.append("plain")
                outputs.append(t)
            elif order % 100 < form.suffix_first_percent:
                forms.append("spm")
                outputs.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
        plain = np.array([f == "plain" for f in forms])
        columns = [
            pa.array(n), pa.array(forms, pa.string()), pa.array(less, mask=plain), pa.array(more - less, mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*kept, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    # the key travels as its decimal text, whatever its type
    source = docs.select(*kept, F.col(key).cast("string").alias(of), F.col(text).alias(name))
    return map_batches(source, each, f"{kinds}, {new}" if kinds else new)


def restored(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The exact text that an output of a form was made from."""
    before, after = (lambda c, mark: F.substring_index(c, mark, 1)), (lambda c, mark: F.substring_index(c, mark, -1))
    p, s, m = form.marks
    middle = after(output, m)
    psm = F.concat(after(before(output, s), p), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, after(before(output, p), s))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)
