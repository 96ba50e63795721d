"""Secret scans with SQL functions only: fixed forms, and windows of high entropy.

Fixed forms are an assignment to a secret-like name, an access key, and a run of hexadecimal digits.
The method adds strings that look random: in every run of a character class (hexadecimal, base 64)
a window slides over the characters; the counts of the window's characters change by one that enters
and one that leaves, and with them the sum of c * log2(c), which gives the entropy of the window.
The sums are whole numbers (table ``c * log2(c)`` times 2^20, rounded), so every engine agrees.
A run that the allow-list describes is no candidate.

Everything stays in the row: no shuffle, no Python.  Positions are code points, the end exclusive.

Defined cases: a null or empty text has no span; very long texts and runs are scanned as wholes, in time that
grows with their length; an empty table has an empty result; rows are scanned one by one, so repeated rows, null
keys and extra columns change nothing (a clashing column ``spans`` is replaced).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions.spans import let
from kinchart.llm.common import free_name

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
SCALE = 2**20

# Runs that are no secrets as a whole: numbers (joined by signs), signs, universally unique ids, digests of published
# packages, alphabets written out.
ALLOWED = (
    r"^(?:[0-9-]+|[-_+/=]+|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+|(?:0123456789|abcdefghij|ABCDEFGHIJ).*)$"
)
# Nor are runs whose every part between signs is a word of one case with a short number behind it or a number, or that
# begin with a letter and whose parts are all letters or short numbers.  No pattern repeats a group: long runs of parts
# are taken apart before they are looked at.
SIGNS = "[-_+/=]+"
WORD = r"^(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,10})$"
LETTERS = r"^(?:[A-Za-z]+|[0-9]{1,4})$"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``signs`` (a bracket expression's inside), the window, and the least bits a character."""

    kind: str
    signs: str
    alphabet: str
    window: int
    bits: float

    def largest_sum(self) -> int:
        """The window is random enough if its sum of c * log2(c) is at most this."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * SCALE)


# The limit of the widest class suits keys of fewer signs, too (lower case or capitals with digits, base 32): their
# windows are windows of this class.  The allow-list holds down false alarms.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", _DIGITS + "abcdefABCDEF", 20, 2.8),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 20, 3.4),
)
KINDS = ("assign", "access", "hex", *[c.kind for c in CLASSES])

_MARK, _OTHER = "\uE000", "\uE001"  # of equal length; no pattern here tells them apart from other signs
_BLOCK = 128


def _before(lengths: Column) -> Column:
    """Sums of all lengths before each one: folded in blocks, then over the blocks."""

    def inner(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            block,
            start,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")
            ),
        )

    blocks = let(
        lengths,
        lambda v: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
            lambda b: inner(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))),
        ),
    )
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out"))
    shifted = F.aggregate(
        blocks,
        start,
        lambda acc, block: F.struct(
            (acc["sum"] + block["sum"]).alias("sum"),
            F.concat(acc["out"], F.array(F.transform(block["out"], lambda x: x + acc["sum"]))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(shifted)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right: array of (at, text).  The pattern never matches the empty text.

    Each match is set between marks; split there, the pieces are gap, match, gap, ... and their
    lengths add up to the positions.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), F.lit(f"({pattern})"), F.lit(f"{_MARK}$1{_MARK}"))

    def located(pieces: Column) -> Column:
        both = F.arrays_zip(_before(F.transform(pieces, lambda p: F.length(p))).alias("at"), pieces.alias("text"))
        return F.filter(both, lambda _, i: i % 2 == 1)

    found = let(F.split(marked, _MARK, -1), located)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<at:int,text:string>>"))


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        F.lit(kind).alias("kind"),
        end.cast("int").alias("end"),
    )


def _whole(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: _span(m["at"], m["at"] + F.length(m["text"]), kind))


def fixed_spans(text: Column) -> Column:
    """The spans of the fixed forms."""
    assign = f"(?i){ASSIGN}"
    named = F.filter(matches(text, assign), lambda m: F.length(F.regexp_extract(m["text"], assign, 1)) >= MIN_VALUE)
    return F.concat(
        _whole(named, "assign"), _whole(matches(text, ACCESS), "access"), _whole(matches(text, HEX), "hex")
    )


def _table(window: int) -> Column:
    values = [0, *[round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]]
    return F.array(*[F.lit(v).cast("long") for v in values])


def _random_part(run: Column, kind: CharacterClass) -> Column:
    """(first, last) of the run: from the first to the last window of enough entropy; nulls if none.

    Long runs go in pieces of 1,024 characters, each with the tail of the one before it.
    """
    width, logs = kind.window, _table(kind.window)
    state = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def slide(signs: Column, offset: Column) -> Column:
        def step(acc: Column, sign: Column) -> Column:
            n = acc["n"]
            enters = F.instr(F.lit(kind.alphabet), sign) - 1
            leaving = F.when(n >= width, F.get(signs, n - width))
            leaves = F.coalesce(F.instr(F.lit(kind.alphabet), leaving) - 1, F.lit(-1))

            def changed(at: Column) -> Column:
                c_out = F.coalesce(F.get(acc["counts"], at["leaves"]), F.lit(0))
                less = F.when(at["leaves"] >= 0, F.get(logs, c_out - 1) - F.get(logs, c_out)).otherwise(F.lit(0))
                c_in = F.get(acc["counts"], at["enters"]) - (at["leaves"] == at["enters"]).cast("int")
                total = acc["sum"] + less + F.get(logs, c_in + 1) - F.get(logs, c_in)
                high = (n + 1 >= width) & (total <= kind.largest_sum())
                counts = F.transform(
                    acc["counts"],
                    lambda c, k: c + (k == at["enters"]).cast("int") - (k == at["leaves"]).cast("int"),
                )
                return F.struct(
                    counts.alias("counts"),
                    total.alias("sum"),
                    (n + 1).alias("n"),
                    F.coalesce(acc["first"], F.when(high, n + 1 - width + offset)).alias("first"),
                    F.when(high, n + 1 + offset).otherwise(acc["last"]).alias("last"),
                )

            return let(F.struct(enters.alias("enters"), leaves.alias("leaves")), changed)

        return F.aggregate(signs, state, step, lambda acc: F.struct(acc["first"], acc["last"]))

    def over(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            tail = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(width - 1))).otherwise(F.lit(""))
            return slide(F.split(F.concat(tail, p), ""), i * 1024 - F.length(tail))

        return F.transform(pieces, piece)

    parts = let(F.regexp_extract_all(run, F.lit("(?s).{1,1024}"), F.lit(0)), over)
    return let(
        parts,
        lambda p: F.struct(
            F.array_min(F.transform(p, lambda x: x["first"])).alias("first"),
            F.array_max(F.transform(p, lambda x: x["last"])).alias("last"),
        ),
    )


def allowed_run(run: Column, allowed: str = ALLOWED) -> Column:
    """Whether the allow-list describes a run."""
    parts = F.filter(F.split(run, SIGNS, -1), lambda p: p != "")

    def of_words(found: Column) -> Column:
        words = F.forall(found, lambda p: p.rlike(WORD))
        return words | (run.rlike("^[A-Za-z]") & F.forall(found, lambda p: p.rlike(LETTERS)))

    return run.rlike(allowed) | let(parts, of_words)


def entropy_spans(text: Column, kind: CharacterClass, allowed: str = ALLOWED) -> Column:
    """Random-looking parts of the runs of a character class."""
    runs = matches(text, f"[{kind.signs}]{{{kind.window},}}")
    candidates = F.filter(runs, lambda m: m["text"].rlike("[0-9]") & ~allowed_run(m["text"], allowed))
    parts = F.transform(
        candidates,
        lambda m: let(_random_part(m["text"], kind), lambda p: _span(m["at"] + p["first"], m["at"] + p["last"], kind.kind)),
    )
    return F.filter(parts, lambda s: s["start"].isNotNull())


def secret_spans(
    docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: str = ALLOWED
) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, kind, end), by start, then kind.

    A random-looking part inside a span of a fixed form, or inside one of an earlier class, is not told twice.
    """
    return docs.withColumn("spans", all_spans(docs[text], classes, allowed))


def all_spans(text: Column, classes: tuple[CharacterClass, ...] = CLASSES, allowed: str = ALLOWED) -> Column:
    found = F.concat(fixed_spans(text), *[entropy_spans(text, kind, allowed) for kind in classes])
    return F.coalesce(F.array_sort(_told_once(found)), F.array()).cast(SPANS)


def _largest_so_far(values: Column) -> Column:
    """The largest value up to each place: folded in blocks, then over the blocks."""

    def grown(out: Column, x: Column) -> Column:
        return F.concat(out, F.array(F.greatest(F.element_at(out, -1), x)))

    def inner(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(grown(acc, x)))

    blocks = let(
        values,
        lambda v: F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / _BLOCK), F.lit(0)).cast("int")),
            lambda b: inner(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))),
        ),
    )
    start = F.struct(F.lit(0).alias("most"), F.array().cast("array<array<int>>").alias("out"))
    raised = F.aggregate(
        blocks,
        start,
        lambda acc, block: F.struct(
            F.greatest(acc["most"], F.try_element_at(block, F.lit(-1))).alias("most"),
            F.concat(acc["out"], F.array(F.transform(block, lambda x: F.greatest(x, acc["most"])))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(raised)


def _told_once(spans: Column) -> Column:
    """Without spans of a class that lie in one of a lower rank: one sorted pass with the furthest end so far."""
    def ordered(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"), s["kind"].alias("kind"))

    def fresh(found: Column) -> Column:
        # what covers a span comes before it: it starts earlier, or at the same place and ends later, or has a lower rank
        def reach(rank: int) -> Column:
            return _largest_so_far(F.transform(found, lambda s: F.when(s["rank"] < rank, -s["back"]).otherwise(F.lit(0))))

        def kept(ends: Column) -> Column:
            def free(s: Column, i: Column) -> Column:
                covered = F.get(F.get(ends, s["rank"] - 3), i) >= -s["back"]
                return (s["rank"] < 3) | ~F.coalesce(covered, F.lit(False))

            return F.filter(found, free)

        return let(F.array(*[reach(rank) for rank in range(3, len(KINDS))]), kept)

    def whole(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (-s["back"]).alias("end"))

    return F.transform(let(F.array_sort(F.transform(spans, ordered)), fresh), whole)


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


_PIECE = 4096


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``, exclusive, of a text cut in pieces: no scan from the text's beginning."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    at, until = (start % _PIECE).cast("int"), (end % _PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    across = F.concat(
        F.substring(piece(first), at + 1, F.lit(_PIECE)),
        F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(piece(last), F.lit(1), until),
    )
    return F.when(first == last, F.substring(piece(first), at + 1, end - start)).otherwise(across)


def without_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; overlapping spans become one."""
    name = free_name(docs, "_spans")
    scanned = docs.withColumn(name, all_spans(docs[text]))
    spans = F.col(name)

    def masked(x: Column) -> Column:
        pieces, reach = x["pieces"], x["reach"]

        def told(s: Column, i: Column) -> Column:
            # how far the spans before this one reach
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            return F.when(s["start"] >= before, F.concat(_part(pieces, before, s["start"]), F.lit(mask))).otherwise(F.lit(""))

        rest = _part(pieces, F.try_element_at(reach, F.lit(-1)), F.length(docs[text]))
        return F.concat(F.array_join(F.transform(spans, told), ""), rest)

    cut = F.struct(
        F.regexp_extract_all(docs[text], F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"),
        _largest_so_far(F.transform(spans, lambda s: s["end"])).alias("reach"),
    )
    return scanned.withColumn(text, F.when(F.size(name) > 0, let(cut, masked)).otherwise(docs[text])).drop(name)
