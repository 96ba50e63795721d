"""Text spans as array columns: position, text and groups of every match, inside the row.

A document is one row, so everything that depends on a document only - matches, overlaps, the
nearest dose after a medicine - is computed in that row with built-in functions.  Nothing is
shuffled to bring a document's spans together, and a long document costs its own task only.
"""

from __future__ import annotations

import os
import re
from functools import cache
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a plain reuse would evaluate it every time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


BLOCK = 128


def running(values: Column, combine) -> Column:
    """The values combined up to each place (sums, maxima): folded in blocks, then over the blocks.

    An array grows by copying, so one fold over all would take the square of its length.
    """

    def joined(before: Column, x: Column) -> Column:
        return F.coalesce(combine(before, x), x)

    def inner(block: Column) -> Column:
        grow = lambda acc, x: F.concat(acc, F.array(joined(F.try_element_at(acc, F.lit(-1)), x)))
        return F.aggregate(block, F.array().cast("array<int>"), grow)

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int"))
        return F.transform(numbers, lambda b: inner(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def outer(acc: Column, block: Column) -> Column:
        last = F.try_element_at(block, F.lit(-1))
        lifted = F.transform(block, lambda x: joined(acc["last"], x))
        return F.struct(joined(acc["last"], last).alias("last"), F.concat(acc["out"], F.array(lifted)).alias("out"))

    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<array<int>>").alias("out"))
    joint = lambda v: F.flatten(F.aggregate(blocks(v), start, outer, lambda acc: acc["out"]))
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, inner(v)).otherwise(joint(v)))


def first_from(values: Column, at: Column) -> Column:
    """Index of the first of sorted values that is not below ``at``, by bisection; their number if there is none."""
    rounds = F.ceil(F.log2(F.size(values) + 1)).cast("int")
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        # an empty range stays: its middle is its end
        later = (acc["low"] < acc["high"]) & (F.get(values, middle) < at)
        return F.struct(
            F.when(later, middle + 1).otherwise(acc["low"]).alias("low"), F.when(later, acc["high"]).otherwise(middle).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(0), rounds), start, halve, lambda acc: acc["low"])


MARK = "\uE000"
# What a mark in the text becomes: of the same kind and length, so no pattern tells them apart.
PLAIN = "\uE001"


def _by_turns(text: Column, pattern: str, group: int) -> Column:
    """The text cut into what lies between matches and the matches, by turns.

    One pass: a copy of the group (all of the match, or what a look-ahead saw) is put between marks and the
    text is split at them.
    """
    return _cut(F.replace(text, F.lit(MARK), F.lit(PLAIN)), pattern, group)


def _cut(text: Column, pattern: str, group: int) -> Column:
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}${group}{MARK}")), MARK, -1)


def groups(match: Column, pattern: str, count: int) -> Column:
    """All groups of a match by one pass; a match holds no mark."""
    return F.split(F.regexp_replace(match, F.lit(pattern), F.lit(MARK.join(f"${i + 1}" for i in range(count)))), MARK, -1)


def _span(begin: Column, match: Column) -> Column:
    return F.struct(begin.alias("start"), (begin + F.length(match)).alias("end"), match.alias("text"))


def _numbers(turns: Column) -> Column:
    """0, 1, 2, ... of the matches; there must be one."""
    return F.sequence(F.lit(0), F.floor(F.size(turns) / 2).cast("int") - 1)


# Up to so many turns (eight matches) are placed one by one.
FEW = 17


def _placed(turns: Column, zero_width: bool = False, chosen: Column | None = None) -> Column:
    """Spans of the matches, or of those with the chosen numbers."""
    # lengths up to each match: its gap, and the match before it where that was part of the text
    gap = lambda i: F.length(F.get(turns, i * 2))
    size = gap if zero_width else (lambda i: gap(i) + F.when(i > 0, F.length(F.get(turns, i * 2 - 1))).otherwise(0))
    upto = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda acc, j: acc + size(j))
    many = running(F.transform(_numbers(turns), size), lambda before, x: before + x)
    begins = F.when(F.size(turns) <= FEW, F.transform(_numbers(turns), upto)).otherwise(many)
    spans = F.transform if chosen is None else (lambda at, one: F.transform(chosen, lambda i: one(F.get(at, i), i)))
    return let(begins, lambda at: spans(at, lambda begin, i: _span(begin, F.get(turns, i * 2 + 1))))


def regex_spans(text: Column, pattern: str) -> Column:
    """Spans of all matches, left to right.  The pattern must not match the empty string."""
    return _all_spans(_by_turns(text, pattern, 0), False)


def pattern_spans(text: Column, pattern: str, plain: Column | None = None) -> Column:
    """``regex_spans``; a text of ASCII alone (``plain``) is searched by what the pattern means there."""
    return _all_spans(_by_kind(text, pattern, 0, plain), False)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def in_ascii(pattern: str) -> str:
    """What a pattern that ignores case means in a text of ASCII alone, where classes are small and need no tables."""
    for flags in ("(?iU)", "(?iu)"):
        pattern = pattern.replace(flags, "(?i)")
    return re.sub(r"(?<!\[)" + re.escape(_OUTSIDE), "", pattern.replace("(?U)", "").replace(r"\p{L}", "[A-Za-z]"))


def _by_kind(text: Column, pattern: str, group: int, plain: Column | None) -> Column:
    """``_by_turns``, one pass over each text: a text of ASCII alone holds no mark."""
    kind = is_ascii(text) if plain is None else plain
    return F.when(kind, _cut(text, in_ascii(pattern), group)).otherwise(_by_turns(text, pattern, group))


def _all_spans(turns: Column, zero_width: bool) -> Column:
    nothing = F.array().cast(SPAN)

    def spans(turns: Column) -> Column:
        one = F.array(_span(F.length(F.get(turns, F.lit(0))), F.get(turns, F.lit(1))))
        return F.when(F.size(turns) == 1, nothing).when(F.size(turns) == 3, one).otherwise(_placed(turns, zero_width))

    return F.coalesce(let(turns, spans), nothing)


def _only(letters: str) -> str:
    """A class of the letters in either case and of all signs outside ASCII: some of those are like a letter of ASCII
    when case is ignored.  It lists what is not in it, which is one look into a table a sign.
    """
    both = {v for c in letters for v in (c.lower(), c.upper())}
    return "[^" + "".join(f"\\x{i:02x}" for i in range(128) if chr(i) not in both) + "]"


def starting(letters: str, digits: bool = False, word: bool = True, second: str = "") -> str:
    """A test that a match starting with one of the letters (or a digit) passes always, and most places do not.

    It is put in front of an expression that ignores case; ``word`` is for expressions that start with a word
    boundary, and rules out places behind a letter or digit before the boundary is worked out; ``second`` is what
    may stand behind the first sign, if that is known.
    """
    ascii_only = lambda s: "".join(c for c in s if c.isascii())
    first = _only(ascii_only(letters) + "0123456789" * digits)
    then = _only(ascii_only(second)) if second else ""
    return rf"(?-iU:(?={first}{then}){r'(?<!\w)' if word else ''})"


def by_letter(expression: str) -> tuple[str, str]:
    r"""An expression that starts with a choice of names (``\b(a|b|c)...``), its names put together by their first letter,
    and the second signs of all names; as it was, and none, where a name does not start with two plain signs.

    Names of different letters never fit one place, so the order of those of one letter is all that counts.
    """
    form = re.fullmatch(r"\\b\(([^()]*)\)(.*)", expression)
    names = form[1].split("|") if form else []
    if not names or not all(re.match(r"[A-Za-z](?![?*+{])[A-Za-z0-9](?![?*+{])", n) for n in names):
        return expression, ""
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(name[0].lower(), []).append(name[1:])
    told = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items())
    return rf"\b({told}){form[2]}", "".join(sorted({n[1].lower() for n in names}))


# A sign outside ASCII, as one kind: any of them may stand wherever a pattern asks for a sign.
OTHER = "\x80"
_OUTSIDE = r"\x80-\x{10FFFF}"
_ALL = frozenset(map(chr, range(129)))


def _signs(op, value) -> frozenset:
    """The ASCII signs, and ``OTHER``, that one step of a parsed expression may read when case is ignored."""
    told = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": "".join(map(chr, range(33))),
            "CATEGORY_WORD": "".join(c for c in map(chr, range(128)) if c.isalnum() or c == "_")}
    if op is _parser.LITERAL and value < 128:
        return frozenset({chr(value).lower(), chr(value).upper(), OTHER})
    if op is _parser.RANGE and value[1] < 128:
        return frozenset(v for c in range(value[0], value[1] + 1) for v in (chr(c).lower(), chr(c).upper())) | {OTHER}
    if op is _parser.CATEGORY and str(value) in told:
        return frozenset(told[str(value)]) | {OTHER}
    if op is _parser.IN and value[0][0] is not _parser.NEGATE:
        return frozenset().union(*[_signs(*v) for v in value])
    # signs outside ASCII that are like no sign in it
    return frozenset({OTHER}) if op is _parser.LITERAL and chr(value) not in "\u0130\u0131\u017f\u212a" else _ALL


def _openings(parsed, depth: int) -> set[tuple[frozenset, ...]]:
    """What signs may stand first, second, ... in a match; shorter where a match may end, or go on with anything."""
    found: set[tuple[frozenset, ...]] = {()}
    done: set[tuple[frozenset, ...]] = set()
    for op, value in parsed:
        if op in (_parser.AT, _parser.ASSERT, _parser.ASSERT_NOT):
            continue
        if op is _parser.BRANCH:
            nexts = set().union(*[_openings(b, depth) for b in value[1]])
        elif op in (_parser.SUBPATTERN, _parser.ATOMIC_GROUP):
            nexts = _openings(value[3] if op is _parser.SUBPATTERN else value, depth)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _openings(inner, depth)
            times, nexts = {()}, set()
            for n in range(min(high, low + depth, 2 * depth) + 1):
                nexts |= times if n >= min(low, depth) else set()
                times = {(a + b)[:depth] for a in times for b in once}
        elif op in (_parser.LITERAL, _parser.NOT_LITERAL, _parser.ANY, _parser.IN):
            nexts = {(_signs(op, value),)}
        else:
            break
        found = {(a + b)[:depth] for a in found for b in nexts}
        done |= {f for f in found if len(f) == depth}
        found = {f for f in found if len(f) < depth}
        if not found:
            break
    return done | found


def _class(signs: frozenset) -> str:
    if signs == _ALL:
        return r"[\s\S]"
    plain = "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in sorted(signs - {OTHER}))
    return f"[{plain}{_OUTSIDE * (OTHER in signs)}]"


def _told_apart(ways: set[tuple[frozenset, ...]]) -> str:
    """An expression for what the ways allow, told apart sign by sign."""
    if () in ways:
        return ""
    nexts: dict[str, set] = {}
    for way in ways:
        for c in way[0]:
            nexts.setdefault(c, set()).add(way[1:])
    alike: dict[str, set] = {}
    for c, rest in nexts.items():
        alike.setdefault(_told_apart(rest), set()).add(c)
    parts = [_class(frozenset(signs)) + rest for rest, signs in sorted(alike.items(), key=lambda a: (len(a[1]), a[0]))]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@cache
def opening(expression: str, depth: int = 3, behind: str = "") -> str:
    """A test that a match of an expression that ignores case passes always, and most places do not.

    It looks at the first signs of the place: each alone, then ``behind`` (what must not stand before), then together.
    Signs outside ASCII pass.  Every look is one into a table.
    """
    ways = _openings(_parser.parse(expression), depth)
    alone = "".join(_class(frozenset().union(*[w[i] for w in ways])) for i in range(min(map(len, ways))))
    return f"(?-iU:(?={alone}){behind}(?={_told_apart(ways)}))" if alone else ""


def sooner(expression: str) -> str:
    """The expression with a test of its first letter, if it is one letter behind a word boundary."""
    found = re.match(r"\\b([A-Za-z])(?![?*{])", expression)
    if found and "|" not in expression:
        return starting(found[1]) + expression
    # a digit of any script stands first, or a given one behind what it must not follow
    if expression.startswith(r"(\d)") and not re.match(r"\(\\d\)[?*{|]", expression) and "|" not in expression:
        return starting("", digits=True, word=False) + expression
    zero = re.match(r"\(\?<!\\d\)(\d)(?![?*{|\d])", expression)
    return f"(?={zero[1]}){expression}" if zero else expression


def needs(expression: str) -> str | None:
    """What the folded text must hold for an expression that ignores case to match; none for forms not listed here."""
    forms = (
        r"\\b(\w+)\\b",
        r"\(\?<!\\d\)(\d)\(\?=(?:[^()]|\([^()]*\))*\)",
        r"\(\\d\)(?:\\s[+*])?\\?([.,])(?:\\s[+*])?\(\\d(?:\{\d\})?\)",
    )
    found = next(filter(None, (re.fullmatch(form, expression, re.ASCII) for form in forms)), None)
    return found[1].lower() if found and not re.search(r"(?<!\\)\.", expression) else None


# Shorter texts (in bytes) are searched at once.
SHORT = 512


def where_held(text: Column, expression: str, first: str) -> Column:
    """The text, or null where a long one holds no match of an expression that ignores case.

    A match starts with one of the signs ``first`` or outside ASCII; runs of all others are passed over in a tight
    loop, so that a text without a match costs a fraction of a search.
    """
    starts = {v for c in first for v in (c.lower(), c.upper())}
    signs = "".join(f"\\x{i:02x}" for i in range(128) if chr(i) not in starts)
    still, other = f"[{signs}]", f"[^{signs}]"
    leaps = rf"(?-iU:{still}*+)(?:(?!{expression})(?-iU:{other}{still}*))*+"
    return F.when((F.octet_length(text) <= SHORT) | text.rlike(rf"(?iU)\A{leaps}(?:{expression})"), text)


def with_digits(text: Column) -> Column:
    """The text, or null where a long one holds no digit of any script."""
    return where_held(text, r"\d", "0123456789")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


@cache
def vocabulary_layers(names: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """Names in layers, so that no name of a layer continues another one of it after a non-letter ("diabetes",
    "diabetes mellitus"); within a layer at most one name fits a position.  A name of a later layer continues one
    of the layer before, which fits wherever it does.
    """
    depth: dict[str, int] = {}
    for name in sorted(names, key=len):
        shorter = [o for o in depth if name.startswith(o) and name != o and not name[len(o)].isalpha()]
        depth[name] = 1 + max((depth[o] for o in shorter), default=-1)
    return tuple(tuple(name for name in names if depth[name] == layer) for layer in range(max(depth.values()) + 1))


@cache
def vocabulary_patterns(names: tuple[str, ...]) -> tuple[str, ...]:
    """Look-ahead patterns, one a layer, that together find every occurrence of every name.

    The alternation branches letter by letter; a test of the first three signs dismisses most positions before it.
    """
    trees = [_tree(list(chosen)) for chosen in vocabulary_layers(names)]
    return tuple(rf"(?iu){opening(tree, behind='(?<![A-Za-z])')}(?<!\p{{L}})(?=({tree})(?!\p{{L}}))" for tree in trees)


def _vocabulary_hits(text: Column, names: tuple[str, ...], plain: Column | None) -> Column:
    """Hits of all layers; a later layer is looked for where a hit of the one before could go on."""
    layers = vocabulary_layers(names)
    patterns = vocabulary_patterns(names)

    def further(hits: Column, layer: int) -> Column:
        """The hits, behind them those of the layers from this one on."""
        if layer == len(layers):
            return hits
        begun = [o for o in layers[layer - 1] if any(n.startswith(o) and n != o and not n[len(o)].isalpha() for n in layers[layer])]
        goes_on = F.exists(hits, lambda s: s["text"].rlike(rf"(?iu)^(?:{_tree(begun)})$"))
        more = let(_all_spans(_by_kind(text, patterns[layer], 1, plain), True), lambda found: F.concat(hits, further(found, layer + 1)))
        return F.when(goes_on, more).otherwise(hits)

    return let(_all_spans(_by_kind(text, patterns[0], 1, plain), True), lambda hits: further(hits, 1))


def _tree(names: list[str]) -> str:
    """An expression for the names that tells them apart letter by letter."""
    branches: dict[str, list[str]] = {}
    for name in names:
        branches.setdefault(name[:1], []).append(name)
    ends = "" in branches
    parts = []
    for _, group in sorted((c, g) for c, g in branches.items() if c):
        shared = os.path.commonprefix(group)
        rest = _tree([name[len(shared) :] for name in group]) if len(set(group)) > 1 else ""
        parts.append(re.escape(shared) + (f"(?:{rest})" if rest else ""))
    return "|".join(parts + [""] * ends)


def vocabulary_spans(text: Column, names: tuple[str, ...], plain: Column | None = None) -> Column:
    """Names found between non-letters; longest first over the whole text, then by name, then left to
    right; a hit that overlaps an accepted one is dropped.
    """
    found = _vocabulary_hits(text, names, plain)
    # by length, name and place: the order in which hits are accepted
    rank = lambda s: F.struct(
        (-F.length(s["text"])).alias("k"), F.lower(s["text"]).alias("name"), s["start"].alias("at"), s.alias("s")
    )
    ranked = lambda hits: F.array_sort(F.transform(hits, rank))

    def accepted(cluster: Column) -> Column:
        def accept(acc: Column, x: Column) -> Column:
            taken = F.exists(acc, lambda other: overlaps(x["s"], other))
            return F.when(taken, acc).otherwise(F.concat(acc, F.array(x["s"])))

        return F.when(F.size(cluster) == 1, cluster).otherwise(F.aggregate(ranked(cluster), F.array().cast(SPAN), accept))

    def clustered(hits: Column) -> Column:
        """Hits decide on each other only inside a cluster of overlaps, and clusters are short."""

        def cut(reach: Column) -> Column:
            opens = F.filter(
                F.sequence(F.lit(0), F.size(hits) - 1),
                lambda i: (i == 0) | (F.get(hits, i)["start"] >= F.get(reach, i - 1)),
            )
            return let(
                opens,
                lambda o: F.flatten(
                    F.transform(
                        o,
                        lambda at, k: let(F.slice(hits, at + 1, F.coalesce(F.get(o, k + 1), F.size(hits)) - at), accepted),
                    )
                ),
            )

        return let(running(F.transform(hits, lambda s: s["end"]), F.greatest), cut)

    def resolved(hits: Column) -> Column:
        told = F.transform(ranked(let(F.array_sort(hits), clustered)), lambda x: x["s"])
        return F.when(F.size(hits) > 1, told).otherwise(hits)

    return let(found, resolved)


def without_overlap(spans: Column, taken: Column) -> Column:
    """Spans clear of the taken ones, which are sorted and clear of each other."""

    def clear(of: Column) -> Column:
        def free(s: Column) -> Column:
            # the first taken span that ends behind the start
            next_one = F.get(of["starts"], first_from(of["ends"], s["start"] + 1))
            return F.coalesce(next_one >= s["end"], F.lit(True))

        return F.filter(spans, free)

    ends = F.struct(*[F.transform(taken, lambda t: t[n]).alias(f"{n}s") for n in ("start", "end")])
    return F.when((F.size(taken) == 0) | (F.size(spans) == 0), spans).otherwise(let(ends, clear))


def hospital_spans(text: Column, words: list[str], plain: Column | None = None) -> Column:
    """Runs of letters and white space up to their last hospital word.

    The run is found first and searched from its end, which keeps the cost linear in the text; one
    expression for both would rescan a long run from each of its letters.
    """
    alternation = "|".join(re.escape(w) for w in words)
    nothing = F.array().cast(SPAN)
    # told apart letter by letter only to test, never to match
    test = opening(_tree(words))
    one_of = rf"(?iU){test}\b(?:{alternation})\b"
    named = rf"(?isU)^(?:.*{test}\b)?(?:{alternation})\b"
    glued = F.lit(r"(?U)\w")

    def cut(s: Column) -> Column:
        hit = F.regexp_extract(s["text"], named, 0)
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(hit)).alias("end"), hit.alias("text"))

    def stands(s: Column) -> Column:
        # a run that is a hospital word and nothing before it must not continue an earlier word
        bare = F.lower(s["text"]).isin(words)
        before = F.substring(text, s["start"], F.lit(1))
        return (F.length(s["text"]) > 0) & ~(bare & (s["start"] > 0) & F.rlike(before, glued))

    def of(turns: Column) -> Column:
        return let(F.filter(_numbers(turns), lambda i: F.get(turns, i * 2 + 1).rlike(one_of)), lambda i: placed(turns, i))

    def placed(turns: Column, chosen: Column) -> Column:
        # a few are placed by what lies before each; more of them by running lengths
        before = lambda i: F.length(F.array_join(F.slice(turns, F.lit(1), i * 2 + 1), ""))
        few = F.transform(chosen, lambda i: _span(before(i), F.get(turns, i * 2 + 1)))
        spans = F.when(F.size(chosen) <= 3, few).otherwise(_placed(turns, chosen=chosen))
        return F.filter(F.transform(spans, cut), stands)

    # a run too short for any word needs no look; its last letter may be one outside ASCII
    run = rf"(?U)[A-Za-z][A-Za-z\s]{{{min(map(len, words)) - 2},}}+\w?"
    # most texts, and most runs, name no hospital: one linear test spares them the rest
    named_in = where_held(text, rf"\b(?:{alternation})\b", "".join({w[0] for w in words}))
    return F.when(named_in.rlike(one_of), let(_by_kind(text, run, 0, plain), of)).otherwise(nothing)
