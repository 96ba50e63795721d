"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question asked again with other values has
the same template.  Windows of eight template tokens of the documents are joined by hash with those
of the benchmark.  Windows of one pair that keep the same distance are one alignment; its slots must
be consistent: a value of the benchmark stands for one value of the document wherever it comes up.
A document leaks an item if consistent alignments cover at least half of the item's windows.

The windows of the benchmark fill a bitmap of fixed size; only document windows that hit it become
rows, and the join decides.  Items of one template whose values come up alike are one class in the join, however
many they are: a document meets each template once, and an alignment has at most as many rows as its
item has windows.

Defined cases: null and blank texts have no windows; items of five to seven tokens are one window of
their length, shorter ones and windows of fewer than four plain words (half of a short one) prove
nothing and are not searched for; very long texts are searched whole, their words hashed once; of equal
shares no item goes before another: each is told; repeated rows leak alike; null ids are reported as null;
empty tables leak nothing; other columns of either table play no part, and ``without_leaks`` keeps them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import free_name, map_batches, mix64, remembered, stored, texts_of

WINDOW = 8
LEAST_TOKENS = 5
LEAST_PLAIN = 4
COVERAGE = 0.5
CONSISTENT = 0.8
BITMAP_BITS = 2**24
MEMORY = 200_000

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr hrs ms d w kb mb gb tb hz khz mhz ghz v a w kw kwh j "
    "kj cal kcal pa bar psi k c f usd eur gbp jpy cent cents dollar dollars euro euros pound pounds yen percent degree "
    "degrees meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram "
    "grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years stunde stunden tag tage jahr jahre heure heures jour jours an ans hora horas dia dias".split()
)
_UNIT_WORDS = frozenset(u.encode() for u in UNITS)
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’–—…¿¡•"
_NUMBER = re.compile(r"^\d[\d.,:/ -]*(?:[^\W\d_]{0,4})$")
_ENDS = re.compile(r"[.!?:…][\"'”’»)\]]*$")
_PLAIN, _NUM, _CAPITAL, _UNIT, _NOTHING = range(5)
_PLACE = {_NUM: 0x6E756D, _CAPITAL: 0x6E616D65, _UNIT: 0x756E6974}
_POWER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Per word: hash of its plain form in the upper bits, kind and "ends a sentence" in the lower four."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        bare = word[:-1] if word[-1:] in (b".", b",") else word
        if bare.isalpha():  # ASCII letters, perhaps with a stop or comma: most words
            plain = bare.lower()
            kind = _UNIT if plain in _UNIT_WORDS else _CAPITAL if bare[0] < 97 else _PLAIN
            ends = bare is not word and word[-1] == 46
            value = self[word] = (xxhash.xxh3_64_intdigest(plain) & ~15) | kind << 1 | ends
            return value
        text = word.decode("utf-8", "replace")
        core = text.strip(_SIGNS)
        plain = core.lower()
        if not core:
            kind = _UNIT if text in ("%", "$", "€", "£") else _NOTHING
        elif _NUMBER.match(core):
            kind = _NUM
        elif plain in UNITS:
            kind = _UNIT
        elif core[0].isupper():
            kind = _CAPITAL
        else:
            kind = _PLAIN
        ends = _ENDS.search(text) is not None
        value = self[word] = (xxhash.xxh3_64_intdigest(plain.encode()) & ~15) | kind << 1 | ends
        return value


_WORDS = remembered(_Words())


def tokens(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words that are tokens, their kinds, and the hashes of their template forms."""
    words = text.split()
    if not words:
        return [], np.zeros(0, np.int64), np.zeros(0, np.uint64)
    packed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    kind = ((packed >> np.uint64(1)) & np.uint64(7)).astype(np.int64)
    starts = np.concatenate(([True], (packed[:-1] & np.uint64(1)) == 1))
    after_number = np.concatenate(([False], kind[:-1] == _NUM))
    kind[(kind == _CAPITAL) & starts] = _PLAIN
    kind[(kind == _UNIT) & ~after_number] = _PLAIN
    form = packed & ~np.uint64(15)
    for k, value in _PLACE.items():
        form[kind == k] = value
    real = np.flatnonzero(kind != _NOTHING)
    if len(real) < len(words):
        words, kind, form = [words[i] for i in real], kind[real], form[real]
    return words, kind, form


def windows(kind: np.ndarray, form: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window, and whether it has enough plain words."""
    n = len(form) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    run = np.full(n, width, np.uint64)
    for i in range(width):
        run = run * _POWER + form[i : n + i]
    plain = np.concatenate(([0], np.cumsum(kind == _PLAIN)))
    return mix64(run).view(np.int64), plain[width:] - plain[:n] >= min(LEAST_PLAIN, (width + 1) // 2)


def _slots(words: list[bytes], kind: np.ndarray, at: int, width: int) -> list[str]:
    """Values of the placeholders, from left to right: windows of equal hash have them at equal places."""
    return [words[at + i].decode("utf-8", "replace").strip(_SIGNS).lower() for i in range(width) if kind[at + i] != _PLAIN]


def _rows(df: DataFrame, keys: list[str], text: str, widths: list[int] | None, bitmap: bytes | None) -> DataFrame:
    """Windows as rows: the keys, position, hash, slots, number of windows of the text.

    With ``widths`` None each text has windows of its own width; with a bitmap only hits become rows.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in df.schema if f.name == k]
    shared = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(shared.value, "<u4") if shared is not None else None
        row, place, code, slots, total, wide = [], [], [], [], [], []
        for i, t in enumerate(texts_of(batch.column(len(keys)))):
            words, kind, form = tokens(t)
            own = [min(WINDOW, len(words))] if len(words) >= LEAST_TOKENS else []
            for width in own if widths is None else widths:
                found, good = windows(kind, form, width)
                if bits is not None:
                    bit = np.mod(found, BITMAP_BITS)
                    good &= ((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).astype(bool)
                for at in np.flatnonzero(good).tolist():
                    row.append(i)
                    place.append(at)
                    code.append(int(found[at]))
                    slots.append(_slots(words, kind, at, width))
                    wide.append(width)
                total += [int(good.sum())] * (len(row) - len(total))
        new = [pa.array(place, pa.int32()), pa.array(code, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(total, pa.int32()), pa.array(wide, pa.int32())]
        kept = [batch.column(k).take(pa.array(row, pa.int32())) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*kept, *new], [*keys, "at", "code", "slots", "total", "width"])

    schema = ", ".join([*fields, "at int, code long, slots array<string>, total int, width int"])
    return map_batches(df.select(*keys, text), each, schema)


def _bitmap(codes: DataFrame) -> bytes:
    """Bits of the window hashes in a map of fixed size."""
    bit = f"pmod(code, {BITMAP_BITS})"
    rows = codes.groupBy(F.expr(f"cast({bit} div 32 as int)").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 32 as int))")).alias("v")
    )
    found = rows.toPandas()
    out = np.zeros(BITMAP_BITS // 32, "<u4")
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return out.tobytes()


def item_classes(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per item: its windows (at, code, numbers of the slots' values), the values in order of first use, and ``form``.

    Items of one ``form`` have one template, and their values come up again at the same places: they are searched
    for as one.  An item is a row as long as its text.
    """
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    window = F.struct("at", "code", "width", "slots")
    whole = _rows(items, ["item"], "text", None, None).groupBy("item", "total").agg(F.array_sort(F.collect_set(window)).alias("whole"))
    valued = whole.withColumn("values", F.array_distinct(F.flatten(F.transform("whole", lambda w: w["slots"]))))

    def numbered(w: Column) -> Column:
        ids = F.transform(w["slots"], lambda v: F.array_position("values", v).cast("int"))
        return F.struct(w["at"].alias("at"), w["code"].alias("code"), w["width"].alias("width"), ids.alias("ids"))

    known = valued.withColumn("windows", F.transform("whole", numbered)).drop("whole")
    form = F.struct(F.xxhash64("windows").alias("x"), F.xxhash64(F.lit(1), "windows").alias("y"))
    return known.withColumn("form", form)


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", coverage: float = COVERAGE, consistent: float = CONSISTENT,
) -> DataFrame:
    """(key, text_hash, item, n_items, n_windows, matched, coverage, same_values) of every document and form that leaks.

    ``item`` is the least item of the form, ``n_items`` their number (``item_classes`` lists them); ``same_values``
    tells that the document has the values of one of them.
    """
    known = stored(item_classes(benchmark, item, item_text))
    least = F.min(F.struct("item", "values", "windows", "total"))
    heads = known.groupBy("form").agg(least.alias("h"), F.count("*").alias("n_items"))
    ask = heads.select("form", "n_items", "h.item", "h.total", "h.values", F.inline("h.windows"))
    ask = stored(ask.withColumnRenamed("at", "item_at"))
    widths = sorted(r["width"] for r in ask.select("width").distinct().collect())  # LEAST_TOKENS to WINDOW
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    hits = _rows(source, ["key", "th"], "text", widths, _bitmap(ask)).drop("total", "width")
    asked = F.transform("ids", lambda i: F.struct(i.alias("id"), F.get("values", i - 1).alias("asked")))
    # one row per place of an alignment, also for repeated rows
    met = hits.join(ask, "code").select(
        "key", "th", "form", "item", "n_items", "total", F.size("values").alias("n_values"), "item_at",
        (F.col("at") - F.col("item_at")).alias("shift"),
        F.zip_with(asked, "slots", lambda a, b: F.struct(a["id"], a["asked"], b.alias("found"))).alias("slots"),
    )
    pair = ["key", "th", "form", "item", "n_items", "total", "n_values"]
    aligned = met.groupBy(*pair, "shift").agg(
        F.collect_set("item_at").alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("slots")))).alias("slots")
    )
    size = F.size("slots")
    agree = F.when(size == 0, 1.0).otherwise(F.size(F.array_distinct(F.transform("slots", lambda s: s["id"]))) / size)
    found = F.xxhash64(F.transform("slots", lambda s: s["found"]))
    fits = aligned.where(agree >= consistent).withColumns(
        {
            "changed": F.exists("slots", lambda s: ~s["asked"].eqNullSafe(s["found"])),
            "found": F.when(size == F.col("n_values"), found),  # every value has one counterpart
        }
    )
    places = fits.select(*pair, "changed", "found", F.explode("places").alias("place"))
    once = places.groupBy(*pair, "place").agg(F.min("changed").alias("changed"), F.max("found").alias("found"))
    told = once.groupBy(*pair).agg(F.count("*").alias("matched"), F.max("changed").alias("changed"), F.max("found").alias("found"))
    share = F.col("matched") / F.col("total")
    members = known.select(F.col("form").alias("_form"), F.xxhash64("values").alias("_values")).distinct()
    some = (F.col("form") == F.col("_form")) & (F.col("found") == F.col("_values"))
    return told.where(share >= coverage).join(members, some, "left").select(
        F.col("key").alias(key), F.col("th").alias("text_hash"), F.col("item").alias(item), "n_items",
        F.col("total").cast("long").alias("n_windows"), "matched", share.alias("coverage"),
        (~F.col("changed") | F.col("_form").isNotNull()).alias("same_values"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    name = free_name(docs, "_th")
    bad = stored(leaks(docs, benchmark, key, text).select(F.col("text_hash").alias(name)).distinct())
    return docs.withColumn(name, F.xxhash64(text)).join(bad, name, "left_anti").select(*docs.columns)
