"""Strings that occur twice or more in the corpus, cut out: a suffix sort to a bounded depth, by a sampled cover.

Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else, in the
same document or another one.  The steps are those of a difference-cover suffix sort; they need
no order beyond ``length`` bytes, so names are digests of strings of bounded length instead of ranks.

* **Sampled suffixes.** A window of ``WINDOW`` places slides over the text; the place whose eight
  bytes have the least hash is sampled (about one in 32).  What is sampled before a place
  depends only on the string that starts there: all copies of a string have their sample at the same
  distance, which is what the cover of a difference-cover sort is for.  Each start has one sample;
  the starts of a sample are a short run of places.
* **Names.** A sample's core, the bytes that every string over its starts contains, is named first.
  Cores that occur once rule out all their starts.
* **Recursion on what is left.** Samples with a core that occurs twice are named by their whole
  context: all bytes of the strings over their starts.  Equal contexts settle all their starts.
* **Remaining suffixes.** Where contexts of one core differ, at the edges of a passage, every start is
  named by core, bytes before and bytes behind it; one member stands for all of equal context.
  Equal names next to each other are what a comparison of adjacent prefixes finds.

What is shuffled: a number per distinct core and map task, contexts of shared cores, names of the starts
at edges, one short list per document with repeats and the text of such documents, once.  Equal names are
counted in each task first, so a passage in a third of all documents is a few rows.  Two bitmaps of a
fixed size tell most samples that matter from the rest before exact joins; a full one only lets more
rows through.  Texts go through in blocks, a document's marks are merged within the document.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep all bytes; rows repeated with
key and text are occurrences of their own; rows with a null key, or with one key and different texts, are told
apart by their text; the order of rows does not matter; an empty table has an empty result; result columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import free_name, map_batches, map_partitions, stored, texts_of

LENGTH = 400
WINDOW = 64
GRAM = 8
# Places of a text that are looked at together.
BLOCK = 1 << 20
BITMAP_BITS = 2**26
PAGE = 512  # words of a bitmap's page
# Kinds of runs of starts.
CONTEXT, ALONE, START = range(3)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def samples(data: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place): the sampled places, and the starts of whole strings that each stands for."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    parts = []
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at) + window - 1
        grams = np.ndarray(count, "<u8", data[at : at + count + GRAM - 1].tobytes(), strides=(1,)).astype(np.uint64)
        grams ^= grams >> np.uint64(29)
        grams *= _ODD
        # hash, then place: the first of equal ones
        least = (grams & ~_LOW) | np.arange(count, dtype=np.uint64)
        wide = 1
        while wide < window:
            step = min(wide, window - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        parts.append((least & _LOW).astype(np.int64) + at)
    place = np.concatenate(parts)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return first, np.append(first[1:], n) - 1, place[first]


def core_size(length: int, window: int) -> int:
    """Bytes from a sample on that belong to every string it stands for."""
    return length - window + 1


def bitmap(hashes: DataFrame) -> bytes:
    """Bits of the hashes (h) in a map of fixed size: its rows do not grow with the data."""
    bit = f"pmod(h, {BITMAP_BITS})"
    words = hashes.groupBy(F.expr(f"cast({bit} div 64 as int)").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 64 as int))")).alias("v")
    )
    # pages of the map are put together where the words are: the driver gets a few thousand rows of bytes
    of = F.struct((F.col("w") % PAGE).alias("at"), "v")
    lists = words.groupBy(F.expr(f"w div {PAGE}").alias("page")).agg(F.collect_list(of).alias("words"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = []
        for row in batch.column(1):
            page = np.zeros(PAGE, "<i8")
            page[row.values.field(0).to_numpy()] = row.values.field(1).to_numpy()
            pages.append(page.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.binary())], ["page", "bits"])

    out = bytearray(BITMAP_BITS // 8)
    for r in map_batches(lists.select(F.col("page").cast("int").alias("page"), "words"), each, "page int, bits binary").toLocalIterator():
        out[r["page"] * PAGE * 8 : (r["page"] + 1) * PAGE * 8] = r["bits"]
    return bytes(out)


def _in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = np.mod(hashes, BITMAP_BITS)
    return ((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _cores(text: memoryview, place: np.ndarray, size: int) -> np.ndarray:
    return _signed([xxhash.xxh3_64_intdigest(text[j : j + size]) for j in place.tolist()])


def _keys(key: str, text: str) -> tuple[Column, Column]:
    """Two hashes that name a row by key and text."""
    return F.xxhash64(F.col(key), F.col(text)), F.xxhash64(F.col(text), F.col(key), F.lit(1))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    k, th = _keys(key, text)
    return docs.select(k.alias("k"), th.alias("th"), F.col(text).alias("text"))


def _shared_cores(keyed: DataFrame, length: int, window: int) -> DataFrame:
    size = core_size(length, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts_of(batch.column(0)):
                place = samples(np.frombuffer(t, np.uint8), length, window)[2]
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array(_cores(memoryview(t), place, size))], ["h"])

    found = map_partitions(keyed.where(F.octet_length("text") >= length).select("text"), run, "h long")
    return found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def _contexts(keyed: DataFrame, cores: DataFrame, length: int, window: int) -> DataFrame:
    """(k, th, first, last, core, x, y): samples whose core occurs twice, with the name (x, y) of their context."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap(cores))
    size = core_size(length, window)
    names = ["k", "th", "first", "last", "core", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, "<u8")
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)))
            for k, th, t in keys:
                first, last, place = samples(np.frombuffer(t, np.uint8), length, window)
                view = memoryview(t)
                core = _cores(view, place, size)
                at = np.flatnonzero(_in(words, core))
                if not len(at):
                    continue
                first, last = first[at], last[at]
                digests = [xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                same = [pa.array(np.full(len(at), v, np.int64)) for v in (k, th)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(first), pa.array(last), pa.array(core[at]), *_halves(digests)], names)

    long_texts = keyed.where(F.octet_length("text") >= length)
    return map_partitions(long_texts, run, ", ".join(f"{n} long" for n in names))


def _edges(keyed: DataFrame, wanted: DataFrame, length: int, window: int) -> DataFrame:
    """(k, th, start, x, y): the name of every start of the wanted samples (k, th, first)."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.expr("k ^ th ^ shiftleft(first, 7)").alias("h"))))
    size = core_size(length, window)
    fields = {"k": pa.int64(), "th": pa.int64(), "first": pa.int64(), "before": pa.int64(), "core": pa.binary(), "edge": pa.binary()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, "<u8")
        for batch in batches:
            rows = []
            for k, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                first, last, place = samples(np.frombuffer(t, np.uint8), length, window)
                at = np.flatnonzero(_in(words, k ^ th ^ (first << 7)))
                for a, b, j in zip(first[at].tolist(), last[at].tolist(), place[at].tolist()):
                    core = xxhash.xxh3_128_digest(t[j : j + size])
                    rows.append((k, th, a, j - a, core, t[a:j] + t[j + size : b + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), fields.values())], list(fields))

    rest = length - size

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, digests = [], []
        for k, th, a, before, core, edge in zip(*[c.to_pylist() for c in batch.columns]):
            # the string that starts i places on: what is left before the sample, the core, the rest behind it
            for i in range(len(edge) - rest + 1):
                digests.append(xxhash.xxh3_128_digest(core + bytes([before - i]) + edge[i : i + rest]))
                keys.append((k, th, a + i))
        columns = [pa.array(c, pa.int64()) for c in zip(*keys)]
        return pa.RecordBatch.from_arrays([*columns, *_halves(digests)], ["k", "th", "start", "x", "y"])

    long_texts = keyed.where(F.octet_length("text") >= length)
    samples_of = map_partitions(long_texts, found, "k long, th long, first long, before long, core binary, edge binary")
    exact = samples_of.join(wanted, ["k", "th", "first"], "left_semi")
    return map_batches(exact.select(*fields), named, "k long, th long, start long, x long, y long")


SPANS = "array<struct<start:bigint,end:bigint>>"


def repeated_spans(keyed: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(k, th, spans): the stretches that go, of the documents that have some."""
    if window + GRAM - 1 > length or window > 255:
        raise ValueError("the window of samples is too wide")
    contexts = stored(_contexts(keyed, stored(_shared_cores(keyed, length, window)), length, window))
    one = F.struct("k", "th", "first", "last")
    named = stored(
        contexts.groupBy("x", "y").agg(F.count("*").alias("n"), F.first("core").alias("core"), F.min(one).alias("one"))
    )
    # cores of several contexts, one of them at least found once: their starts are compared one by one
    cores = named.groupBy("core").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1")
    wanted = stored(named.join(cores, "core", "left_semi").select("one.*"))
    starts = stored(_edges(keyed, wanted.select("k", "th", "first"), length, window))
    repeated = starts.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    again = starts.join(repeated, ["x", "y"], "left_semi").select("k", "th", F.col("start").alias("first"), F.col("start").alias("last"))
    runs = (
        contexts.select("k", "th", "first", "last", F.lit(CONTEXT).alias("kind"))
        .union(named.where("n = 1").select("one.*", F.lit(ALONE).alias("kind")))
        .union(again.withColumn("kind", F.lit(START)))
    )
    lists = runs.groupBy("k", "th").agg(F.collect_list(F.struct("first", "last", "kind")).alias("runs"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for row in batch.column(2):
            cut = covered(list(zip(*[row.values.field(i).to_pylist() for i in range(3)])), length)
            found.append([{"start": a, "end": b} for a, b in cut])
        kept = pa.array([bool(f) for f in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, kind)], ["k", "th", "spans"]).filter(kept)

    return map_batches(lists, each, f"k long, th long, spans {SPANS}")


def covered(runs: list[tuple[int, int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of the repeated strings that start in the runs.

    Starts of a run of kind ``CONTEXT`` are repeated unless the same run is there as ``ALONE``; those
    of kind ``START`` are repeated.
    """
    alone = {(a, b) for a, b, kind in runs if kind == ALONE}
    out: list[list[int]] = []
    for a, b, kind in sorted(runs):
        if kind == ALONE or kind == CONTEXT and (a, b) in alone:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (start and end of each removed stretch, in bytes) and ``kept_bytes``."""
    added = {"n_bytes": "bigint", "spans": SPANS, "kept_bytes": "binary"}
    kept = [c for c in docs.columns if c.lower() not in added]
    k, th, of = (free_name(docs, n) for n in ("_k", "_th", "_text"))
    found = stored(repeated_spans(_keyed(docs, key, text), length, window))
    # most documents have no repeat and stay where they are; only the others are dealt to meet their spans
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(F.expr("k ^ th").alias("h"))))
    first, second = _keys(key, text)
    hashed = docs.select(*kept, first.alias(k), second.alias(th), F.col(text).alias(of))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def touched(batch: pa.RecordBatch) -> np.ndarray:
        both = [batch.column(batch.num_columns - i).to_numpy() for i in (3, 2)]
        return _in(np.frombuffer(shared.value, "<u8"), both[0] ^ both[1])

    def to_meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(touched(batch)))

    def cut(columns: list[pa.Array], texts: list[bytes], spans: list[list[dict]]) -> pa.RecordBatch:
        rest = []
        for t, found in zip(texts, spans):
            ends, starts = [0, *[s["end"] for s in found]], [*[s["start"] for s in found], len(t)]
            rest.append(b"".join(t[e:s] for e, s in zip(ends, starts)) if found else t)
        new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *new], [*kept, *added])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~touched(batch)))
        texts = texts_of(batch.column(batch.num_columns - 1))
        return cut(batch.columns[:-3], texts, [[] for _ in texts])

    def met(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [s or [] for s in batch.column(batch.num_columns - 1).to_pylist()]
        return cut(batch.columns[:-2], texts_of(batch.column(batch.num_columns - 2)), spans)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    schema = ", ".join(kinds + [f"{n} {t}" for n, t in added.items()])
    meeting = map_batches(hashed, to_meet, hashed.schema).join(found.toDF(k, th, "spans"), [k, th], "left")
    return map_batches(hashed, whole, schema).unionByName(map_batches(meeting.select(*kept, of, "spans"), met, schema))
