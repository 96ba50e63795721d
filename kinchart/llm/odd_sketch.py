"""Near-duplicates by MinHash bands, odd sketches and an exact check.

A document is the set of its shingles of five words (A-Z in lower case).  Documents with equal sets
are one class, so exact copies cost one row however many there are.  Each class has MinHash samples
in bands that make its bucket keys (144 in 24 bands of six at the threshold of 0.85, 145 in 29 bands
of five at 0.80: see ``shape``), and all samples are folded into an odd sketch, a bitmap of parities.  The exclusive or of two sketches counts the samples that differ, which tells
high similarities apart well.  A second bitmap holds the parities of the full set: two of them never
differ in more bits than the sets have shingles apart, so too many bits rule a pair out for certain.
Only pairs that neither rules out are checked on full sets.  A pair at the threshold misses all bands
with a chance of 1e-5, less above it.

Links are what the components need, so pairs already in one component are not compared again:

1. every member of a bucket against the bucket's first one;
2. twice: in buckets with more than one component, the best links between components (a spanning
   forest by sketch similarity);
3. in buckets that still have more than one component, every pair across components.

In 2 and 3 only members outside the bucket's largest component meet all others.  Members and outsiders
are cut in blocks of about ``BLOCK``, and each pair of blocks is a group of its own: what a task holds
has a bound, and rows grow with outsiders times members over ``BLOCK``.  Full sets are read for classes in shared buckets only.

Defined cases: null and blank texts have no shingles, are linked with nothing and kept; fewer than
five words are one shingle; a null id is never a component's name, and such a row is kept only where
its component has no id at all; repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import free_name, map_batches, map_partitions, mix64, remembered, stored, texts_of
from kinchart.llm.components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
BITS = 512
# Bits of the parities of the full set.
SET_BITS = 2048
# A pair at the threshold may miss all bands with this chance.
MISSED = 1.2e-5
MOST_SAMPLES = 150
# The sketches rule a pair out this many deviations under the threshold.
DEVIATIONS = 4.5
BLOCK = 2048
BITMAP_BITS = 2**24
# Words whose hash a worker remembers.
MEMORY = 150_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWER = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(20_240_607)
_MASKS = _draw.integers(0, 2**32, SAMPLES, np.uint32)
_FACTORS = _draw.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
# What thresholds other than 0.85 need beyond these.
_MASKS = np.append(_MASKS, _draw.integers(0, 2**32, MOST_SAMPLES - SAMPLES, np.uint32))
_FACTORS = np.append(_FACTORS, _draw.integers(0, 2**32, MOST_SAMPLES - SAMPLES, np.uint32) | np.uint32(1))
_PLACE = np.arange(MOST_SAMPLES, dtype=np.uint64) << np.uint64(32)


def shape(percent: int) -> tuple[int, int]:
    """Bands and their rows at a threshold: as many rows as the samples allow if a pair may hardly miss all bands."""
    for rows in range(ROWS, 0, -1):
        alike = min(percent / 100, 0.999) ** rows
        count = max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-alike)))
        if count * rows <= MOST_SAMPLES:
            return count, rows
    raise ValueError(f"no bands for a threshold of {percent} per cent")


class _Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = remembered(_Words())


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; all words as one run if they are fewer."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    run = hashes[: len(parts) - width + 1].copy()
    for i in range(1, width):
        run = run * _POWER + hashes[i : len(parts) - width + 1 + i]
    return np.unique(mix64(run + np.uint64(width)))


def samples(found: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """MinHash samples of a set of hashes."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 256):
        block = x[at : at + 256, None] ^ _MASKS[:count]
        block *= _FACTORS[:count]
        np.minimum(least, block.min(0), out=least)
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = least.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(keys) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix64(out * _POWER + keys[:, i])
    return out.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as whole numbers of 64 bits."""
    bit = mix64(_PLACE[: len(least)] | least.astype(np.uint64)) % np.uint64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Parity bitmap of the whole set."""
    odd = np.bincount((found % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similarity(differing: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """Similarity that the number of differing bits of two sketches stands for."""
    inside = np.maximum(1 - 2 * np.asarray(differing, float) / BITS, 1e-9)
    return 1 + (BITS / 2) * np.log(inside) / (2 * count)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ; unsigned, for numpy counts the bits of absolute values."""
    both = np.ascontiguousarray(x ^ y).view(np.uint64)
    return sum(np.bitwise_count(both[..., i]).astype(np.int16) for i in range(both.shape[-1]))


def most_bits(percent: int) -> int:
    """Most differing bits of a pair that is not ruled out."""
    count, alike = math.prod(shape(percent)), percent / 100
    ruled_out = alike - DEVIATIONS * math.sqrt(alike * (1 - alike) / count)
    return int(np.flatnonzero(similarity(np.arange(BITS // 2), count) >= ruled_out).max())


def _described(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row: id, hash of the text, number of shingles, class, sketch, bands."""
    count, in_band = shape(percent)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, names, sketches, keys = [], [], [], []
        for t in texts_of(batch.column(2)):
            found = shingles(t, words)
            n.append(len(found))
            names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            least = samples(found, count * in_band) if len(found) else None
            sketches.append(None if least is None else np.concatenate((sketch(least), parity(found))))
            keys.append(None if least is None else bands(least, in_band))
        long_list = pa.list_(pa.int64())
        new = [pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, long_list), pa.array(keys, long_list)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["key", "th", "n", "cid", "sketch", "bands"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return map_batches(source, each, "key long, th long, n long, cid binary, sketch array<long>, bands array<long>")


def _bitmap(hashes: DataFrame) -> bytes:
    """Bits of the hashes in a map of fixed size: its rows do not grow with the data."""
    bit = f"pmod(th, {BITMAP_BITS})"
    rows = hashes.groupBy(F.expr(f"cast({bit} div 32 as int)").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 32 as int))")).alias("v")
    )
    found = rows.toPandas()
    out = np.zeros(BITMAP_BITS // 32, "<u4")
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return out.tobytes()


def _sets(docs: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """Full sets of the wanted classes: a bitmap of their texts' hashes spares the other texts the work."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(wanted))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(shared.value, "<u4")
        bit = np.mod(batch.column(0).to_numpy(), BITMAP_BITS)
        hit = np.flatnonzero((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1)
        sets = [shingles(t, words) for t in texts_of(batch.column(1).take(pa.array(hit)))]
        names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "hashes"]
        )

    source = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # copies of a class are folded in each task, before anything is dealt by class
    once = map_batches(source, each, "cid binary, hashes binary").groupBy("cid").agg(F.first("hashes").alias("hashes"))
    return stored(once.join(wanted.select("cid"), "cid", "left_semi"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    # sets are long: only those of the pairs' classes move
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    of = sets.join(ends, "cid", "left_semi")
    left = pairs.join(of.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(of.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
        return batch.select([0, 1]).filter(pa.array(keep))

    return map_batches(both.select("a", "b", "x", "y"), each, "a binary, b binary")


def _live(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, cid) of the buckets that hold several classes, one bucket of every set of members; and these classes.

    Near copies share most of their bands, and one bucket tells as much as all of equal members.  The
    buckets are counted first; a bitmap of the shared ones spares most classes the joins.
    """
    spark = classes.sparkSession
    keys = classes.select(F.explode("bands").alias("bucket"))
    shared = stored(keys.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"))
    bitmap = spark.sparkContext.broadcast(_bitmap(shared.withColumnRenamed("bucket", "th")))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(bitmap.value, "<u4")
        lists = batch.column(0)
        keys, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        bit = np.mod(keys, BITMAP_BITS)
        hit = ((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).astype(bool)
        before = np.concatenate(([0], np.cumsum(hit))).astype(np.int32)[ends - ends[0]]
        left = pa.ListArray.from_arrays(pa.array(before), pa.array(keys[hit]))
        columns = [left, *batch.columns[1:]]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(np.diff(before) > 0))

    fields = ["bands", "cid", "th", "sketch", "n"]
    schema = "bands array<long>, cid binary, th long, sketch array<long>, n long"
    some = stored(map_batches(classes.select(*fields), each, schema))
    members = stored(some.select(F.explode("bands").alias("bucket"), "cid").join(shared, "bucket", "left_semi"))
    parity = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"x{i}") for i in range(2)]
    alike = members.groupBy("bucket").agg(F.count("*").alias("c"), *parity).groupBy("c", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    live = stored(members.join(alike.select("bucket"), "bucket", "left_semi"))
    return live, stored(some.drop("bands").join(live.select("cid").distinct(), "cid", "left_semi"))


def _differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def _starred(live: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members with its first one that the sketches do not rule out."""
    first = live.groupBy("bucket").agg(F.min("cid").alias("a"))
    pairs = live.join(first, "bucket").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    of = classes.select("cid", "sketch", "n")
    both = pairs.join(of.toDF("a", "x", "n"), "a").join(of.toDF("b", "y", "m"), "b")
    words = BITS // 64
    near = _differing(F.slice("x", 1, words), F.slice("y", 1, words)) <= most_bits(percent)
    apart = _differing(F.slice("x", words + 1, SET_BITS // 64), F.slice("y", words + 1, SET_BITS // 64))
    return both.where(near & (apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))).select("a", "b")


def _dealt(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (bucket, cid, comp) of buckets with more than one component, once per pair of blocks they are in: all in
    a home block that meets each block of guests, those outside the largest component as guests of each home block, too.
    """
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    facts = sizes.groupBy("bucket").agg(
        F.sum("c").alias("size"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("largest")
    )
    blocks, guest_blocks = (F.ceil(n / BLOCK).cast("int") for n in (F.col("size"), F.col("size") - F.col("largest.c")))
    open_ones = facts.where("comps > 1").select(
        "bucket", F.col("largest.comp").alias("most"), blocks.alias("blocks"), guest_blocks.alias("guest_blocks")
    )
    members = named.join(open_ones, "bucket").join(classes.select("cid", "sketch", "n"), "cid")
    own, own_guest = (F.pmod(F.xxhash64("cid"), F.col(n)).cast("int") for n in ("blocks", "guest_blocks"))
    outside = F.col("comp") != F.col("most")

    def place(home: Column, guest: Column) -> Column:
        return F.struct(home.alias("home"), guest.alias("guest"))

    as_home = F.transform(F.sequence(F.lit(0), F.col("guest_blocks") - 1), lambda g: place(own, g))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda h: place(h, own_guest))
    placed = members.select(
        "bucket", F.explode(F.when(outside, F.array_union(as_home, as_guest)).otherwise(as_home)).alias("at"),
        own.alias("own"), own_guest.alias("own_guest"), outside.alias("outside"), "cid", "comp", "sketch", "n",
    )
    is_home = F.col("at.home") == F.col("own")
    is_guest = F.col("outside") & (F.col("at.guest") == F.col("own_guest"))
    return placed.select(
        "bucket", "at.home", "at.guest", is_home.alias("is_home"), is_guest.alias("is_guest"), "cid", "comp", "sketch", "n"
    )


def _across(live: DataFrame, classes: DataFrame, comps: DataFrame, forest: bool, percent: int) -> DataFrame:
    """Pairs across components of one bucket that the sketches do not rule out; the best ones if ``forest``."""
    named = live.join(comps.toDF("cid", "comp"), "cid", "left")
    named = named.select("bucket", "cid", F.coalesce("comp", "cid").alias("comp"))
    dealt = _dealt(named, classes).repartition("bucket", "home", "guest").sortWithinPartitions("bucket", "home", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            rest += rows
            last = rest[-1][:3]
            cut = len(rest)
            while cut and rest[cut - 1][:3] == last:
                cut -= 1
            yield from _pairs(rest[:cut], forest, percent)
            rest = rest[cut:]
        yield from _pairs(rest, forest, percent)

    return map_partitions(dealt, run, "a binary, b binary").distinct()


def _pairs(rows: list[tuple], forest: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Of whole groups of (bucket, home block, guest block), side by side: pairs of guests with the home members."""
    most = most_bits(percent)
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][:3] == rows[at][:3]:
            end += 1
        group, at = rows[at:end], end
        home = [r for r in group if r[3]]
        guests = [r for r in group if r[4]]
        if not home or not guests:
            continue
        code = {c: i for i, c in enumerate(dict.fromkeys(r[6] for r in group))}
        words = BITS // 64
        right, right_n = (np.array([r[i] for r in home], np.int64) for i in (7, 8))
        right_comp = np.array([code[r[6]] for r in home])
        chosen: list[tuple[int, int, int]] = []
        for start in range(0, len(guests), 128):
            part = guests[start : start + 128]
            left, left_n = (np.array([r[i] for r in part], np.int64) for i in (7, 8))
            bits = differing(left[:, None, :words], right[None, :, :words])
            other = np.array([code[r[6]] for r in part])[:, None] != right_comp
            g, h = np.nonzero(other & (bits <= most))
            apart = differing(left[g, words:], right[h, words:]).astype(np.int64)
            near = apart * (100 + percent) <= (left_n[g] + right_n[h]) * (100 - percent)
            g, h = g[near], h[near]
            found = list(zip(bits[g, h].tolist(), (start + g).tolist(), h.tolist()))
            if forest:  # the best links so far and the new ones: no more is held than a forest and one part
                chosen = _forest(chosen + found, [code[r[6]] for r in guests], right_comp.tolist(), len(code))
            else:
                yield from _named(found, guests, home)
        yield from _named(chosen, guests, home)


def _forest(found: list[tuple[int, int, int]], left: list[int], right: list[int], n: int) -> list[tuple[int, int, int]]:
    """The best links (bits, guest, home) that span what all links join, among ``n`` components."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    chosen = []
    for item in sorted(found):
        i, j = root(left[item[1]]), root(right[item[2]])
        if i != j:
            parent[i] = j
            chosen.append(item)
    return chosen


def _named(found: list[tuple[int, int, int]], guests: list[tuple], home: list[tuple]) -> Iterator[pa.RecordBatch]:
    out = {tuple(sorted((guests[g][5], home[h][5]))) for _, g, h in found}
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) with more links."""
    named = comps.select(F.col("node"), F.col("comp"))
    ends = links.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    fresh = joined.join(named.select("node"), "node", "left_anti")
    moved = named.join(joined.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(moved.union(fresh))


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_shingles``, ``component_id``, ``kept`` and ``text_hash``."""
    rows = stored(_described(docs, key, text, words, percent))
    classes = stored(
        rows.where("n > 0").groupBy("cid").agg(
            F.min("key").alias("key"), F.count("*").alias("copies"), F.min("th").alias("th"),
            F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("n").alias("n"),
        )
    )
    live, known = _live(classes)  # no other class is looked at from here on
    sets = _sets(docs, known.select("cid", "th"), text, words)

    tested = stored(_starred(live, known, percent))
    comps = components(stored(_confirmed(tested, sets, percent)))
    for forest in (True, True, False):
        found = stored(_across(live, known, comps, forest, percent))
        if found.isEmpty():  # no bucket has a pair left across components
            break
        pairs = stored(found.join(tested, ["a", "b"], "left_anti"))
        links = stored(_confirmed(pairs, sets, percent))
        if not links.isEmpty():
            comps = _merged(comps, links)
        tested = tested.union(pairs)

    linked = classes.select("cid", "key", "copies").join(comps.toDF("cid", "comp"), "cid", "left")
    grouped = linked.where("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "cid"))
    least = grouped.groupBy("comp").agg(F.min("key").alias("component_id"))
    answer = grouped.join(least, "comp").select("cid", "component_id")
    joined = rows.select("key", "n", "cid", "th").join(answer, "cid", "left")
    name = F.coalesce("component_id", "key")
    return joined.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), name.alias("component_id"),
        F.coalesce(F.col("key") == name, name.isNull()).alias("kept"), F.col("th").alias("text_hash"),
    )


def _without(keyed: DataFrame, gone: DataFrame, key: str, th: str) -> DataFrame:
    """The rows that ``gone`` does not list.  Fewer go than stay: a bitmap of those that go leaves most texts where they
    are, and only rows that hit it are dealt to meet the list.
    """
    spark = keyed.sparkSession
    one = F.coalesce(F.col(key), F.lit(0)).bitwiseXOR(F.col(th))
    shared = spark.sparkContext.broadcast(_bitmap(gone.select(one.alias("th"))))
    hash_ = free_name(keyed, "_one")

    def hits(wanted: bool):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = np.frombuffer(shared.value, "<u4")
            bit = np.mod(batch.column(batch.num_columns - 1).to_numpy(), BITMAP_BITS)
            hit = ((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).astype(bool)
            return batch.select(range(batch.num_columns - 1)).filter(pa.array(hit == wanted))

        return map_batches(keyed.withColumn(hash_, one), each, keyed.schema)

    some = hits(True)
    same = some[key].eqNullSafe(gone[key]) & (some[th] == gone[th])
    return hits(False).unionByName(some.join(gone, same, "left_anti"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of every component: that of the smallest id, and one of its copies if the row is repeated."""
    name, there = free_name(docs, "_key"), free_name(docs, "_th")
    marks = stored(near_copies(docs, key, text, percent=percent).select(F.col(key).alias(name), "kept", F.col("text_hash").alias(there)))
    known = F.col(name).isNotNull()
    # an id may come with several texts, of which some go
    gone = stored(marks.where(~F.col("kept")).select(name, there).distinct())
    again = stored(marks.where(F.col("kept") & known).groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name))
    keyed = docs.withColumns({name: F.col(key).cast("long"), there: F.xxhash64(text)})
    left = _without(keyed, gone, name, there)
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(again, name, "left_semi").dropDuplicates([key, text])
    return left.join(again, name, "left_anti").select(*docs.columns).union(repeated.select(*docs.columns))
