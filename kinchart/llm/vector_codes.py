"""Vector compression: product codes whose nearest entries are found by an integer Walsh-Hadamard transform.

Each component x becomes the whole number floor(1024 * x).  A vector is cut in equal consecutive
parts; a part becomes the number of the nearest entry of its codebook.  Codebooks start as the
parts of the vectors with the least keys and are refined in rounds of assignment and mean.

Nearest entries: part and entries are padded with zeros to a power of two and transformed; the
transform keeps squared distances but for a factor, the padded length.  Coefficients go in sequency
order (number of sign changes).  After some of them the most promising entry of each part is
measured in full, and every entry whose sum so far is larger can no longer win; the rest go on with
the next coefficients, fewer at each step.  All of it is whole numbers: 32 bits where the data's
largest component and the padded length leave room, else 64, else unbounded ones.

Only codebooks (entries times dimensions numbers) reach the driver.  A round is one pass over the
vectors: every task adds its parts up per entry before anything is shuffled.

Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; whole
numbers beyond 2^62 count as 2^62 and error sums beyond a long as the largest long; vectors shorter
than the longest one, rounded up to a multiple of the parts, count as padded with zeros (an empty
vector is all zeros); with fewer vectors than entries the codebooks are shorter; equal keys start
codebooks in the order of their components; a null key comes last; repeated rows are rows of their
own; an empty table has an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import map_partitions, stored

SCALE = 1024
LARGEST = 2**62
LONG = 2**63 - 1
# Parts that are measured side by side.
ROWS = 64
# Components that a row of sums carries.
CHUNK = 16


def walsh(values: np.ndarray, length: int) -> np.ndarray:
    """Walsh-Hadamard transform of each row, padded with zeros to ``length``, in sequency order."""
    out = np.zeros((len(values), length), values.dtype)
    out[:, : values.shape[1]] = values
    return _butterflies(out)[:, sequency(length)]


def _butterflies(rows: np.ndarray) -> np.ndarray:
    half, shape = 1, rows.shape
    while half < shape[1]:
        pairs = rows.reshape(shape[0], -1, 2, half)
        rows = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(shape)
        half *= 2
    return rows


def sequency(length: int) -> np.ndarray:
    """Rows of the transform by their number of sign changes."""
    signs = _butterflies(np.eye(length, dtype=np.int8))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def padded(width: int) -> int:
    return 1 << max(0, width - 1).bit_length()


def number_type(largest: int, length: int) -> type:
    """Smallest kind of number that holds every sum of squared differences."""
    most = 4 * length * length * largest * largest
    return np.int32 if most < 2**31 else np.int64 if most < 2**54 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part the nearest entry, the first one on ties, and the squared distance.

    Both are transformed.  The distances are those of the transforms: scaled by the length.
    """
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    for at in range(0, len(parts), ROWS):
        index[at : at + ROWS], distance[at : at + ROWS] = _nearest(parts[at : at + ROWS], entries)
    return index, distance


def _nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = parts.shape[1]
    columns = np.ascontiguousarray(entries.T)
    sums = np.zeros((len(parts), len(entries)), parts.dtype)
    apart = np.empty_like(sums)
    # half the coefficients for all entries side by side: fewer eliminate too little to pay for the picking
    half = (length + 1) // 2
    for k in range(half):
        np.subtract(parts[:, k, None], columns[k], out=apart)
        np.multiply(apart, apart, out=apart)
        sums += apart
    promising = entries[sums.argmin(1)]
    bound = ((parts - promising) ** 2).sum(1, dtype=parts.dtype)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for k in range(half, length):
        apart = parts[row, k] - entries[entry, k]
        sums += apart * apart
        if k % 2:
            alive = np.flatnonzero(sums <= bound[row])
            row, entry, sums = row[alive], entry[alive], sums[alive]
    alive = np.flatnonzero(sums <= bound[row])
    row, entry, sums = row[alive], entry[alive], sums[alive]
    # the entry measured in full is among those left, so every part has one
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(sums, first)
    best = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(first, len(row)))))
    best = best[np.append(True, row[best][1:] != row[best][:-1])]
    return entry[best], least


@dataclass(frozen=True)
class Codebooks:
    """One array of whole numbers (entries, width) per part; ``largest`` bounds every component of the data."""

    parts: list[np.ndarray]
    width: int
    largest: int

    @property
    def kind(self) -> type:
        return number_type(self.largest, padded(self.width))

    def transformed(self) -> list[np.ndarray]:
        return [walsh(p.astype(self.kind), padded(self.width)) for p in self.parts]

    def digest(self) -> str:
        """SHA-256 of all components in order of part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for p in self.parts for x in p.ravel()).encode()).hexdigest()


def _whole_numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, ints) of the vectors that are kept."""
    source = vectors.select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")
    ).where("v is not null and not exists(v, x -> x is null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            at = offsets - offsets[0]
            keep = bad[at[1:]] == bad[at[:-1]]
            with np.errstate(over="ignore"):
                scaled = np.floor(np.where(np.isfinite(flat), flat, 0) * SCALE)
            huge = np.abs(scaled) >= float(LARGEST)
            ints = np.where(huge, 0, scaled).astype(np.int64)
            ints[huge] = np.where(scaled[huge] > 0, LARGEST, -LARGEST)
            out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ints))
            columns = [batch.column(0), batch.column(1), out]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "ints"]).filter(pa.array(keep))

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return map_partitions(source, run, f"key {kinds['key']}, label {kinds['label']}, ints array<bigint>")


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``size``."""
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _assigned(ints: np.ndarray, books: Codebooks, entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index, exact squared distance) of each row and part."""
    length, w = padded(books.width), books.width
    pairs = []
    for p, of in enumerate(entries):
        index, scaled = nearest(walsh(ints[:, p * w : (p + 1) * w].astype(books.kind), length), of)
        pairs.append((index, scaled // length))
    return np.stack([i for i, _ in pairs], 1), np.stack([d.astype(object) for _, d in pairs], 1)


def _refined(kept: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry the floored mean of its parts: one pass, summed per task first."""
    n_parts, w = len(books.parts), books.width
    chunks = max(1, -(-w // CHUNK))
    schema = "part int, entry int, chunk int, n bigint, " + ", ".join(f"low{i} bigint, high{i} bigint" for i in range(CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.transformed()
        wide = object if books.kind is object else np.int64
        sums = [np.zeros((len(p), chunks * CHUNK), wide) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _matrix(batch.column(0), n_parts * w)
            index, _ = _assigned(ints, books, entries)
            for p in range(n_parts):
                order = np.argsort(index[:, p], kind="stable")
                found, first, n = np.unique(index[order, p], return_index=True, return_counts=True)
                counts[p][found] += n
                if w:
                    sums[p][found, :w] += np.add.reduceat(ints[order, p * w : (p + 1) * w].astype(wide), first, axis=0)
        for p in range(n_parts):
            used = np.flatnonzero(counts[p])
            if not len(used):
                continue
            for c in range(chunks):
                part = sums[p][used, c * CHUNK : (c + 1) * CHUNK]
                split = [half[:, i].astype(np.int64) for i in range(CHUNK) for half in (part & 0xFFFFFFFF, part >> 32)]
                columns = [np.full(len(used), p, np.int32), used.astype(np.int32), np.full(len(used), c, np.int32), counts[p][used]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns + split], [f.split()[0] for f in schema.split(", ")])

    added = map_partitions(kept.select("ints"), run, schema).groupBy("part", "entry", "chunk")
    names = ["n", *[f"{half}{i}" for i in range(CHUNK) for half in ("low", "high")]]
    fresh = [p.copy() for p in books.parts]
    # entries times dimensions numbers, however many vectors there are
    for r in added.agg(*[F.sum(n).alias(n) for n in names]).collect():
        at = r["chunk"] * CHUNK
        for i in range(min(CHUNK, w - at)):
            fresh[r["part"]][r["entry"], at + i] = ((r[f"high{i}"] << 32) + r[f"low{i}"]) // r["n"]
    return Codebooks(fresh, w, books.largest)


def train(kept: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks of whole-number vectors (key, ints); none for an empty table."""
    facts = kept.agg(
        F.max(F.size("ints")).alias("size"), F.max(F.array_max("ints")).alias("most"), F.min(F.array_min("ints")).alias("least")
    ).first()
    if facts["size"] is None:
        return None
    width = -(-facts["size"] // parts)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("ints"))
    whole = kept.select("key", F.concat("ints", zeros).alias("ints"))
    first = whole.orderBy(F.col("key").asc_nulls_last(), "ints").limit(entries).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts * width)
    largest = max(abs(facts["most"] or 0), abs(facts["least"] or 0))
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(parts)], width, largest)
    for _ in range(rounds):
        books = _refined(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(key, label, code, error) of whole-number vectors: the codes as hexadecimal digits, the error as a decimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.transformed()
        digits = max(2, len(f"{max(len(p) for p in books.parts) - 1:x}"))
        for batch in batches:
            if not batch.num_rows:
                continue
            index, apart = _assigned(_matrix(batch.column(2), len(books.parts) * books.width), books, entries)
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
            error = [min(int(sum(row)), LONG) for row in apart]
            columns = [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return map_partitions(kept, run, f"key {kinds['key']}, label {kinds['label']}, code string, error bigint")


def vector_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> DataFrame:
    """Per kept vector: its key, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``."""
    kept = stored(_whole_numbers(vectors, key, vector, label))
    books = train(kept, parts, entries, rounds)
    if books is None:
        coded, digest = kept.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), ""
    else:
        coded, digest = stored(encode(kept, books)), books.digest()
    # labels are few rows beside the vectors; stored, their size decides how they are joined
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = stored(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return joined.select(
        F.col("key").alias(key), F.col("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
