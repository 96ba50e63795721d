"""Token ids as binary shards with a minimal perfect hash index.

A shard is two files.  ``.ids`` holds the ids of its documents one after another, nothing else
(little-endian; two bytes each where the vocabulary allows, else four).  ``.idx`` holds, as arrays
behind a header of whole numbers:

    magic, documents, distinct keys, hash levels, bytes of an id | bits of each level | bit words | ranks before each word |
    fingerprint and first document of each slot | offset of each document (one more than documents) |
    key of each document | whether the document has a key

The index is a minimal perfect hash in levels: in each level a key hashes to one bit; keys alone on
their bit keep it, the others go to the next level.  The rank of a key's bit is its slot, so a
lookup costs a few reads whatever the size; the fingerprint in the slot turns foreign keys away.

Documents are dealt to shards by ranges of the key, so shards follow each other in key order.  Every
shard is written by one task as a stream (only its index is held), first under a name of the attempt
and then renamed, so a repeated task replaces its own work.

Defined cases: a null text is empty and has its end id only; documents without a key come first, are
stored, and are not in the index; documents of one key (repeated rows) lie side by side, the
slot names the first; an empty table gives no shard.  Extra columns are not stored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinchart.llm.common import map_partitions, mix64, shared_folder, stored, texts_of

END_ID = 1
ROWS_A_SHARD = 10_000
MAGIC = 0x4B43494458
# Words whose ids a worker remembers; beyond that it starts anew.
MEMORY = 800_000
# New words are encoded in runs of this many.
RUN = 4096
_MANIFEST = "shard int, path string, n_docs long, n_ids long, min_key long, max_key long"


class Encoder:
    """Ids of texts as bytes; equal words (between ASCII blanks, which the tokenizer drops) are encoded once."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 2**16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(pieces.values()), bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Runs of letters as one text: each ends with the one piece of it that ends a word."""
        text = b" ".join(words).decode("utf-8")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._one_by_one(words)
        raw, edges = ids.tobytes(), (cuts * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *edges], edges)]

    def _learn(self, new: set[bytes]) -> None:
        """Letters in lower case stand for all their forms, and closing signs are words of their own:
        the tokenizer lowers letters and cuts between letters and signs anyway.
        """
        made, parts = [], set()
        for word in new:
            core = word.lower().rstrip(_CLOSING)
            if core == word:
                parts.add(word)
            elif core and core[-1] in _LETTERS and b"<|" not in word:  # not in a special token
                made.append((word, core, word[len(core) :]))
                parts.add(core)
            else:
                parts.add(word)
        parts.update(tail for _, _, tail in made)
        parts.difference_update(self.known)
        tokenize, kind = self.model.tokenize, "H" if self.kind == "<u2" else "I"
        plain = [w for w in parts if w.isalpha() and w.islower()]  # ASCII letters: the merges are all that is left to do
        self.known.update((w, array(kind, [t.id for t in tokenize(w.decode())]).tobytes()) for w in plain)
        parts.difference_update(plain)
        letters = [w for w in parts if _letters_only(w)]
        others = list(parts.difference(letters))
        self.known.update(zip(others, self._one_by_one(others)))
        for at in range(0, len(letters), RUN):
            part = letters[at : at + RUN]
            self.known.update(zip(part, self._together(part)))
        known = self.known
        for word, core, tail in made:
            known[word] = known[core] + known[tail] if tail else known[core]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = words
        self._learn(new)
        of = self.known.__getitem__
        return [b"".join(map(of, w)) for w in split]


def _letters_only(word: bytes) -> bool:
    """Whether the word is one run of letters for the tokenizer, also after lowering."""
    try:
        text = word.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


_CLOSING = b".,;:!?%$#*&|\"()[]{}"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """The worker's encoder of a tokenizer file: loaded once, kept between tasks."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


@dataclass
class Index:
    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    keyed: np.ndarray
    width: int

    @property
    def kind(self) -> str:
        return f"<u{self.width}"

    @staticmethod
    def build(keys: np.ndarray, keyed: np.ndarray, counts: np.ndarray, width: int) -> Index:
        """``keys`` ascending (those without a key first), ``counts`` ids of each document."""
        mine, first = np.unique(keys[keyed], return_index=True)
        first = first + np.flatnonzero(keyed)[:1].sum()
        left, sizes, words = mine, [], []
        while len(left):
            size = 64 * max(1, -(-2 * len(left) // 64))
            at = _place(left, len(sizes), size)
            taken = np.bincount(at, minlength=size)
            words.append(np.packbits((taken == 1).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel())
            sizes.append(size)
            left = left[taken[at] > 1]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits))[:-1])) if len(bits) else np.zeros(0)
        index = Index(
            np.array(sizes, "<i8"), bits.astype("<u8"), ranks.astype("<u4"), np.zeros(len(mine), "<u4"),
            np.zeros(len(mine), "<u4"), np.concatenate(([0], np.cumsum(counts))).astype("<i8"),
            keys.astype("<i8"), keyed.astype("u1"), width,
        )
        slot = index._slots(mine)
        index.prints[slot] = _fingerprint(mine)
        index.first[slot] = first
        return index

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that no level knows."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(keys[left], level, size) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left, start = left[~hit], start + size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, -1 where the key is not in the shard."""
        keys = np.asarray(keys, np.int64)
        if not len(self.prints):
            return np.full(len(keys), -1, np.int64)
        slot = self._slots(keys)
        known = (slot >= 0) & (self.prints[slot] == _fingerprint(keys))
        return np.where(known, self.first[slot].astype(np.int64), -1)

    def tobytes(self) -> bytes:
        head = np.array([MAGIC, len(self.keys), len(self.prints), len(self.sizes), self.width], "<i8")
        parts = (head, self.sizes, self.words, self.ranks, self.prints, self.first, self.offsets, self.keys, self.keyed)
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def frombytes(raw: bytes) -> Index:
        magic, docs, slots, levels, width = np.frombuffer(raw, "<i8", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not an index of token ids")
        at = 40
        out = []

        def take(kind: str, n: int) -> None:
            nonlocal at
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes

        take("<i8", levels)
        n_words = int(out[0].sum()) // 64
        for kind, n in (("<u8", n_words), ("<u4", n_words), ("<u4", slots), ("<u4", slots), ("<i8", docs + 1), ("<i8", docs), ("u1", docs)):
            take(kind, n)
        return Index(*out, width)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    return (mix64(keys.astype(np.int64).view(np.uint64) ^ seed) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype("<u4")


def _crc32(ids: bytes, kind: str) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(
    docs: DataFrame, tokenizer_file: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, rows_a_shard: int = ROWS_A_SHARD,
) -> DataFrame:
    """Encode all documents into shards below ``folder`` (shared by all executors); gives one row per shard."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    picked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    shards = max(1, -(-docs.count() // rows_a_shard))
    # the row number splits a key that holds very many rows
    dealt = picked.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(
        shards, F.asc_nulls_first("key"), F.asc("row")
    )
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("key"), "row").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, trial = f"{path}/shard-{shard:06d}", f"{path}/attempt-{attempt}"
        keys, keyed, counts, out = [], [], [], None
        for batch in batches:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{trial}.ids")
            of = batch.column(0)
            keys.append(of.fill_null(0).to_numpy(zero_copy_only=False))
            keyed.append(of.is_valid().to_numpy(zero_copy_only=False))
            words = encoder(tokenizer_file)
            end = np.array([end_id], words.kind).tobytes()
            for ids in words.encode(texts_of(batch.column(1))):
                out.write(ids + end)
                counts.append(len(ids) // len(end) + 1)
        if out is None:
            return
        out.close()
        key_of, has = np.concatenate(keys), np.concatenate(keyed)
        with store.open_output_stream(f"{trial}.idx") as file:
            file.write(Index.build(key_of, has, np.array(counts, np.int64), len(end)).tobytes())
        for kind in ("ids", "idx"):
            store.move(f"{trial}.{kind}", f"{name}.{kind}")
        known = key_of[has]
        ends = [known.min(), known.max()] if len(known) else [None, None]
        row = [[shard], [f"{folder}/shard-{shard:06d}"], [len(counts)], [sum(counts)], ends[:1], ends[1:]]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "path", "n_docs", "n_ids", "min_key", "max_key"]
        )

    return stored(map_partitions(ordered, run, _MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """Every stored document, found by its key through the index: key, start among all ids, count, crc32, shard."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before).select("shard", "path", "base")
    spread = placed.repartitionByRange(max(1, manifest.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri, base in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = _open(uri)
                with store.open_input_file(f"{path}.idx") as file:
                    index = Index.frombytes(file.read())
                docs = np.arange(len(index.keys))
                keyed = index.keyed.astype(bool)
                lead = np.where(keyed, index.find(index.keys), docs)
                # documents of one key follow the first of them
                if not np.array_equal(index.keys[lead], index.keys) or (lead > docs).any() or (lead < 0).any():
                    raise ValueError(f"{uri}: the index does not fit its documents")
                counts = np.diff(index.offsets)
                with store.open_input_stream(f"{path}.ids", buffer_size=2**20) as file:
                    crc = [_crc32(file.read(index.width * n), index.kind) for n in counts.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index.keys, pa.int64(), mask=~keyed),
                        pa.array(index.offsets[:-1] + base, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(docs), shard), pa.int32()),
                    ],
                    ["key", "start", "n_tokens", "ids_crc32", "shard"],
                )

    return map_partitions(spread, run, "key long, start long, n_tokens long, ids_crc32 long, shard int")


def fetch(uri: str, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the given keys of one shard by direct access: a lookup and one read for each document."""
    store, path = _open(uri)
    out: dict[int, list[np.ndarray]] = {}
    with store.open_input_file(f"{path}.idx") as file:
        index = Index.frombytes(file.read())
    with store.open_input_file(f"{path}.ids") as file:
        for key, doc in zip(keys, index.find(np.array(keys)).tolist()):
            while 0 <= doc < len(index.keys) and index.keys[doc] == key:
                begin, end = index.offsets[doc : doc + 2].tolist()
                out.setdefault(key, []).append(np.frombuffer(file.read_at(index.width * (end - begin), index.width * begin), index.kind))
                doc += 1
    return out
