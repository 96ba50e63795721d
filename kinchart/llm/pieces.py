"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is that of a SentencePiece model file.  A unigram lattice needs log scores; the
public file holds merge ranks, so the scores are Zipf's: the piece of rank r has -log(r) up to a
constant that makes the probabilities add up to one (``scores="stored"`` takes the file's numbers).
Characters without a piece fall back to the pieces of their bytes.  A blank is the white-space
marker; one is put before the text and taken away again by decoding.

No piece has a blank after another sign and none holds a line break, so the best path of a text is
that of its runs "blanks, then other signs" put together; each worker solves every distinct run
once, all new runs of a batch side by side in numpy (long runs one at a time).

Defined cases: a null or empty text has no ids and decodes to the empty text; a marker sign that
stands in the text itself is kept apart from blanks by byte fallback, so decoding gives back
every valid text; equal scores go to the piece found first, from the left and from short to long.
Repeated rows and extra columns change nothing; columns named like a result are replaced.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinchart.llm.common import free_name, map_batches, texts_of

MARKER = "▁"
# Runs whose ids a worker remembers; beyond that it starts anew.
MEMORY = 150_000
# Longer runs are solved one at a time.
WIDE = 64
# What a character without a piece scores below the worst piece.
PENALTY = 10.0
_RUN = re.compile(rb" *[^ \n]+| +|\n")
_WHOLE = re.compile(rb"(?s).+")


@dataclass
class Trie:
    """Double array: the child of node s by byte b is ``base[s] + b + 1`` if ``check`` says so."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        leaf = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    leaf.append(-1)
                node = children[node][b]
            leaf[node] = value
        size = 4 * len(children) + 4096
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[:257] = True  # the root, and room so that no base is negative
        at = {0: 0}
        free = 257
        for node in range(len(children)):
            place = at[node]
            value[place] = leaf[node]
            signs = np.fromiter(sorted(children[node]), np.int64, len(children[node]))
            if not len(signs):
                continue
            while used[free]:
                free += 1
            start, look = -1, free
            while start < 0:  # the first base under which all children find a free place
                starts = np.flatnonzero(~used[look : look + 512]) + look - int(signs[0]) - 1
                fits = ~used[starts[:, None] + signs + 1].any(1)
                start, look = (int(starts[fits.argmax()]) if fits.any() else -1), look + 512
            base[place] = start
            for b in signs.tolist():
                child = start + b + 1
                used[child], check[child] = True, place
                at[children[node][b]] = child
        last = int(np.flatnonzero(used)[-1]) + 258
        return Trie(base[:last], check[:last], value[:last])


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    surface: list[bytes]
    split: bool
    known: dict[bytes, bytes] = field(default_factory=dict)

    @staticmethod
    def load(model_file: str, scores: str = "zipf") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        of_byte = [i for i in range(n) if model.is_byte(i)]
        normal = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        score = np.zeros(n)
        if scores == "zipf":
            rank = np.arange(1, len(normal) + 1)
            score[normal] = -np.log(rank) - np.log((1 / rank).sum())
        else:
            score[normal] = [model.get_score(i) for i in normal]
        surface = [p.replace(MARKER, " ").encode() for p in pieces]
        byte_ids = np.zeros(256, np.int64)
        for i in of_byte:
            byte_ids[int(pieces[i][1:-1], 16)] = i
            surface[i] = bytes([int(pieces[i][1:-1], 16)])
        for i in range(n):
            if special[i]:
                surface[i] = b""
        whole = [surface[i] for i in normal]
        split = not any(b" " in p.lstrip(b" ") or b"\n" in p for p in whole)
        return Vocabulary(
            Trie.build({surface[i]: i for i in normal}), score, float(score[normal].min()) - PENALTY, byte_ids, surface, split
        )

    def _ids(self, run: bytes, steps: list[tuple[int, int]]) -> bytes:
        """Ids of the path: (begin, id) from the end; an id below 0 stands for the bytes."""
        out: list[int] = []
        end = len(run)
        for begin, piece in steps:
            out.extend([piece] if piece >= 0 else self.byte_ids[list(run[begin:end])].tolist()[::-1])
            end = begin
        return np.array(out[::-1], "<i4").tobytes()

    def _long(self, run: bytes) -> bytes:
        n = len(run)
        best, back = np.full(n + 1, -np.inf).tolist(), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            node = 0
            for j in range(i, n):
                child = base[node] + run[j] + 1
                if check[child] != node:
                    break
                node = child
                piece = value[node]
                if piece >= 0 and here + score[piece] > best[j + 1]:
                    best[j + 1], back[j + 1] = here + score[piece], (i, int(piece))
            after = min(n, i + _char_bytes(run[i]))
            if here + self.unknown > best[after]:
                best[after], back[after] = here + self.unknown, (i, -1)
        steps, at = [], n
        while at:
            steps.append(back[at])
            at = back[at][0]
        return self._ids(run, steps)

    def _short(self, runs: list[bytes]) -> list[bytes]:
        """All runs side by side: one position after the other, one trie step after the other."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        width = int(lengths.max())
        signs = np.frombuffer(b"".join(run.ljust(width, b"\0") for run in runs), np.uint8).reshape(len(runs), width)
        signs = np.ascontiguousarray(signs.T).astype(np.int32)  # one row per position
        best = np.full((width + 5, len(runs)), -np.inf)
        best[0] = 0
        begin = np.zeros((width + 5, len(runs)), np.int16)
        chosen = np.full((width + 5, len(runs)), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value

        def offer(end: int, rows: np.ndarray, start: int, total: np.ndarray, piece: np.ndarray | int) -> None:
            better = total > best[end, rows]
            rows = rows[better]
            best[end, rows], begin[end, rows] = total[better], start
            chosen[end, rows] = piece[better] if isinstance(piece, np.ndarray) else piece

        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (lengths > i))
            if not len(rows):
                continue
            walk, node, here = rows, np.zeros(len(rows), np.int32), best[i, rows]
            total = here
            for j in range(i, width):
                child = base[node] + signs[j, walk] + 1
                fits = np.flatnonzero((check[child] == node) & (lengths[walk] > j))
                if not len(fits):
                    break
                walk, node, total = walk[fits], child[fits], total[fits]
                piece = value[node]
                has = np.flatnonzero(piece >= 0)
                if len(has):
                    offer(j + 1, walk[has], i, total[has] + self.scores[piece[has]], piece[has])
            size = _CHAR_BYTES[signs[i, rows]]
            for k in np.unique(size).tolist():
                of = size == k
                ends = np.minimum(i + k, lengths[rows[of]])
                for end in np.unique(ends).tolist():
                    offer(end, rows[of][ends == end], i, here[of][ends == end] + self.unknown, -1)
        out = []
        for run, starts, pieces in zip(runs, begin.T.tolist(), chosen.T.tolist()):
            ids, at = [], len(run)
            while at:
                start = starts[at]
                ids.append(pieces[at])
                if pieces[at] < 0:
                    ids[-1:] = self.byte_ids[list(run[start:at])].tolist()[::-1]
                at = start
            out.append(struct.pack(f"<{len(ids)}i", *ids[::-1]))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit numbers."""
        pattern = _RUN if self.split else _WHOLE
        parts = [pattern.findall(b" " + t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = set().union(*parts)
        by_width: dict[int, list[bytes]] = {}
        for run in new:
            if len(run) > WIDE:
                self.known[run] = self._long(run)
            else:
                by_width.setdefault((len(run) + 7) // 8, []).append(run)
        for runs in by_width.values():
            self.known.update(zip(runs, self._short(runs)))
        of = self.known.__getitem__
        return [b"".join(map(of, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, as UTF-8."""
        return b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:]


def _char_bytes(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


_CHAR_BYTES = np.array([_char_bytes(b) for b in range(256)])
_NEW = ("ids", "n_tokens", "n_byte_tokens", "decoded")


def encode(docs: DataFrame, words: Vocabulary, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``ids``, their number, and how many of them are byte pieces."""
    rest = [c for c in docs.columns if c not in _NEW[:3] and (keep_text or c != text)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]

    shared = docs.sparkSession.sparkContext.broadcast(words)  # as large as the vocabulary

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = shared.value
        found = words.encode(texts_of(batch.column(len(rest))))
        counts = np.fromiter((len(f) // 4 for f in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(found), "<i4")
        edges = np.concatenate(([0], np.cumsum(counts)))
        is_byte = np.isin(flat, words.byte_ids) if len(flat) else np.zeros(0, bool)
        in_bytes = np.diff(np.concatenate(([0], np.cumsum(is_byte)))[edges])
        ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))
        new = [ids, pa.array(counts.astype(np.int64)), pa.array(in_bytes.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], [*rest, *_NEW[:3]])

    value = docs[text].alias(free_name(docs, "_text"))
    return map_batches(
        docs.select(*rest, value), each, ", ".join([*fields, "ids array<int>, n_tokens long, n_byte_tokens long"])
    )


def decode(rows: DataFrame, words: Vocabulary, ids: str = "ids") -> DataFrame:
    """Every row with ``decoded``, the text of its ids."""
    rest = [c for c in rows.columns if c != "decoded"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in rest]
    where = rest.index(ids)

    shared = rows.sparkSession.sparkContext.broadcast(words)  # as large as the vocabulary

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = shared.value
        texts = [b"" if v is None else words.decode(v.astype("<i4").tobytes()) for v in _lists(batch.column(where))]
        back = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, back], [*rest, "decoded"])

    return map_batches(rows.select(*rest), each, ", ".join([*fields, "decoded string"]))


def _lists(column: pa.ListArray) -> list[np.ndarray | None]:
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [None if not ok else flat[a:b] for ok, a, b in zip(column.is_valid().to_pylist(), edges[:-1], edges[1:])]
