"""Byte-level BPE: encoding and decoding with the ranks of a public tokenizer.

A batch's texts are cut into pieces by the tokenizer's pattern and each distinct piece is merged
once. Pieces are bucketed by length into padded matrices of token ids. Every round, each row
merges its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash
table. Rows that are done leave the matrix, and columns are compacted as rows get shorter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches, text_slices
from .words import mix64

#: What a pair that doesn't merge has for a rank.
NEVER = np.int32(2**31 - 1)
#: Cells of a matrix, at most, unless one row has more.
CELLS = 1 << 20
#: Distinct pieces and their ids that a task remembers, at most.
REMEMBER = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> id of their joint bytes, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(list(pairs), np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.values = np.full(int(self.mask) + 1, NEVER, np.int32)
        slot, left = mix64(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = np.where(self.keys[slot[left]] == keys[left], slot[left], slot[left] + np.uint64(1)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id on either side never merges."""
        out = np.full(left.shape, NEVER, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.uint64) << np.uint64(32) | right[todo].astype(np.uint64)
        slot = mix64(keys) & self.mask
        while len(todo):
            held = self.keys[slot]
            hit = held == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            todo, keys, slot = todo[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def merge_rows(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """The merged ids of each row of a padded matrix (-1 beyond its length)."""
    rows, width = ids.shape
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * rows
    row = np.arange(rows)
    ids = ids.copy()
    column = np.arange(width)
    after = np.broadcast_to(column + 1, (rows, width)).copy()  # the next live cell
    before = np.broadcast_to(column - 1, (rows, width)).copy()
    right = np.full((rows, width), -1, ids.dtype)
    right[:, :-1] = ids[:, 1:]
    rank = table.find(ids.ravel(), right.ravel()).reshape(rows, width)
    live = lengths.astype(np.int64).copy()
    while len(row):
        at = rank.argmin(axis=1)
        every = np.arange(len(row))
        best = rank[every, at]
        done = best == NEVER
        if done.any():
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i][ids[i] >= 0]
            on = ~done
            row, ids, rank, after, before, live, at, best = row[on], ids[on], rank[on], after[on], before[on], live[on], at[on], best[on]
            every = np.arange(len(row))
            if not len(row):
                break
        width = ids.shape[1]
        # the pair's right cell dies, the left one takes its place
        dead = after[every, at]
        beyond = after[every, dead]
        ids[every, at] = best
        ids[every, dead] = -1
        rank[every, dead] = NEVER
        after[every, at] = beyond
        inner = beyond < width
        before[every[inner], beyond[inner]] = at[inner]
        following = np.where(inner, ids[every, np.minimum(beyond, width - 1)], -1)
        rank[every, at] = table.find(best.astype(ids.dtype), following)
        back = before[every, at]
        has = back >= 0
        rank[every[has], back[has]] = table.find(ids[every[has], back[has]], best[has].astype(ids.dtype))
        live -= 1
        if width > 8 and live.max() * 2 <= width:
            # columns are compacted when no row fills half of them
            order = np.argsort(ids < 0, axis=1, kind="stable")[:, : int(live.max())]
            ids, rank = np.take_along_axis(ids, order, 1), np.take_along_axis(rank, order, 1)
            column = np.arange(ids.shape[1])
            after = np.broadcast_to(column + 1, ids.shape).copy()
            after[column >= live[:, None] - 1] = ids.shape[1]
            before = np.broadcast_to(column - 1, ids.shape).copy()
    return out


@dataclass
class Codec:
    """Encodes texts and decodes ids with one vocabulary."""

    path: str
    pattern: str

    def __post_init__(self):
        self.ranks = load_ranks(self.path)
        self.table = PairTable(self.ranks)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        # \s is the property White_Space there, which excludes U+001C..U+001F
        self.cut = regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.known: list[np.ndarray] = []

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, a piece that is a token itself being that token."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            else:
                buckets.setdefault(max(4, (len(piece) - 1).bit_length()), []).append(i)
        for bucket, members in sorted(buckets.items()):
            step = max(1, CELLS >> bucket)
            for first in range(0, len(members), step):
                own = members[first : first + step]
                lengths = np.array([len(pieces[i]) for i in own])
                matrix = np.full((len(own), int(lengths.max())), -1, np.int32)
                matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)]
                for i, ids in zip(own, merge_rows(matrix, lengths, self.table)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, each match of the pattern on its own; null is empty."""
        if len(self.codes) > REMEMBER:
            self.forget()
        codes, find = self.codes, self.cut.findall
        cut, fresh = [], []
        for text in texts:
            own = []
            for piece in find(text or ""):
                code = codes.get(piece)
                if code is None:
                    code = codes[piece] = len(codes)
                    fresh.append(piece)
                own.append(code)
            cut.append(np.array(own, np.int64))
        self.known += self.merge([x.encode() for x in fresh])
        out = []
        for own in cut:
            out.append(np.concatenate([self.known[c] for c in own.tolist()]) if len(own) else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, in one gather."""
        if not len(ids):
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.bytes[np.arange(len(shift)) + shift].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once in a worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ids array<int>), one for each row of ``docs``; ``carry`` keeps columns.

    Defined cases: a null or empty text has no ids; ids of rows may be null or repeated; other
    columns are left unread; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", 2 << 20):
            ids = codec(path, pattern).encode(part.column("__text").to_pylist())
            column = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate([*ids, np.zeros(0, np.int32)])
            )
            keep = [i for i, f in enumerate(part.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], column], [*[part.schema[i].name for i in keep], "ids"])

    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "__text")
    return read.mapInArrow(run, f"{kept}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, decoded binary) from rows (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [use.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in part.column("ids")]
                keep = [i for i, f in enumerate(part.schema) if f.name != "ids"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(rows, pa.binary())], [*[part.schema[i].name for i in keep], "decoded"])

    read = small_batches(encoded).select("doc_id", *carry, "ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "ids")
    return read.mapInArrow(run, f"{kept}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ..., ids, decoded_sha256): ``encode``, and the digest of what the ids decode to.

    One worker does both, so that ids don't go to a second one and back. Cases as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text", 2 << 20):
            use = codec(path, pattern)
            ids = use.encode(part.column("__text").to_pylist())
            digests = pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in ids], pa.string())
            column = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate([*ids, np.zeros(0, np.int32)])
            )
            keep = [i for i, f in enumerate(part.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], column, digests], [*[part.schema[i].name for i in keep], "ids", "decoded_sha256"])

    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "__text")
    return read.mapInArrow(run, f"{kept}, ids array<int>, decoded_sha256 string")
