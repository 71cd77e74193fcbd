"""Bounded-space online packing of token sequences.

Each input partition packs its documents as they come, without a shuffle, into windows of
``CAPACITY`` tokens and keeps ``OPEN`` of them. Whole windows of a long document go out at
once; its rest goes to the open window that it fits best. When none fits and all places are
taken, the fullest window is emitted: as it is where at most ``SLACK`` tokens are missing,
else filled with the head of the newcomer. At the end of a partition its open windows are
merged by cutting, which leaves less than one window; those of ``MERGED`` partitions at a time
are merged in the same way, and the last rest becomes sequences of powers of two.

A document's ids are those of its whole text and an end id. Sequences shorter than
``CAPACITY`` that are not a power of two are meant to be padded.

The order of a partition decides its windows, so ``docs`` should be read from files (as the
pipeline does) for retried tasks to repeat their work exactly.

Defined results: null or empty text is the end id alone; repeated rows are packed each;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import written
from webcatalog.llm.encode import encoder

CAPACITY, END_ID = 2048, 1
OPEN, SLACK, MERGED = 64, 16, 64
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_()),
])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


class Piece:
    """Part of a document: its ids from ``start`` on, four bytes each."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: 4 * n], self.ids[4 * n :]
        return Piece(self.doc_id, self.start, head, self.doc_tokens), Piece(self.doc_id, self.start + n, tail, self.doc_tokens)


class Packer:
    """Packs the pieces of one partition; ``emitted`` gets lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, places: int = OPEN, slack: int = SLACK) -> None:
        self.capacity, self.places, self.slack = capacity, places, slack
        self.windows: dict[int, list[Piece]] = {}
        self.free: list[tuple[int, int]] = []  # (tokens free, window), ascending
        self.opened = 0
        self.emitted: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.capacity:
            head, piece = piece.cut(self.capacity)
            self.emitted.append([head])
        while len(piece):
            at = bisect_left(self.free, (len(piece), -1))
            if at < len(self.free):
                self._put(at, piece)
                return
            if len(self.free) < self.places:
                self.opened += 1
                self.windows[self.opened] = []
                insort(self.free, (self.capacity, self.opened))
            elif self.free[0][0] <= self.slack:
                self.emitted.append(self.windows.pop(self.free.pop(0)[1]))
            else:
                head, piece = piece.cut(self.free[0][0])
                self._put(0, head)

    def _put(self, at: int, piece: Piece) -> None:
        free, window = self.free.pop(at)
        self.windows[window].append(piece)
        if free > len(piece):
            insort(self.free, (free - len(piece), window))
        else:
            self.emitted.append(self.windows.pop(window))

    def finish(self) -> list[Piece]:
        """Merge the open windows; the pieces of the last, unfilled one."""
        rest = [p for _, window in self.free for p in self.windows[window]]
        self.windows, self.free = {}, []
        full, rest = concatenate(rest, self.capacity)
        self.emitted += full
        return rest


def concatenate(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of ``pieces`` in turn, cut where a window ends, and what is left."""
    full: list[list[Piece]] = []
    window: list[Piece] = []
    free = capacity
    for piece in pieces:
        while len(piece) >= free:
            head, piece = piece.cut(free)
            full.append([*window, head])
            window, free = [], capacity
        if len(piece):
            window.append(piece)
            free -= len(piece)
    return full, window


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """``pieces`` as sequences of powers of two, largest first."""
    out = []
    while total := sum(map(len, pieces)):
        (first, *_), _ = concatenate(pieces, size := 1 << total.bit_length() - 1)
        out.append(first)
        full, rest = concatenate(pieces, size)
        pieces = [p for w in full[1:] for p in w] + rest
    return out


def _rows(windows: list[list[Piece]], first_id: int, keep: bool, is_open: bool = False) -> list[dict]:
    rows = []
    for sequence_id, window in enumerate(windows, first_id):
        offset = 0
        for p in window:
            rows.append({
                "doc_id": p.doc_id, "start": p.start, "length": len(p), "ids_crc32": zlib.crc32(p.ids), "doc_tokens": p.doc_tokens,
                "sequence_id": sequence_id, "offset": offset, "ids": p.ids if keep or is_open else None, "open": is_open,
            })
            offset += len(p)
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` (unsigned 32-bit little-endian) is null unless ``keep_ids``.
    """

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(capacity)
        end = np.array([end_id], dtype="<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                packer.add(Piece(doc_id, 0, ids, len(ids) // 4))
            rows = _rows(packer.emitted, next_id, keep_ids)
            next_id += len(packer.emitted)
            packer.emitted = []
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
        rest = packer.finish()
        rows = _rows(packer.emitted, next_id, keep_ids)
        rows += _rows([rest] if rest else [], next_id + len(packer.emitted), keep_ids, is_open=True)
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.drop_columns(["group"]).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        pieces = [Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows]
        full, rest = concatenate(pieces, capacity)
        number = group["group"][0].as_py()
        merged = _rows([*full, *powers(rest)], (1 << 62) + (number << 32), keep_ids)
        return pa.Table.from_pylist(merged, schema=SCHEMA)

    packed = written(docs.select("doc_id", "text").mapInArrow(first_pass, DDL), "packed")
    left = packed.where("open").withColumn("group", F.expr(f"shiftright(sequence_id, 32) div {MERGED}"))
    merged = left.groupBy("group").applyInArrow(merge, DDL)
    return packed.where("NOT open").unionByName(merged).drop("open")
