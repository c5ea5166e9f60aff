"""Bounded-space online packing of token ids into sequences.

Each task keeps a fixed number of open windows. A document's ids (with the closing
id) first fill whole sequences; what is left goes to the open window that it fits
best. When none fits, and no further window may open, the fullest is filled up with
the first part of the piece and emitted, and the rest is placed again. At a task's
end its open windows are leftovers; these are written once, dealt out in groups of
tasks, and packed again the same way. What is left of a group is laid end to end
and cut at powers of two, where sequences aren't padded.

A task holds OPEN windows, whatever its input; a group holds OPEN windows of each of
GROUP tasks.

Defined cases: null text counts as empty and still has its closing id; null ids are
carried through; rows that repeat an id are packed one by one; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import materialize, slices, small_batches
from beamframe.llm.encode import encoder

LENGTH = 1024
OPEN = 16
GROUP = 64
CLOSE = 0

Piece = tuple[object, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Packer:
    """Open windows and the sequences that they emit."""

    def __init__(self, prefix: int, length: int = LENGTH, windows: int = OPEN) -> None:
        self.next, self.length, self.windows = prefix, length, windows
        self.open: list[list[Piece]] = []
        self.fill: list[int] = []
        self.done: list[tuple[int, int, Piece]] = []  # sequence, offset, piece

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.done.append((self.next, at, p))
            at += len(p[3])
        self.next += 1

    def add(self, piece: Piece) -> None:
        doc, start, total, ids = piece
        while len(ids) >= self.length:
            self.emit([(doc, start, total, ids[: self.length])])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [(f, i) for i, f in enumerate(self.fill) if f + len(ids) <= self.length]
            if not fits and len(self.open) < self.windows:
                self.open.append([])
                self.fill.append(0)
                fits = [(0, len(self.open) - 1)]
            f, i = max(fits) if fits else max((f, i) for i, f in enumerate(self.fill))
            part = ids[: self.length - f]
            self.open[i].append((doc, start, total, part))
            self.fill[i] += len(part)
            start, ids = start + len(part), ids[len(part) :]
            if self.fill[i] == self.length:
                self.emit(self.open.pop(i))
                self.fill.pop(i)

    def leftovers(self) -> list[Piece]:
        rest = [p for w in self.open for p in w]
        self.open, self.fill = [], []
        return rest

    def finish(self) -> None:
        """Lay the leftovers end to end and cut at powers of two."""
        rest = self.leftovers()
        left = sum(len(p[3]) for p in rest)
        while left:
            size = min(self.length, 1 << (left.bit_length() - 1))
            left -= size
            row = []
            while size:
                doc, start, total, ids = rest.pop(0)
                row.append((doc, start, total, ids[:size]))
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, total, ids[size:]))
                size -= len(row[-1][3])
            self.emit(row)


_PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task int"


def _batch(done: list[tuple[int | None, int | None, Piece]], kind: pa.DataType, task: int, ids: bool) -> pa.RecordBatch:
    raw_ids = [p[3].astype("<u4").tobytes() for _, _, p in done]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for _, _, p in done], kind),
            pa.array([p[1] for _, _, p in done], pa.int64()),
            pa.array([len(p[3]) for _, _, p in done], pa.int64()),
            pa.array([zlib.crc32(x) for x in raw_ids], pa.int64()),
            pa.array([p[2] for _, _, p in done], pa.int64()),
            pa.array([s for s, _, _ in done], pa.int64()),
            pa.array([o for _, o, _ in done], pa.int64()),
            pa.array([x if ids or s is None else None for x, (s, _, _) in zip(raw_ids, done, strict=True)], pa.binary()),
            pa.array([task] * len(done), pa.int32()),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"],
    )


def _pack(path: str, length: int, windows: int, ids: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, kind, enc = Packer(task << 32, length, windows), None, encoder(path)
        for b in slices(batches, "text"):
            kind = b.column("doc_id").type
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                packer.add((doc, 0, len(x) + 1, np.append(x, np.uint32(CLOSE))))
            yield _batch(packer.done, kind, task, ids)
            packer.done = []
        if kind is not None:
            yield _batch([(None, None, p) for p in packer.leftovers()], kind, task, ids)

    return run


def _merge(length: int, windows: int, ids: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple[int, Piece]]] = {}
        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            for doc, start, total, x, task in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "task")), strict=True):
                groups.setdefault(task // GROUP, []).append((task, (doc, start, total, np.frombuffer(x, "<u4"))))
        for group, pieces in groups.items():
            packer = Packer((1 << 62) | (group << 32), length, windows)
            for _, p in sorted(pieces, key=lambda x: (-len(x[1][3]), x[0])):
                packer.add(p)
            packer.finish()
            yield _batch(packer.done, kind, group, ids)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = OPEN, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``ids`` the ids, too."""
    small_batches(docs.sparkSession)
    shape = _PIECE.format(id=docs.schema[id_col].dataType.simpleString())
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    placed = materialize(texts.mapInArrow(_pack(tokenizer, length, windows, ids), shape), "packed")
    left = placed.where("sequence_id is null")
    merged = left.repartition(F.floor(F.col("task") / GROUP)).mapInArrow(_merge(length, windows, ids), shape)
    out = placed.where("sequence_id is not null").unionByName(merged)
    return out.drop("task") if ids else out.drop("task", "ids")
