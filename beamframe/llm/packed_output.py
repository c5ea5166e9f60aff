"""Best-fit-decreasing packing into id matrices.

Each task gathers pieces of SHARD tokens, sorts them by length, and puts each where
the least room is left; a segment tree over room finds that window in log(length)
steps. Overlong documents are split into whole rows and a remainder, losslessly.
A row of the result is a row of the packed id matrix with its cumulative segment
lengths and the positions that begin anew in each segment. A task holds one shard,
whatever its input. No shuffle.

Defined cases: null text counts as empty and still has its closing id; null ids are
carried through; rows that repeat an id are packed one by one; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from beamframe.llm.common import slices, small_batches
from beamframe.llm.encode import encoder

LENGTH = 2048
SHARD = 1 << 21
CLOSE = 0


class Room:
    """Windows by the room that is left in them: a segment tree whose leaf r counts the windows with room r."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.held[room].append(window)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least room that is enough."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces of each window, pieces by falling size, ties by place."""
    room, windows = Room(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = room.take(sizes[k])
        if found is None:
            windows.append([])
            found = (length, len(windows) - 1)
        windows[found[1]].append(k)
        if found[0] > sizes[k]:
            room.put(found[0] - sizes[k], found[1])
    return windows


_ROW = "sequence_id long, n_tokens int, doc_ids array<{id}>, starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def _rows(path: str, length: int, shard: int):  # noqa: ANN202
    def packed(pieces: list[tuple[object, int, np.ndarray]], first: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        windows = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            ids, positions = np.zeros((len(part), length), "<u4"), np.zeros((len(part), length), "<u2" if length <= 1 << 16 else "<u4")
            ends = []
            for row, w in enumerate(part):
                end = np.cumsum([0, *(len(pieces[k][2]) for k in w)])
                ends.append(end.tolist())
                for k, a, z in zip(w, end[:-1], end[1:], strict=True):
                    ids[row, a:z] = pieces[k][2]
                    positions[row, a:z] = np.arange(z - a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + at, first + at + len(part)), pa.int64()),
                    pa.array([e[-1] for e in ends], pa.int32()),
                    pa.array([[pieces[k][0] for k in w] for w in part], pa.list_(kind)),
                    pa.array([[pieces[k][1] for k in w] for w in part], pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([x.tobytes() for x in positions], pa.binary()),
                ],
                names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(path), TaskContext.get().partitionId() << 32
        pieces: list[tuple[object, int, np.ndarray]] = []
        held, kind = 0, pa.int64()
        for b in slices(batches, "text"):
            kind = b.column("doc_id").type
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                x = np.append(x, np.uint32(CLOSE))
                pieces += [(doc, s, x[s : s + length]) for s in range(0, len(x), length)]
                held += len(x)
                if held >= shard:
                    for out in packed(pieces, first, kind):
                        first += out.num_rows
                        yield out
                    pieces, held = [], 0
        for out in packed(pieces, first, kind):
            yield out

    return run


def packed_rows(docs: DataFrame, tokenizer: str, length: int = LENGTH, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: ids (little-endian unsigned 32-bit, padded with 0), positions (16-bit), cu_seqlens, the segments' documents and starts."""
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return texts.mapInArrow(_rows(tokenizer, length, shard), _ROW.format(id=docs.schema[id_col].dataType.simpleString()))


def write_packed(docs: DataFrame, tokenizer: str, path: str, length: int = LENGTH) -> None:
    """Write the matrix rows where every executor and reader can reach them."""
    packed_rows(docs, tokenizer, length).write.mode("error").parquet(path)
