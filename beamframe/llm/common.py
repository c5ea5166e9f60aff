"""Shared pieces of the training-data operators.

``materialize`` cuts lineage with a written table in the folder that the cluster
names in ``spark.checkpoint.dir``; ``words`` tokenises a whole Arrow string
column without a Python loop over rows or words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch is also cut by bytes of text below.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Bytes of text that one vectorised step holds at most, unless one text is longer.
SLICE_BYTES = 6 << 20

ASCII_SPACE = (0x20, *range(0x09, 0x0E))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back: a worker waits for its next task, and what it holds is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same stage, leaving a small worker behind."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, where each group begins, and the number of rows), of batches sorted by ``keys`` (whole numbers, none null)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
        new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and not np.array_equal(k[0], last):
            new = np.append(0, new)
        if len(new):  # the last group may go on in the next batch
            whole = pa.Table.from_batches([*held, b.slice(0, new[-1])]).combine_chunks()
            before = len(whole) - new[-1]
            first = [0] if before or new[0] else []
            yield whole, np.concatenate([first, before + new]).astype(np.int64)
            held = []
        held.append(b.slice(new[-1] if len(new) else 0))
        last = k[-1]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, np.array([0, len(whole)])


def in_blocks(rows: DataFrame, key: str, blocks: Column, order: str) -> DataFrame:
    """Each row once for each block pair (i, j) of its key that its block is in, sorted by key, block pair and ``order``."""
    split = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = split.withColumn("p", F.explode(own)).select(*[c for c in split.columns if c != "blocks"], "p.i", "p.j")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", order)


# ---------------------------------------------------------------- tokens


def byte_classes(separators: set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(map of each byte, whether a byte belongs to a word)."""
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    word = np.ones(256, dtype=bool)
    word[sorted(separators)] = False
    return to, word


#: Words are runs of anything but ASCII white space.
SPACED = byte_classes(set(ASCII_SPACE), lower=False)
SPACED_LOWER = byte_classes(set(ASCII_SPACE), lower=True)
#: Words are runs of ASCII letters, digits and non-ASCII characters, letters lower-cased.
ALNUM_LOWER = byte_classes({c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)}, lower=True)


class Words(NamedTuple):
    """Words of many texts: their strings, the first word of each text (n + 1 numbers), byte places in ``data``."""

    flat: pa.StringArray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    text_offsets: np.ndarray

    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word in the distinct words, the distinct words)."""
        e = self.flat.dictionary_encode()
        return e.indices.to_numpy(), e.dictionary.to_numpy(zero_copy_only=False)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        codes, distinct = self.encoded()
        return hash_strings(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)


def hash_strings(strings: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(strings.astype(object), categorize=False)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = texts.cast(pa.string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, classes: tuple[np.ndarray, np.ndarray]) -> Words:
    data, off = raw(texts)
    to, is_word = classes
    data = to[data]
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = off[1:-1]
        before[cuts[cuts < len(inside)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where.astype(np.int32)), pa.py_buffer(data[inside]))
    return Words(flat, np.searchsorted(starts, off), starts, ends, data, off)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds ``most`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: An odd multiplier for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` numbers of ``h``, by doubling; runs over the end are left out."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size, rest = None, 0, h.astype(np.uint64), 1, length
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else mix(out * np.uint64(BASE) + part)
            done += size
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - size] * np.uint64(BASE) + power[size:])
            size *= 2
    return mix(out + np.uint64(length))


def inside_documents(offsets: np.ndarray, length: int, total: int) -> np.ndarray:
    """Whether a window of ``length`` words that begins at each word ends in the same text."""
    n = np.diff(offsets)
    ends = np.repeat(offsets[1:], n)
    return np.arange(total) + length <= ends


# ---------------------------------------------------------------- bounded filters


class Bits(NamedTuple):
    """A set of 64-bit keys as a bitmap of fixed size: no false negatives, false positives only cost work."""

    log2: int
    bitmap: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.log2)
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_bits(keys: DataFrame, column: str, log2: int = 24) -> Bits:
    """A bitmap of 2**log2 bits of the numbers in ``column``.

    Each task folds its keys into the blocks of the bitmap that it touches, and
    blocks are or-ed by one task each; what reaches the driver is 2**log2 / 8 bytes
    at most, whatever the input.
    """
    block = 1 << 16

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (log2 - 3), np.uint8)
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            at = mix(k.astype(np.int64).view(np.uint64)) >> np.uint64(64 - log2)
            np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for i in range(0, len(bitmap), block):
            if (part := bitmap[i : i + block]).any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "bits": pa.array([part.tobytes()], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, bits in zip(b.column("at").to_pylist(), b.column("bits").to_pylist(), strict=True):
                new = np.frombuffer(bits, np.uint8)
                held[at] = held[at] | new if at in held else new
        for at, bits in held.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    shape = "at long, bits binary"
    blocks = keys.select(F.col(column).cast("long")).mapInArrow(fold, shape).repartition("at").mapInArrow(join, shape)
    bitmap = np.zeros(1 << (log2 - 3), np.uint8)
    for row in blocks.collect():  # 2**log2 / 8 bytes in all at most
        bitmap[row["at"] : row["at"] + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return Bits(log2, bitmap)
