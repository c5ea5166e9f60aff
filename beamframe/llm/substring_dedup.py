"""Substring dedup by difference-cover anchors.

A window is 35 consecutive words of one document. Every word covered by a window
whose words also stand somewhere else goes, judged on the input.

Two equal windows at places i and j hold, for a difference cover D modulo p, a
shift s < p with i + s and j + s both in D modulo p. So if only the anchors (runs
of 35 - p + 1 words) at cover places are hashed, any two equal windows share an
aligned anchor. Stage 1 finds the anchors that occur twice; stage 2 extends them:
only windows around such anchors are hashed and compared.

Layout. Each task first settles what repeats within its own slice of documents and
sends each distinct hash once, so a passage that stands in a third of all documents
costs its reducer one entry per slice, not one per document. Hashes travel packed,
by bucket (their upper bits), to a number of buckets that follows the size of the
corpus. Stage 2 only moves documents that have a repeated anchor (a bitmap of fixed
size drops most others before the shuffle; it has no false negatives). Its slices
are written to the shared folder; a slice asks about its windows in a fixed order
and gets back one bit for each, so positions needn't travel.

Anchors are compared by 64 bits: a chance match only costs work. Windows are compared by
80 bits of two hashes and the bucket's number, between slices, and by 64 within one: of
10^13 windows asked about, some forty match another by chance; words aren't compared.

Defined cases: null text has no words; null ids are carried through; rows that
repeat an id are different places (identical rows repeat each other); a text of
fewer than 35 words loses nothing; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import SPACED, Bits, Words, inside_documents, key_bits, materialize, mix, slices, small_batches, window_hashes, words

WINDOW = 35
#: Perfect difference sets: every difference modulo the period occurs. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: Words of an anchor at least, where the window allows it: short anchors repeat by chance.
LEAST_ANCHOR = 12
#: What sets the second hash of a window apart, and the bytes of a window's key: 6 of the first hash, 4 of the second.
SECOND, KEY = 0x9B1D5A3C0F4E7268, 10
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 16 << 20


def cover(window: int) -> tuple[int, np.ndarray]:
    """(period, whether each residue is in the cover) for a window."""
    period = max((p for p in COVERS if window - p + 1 >= LEAST_ANCHOR), default=1)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return period, inside


def _buckets(docs: DataFrame, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(2, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))


def _places(w: Words) -> np.ndarray:
    """The place of each word in its text."""
    return np.arange(len(w.starts)) - np.repeat(w.offsets[:-1], np.diff(w.offsets))


def _repeated(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_ANCHORS = "bucket int, hashes binary, rids binary, counts binary, places binary"


def _anchors(window: int, buckets: int):  # noqa: ANN202
    period, inside = cover(window)
    length, shift = window - period + 1, 64 - buckets.bit_length() + 1

    def row(bucket: int, h: np.ndarray | None, doc: np.ndarray, place: np.ndarray, rid: np.ndarray) -> dict:
        new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        return {
            "bucket": bucket,
            "hashes": None if h is None else h.astype("<u8").tobytes(),
            "rids": rid[doc[new]].tobytes(),
            "counts": np.diff(np.append(new, len(doc))).astype("<u4").tobytes(),
            "places": place.astype("<u4").tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(slices(batches, "text")):
            w = words(b.column("text"), SPACED)
            rid = b.column("rid").to_numpy()
            place = _places(w)
            h = window_hashes(w.hashes(), length)
            n = np.diff(w.offsets)
            at = np.flatnonzero(inside_documents(w.offsets, length, len(place))[: len(h)] & np.repeat(n >= window, n)[: len(h)] & inside[place[: len(h)] % period])
            if not len(at):
                continue
            h = h[at]
            doc = np.repeat(np.arange(len(rid)), n)[at]
            out = []
            twice = _repeated(h)
            if twice.any():
                out.append(row(int(h[0] >> np.uint64(shift)) ^ (k % buckets), None, doc[twice], place[at[twice]], rid))
            _, one = np.unique(h, return_index=True)
            one.sort()
            bucket = (h[one] >> np.uint64(shift)).astype(np.int64)
            order = one[np.argsort(bucket, kind="stable")]
            ids, cuts = np.unique((h[order] >> np.uint64(shift)).astype(np.int64), return_index=True)
            out += [row(i, h[o], doc[o], place[at[o]], rid) for i, o in zip(ids.tolist(), np.split(order, cuts[1:]), strict=True)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "rids", "counts", "places")]]))

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the anchors that two slices have, and those that a slice has settled itself."""
    hashes, rids, places = [], [], []

    def out(rid: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rid), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(rid[i : i + (1 << 16)]), pa.array(place[i : i + (1 << 16)].astype(np.int32))], names=["rid", "place"])

    for b in batches:
        for h, r, c, p in zip(*(b.column(x).to_pylist() for x in ("hashes", "rids", "counts", "places")), strict=True):
            rid = np.repeat(np.frombuffer(r, "<i8"), np.frombuffer(c, "<u4"))
            place = np.frombuffer(p, "<u4")
            if h is None:
                yield from out(rid, place)
            else:
                hashes.append(np.frombuffer(h, "<u8"))
                rids.append(rid)
                places.append(place)
    if hashes:
        twice = _repeated(np.concatenate(hashes))
        yield from out(np.concatenate(rids)[twice], np.concatenate(places)[twice])


def _results(w: Words, doc_ids: pa.Array, gone: np.ndarray, texts: bool) -> pa.RecordBatch:
    """The result of a slice, of which the words in ``gone`` are removed."""
    n = np.diff(w.offsets)
    before = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=before[1:])
    removed = before[w.offsets[1:]] - before[w.offsets[:-1]]
    flat = w.flat.filter(pa.array(~gone)) if gone.any() else w.flat
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array((w.offsets - before[w.offsets]).astype(np.int32)), flat), " ")
    out = {
        "doc_id": doc_ids,
        "n_words": pa.array(n),
        "n_removed": pa.array(removed),
        "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept.to_pylist()], pa.string()),
    }
    return pa.RecordBatch.from_pydict(out | ({"kept_text": kept} if texts else {}))


def _untouched(bits: Bits, texts: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(~bits.has(b.column("rid").to_numpy())))
            if b.num_rows:
                w = words(b.column("text"), SPACED)
                yield _results(w, b.column("doc_id"), np.zeros(len(w.starts), bool), texts)

    return run


def _members(bits: Bits):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(bits.has(b.column("rid").to_numpy())))

    return run


_SLICE = "slice long, payload binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of documents with their repeated anchors, each as one compressed row."""
    for b in slices(batches, "text"):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_batch(b)
        name = np.frombuffer(os.urandom(8), "<i8")  # written before it is used, so a lost task can't rename a slice
        yield pa.RecordBatch.from_pydict({"slice": pa.array(name), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class Extended:
    """The candidate windows of a slice, in an order that every task finds again."""

    def __init__(self, payload: bytes, window: int) -> None:
        period, _ = cover(window)
        self.batch = pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]
        self.words = w = words(self.batch.column("text"), SPACED)
        anchors = self.batch.column("places")
        n = len(w.starts)
        size = anchors.value_lengths().fill_null(0).to_numpy()
        at = np.repeat(w.offsets[:-1], size) + anchors.flatten().to_numpy()
        first = np.maximum(at - (period - 1), np.repeat(w.offsets[:-1], size))
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, at + 1, -1)
        words_ = w.hashes()
        h = window_hashes(words_, window)
        near = (np.cumsum(marks[:-1]) > 0)[: len(h)]
        self.at = np.flatnonzero(near & inside_documents(w.offsets, window, n)[: len(h)])
        self.distinct, one, self.inverse, self.counts = np.unique(h[self.at], return_index=True, return_inverse=True, return_counts=True)
        # a second hash of each distinct window, of other numbers for its words
        self.second = (window_hashes(mix(words_ ^ np.uint64(SECOND)), window)[self.at[one]] >> np.uint64(32)).astype(np.uint32)

    def gone(self, elsewhere: np.ndarray, window: int) -> np.ndarray:
        """Words covered by windows that stand elsewhere, here or in another slice."""
        at = self.at[((self.counts > 1) | elsewhere)[self.inverse]]
        marks = np.zeros(len(self.words.starts) + 1, np.int64)
        marks[at] += 1
        marks[at + window] -= 1
        return np.cumsum(marks)[:-1] > 0


def _ask(window: int, buckets: int):  # noqa: ANN202
    up = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, payload in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
                x = Extended(payload, window)
                h = x.distinct
                bucket = (h >> np.uint64(64 - up)).astype(np.int64)
                low = np.zeros((len(h), KEY), np.uint8)
                low[:, :6] = ((h << np.uint64(up)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                low[:, 6:] = x.second.astype("<u4").view(np.uint8).reshape(-1, 4)
                ids, cuts = np.unique(bucket, return_index=True)
                keys = [k.tobytes() for k in np.split(low, cuts[1:])] if len(ids) else []
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s] * len(ids), pa.int64()), "bucket": pa.array(ids.astype(np.int32)), "keys": pa.array(keys, pa.binary())})

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice and bucket one bit per key: another slice has it, too."""
    who: list[tuple[int, int]] = []
    keys: list[np.ndarray] = []
    for b in batches:
        for s, bucket, k in zip(*(b.column(x).to_pylist() for x in ("slice", "bucket", "keys")), strict=True):
            own = np.frombuffer(k, np.uint8).reshape(-1, KEY)
            wide = np.zeros((len(own), 16), np.uint8)
            wide[:, :6], wide[:, 8:12] = own[:, :6], own[:, 6:]
            who.append((s, bucket))
            keys.append(wide.view("<u8"))
    if not who:
        return
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    bucket = np.repeat(np.array([x for _, x in who]), sizes)
    order = np.lexsort((flat[:, 1], flat[:, 0], bucket))
    same = (flat[order][1:] == flat[order][:-1]).all(axis=1) & (bucket[order][1:] == bucket[order][:-1])
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(sizes)[:-1])]
    yield pa.RecordBatch.from_pydict({"slice": pa.array([s for s, _ in who], pa.int64()), "bucket": pa.array([x for _, x in who], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _finish(window: int, buckets: int, texts: bool):  # noqa: ANN202
    up = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, answers in zip(b.column("payload").to_pylist(), b.column("answers").to_pylist(), strict=True):
                x = Extended(payload, window)
                sizes = np.bincount((x.distinct >> np.uint64(64 - up)).astype(np.int64), minlength=buckets)
                parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(sizes[a["bucket"]])) for a in sorted(answers or [], key=lambda a: a["bucket"])]
                elsewhere = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
                yield _results(x.words, x.batch.column("doc_id"), x.gone(elsewhere, window), texts)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256; with ``texts`` also kept_text."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("rid"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    buckets = _buckets(docs, text_col)

    sent = keyed.select("rid", "text").mapInArrow(_anchors(window, buckets), _ANCHORS).repartitionById(buckets, F.col("bucket"))
    repeated = sent.mapInArrow(_settle, "rid long, place int").groupBy("rid").agg(F.collect_list("place").alias("places"))
    repeated = materialize(repeated, "repeated-anchors")
    bits = key_bits(repeated, "rid")

    shape = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    untouched = keyed.mapInArrow(_untouched(bits, texts), shape)
    members = keyed.mapInArrow(_members(bits), keyed.schema)
    sliced = materialize(members.join(repeated, "rid", "left").select("rid", "doc_id", "text", "places").mapInArrow(_packed, _SLICE), "slices")
    asked = sliced.mapInArrow(_ask(window, buckets), "slice long, bucket int, keys binary").repartitionById(buckets, F.col("bucket"))
    answered = asked.mapInArrow(_answer, "slice long, bucket int, bits binary").groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    touched = sliced.join(answered, "slice", "left").select("payload", "answers").mapInArrow(_finish(window, buckets, texts), shape)
    return untouched.unionByName(touched)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS phrase FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d)),
r AS (SELECT rid, i FROM p WHERE phrase IN (SELECT phrase FROM p GROUP BY phrase HAVING count(*) > 1)),
g AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS i FROM r),
a AS (SELECT rid, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT rid, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS kept FROM a LEFT JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
