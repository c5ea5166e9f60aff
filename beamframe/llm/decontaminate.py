"""Benchmark decontamination by an FM-index of each training shard.

A shard is a slice of a task's documents. Its words become symbols (words that no
benchmark item holds become the separator, which no test phrase can cross, so the
index keeps exactly what can match), ``FMIndex`` indexes them, all test phrases
are searched backwards at once, their occurrences are located by sampled suffix
positions, and overlapping occurrences merge into removal spans. No shuffle: the
documents stream through one Arrow stage.

The phrases are what the tasks share. They are cut into blocks of ``block_bytes``
of benchmark text; each block is one pass over the documents, so what a task
holds doesn't grow with the benchmark. Between blocks the spans found so far
travel with their document.

Defined cases: null text has no words; null ids are carried through; an item
without id or words is no item, repeated items with one id count once; rows that
repeat an id are judged one by one; other columns are ignored; an empty table
gives no rows and an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import ALNUM_LOWER, Words, discard, materialize, slices, small_batches, words
from beamframe.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20


class Phrases(NamedTuple):
    vocabulary: pa.StringArray
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """Distinct windows of the items' words and who has them."""
    w = words(pa.array([t for _, t in items], pa.string()), ALNUM_LOWER)
    codes, distinct = w.encoded()
    codes = codes + 1
    owners: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(items):
        own = codes[w.offsets[k] : w.offsets[k + 1]].tolist()
        for i in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[i : i + window]), set()).add(item)
    keys = sorted(owners)
    patterns = np.zeros((len(keys), window), np.int64)
    for i, k in enumerate(keys):
        patterns[i, : len(k)] = k
    return Phrases(pa.array(distinct, pa.string()), patterns, np.array([len(k) for k in keys], np.int64), [sorted(owners[k]) for k in keys])


def occurrences(w: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of all occurrences of phrases in a shard."""
    if not len(w.starts) or not len(p.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = pc.index_in(w.flat, value_set=p.vocabulary)
    x = found.fill_null(-1).to_numpy() + 1
    where = np.arange(len(x))
    begins = np.zeros(len(x), bool)
    begins[w.offsets[:-1][w.offsets[:-1] < len(x)]] = True
    # a separator in front of each text; runs of separators become one
    at = np.flatnonzero(begins)
    x, where = np.insert(x, at, 0), np.insert(where, at, -1)
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    x, where = x[keep], where[keep]
    if not x.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(x, len(p.vocabulary) + 1)
    low, high = index.count(p.patterns, p.lengths)
    n = np.maximum(high - low, 0)
    rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return where[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _pass(p: Phrases, last: bool, cut: bool, carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block of phrases over all documents: adds to ``spans`` (of words) and ``items``; the last one sums up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM_LOWER)
            at, phrase = occurrences(w, p)
            doc = np.searchsorted(w.offsets, at, side="right") - 1
            spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            order = np.argsort(doc, kind="stable")
            ids, cuts = np.unique(doc[order], return_index=True)
            for d, own in zip(ids.tolist(), np.split(order, cuts[1:]), strict=True) if len(ids) else ():
                s = at[own] - w.offsets[d]
                old = [(x["start"], x["end"]) for x in spans[d] or ()]
                new = merged(np.array([*[x for x, _ in old], *s]), np.array([*[x for _, x in old], *(s + p.lengths[phrase[own]])]))
                spans[d] = [{"start": x, "end": y} for x, y in new]
                items[d] = sorted({*(items[d] or ()), *(i for k in np.unique(phrase[own]).tolist() for i in p.items[k])})
            if not last:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, _SPANS), pa.array(items, _ITEMS), *map(b.column, carry)], names=["doc_id", "text", "spans", "items", *carry])
                continue
            out = {
                "doc_id": b.column("doc_id"),
                "n_words": pa.array(np.diff(w.offsets)),
                "n_hit": pa.array([sum(x["end"] - x["start"] for x in s or ()) for s in spans], pa.int64()),
                "n_items": pa.array([len(i or ()) for i in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(i or ()).encode()).hexdigest() for i in items]),
                "contaminated": pa.array([bool(s) for s in spans]),
                "items": pa.array([i or [] for i in items], _ITEMS),
                "spans": pa.array([[_characters(w, d, x["start"], x["end"]) for x in s or ()] for d, s in enumerate(spans)], _SPANS),
            }
            if cut:
                texts = b.column("text").to_pylist()
                out["text"] = pa.array([_without(t, s) for t, s in zip(texts, out["spans"].to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out | {c: b.column(c) for c in carry})

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ITEMS = pa.list_(pa.string())
_STATE = "doc_id {id}, text string, spans array<struct<start:int,end:int>>, items array<string>"
_RESULT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"


def _characters(w: Words, doc: int, start: int, end: int) -> dict[str, int]:
    """Words [start, end) of a text as a span of code points."""
    first = int(w.text_offsets[doc])
    a, b = int(w.starts[w.offsets[doc] + start]), int(w.ends[w.offsets[doc] + end - 1])
    begin = int(np.count_nonzero(w.data[first:a] & 0xC0 != 0x80))
    return {"start": begin, "end": begin + int(np.count_nonzero(w.data[a:b] & 0xC0 != 0x80))}


def _without(text: str | None, spans: list[dict[str, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: counts, items, removal spans in code points; with ``cut`` also the text without them; ``carry``: columns of ``docs`` to keep."""
    carry = list(carry or ())
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *[docs[c] for c in carry]
    )
    rest = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        p = phrases([(r["item_id"], r["text"]) for r in block.toLocalIterator()], window)
        last = k == blocks - 1
        shape = (_RESULT + ", text string" * cut if last else _STATE).format(id=kind) + rest
        state = state.mapInArrow(_pass(p, last, cut, carry), shape)
        if not last:  # the next block meets it from a table, so a task never holds the phrases of two blocks
            state = materialize(state, "decontaminate")
            if k:
                discard(held)
            held = state
    return state


ORACLE = f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM bi),
di AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM di, (SELECT DISTINCT size FROM bw) WHERE i + size - 1 <= len(w)),
o AS (SELECT rid, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.phrase = bw.phrase),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM o) GROUP BY rid),
s AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""
