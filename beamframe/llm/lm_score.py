"""Cross-entropy difference of two matched n-gram models.

The target model is counted on the documents that ``labels`` marks as good
(quality 1), the background model on all documents. Both are bigram models over one
vocabulary with the same smoothing: every word of all documents, one id for a word
that was never seen, one for the start of a text. Nothing is cut: the tables of words
and pairs grow with the corpus, and are never gathered in one place.

A document is scored by what the other documents say: its own counts are taken off
each model that it is part of. Counts of the background are scaled by the models'
numbers of tokens, so both weigh alike against the smoothing.

1. Texts are packed in blocks. A block lists its distinct words and (h, w) pairs once,
   as keys with its own counts, packed by buckets of the key.
2. A bucket adds up each key's counts of both models over all blocks and answers each
   block in the order of its keys, so a very common pair costs one entry a block. It
   adds how many words it has, and their counts: all buckets together tell a block the
   vocabulary and the sizes of the models.
3. A block meets its answers and scores its texts.

A key is a 64-bit digest of the word or the pair: of 10^10 distinct keys, about three
share one, and their counts add up.

With V words, c(.) and N of a model without the document, s = 1 for the target and
(tokens of the target) / (tokens of the background) for the background, the loss of a
token is -log2 p(w | h), p(w | h) = (s c(h, w) + MU p(w)) / (s c(h) + MU),
p(w) = (s c(w) + 1) / (s N + V + 1). A document's score is the mean loss under the
target model less the mean loss under the background model: lower is closer to the
target.

Defined cases: null and blank texts have no tokens and score 0; null ids are scored
and counted as background; several labels of one document count as the largest;
rows that repeat an id are separate documents; without any target document s is 0, both
models are those of smoothing alone, and all differences are 0; other columns are never
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import SPACED_LOWER, Bits, discard, hash_strings, key_bits, lean, materialize, mix, raw, slices, small_batches, trim, words

MU = 200.0
#: Bytes of text of a block, unless one text is longer.
BLOCK_BYTES = 6 << 20
#: Of the texts' compression: they travel once more than they are packed.
LEVEL = 5
#: What sets the keys of words and pairs apart, and the key of the start of a text.
WORD, START = np.uint64(0x57), mix(np.array([0x5354415254], np.uint64))

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, gathered to about BLOCK_BYTES of text each."""
    held, size = [], 0
    for b in slices(batches, "text"):
        n = len(raw(b.column("text"))[0])
        if held and size + n > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _squeeze(x: np.ndarray, kind: str) -> bytes:
    """Numbers by the place of their bytes, compressed: the first bytes of sorted keys take next to nothing."""
    x = np.ascontiguousarray(x, dtype=kind)
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _expand(x: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()


_PACKED = "block string, docs array<{id}>, good binary, lengths binary, data binary, size long"


def _pack(id_type: pa.DataType):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, b in enumerate(_blocks(batches)):
            data, off = raw(b.column("text"))
            good = b.column("good").to_numpy(zero_copy_only=False)
            row = (f"{task}-{k}", b.column("doc_id").to_pylist(), _squeeze(good, "u1"), _squeeze(np.diff(off), "<u4"), pa.Codec("zstd", compression_level=LEVEL).compress(data.tobytes(), asbytes=True), len(data))
            kinds = [pa.string(), pa.list_(id_type), *[pa.binary()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


class _Block(NamedTuple):
    """Words of a block of texts: tokens of each text, text and word of each token, its pair, the distinct words, and the two words of each pair."""

    lengths: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    pair: np.ndarray
    distinct: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _read(r: dict) -> _Block:
    lengths = _expand(r["lengths"], "<u4", len(r["docs"]))
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = pa.decompress(r["data"], r["size"], codec="zstd", asbytes=True)
    w = words(pa.StringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(data)), SPACED_LOWER)
    code, distinct = w.encoded()
    code, v, n = code.astype(np.int64), len(distinct), np.diff(w.offsets)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[w.offsets[:-1][n > 0]] = v  # the start of a text comes behind the words
    pairs = pa.array(before * max(v, 1) + code).dictionary_encode()
    return _Block(n, np.repeat(np.arange(len(n)), n), code, pairs.indices.to_numpy(), distinct, *np.divmod(pairs.dictionary.to_numpy(), max(v, 1)))


def _keys(t: _Block, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, bounds of the buckets in it, keys in it) of the words and the start, then of the pairs."""
    one = np.append(mix(hash_strings(t.distinct) ^ WORD) if len(t.distinct) else np.zeros(0, np.uint64), START)
    out = []
    for x in (one, mix(mix(one[t.left]) + one[t.right])):
        bucket = (mix(x) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((x, bucket))
        out.append((order, np.searchsorted(bucket[order], np.arange(buckets + 1)), x[order]))
    return out


#: A block's words (kind 1) or pairs (kind 2) of a bucket: keys, and counts in all texts and in target texts.
_SENT = "block string, kind int, bucket int, n int, keys binary, background binary, target binary"


def _send(buckets: int):  # noqa: ANN202
    kinds = [pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 3]
    names = [c.split()[0] for c in _SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _one_by_one(batches):
            t = _read(r)
            good = _expand(r["good"], "u1", len(r["docs"])).astype(bool)
            mine = np.repeat(good, t.lengths)
            rows: list[tuple] = []
            for kind, number, (order, cuts, x) in zip((1, 2), (t.code, t.pair), _keys(t, buckets), strict=True):
                counts = [np.bincount(c, minlength=len(order)) for c in (number, number[mine])]
                if kind == 1:
                    counts[0][-1], counts[1][-1] = (t.lengths > 0).sum(), (t.lengths[good] > 0).sum()
                for i in range(buckets):
                    at = slice(cuts[i], cuts[i + 1])
                    if kind == 1 or cuts[i + 1] > cuts[i]:  # the words' answer is awaited from every bucket
                        rows.append((r["block"], kind, i, int(cuts[i + 1] - cuts[i]), _squeeze(x[at], "<u8"), *[_squeeze(c[order][at], "<u8") for c in counts]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


#: Counts of a block's keys in both models; for words also the distinct words of the bucket and all their counts.
_ANSWER = "block string, kind int, bucket int, n int, background binary, target binary, vocabulary long, background_tokens long, target_tokens long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's keys of a bucket come back as their counts over all blocks."""
    held: dict[tuple[int, int], list[dict]] = {}
    for r in _one_by_one(batches):
        held.setdefault((r["bucket"], r["kind"]), []).append(r)
    kinds = [pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 2, *[pa.int64()] * 3]
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    for bucket, kind in sorted(held):
        rows = held.pop((bucket, kind))
        keys = np.concatenate([_expand(r["keys"], "<u8", r["n"]) for r in rows])
        found, at = np.unique(keys, return_inverse=True)
        models = [np.bincount(at, np.concatenate([_expand(r[m], "<u8", r["n"]) for r in rows]), len(found)).astype(np.uint64) for m in ("background", "target")]
        word = found != START[0]
        sums = (int(word.sum()), *[int(m[word].sum()) for m in models]) if kind == 1 else (0, 0, 0)
        z = 0
        for r in rows:
            a, z = z, z + r["n"]
            row = (r["block"], kind, bucket, r["n"], *[_squeeze(m[at[a:z]], "<u8") for m in models], *sums)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)


def losses(v: int, tokens: np.ndarray, both: np.ndarray, c: np.ndarray, h: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """-log2 p of each pair by its count, its word's and that of the word before; ``tokens`` is the size of the model."""
    return -np.log2((scale * both + MU * (scale * c + 1) / (scale * tokens + v + 1)) / (scale * h + MU))


def _own(doc: np.ndarray, number: np.ndarray, most: int) -> np.ndarray:
    """How often each token's number stands in its text."""
    e = pa.array(doc * max(most, 1) + number).dictionary_encode().indices.to_numpy()
    return np.bincount(e)[e] if len(e) else np.zeros(0, np.int64)


def _score(buckets: int):  # noqa: ANN202
    def scored(text: dict, parts: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        t = _read(text)
        if sum(r["kind"] == 1 for r in parts) != buckets:
            raise ValueError(f"block {text['block']} lacks answers")
        parts.sort(key=lambda r: (r["kind"], r["bucket"]))
        v, size = sum(r["vocabulary"] or 0 for r in parts), {m: sum(r[f"{m}_tokens"] or 0 for r in parts) for m in ("background", "target")}
        good = _expand(text["good"], "u1", len(text["docs"])).astype(np.int64)
        first = np.cumsum(t.lengths) - t.lengths
        own_word, own_pair = _own(t.doc, t.code, len(t.distinct)), _own(t.doc, t.pair, len(t.left))
        keys = _keys(t, buckets)
        before = t.left[t.pair]
        own_before = np.append(0, own_word[:-1])[: len(own_word)]
        own_before[before == len(t.distinct)] = 1
        mean = []
        for model in ("target", "background"):
            single, both = (np.empty(len(order)) for order, *_ in keys)
            for kind, c, (order, *_) in zip((1, 2), (single, both), keys, strict=True):
                c[order] = np.concatenate([np.zeros(0), *[_expand(r[model], "<u8", r["n"]) for r in parts if r["kind"] == kind]])
            inside = good[t.doc] if model == "target" else np.ones(len(t.doc), np.int64)
            scale = 1.0 if model == "target" else size["target"] / max(size["background"], 1)
            loss = losses(v, size[model] - inside * t.lengths[t.doc], both[t.pair] - inside * own_pair, single[t.code] - inside * own_word, single[before] - inside * own_before, scale)
            total = np.concatenate([[0], np.cumsum(loss)])
            mean.append((total[first + t.lengths] - total[first]) / np.maximum(t.lengths, 1))
        return pa.RecordBatch.from_arrays([pa.array(text["docs"], id_type), pa.array(t.lengths), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], names=["doc_id", "n_tokens", "target_bits", "background_bits", "difference"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, dict] = {}
        parts: dict[str, list[dict]] = {}
        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field("docs").type.value_type
            for r in b.to_pylist():
                if r["kind"] is None:
                    texts[r["block"]] = r
                else:
                    parts.setdefault(r["block"], []).append(r)
        for name in list(texts):
            yield scored(texts.pop(name), parts.pop(name, []), id_type)
            trim()

    return run


def _members(bits: Bits, wanted: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(bits.has(b.column("rid").to_numpy()) == wanted)).select(["doc_id", "text"])

    return run


def lm_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_bits, background_bits, difference."""
    spark = docs.sparkSession
    small_batches(spark)
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    # most other texts are told apart before the shuffle; the join is exact, and the same at every size
    good = materialize(good, "target-ids")
    bits = key_bits(good.select(F.xxhash64("doc_id").alias("rid")), "rid")
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select(F.xxhash64("doc_id").alias("rid"), "doc_id", "text")
    likely, sure = (named.mapInArrow(_members(bits, x), f"doc_id {kind}, text string") for x in (True, False))
    marked = likely.join(good.select(F.col("doc_id").alias("good_id")).hint("merge"), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("good"))
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    marked = materialize(marked, "lm-marked")  # the blocks below are named by task, so a task that runs again must meet the same rows
    both = sure.select("doc_id", "text", F.lit(False).alias("good")).unionByName(marked)
    blocks = materialize(both.mapInArrow(lean(_pack(id_type)), _PACKED.format(id=kind)), "lm-blocks")
    discard(good, marked)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = blocks.mapInArrow(lean(_send(tasks)), _SENT).repartitionById(tasks, F.col("bucket")).mapInArrow(lean(_answer), _ANSWER)
    met = blocks.unionByName(answers, allowMissingColumns=True).repartition(tasks, "block")
    return met.mapInArrow(lean(_score(tasks)), f"doc_id {kind}, n_tokens long, target_bits double, background_bits double, difference double")
