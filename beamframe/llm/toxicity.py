"""Toxicity by a linear-chain conditional random field.

Training (one task, a bounded sample; only the model comes back to the driver). ``labels`` marks documents, not tokens, so
tokens are labelled first: words and beginnings of words that separate toxic from
clean training documents, picked greedily by how many toxic documents they explain,
label their occurrences in toxic documents. The field is trained on these labelled
tokens (emissions: weights of the word and of its beginnings). At most TRAIN_DOCS
labelled documents of at most TRAIN_CHARS characters are read, the first by a hash of
their id; only rows whose crc32 of the id modulo 3 is not 1 are among them.

Scoring (all documents, whole texts, one Arrow stage, no shuffle). Forward-backward
gives each token's marginal m; a document's evidence is the sum of m * m, so many
unlikely tokens of a long text don't add up to a verdict; a logistic curve fitted on
the same sample turns it into a score. Runs of tokens with m >= 0.5 are the offending
spans.

Defined cases: null and empty texts have score 0; null ids are scored, never learnt
from, and not held out; several labels of one document count as the largest, null
labels not at all; of rows that repeat a labelled id the smallest text is learnt from;
without toxic or without clean training documents all scores are
0; rows that repeat an id are scored one by one; other columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import ALNUM_LOWER, Words, lean, slices, small_batches, words
from beamframe.llm.crf import forward_backward, train

TRAIN_DOCS = 2500
TRAIN_CHARS = 20_000
THRESHOLD = 0.7
#: Training documents that a feature must stand in to have a weight of its own.
LEAST_DOCS = 2
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7)
#: A telling feature is this many times as common in toxic documents, and explains this many at least.
LIFT, LEAST_EXPLAINED = 5, 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of the sample; its size is bounded by TRAIN_DOCS * TRAIN_CHARS."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"], docs["text"]).where(F.length("text") <= TRAIN_CHARS)
    # one text of each id, the smallest, so that the bound falls on documents and not on repeats of one
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    return [(r["text"], r["toxic"]) for r in training_rows(docs, labels, most).collect()]


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings of 4 to 7 characters."""
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) > k]]


def telling_features(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Features that mark toxic documents: common there, rare elsewhere, and explaining documents of their own.

    ``doc`` and ``feature`` list which document has which feature, each pair once.
    """
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    marked = toxic[doc]
    pos = np.bincount(feature[marked], minlength=len(sizes))
    clean = np.bincount(feature[~marked], minlength=len(sizes))
    least = max(LEAST_EXPLAINED, 0.01 * n_pos)
    good = (pos >= least) & (pos / n_pos >= LIFT * (clean + 0.5) / (n_neg + 1))
    of = marked & good[feature]
    order = np.argsort(feature[of], kind="stable")
    ids, cuts = np.unique(feature[of][order], return_index=True)
    options = {int(f): set(d.tolist()) for f, d in zip(ids, np.split(doc[of][order], cuts[1:]), strict=True)} if len(ids) else {}
    picked: list[int] = []
    open_ = set(np.flatnonzero(toxic).tolist())
    while options:
        best = max(options, key=lambda f: (len(options[f] & open_), -clean[f], sizes[f], -f))
        if len(options[best] & open_) < least:
            break
        picked.append(best)
        open_ -= options.pop(best)
    typical = float(np.median(pos[picked])) if picked else 0
    return [*picked, *[f for f in options if pos[f] >= 0.5 * typical and clean[f] <= 0.02 * pos[f]]]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    calibration: tuple[float, float]

    def evidence(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of each token, the sum of its squares over each text)."""
        codes, vocabulary = w.encoded()
        logits = np.array([self.bias + sum(self.weights.get(f, 0.0) for f in features(x)) for x in vocabulary.tolist()])[codes]
        m = forward_backward(logits, w.offsets, self.trans).marginals
        total = np.concatenate([[0], np.cumsum(m * m)])
        return m, np.maximum(total[w.offsets[1:]] - total[w.offsets[:-1]], 0)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * np.log1p(evidence) + b)))


def calibrate(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on log(1 + evidence), by Newton's method with a small penalty."""
    x = np.column_stack([np.log1p(evidence), np.ones(len(evidence))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (toxic - p) - np.array([1e-2, 0]) * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta += step * min(1, 5 / max(1e-9, float(np.abs(step).max())))
    return max(0.0, float(beta[0])), float(beta[1])


def fit(sample: list[tuple[str, int]]) -> Model | None:
    distinct = {t: y for t, y in sample}  # copies would count a family of documents as evidence many times
    texts, marks = list(distinct), [bool(y) for y in distinct.values()]
    if not any(marks) or all(marks):
        return None
    w = words(pa.array(texts, pa.string()), ALNUM_LOWER)
    codes, vocabulary = w.encoded()
    number: dict[str, int] = {}
    size, flat = np.zeros(len(vocabulary), np.int64), []
    for k, x in enumerate(vocabulary.tolist()):
        own = [number.setdefault(f, len(number)) for f in features(x)]
        size[k] = len(own)
        flat += own
    names, of = list(number), np.array(flat, np.int32)
    del number, flat
    first = np.cumsum(size) - size
    # each (document, feature) once
    each = np.unique(np.repeat(np.arange(len(texts)), np.diff(w.offsets)) * len(vocabulary) + codes)
    doc, word = each // len(vocabulary), each % len(vocabulary)
    at = np.repeat(first[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
    each = np.unique(np.repeat(doc, size[word]) * len(names) + of[at])
    doc, feature = each // len(names), each % len(names)
    toxic = np.array(marks, bool)
    telling = np.zeros(len(names), bool)
    telling[telling_features(doc, feature, toxic, np.array([len(x) for x in names]))] = True
    toxic_word = np.zeros(len(vocabulary), bool)
    toxic_word[np.repeat(np.arange(len(vocabulary)), size)[telling[of]]] = True
    states = (toxic_word[codes] & np.repeat(marks, np.diff(w.offsets))).astype(np.int64)
    seen = np.bincount(feature, minlength=len(names))
    del each, at, doc, feature
    own = np.full(len(names), -1)
    own[seen >= LEAST_DOCS] = np.arange(int((seen >= LEAST_DOCS).sum()))
    pairs = np.column_stack([np.repeat(np.arange(len(vocabulary)), size), own[of]])
    pairs = pairs[pairs[:, 1] >= 0]
    weights, bias, trans = train(codes, w.offsets, states, (pairs[:, 0], pairs[:, 1]), int((own >= 0).sum()))
    model = Model({names[f]: float(weights[own[f]]) for f in np.flatnonzero(own >= 0).tolist()}, bias, trans, (0.0, 0.0))
    return model._replace(calibration=calibrate(model.evidence(w)[1], toxic.astype(float)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
    model = fit(sample)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model and tuple(model))], pa.binary())], names=["model"])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the sample, fitted by one task."""
    fitted = training_rows(docs, labels).coalesce(1).mapInArrow(lean(_fit), "model binary").collect()
    parts = pickle.loads(fitted[0]["model"]) if fitted else None
    return parts and Model(*parts)


_SCORED = "doc_id {id}, score double, n_toxic_words long, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _score(model: Model | None, carry: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"), ALNUM_LOWER)
            n = len(w.offsets) - 1
            score, count, spans = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            if model is not None and len(w.starts):
                m, evidence = model.evidence(w)
                score = np.where(np.diff(w.offsets) > 0, model.score(evidence), 0.0)
                hot = np.flatnonzero(m >= 0.5)
                doc = np.searchsorted(w.offsets, hot, side="right") - 1
                count = np.bincount(doc, minlength=n)
                for d in np.unique(doc).tolist():
                    own = hot[doc == d]
                    runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
                    for r in runs:
                        at = int(w.text_offsets[d])
                        a, z = int(w.starts[r[0]]), int(w.ends[r[-1]])
                        begin = int(np.count_nonzero(w.data[at:a] & 0xC0 != 0x80))
                        spans[d].append({"start": begin, "end": begin + int(np.count_nonzero(w.data[a:z] & 0xC0 != 0x80))})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(count), pa.array(spans, _SPANS), *[b.column(c) for c in carry]], names=["doc_id", "score", "n_toxic_words", "spans", *carry])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_toxic_words, spans (code points), and the columns to carry."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    scored = docs.select("doc_id", "text", *[c for c in carry if c != "text"]).mapInArrow(lean(_score(model, list(carry))), _SCORED.format(id=docs.schema["doc_id"].dataType.simpleString()) + kinds)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic_words", "spans", *carry)
