"""Near-dedup by b-bit MinHash.

1. One Arrow stage reads each whole text: its set of 5-word shingles, the set's
   digest, 160 minima as 40 band keys, and the low 2 bits of 2048 minima packed in
   bit planes.
2. Documents with one set are one node from here on, so copies never meet as pairs.
3. Nodes that share a band key are candidates. Round 1 pairs each node with the
   smallest node of its bucket only: as many pairs as nodes. Bit counts of the
   packed planes give the collision-corrected similarity; what lies more than five
   standard deviations under the threshold goes. The rest is confirmed on full sets.
4. The links so far give components. Nodes of a bucket that are still in different
   components are compared in blocks of bounded size, by bit counts. A task returns a
   spanning forest of its likely pairs, never the pairs: at most a row for each row
   that it reads. The forests join components that may be linked into families.
5. Within a family the full sets of all nodes meet in blocks of bounded size, each with
   each. Pairs of different components are confirmed there, and a task again returns a
   spanning forest, of confirmed links. So no likely pair between different components
   is left untested, and what is written grows with the nodes, not with their pairs.
6. Components of all confirmed links; the smallest document of each stays.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**40 < 3e-7.

Full sets travel only for nodes in a candidate pair: a bitmap of fixed size drops
most others before the shuffle.

Defined cases: null and blank texts have no shingles and stand alone; a null id is
never the smallest unless all ids of the component are null (``component_id`` is
then null and the row stays); rows that repeat an id are separate rows of one
verdict each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import SPACED_LOWER, Bits, discard, groups, in_blocks, inside_documents, key_bits, lean, materialize, mix, slices, small_batches, window_hashes, words
from beamframe.llm.components import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 4
#: Minima whose low bits are packed, and bits of each.
PACKED, LOW_BITS = 2048, 2
#: Estimates under this are pruned: 0.75 less five standard deviations of the estimate (0.0115).
PRUNE = 0.692
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 1024
#: Shingles of a block of a family: a family is cut in blocks of FEW, up to SPREAD blocks, then in as many blocks of MANY as it takes.
FEW, SPREAD, MANY = 1 << 15, 16, 1 << 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets)."""
    w = words(texts, SPACED_LOWER)
    h = w.hashes()
    n = np.diff(w.offsets)
    full = window_hashes(h, size)
    ok = inside_documents(w.offsets, size, len(h))[: len(full)]
    doc = np.repeat(np.arange(len(n)), n)
    flat, of = full[ok], doc[: len(full)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.concatenate([window_hashes(h[w.offsets[d] : w.offsets[d + 1]], int(n[d])) for d in short])
        at = np.searchsorted(of, short)
        flat, of = np.insert(flat, at, whole), np.insert(of, at, short)
    offsets = np.searchsorted(of, np.arange(len(n) + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    count = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(new, out=count[1:])
    return flat[new], count[offsets]


def minima(flat: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of ``count`` hash functions over each non-empty set (rows)."""
    starts = offsets[:-1]
    x = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), count), np.uint32)
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    step = 1 << 17  # stays in cache
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + step, side="right")) - 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part, at = x[offsets[a] : offsets[b]], starts[a:b] - offsets[a]
        for k in range(count):
            t = (part ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint32(1))
            t ^= t >> np.uint32(15)
            out[a:b, k] = np.minimum.reduceat(t, at)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (columns) of each set."""
    key = np.zeros((len(m), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return key.view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """Bit plane b of the low bits of PACKED minima, as PACKED / 64 numbers each."""
    planes = [np.packbits((m[:, :PACKED] >> b) & 1, axis=1, bitorder="little").view(np.int64) for b in range(LOW_BITS)]
    return np.concatenate(planes, axis=1)


_SKETCH = "rid long, doc_id {id}, n_shingles long, node long, bands array<long>, planes array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        flat, offsets = shingle_sets(b.column("text"))
        n = np.diff(offsets)
        on = np.flatnonzero(n)
        m = minima(flat, np.append(offsets[:-1][on], offsets[-1]), max(BANDS * ROWS, PACKED)) if len(on) else np.zeros((0, max(BANDS * ROWS, PACKED)), np.uint32)
        raw = flat.astype("<u8")
        node = [np.frombuffer(hashlib.blake2b(raw[a:z], digest_size=8).digest(), "<i8")[0] for a, z in zip(offsets[:-1][on], offsets[1:][on], strict=True)]
        nodes = np.zeros(len(n), np.int64)
        nodes[on] = node

        def lists(x: np.ndarray) -> pa.Array:
            size = np.zeros(len(n), np.int32)  # noqa: B023
            size[on] = x.shape[1]  # noqa: B023
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))

        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("doc_id"), pa.array(n), pa.array(nodes, mask=n == 0), lists(band_keys(m)), lists(pack(m))],
            names=["rid", "doc_id", "n_shingles", "node", "bands", "planes"],
        )


def estimate(a: str, b: str) -> Column:
    """Similarity by the bits in which two packed signatures agree, corrected for chance collisions."""
    words_ = PACKED // 64
    agree = [F.bit_count(F.bitwise_not(reduce(lambda x, y: x.bitwiseOR(y), [F.col(a)[p * words_ + i].bitwiseXOR(F.col(b)[p * words_ + i]) for p in range(LOW_BITS)]))) for i in range(words_)]
    chance = 2.0**-LOW_BITS
    return (reduce(lambda x, y: x + y, agree) / F.lit(float(PACKED)) - chance) / (1 - chance)


def _sets(bits: Bits):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.filter(pa.array(bits.has(b.column("rid").to_numpy())))
            if b.num_rows:
                flat, offsets = shingle_sets(b.column("text"))
                raw = flat.astype("<u8")
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([raw[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["rid", "full"])

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("full_a"), b.column("full_b"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        if any(keep):
            yield b.select(["a", "b"]).filter(pa.array(keep))


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose full sets are similar enough."""
    about = nodes.select("node", "rid", "n_shingles", "planes")
    side = lambda s: about.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in about.columns])
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = likely.where(100 * F.least("n_shingles_a", "n_shingles_b") >= PERCENT * F.greatest("n_shingles_a", "n_shingles_b")).where(estimate("planes_a", "planes_b") >= PRUNE)
    likely = materialize(likely.select("a", "b", "rid_a", "rid_b"), "likely")
    bits = key_bits(likely.select(F.col("rid_a").alias("rid")).unionByName(likely.select(F.col("rid_b").alias("rid"))), "rid")
    sets = texts.mapInArrow(lean(_sets(bits)), "rid long, full binary")
    full = lambda s: sets.select(F.col("rid").alias(f"rid_{s}"), F.col("full").alias(f"full_{s}"))
    joined = likely.join(full("a"), "rid_a").join(full("b"), "rid_b").select("a", "b", "full_a", "full_b")
    return materialize(joined.mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, over components, of the likely pairs of each block pair of a bucket."""
    width = PACKED // 64
    least = (PRUNE * (1 - 2.0**-LOW_BITS) + 2.0**-LOW_BITS) * PACKED
    for table, cuts in groups(batches, ("key", "i", "j")):
        root, size, block, i, j = (table.column(x).to_numpy() for x in ("root", "n_shingles", "block", "i", "j"))
        every = table.column("planes").combine_chunks().flatten().to_numpy().reshape(len(table), LOW_BITS, width).view(np.uint64)
        a, b = [], []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left, right = np.flatnonzero(block[low:high] == i[low]), np.flatnonzero(block[low:high] == j[low])
            own, n, planes = root[low:high], size[low:high], every[low:high]
            now = own.copy()
            for x in left.tolist():
                y = right[now[right] != now[x]]
                y = y[100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])]
                if not len(y):
                    continue
                agree = PACKED - np.bitwise_count(np.bitwise_or.reduce(planes[y] ^ planes[x], axis=1)).sum(axis=1, dtype=np.int64)
                y = y[agree >= least]
                met, first = np.unique(now[y], return_index=True)
                if len(met):
                    a += [own[x]] * len(met)
                    b += own[y[first]].tolist()
                    now[np.isin(now, met)] = now[x]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, over components, of the links of each block pair of a family."""
    for table, cuts in groups(batches, ("family", "i", "j")):
        node, root, block, i, j = (table.column(x).to_numpy() for x in ("node", "root", "block", "i", "j"))
        every = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("full")]
        a, b = [], []
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            left, right = np.flatnonzero(block[low:high] == i[low]), np.flatnonzero(block[low:high] == j[low])
            sets = every[low:high]
            size = np.array([len(s) for s in sets])
            ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
            of = np.split(flat, np.cumsum(size)[:-1])
            now, mark = root[low:high].copy(), np.zeros(len(ids), bool)
            for x in left.tolist():
                y = right[now[right] != now[x]]
                y = y[100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])]
                if not len(y):
                    continue
                mark[of[x]] = True
                both = np.add.reduceat(mark[np.concatenate([of[k] for k in y])], np.cumsum(size[y]) - size[y], dtype=np.int64)
                mark[of[x]] = False
                y = y[100 * both >= PERCENT * (size[x] + size[y] - both)]
                met, first = np.unique(now[y], return_index=True)
                if len(met):
                    a += [node[low + x]] * len(met)
                    b += node[low + y[first]].tolist()
                    now[np.isin(now, met)] = now[x]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _families(shared: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components (node, root): enough of them to join all that are linked."""
    placed = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = materialize(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"), "mixed")
    rows = mixed.join(placed, "key").join(nodes.select("node", "n_shingles", "planes"), "node").select("key", "node", "root", "n_shingles", "planes", "size")
    likely = in_blocks(rows, "key", F.ceil(F.col("size") / BLOCK), "node").drop("size", "node")
    joined = materialize(likely.mapInArrow(lean(_across), "a long, b long").distinct(), "forest")
    family = materialize(components(joined).select(F.col("node").alias("root"), F.col("root").alias("family")), "families")
    about = nodes.select("node", "rid", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(family, "root")
    members = materialize(about, "members")
    total = members.groupBy("family").agg(F.sum("n_shingles").alias("total"))
    sets = texts.mapInArrow(lean(_sets(key_bits(members, "rid"))), "rid long, full binary")
    rows = members.join(total, "family").join(sets, "rid").select("family", "node", "root", "full", "total")
    blocks = F.greatest(F.ceil(F.col("total") / MANY), F.least(F.ceil(F.col("total") / FEW), F.lit(SPREAD)))
    met = in_blocks(rows, "family", blocks, "node").drop("total")
    found = materialize(met.mapInArrow(lean(_within), "a long, b long").distinct(), "family-links")
    discard(mixed, joined, family, members)
    return found


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.xxhash64(id_col, text_col).alias("rid"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sketches = materialize(texts.mapInArrow(lean(_sketch), _SKETCH.format(id=kind)), "sketches")
    nodes = materialize(
        sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("planes").alias("planes")),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = materialize(members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("size")).where("hub != top").select("key", "hub", "size"), "buckets")
    shared = materialize(members.join(buckets, "key"), "shared")
    first = _links(shared.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, texts.select("rid", "text"))

    roots = materialize(components(first), "roots")
    second = _families(shared, nodes, roots, texts.select("rid", "text"))
    # a root stands for its component
    named = second.join(roots.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b").join(roots.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = materialize(components(stars.unionByName(named)), "components")
    discard(buckets, shared, first, roots, second)
    smallest = final.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    verdict = nodes.select("node", "doc_id").join(final, "node", "left").join(materialize(smallest, "smallest"), "root", "left")
    verdict = verdict.select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "node").join(materialize(verdict, "verdict"), "node", "left")
    discard(nodes, final)
    chosen = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", chosen.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {SHINGLE}, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
