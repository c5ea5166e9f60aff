"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, lower-cased. Lines are linked when
100 * intersection >= PERCENT * union. A line goes if a line before it, by document id
and line number, is linked to it. Each document returns its linked lines, with the
class (connected component) and the number of links of each.

1. Words of all lines are counted in a table of fixed size (by hash), which gives each
   token its rarity level: rare first, ties by hash. Collisions only change the order.
2. Equal token sets are one node. A node lists the first n - ceil(0.8 n) + 1 tokens
   of that order: linked sets share one of them (prefix filter). Prefixes travel
   packed, by buckets of the token, with a 128-bit parity sketch of the whole set.
3. Nodes that share a token are candidates if the length filter, the positional filter
   (what can still be shared behind the two places) and the sketch (sets that differ
   in d bits differ in d tokens at least) allow it. A bucket returns a spanning forest
   of its candidates, not the pairs; a token of more than LIST nodes is compared in
   blocks of bounded size, every block with every other, with a forest each. The
   forests make families: all links are inside one.
4. Full sets and places of the lines of families are read again. A family's sets meet
   in blocks of bounded size, each with each, where all pairs are verified once. A task
   returns for each node its number of links, its first linked line and a class of its
   own: no more rows than it reads, though a family of similar lines has all its pairs.

Tokens have 56 bits of a hash and nodes are 64-bit digests of their tokens, so
"exact" holds up to their chance collisions.

Defined cases: null text counts as empty; a line without words is never removed; a
null id comes before all others; rows that repeat an id are separate, but their lines
that stand at the same number tie, and stay together; rows equal in id and text share
their verdicts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import SPACED_LOWER, Bits, discard, groups, in_blocks, key_bits, lean, materialize, mix, raw, slices, small_batches
from beamframe.llm.components import components, labels

PERCENT = 80
#: Entries of the rarity table, as a power of two.
RARITY = 20
#: Bytes of text that one step tokenises, unless one text is longer.
STEP_BYTES = 2 << 20
#: Pairs that one step compares, nodes of a token beyond which it is compared in blocks, and nodes of a block.
PAIRS = 1 << 18
LIST = 2048
BLOCK = 1024
#: Tokens of a block of a family: a family is cut in blocks of FEW, up to SPREAD blocks, then in as many blocks of MANY as it takes.
FEW, SPREAD, MANY = 1 << 15, 16, 1 << 20
#: Nodes of a family from which on each is compared with all others at once.
WIDE = 24

#: Odd multipliers for polynomial hashes modulo 2**64, the second undoing the first, and a number for each byte.
UP = 0x9E3779B97F4A7C15
DOWN = pow(UP, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(base: int, log2: int) -> np.ndarray:
    out = np.full(1 << log2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, 64-bit hash of each word, lower-cased) of the texts that ``off`` cuts ``data`` into."""
    to, is_word = SPACED_LOWER
    inside = is_word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    cuts = np.unique(off[(off > 0) & (off < len(data))])
    cuts = cuts[inside[cuts - 1] & inside[cuts]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    log2 = max(16, int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[to][data] * _powers(UP, log2)[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * _powers(DOWN, log2)[starts] + (ends - starts).astype(np.uint64))


def token_sets(texts: pa.Array, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens of all lines, in rarity order in each; offsets; text of each line; number of each line in its text; lines of each text).

    A token is its level, then 56 bits of its hash. Empty last lines aren't listed.
    """
    data, off = raw(texts)
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([off, breaks + 1]))
    doc = np.searchsorted(off, cuts[:-1], side="right") - 1
    number = np.searchsorted(breaks, cuts[:-1]) - np.searchsorted(breaks, off[doc])
    starts, h = word_hashes(data, off)
    h = (level[(h >> np.uint64(64 - RARITY)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    at = np.searchsorted(starts, cuts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    count = np.concatenate([[0], np.cumsum(new)])
    return h[new], count[at], doc, number, np.diff(np.searchsorted(breaks, off)) + 1


def set_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each token set; 0 for none."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(0x51ED270B)))])
    key = mix((total[offsets[1:]] - total[offsets[:-1]]) ^ (np.diff(offsets).astype(np.uint64) << np.uint64(40))).view(np.int64)
    return np.where(np.diff(offsets) > 0, key, 0)


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set: the parity of its tokens at each of 128 places."""
    place = (h * np.uint64(UP)) >> np.uint64(57)
    bit = np.uint64(1) << (place & np.uint64(63))
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k in (0, 1):
        parity = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)))])
        out[:, k] = parity[offsets[1:]] ^ parity[offsets[:-1]]
    return out


def possible(n: np.ndarray, place: np.ndarray, sketch: np.ndarray, m: np.ndarray, other: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Length, positional and sketch filter of sets of n and m tokens that share the token at these places."""
    least = PERCENT * (n + m)
    behind = np.minimum(n - place, m - other) + np.minimum(place, other)
    differ = np.bitwise_count(sketch ^ its).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * behind >= least) & ((100 + PERCENT) * ((n + m - differ) // 2) >= least)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << RARITY, np.int64)
    for b in slices(batches, "text", STEP_BYTES):
        table += np.bincount((word_hashes(*raw(b.column("text")))[1] >> np.uint64(64 - RARITY)).astype(np.int64), minlength=1 << RARITY)
    step = 1 << 14
    for at in range(0, len(table), step):
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([table[at : at + step].astype("<u4").tobytes()], pa.binary())], names=["at", "n"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
            held[at] = held.get(at, 0) + np.frombuffer(n, "<u4").astype(np.int64)
    for at, n in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.minimum(n, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["at", "n"])


def rarity(texts: DataFrame) -> np.ndarray:
    """The level of each entry: an eighth of a power of two of its count, 0 for a word that stands once in all texts."""
    out = np.zeros(1 << RARITY, np.uint32)
    for r in texts.select("text").mapInArrow(lean(_count), "at long, n binary").repartition("at").mapInArrow(lean(_sum), "at long, n binary").collect():  # 4 bytes an entry
        out[r["at"] : r["at"] + len(r["n"]) // 4] = np.frombuffer(r["n"], "<u4")
    return np.minimum(255, np.log2(np.maximum(out, 1)) * 8).astype(np.uint8)


#: The nodes of a slice of texts with their numbers of lines, and its prefix entries, packed by buckets of the node or the token.
_SENT = "bucket int, nodes binary, lines binary, token binary, node binary, n binary, place binary, sketch binary"


def _send(level: np.ndarray, buckets: int):  # noqa: ANN202
    kinds = [pa.int32(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in _SENT.split(", ")]

    def by_bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (mix(x) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((x, bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP_BYTES):
            h, off, *_ = token_sets(b.column("text"), level)
            key, one, lines = np.unique(set_keys(h, off), return_index=True, return_counts=True)
            key, one, lines = key[key != 0], one[key != 0], lines[key != 0]
            if not len(key):
                continue
            n = np.diff(off)[one]
            sketch = sketches(h, off)[one]
            prefix = n - -(-PERCENT * n // 100) + 1
            line = np.repeat(np.arange(len(one)), prefix)
            place = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            t = h[off[one][line] + place]
            shared = t >> np.uint64(56) > 0  # the others stand in this line alone
            t, line, place = t[shared], line[shared], place[shared]
            (nodes, at), (entries, cuts) = by_bucket(key.view(np.uint64)), by_bucket(t)
            rows = []
            for i in range(buckets):
                o, e = nodes[at[i] : at[i + 1]], entries[cuts[i] : cuts[i + 1]]
                if len(o) or len(e):
                    x = line[e]
                    rows.append((i, *[y.tobytes() for y in (key[o], lines[o].astype("<u4"), t[e].astype("<u8"), key[x], n[x].astype("<u4"), place[e].astype("<u4"), sketch[x].astype("<u8"))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


#: Kind 0: nodes of several lines (a); kind 1: candidates a and b, a forest; kind 2: the nodes (a) of crowds.
_MET = "kind int, a long, b long, token long, n int, place int, low long, high long"


def _candidates(token: np.ndarray, n: np.ndarray, place: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left entries, right entries, entries of crowds), of entries sorted by token and n."""
    _, first, size = np.unique(token, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(size)), size)
    rank = (of.astype(np.int64) << 32) + n
    ahead = np.searchsorted(rank, (of.astype(np.int64) << 32) + np.minimum(100 * n // PERCENT, (1 << 32) - 1), side="right") - np.arange(len(n)) - 1
    ahead[size[of] > LIST] = 0
    work = np.concatenate([[0], np.cumsum(ahead)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PAIRS, side="right")) - 1)
        more = ahead[lo:hi]
        i = np.repeat(np.arange(lo, hi), more)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
        ok = possible(n[i], place[i], sketch[i], n[j], place[j], sketch[j])
        yield i[ok], j[ok], lo + np.flatnonzero(size[of[lo:hi]] > LIST)
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these pairs as stars: each member with the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = labels(at[: len(a)], at[len(a) :], len(ids))
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of several lines, a forest of the candidates, and the nodes of crowds."""
    fields = [(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _MET.split(", ")]

    def batch(kind: int, m: int, **columns: np.ndarray) -> pa.RecordBatch:
        columns["kind"] = np.full(m, kind)
        return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(t.to_pandas_dtype()), t) if c in columns else pa.nulls(m, t) for c, t in fields], names=[c for c, _ in fields])

    kinds = {"nodes": "<i8", "lines": "<u4", "token": "<u8", "node": "<i8", "n": "<u4", "place": "<u4", "sketch": "<u8"}
    held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for b in batches:
        for c, t in kinds.items():
            held[c] += [np.frombuffer(x.as_buffer(), t) for x in b.column(c)]
    if not held["nodes"]:
        return
    nodes, lines, token, node, n, place, sketch = (np.concatenate(held.pop(c)) for c in kinds)
    ids, at = np.unique(nodes, return_inverse=True)
    several = ids[np.bincount(at, lines) > 1]
    yield batch(0, len(several), a=several)
    by = np.lexsort((node, n, token))
    if not len(by):
        return
    by = by[np.append(True, (token[by][1:] != token[by][:-1]) | (node[by][1:] != node[by][:-1]))]
    token, node, n, place, sketch = token[by], node[by], n[by].astype(np.int64), place[by].astype(np.int64), sketch.reshape(-1, 2)[by]
    pairs: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for i, j, crowd in _candidates(token, n, place, sketch):
        pairs.append(np.stack([node[i], node[j]]))
        if sum(p.shape[1] for p in pairs) > 4 * PAIRS:
            pairs = [np.stack(forest(*np.concatenate(pairs, axis=1)))]
        if len(crowd):
            s = sketch[crowd].view(np.int64)
            yield batch(2, len(crowd), a=node[crowd], token=token[crowd].view(np.int64), n=n[crowd], place=place[crowd], low=s[:, 0], high=s[:, 1])
    a, b = forest(*np.concatenate(pairs, axis=1))
    yield batch(1, len(a), a=a, b=b)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the candidates of each block pair of a crowd."""
    for table, cuts in groups(batches, ("token", "i", "j")):
        c = {x: table.column(x).to_numpy().astype(np.int64) for x in ("node", "n", "place", "block", "i", "j")}
        every = np.stack([table.column(x).to_numpy() for x in ("low", "high")], axis=1).view(np.uint64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            node, n, place, block = (c[x][low:high] for x in ("node", "n", "place", "block"))
            sketch = every[low:high]
            left, right = np.flatnonzero(block == c["i"][low]), np.flatnonzero(block == c["j"][low])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in left.tolist():
                y = right[node[right] != node[x]]
                y = y[possible(n[x], place[x], sketch[x], n[y], place[y], sketch[y])]
                a.append(np.full(len(y), node[x]))
                b.append(node[y])
                if sum(map(len, a)) > PAIRS:
                    u, v = forest(np.concatenate(a), np.concatenate(b))
                    a, b = [u], [v]
            u, v = forest(np.concatenate(a), np.concatenate(b))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])


#: Kind 0: a text with its number of lines, and those that count by number and node; kind 1: the full set of a node.
_READ = "kind int, rid long, doc {id}, n_lines long, numbers array<int>, nodes array<long>, node long, full binary"


def _lines(bits: Bits, level: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP_BYTES):
            h, off, doc, number, total = token_sets(b.column("text"), level)
            key = set_keys(h, off)
            on = np.flatnonzero((key != 0) & bits.has(key))
            at = pa.array(np.searchsorted(doc[on], np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (number[on].astype(np.int32), key[on])]
            _, one = np.unique(key[on], return_index=True)
            one = on[one]
            full = h.astype("<u8")
            sets = len(one)
            columns = [
                np.repeat([0, 1], [b.num_rows, sets]).astype(np.int32),
                *[pa.concat_arrays([x, pa.nulls(sets, x.type)]) for x in (b.column("rid"), b.column("doc"), pa.array(total, pa.int64()), *lists)],
                pa.concat_arrays([pa.nulls(b.num_rows, pa.int64()), pa.array(key[one])]),
                pa.concat_arrays([pa.nulls(b.num_rows, pa.binary()), pa.array([full[off[i] : off[i + 1]].tobytes() for i in one.tolist()], pa.binary())]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _READ.split(", ")])

    return run


def similar(x: np.ndarray, y: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Whether the sets x and y are linked; set k is flat[start[k]:][:size[k]], sorted numbers under ``most``."""
    place = np.repeat(np.arange(len(size)), size) * most + flat
    n = size[x]
    of = np.repeat(np.arange(len(x)), n)
    mine = flat[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[x][of]]
    want = y[of] * most + mine
    at = np.searchsorted(place, want)
    both = np.bincount(of, place[np.minimum(at, len(place) - 1)] == want, len(x)).astype(np.int64)
    return 100 * both >= PERCENT * (n + size[y] - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block pair of a family: the nodes with links, each with its number of linked lines, the first of these, and the smallest node of its component."""
    for table, cuts in groups(batches, ("family", "i", "j")):
        node, lines, block, i, j = (table.column(x).to_numpy() for x in ("node", "lines", "block", "i", "j"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("full")]
        size = np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
        links, near, label = np.zeros(len(table), np.int64), np.full(len(table), len(table)), np.arange(len(table))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def take(x: np.ndarray, y: np.ndarray) -> None:
            """Rows are sorted by their first line, so the first linked line is that of the first linked row."""
            nonlocal links, label
            links += np.bincount(x, lines[y], len(table)).astype(np.int64) + np.bincount(y, lines[x], len(table)).astype(np.int64)  # noqa: B023
            np.minimum.at(near, x, y)  # noqa: B023
            np.minimum.at(near, y, x)  # noqa: B023
            held.append((x, y))  # noqa: B023
            if sum(len(x) for x, _ in held) > PAIRS:  # noqa: B023
                label = labels(*(np.concatenate([*c, own]) for c, own in zip(zip(*held, strict=True), (label, np.arange(len(label))), strict=True)), len(label))  # noqa: B023
                held.clear()  # noqa: B023

        few: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            x, y = (np.concatenate(c) for c in zip(*few, strict=True))  # noqa: B023
            few.clear()  # noqa: B023
            ok = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])  # noqa: B023
            x, y = x[ok], y[ok]
            if len(x):
                ok = similar(x, y, flat, start, size, len(ids))  # noqa: B023
                take(x[ok], y[ok])

        waiting = 0
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            alone = i[low] == j[low]
            if high - low < WIDE:
                if alone:
                    x, y = np.triu_indices(high - low, 1)
                else:
                    side = block[low:high] == i[low]
                    x, y = np.repeat(np.flatnonzero(side), (~side).sum()), np.tile(np.flatnonzero(~side), side.sum())
                few.append((low + x, low + y))
                waiting += int((size[low + x]).sum())
                if waiting > 4 * PAIRS:
                    settle()
                    waiting = 0
                continue
            left, right = low + np.flatnonzero(block[low:high] == i[low]), low + np.flatnonzero(block[low:high] == j[low])
            mark = np.zeros(len(ids), bool)
            of = np.concatenate([flat[start[k] : start[k] + size[k]] for k in right]) if len(right) else flat[:0]
            begin = np.cumsum(size[right]) - size[right]
            for k, x in enumerate(left.tolist()):
                since = k + 1 if alone else 0
                y = right[since:]
                if not len(y):
                    continue
                own = flat[start[x] : start[x] + size[x]]
                mark[own] = True
                both = np.add.reduceat(mark[of[begin[since] :]], begin[since:] - begin[since], dtype=np.int64)
                mark[own] = False
                y = y[100 * both >= PERCENT * (size[x] + size[y] - both)]
                if len(y):
                    take(np.full(len(y), x), y)
        if few:
            settle()
        if held:
            label = labels(*(np.concatenate([*c, own]) for c, own in zip(zip(*held, strict=True), (label, np.arange(len(label))), strict=True)), len(label))
        on = np.flatnonzero(links)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), table.column("first").combine_chunks().take(pa.array(near[on])), pa.array(node[label[on]])], names=["node", "links", "near", "class"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, in order), n_links, links.

    ``links`` lists each line that any other line is linked to, equal ones included: its number, class and number of such lines.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("rid"), docs[id_col].alias("doc"), docs[text_col].alias("text"))
    level = rarity(texts)
    sent = texts.select("text").mapInArrow(lean(_send(level, tasks)), _SENT)
    met = materialize(sent.repartitionById(tasks, F.col("bucket")).mapInArrow(lean(_meet), _MET), "line-index")
    crowds = met.where("kind = 2").select("token", F.col("a").alias("node"), "n", "place", "low", "high")
    sizes = crowds.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    dealt = in_blocks(crowds.join(sizes, "token"), "token", F.ceil(F.col("size") / BLOCK), "node").drop("size")
    joined = met.where("kind = 1").select("a", "b").unionByName(dealt.mapInArrow(lean(_across), "a long, b long"))
    family = materialize(components(joined).withColumnRenamed("root", "family"), "line-families")
    wanted = family.select("node").unionByName(met.where("kind = 0").select(F.col("a").alias("node")))
    read = materialize(texts.mapInArrow(lean(_lines(key_bits(wanted, "node"), level)), _READ.format(id=kind)), "line-sets")
    where = read.where("kind = 0").select("rid", "doc", F.explode(F.arrays_zip("numbers", "nodes")).alias("x"))
    where = where.select("rid", F.col("x.nodes").alias("node"), F.struct(F.col("doc").isNotNull().alias("has"), "doc", F.col("x.numbers").alias("number")).alias("line"))
    nodes = materialize(where.groupBy("node").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("lines")), "line-nodes")

    sets = read.where("kind = 1").groupBy("node").agg(F.first("full").alias("full"))
    members = family.join(nodes, "node").join(sets, "node")
    members = materialize(members, "line-members")
    total = members.groupBy("family").agg(F.sum(F.length("full") / 8).alias("total"))
    blocks = F.greatest(F.ceil(F.col("total") / MANY), F.least(F.ceil(F.col("total") / FEW), F.lit(SPREAD)))
    dealt = in_blocks(members.join(total, "family"), "family", blocks, "first").drop("total")
    shape = nodes.schema["first"].dataType.simpleString()
    links = materialize(dealt.mapInArrow(lean(_verify), f"node long, links long, near {shape}, class long"), "line-links")

    near = links.groupBy("node").agg(F.min("near").alias("near"), F.sum("links").alias("links"))
    classes = components(links.select(F.col("node").alias("a"), F.col("class").alias("b"))).withColumnRenamed("root", "class")
    linked = nodes.join(near, "node", "left").where("lines > 1 or links is not null").join(classes, "node", "left")
    linked = materialize(linked.select("node", F.least("first", "near").alias("first"), (F.col("lines") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("class", "node").alias("class")), "line-linked")
    found = where.join(linked, "node").select("rid", F.struct("line.number", "class", "links").alias("link"), (F.col("line") > F.col("first")).alias("later"))
    by_doc = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.when(F.col("later"), F.col("link.number")))).alias("removed"), F.array_sort(F.collect_set("link")).alias("links"))
    by_doc = materialize(by_doc, "line-gone")
    discard(met, family, nodes, members, links, linked)
    out = read.where("kind = 0").select("rid", "doc", "n_lines").join(by_doc, "rid", "left")
    removed, every = F.coalesce("removed", F.array().cast("array<int>")), F.coalesce("links", F.array().cast("array<struct<number:int,class:bigint,links:bigint>>"))
    n_links = F.aggregate(every, F.lit(0).cast("long"), lambda n, x: n + x["links"])
    return out.select(F.col("doc").alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), n_links.alias("n_links"), every.alias("links"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, list[int]]:
    """For tests: removed line numbers by comparing all pairs of lines; ids are unique."""
    every = [(d, i, frozenset("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s).split())) for d, t in rows for i, s in enumerate((t or "").split("\n"))]
    every = sorted((x for x in every if x[2]), key=lambda x: x[:2])
    out: dict[int, list[int]] = {d: [] for d, _ in rows}
    for i, (d, n, s) in enumerate(every):
        if any(100 * len(s & t) >= PERCENT * len(s | t) for _, _, t in every[:i]):
            out[d].append(n)
    return out
