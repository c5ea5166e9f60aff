"""Connected components of an edge table.

Each task first reduces its own edges to stars. Then alternating large-star and
small-star steps run until all edges form stars: each round is two aggregates and two
joins on edge rows; no neighbourhood is ever gathered. The minima are written before
they are joined back, so both sides of a join are plain exchanges and a node with very
many neighbours can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.common import discard, materialize

#: Edges that a task reduces at once.
CHUNK = 1 << 20


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of n members, by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def reduced() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = labels(at[: len(u)], at[len(u) :], len(ids))
        out = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[label[out]])], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield reduced()
            held.clear()
    if held:
        yield reduced()


def _step(edges: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "minima")
    return edges.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u != m").select("u", F.col("m").alias("v"))).where("u != v").distinct(), low


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a root, and roots have none."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b) of whole numbers; the root is the component's smallest node."""
    given = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    now = materialize(given.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step, low = _step(both, "v > u")
        large = materialize(step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        discard(now, low)
        step, low = _step(large, "true")
        now = materialize(step, "small-star")
        discard(large, low)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
