"""Beam selection, slices, samples and merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.sources.scratch import folder


def reduce_by_factor(df: DataFrame, factor: int, height: int) -> DataFrame:
    """Rows 0, n, 2n ... renumbered; a factor of the whole height keeps the middle row."""
    if factor <= 0 or height % factor:
        raise ValueError(f"{factor} doesn't divide {height}")
    if factor == height:
        return df.where(F.col("row") == height // 2).withColumn("row", F.lit(0))
    return df.where(F.col("row") % factor == 0).withColumn("row", (F.col("row") / factor).cast("int"))


def select_rows(df: DataFrame, rows: list[int], height: int) -> DataFrame:
    """The given rows, numbered in the given order."""
    if len(set(rows)) != len(rows) or any(not 0 <= r < height for r in rows):
        raise ValueError("rows must be unique and inside the frame")
    to = F.create_map(*[F.lit(x) for pair in ((r, i) for i, r in enumerate(rows)) for x in pair])
    return df.where(F.col("row").isin(rows)).withColumn("row", to[F.col("row").cast("int")])


def select_beams(beams: DataFrame, rows: list[int], height: int, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(beams, rendered zone images) of a sensor that keeps the given rows: angles, shifts and images follow."""
    return select_rows(beams, rows, height), None if images is None else select_rows(images, rows, height)


def numbered(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``seq``: the position by ``order``, from 0.

    Ranges of the order are counted first and each range numbers its own rows, so no
    task holds the whole table: range partitions are sorted and offset by the sizes
    of those before. Spark samples the borders of ranges anew for each plan, so the
    ranges are written once: sizes and rows are read from the same ones.
    """
    path = folder(df.sparkSession, "numbered")
    dealt = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    parts = df.sparkSession.read.schema(dealt.schema).parquet(path)
    own = parts.withColumn("seq", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    return own.join(F.broadcast(before), "part").withColumn("seq", (F.col("seq") + F.col("before") - 1).cast("long")).drop("part", "before")  # one row per partition


def slice_frames(df: DataFrame, start: int | None, stop: int | None, step: int = 1, seq: str = "seq", size: int | None = None) -> DataFrame:
    """Python's slice over ``seq``; negative bounds count from the end and need the size."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = size if size is not None else df.agg(F.coalesce(F.max(seq) + 1, F.lit(0))).first()[0] if min(start or 0, stop or 0) < 0 else None
    a = 0 if start is None else max(0, start + n) if start < 0 else start
    b = None if stop is None else max(0, stop + n) if stop < 0 else stop
    if b is not None and a > b:
        raise ValueError("the start lies behind the stop")
    keep = (F.col(seq) >= a) & ((F.col(seq) - a) % step == 0)
    return df.where(keep if b is None else keep & (F.col(seq) < b))


def time_slice(df: DataFrame, ts: str, start: float, stop: float, step: int, order: list[str]) -> DataFrame:
    """Frames from ``start`` to ``stop`` after the first, then every ``step``-th of them."""
    first = df.agg(F.min(ts)).first()[0]
    if first is None:
        return df.limit(0)
    return slice_frames(numbered(df.where((F.col(ts) - first).between(start, stop)), order), 0, None, step).drop("seq")


def single(df: DataFrame, sensor: int, column: str = "sensor_idx") -> DataFrame:
    return df.where(F.col(column) == sensor)


def at_index(df: DataFrame, index: int, size: int | None = None) -> DataFrame:
    n = size if size is not None else df.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0] if index < 0 else 0
    return df.where(F.col("seq") == (index + n if index < 0 else index))


def newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Bounded history: the ``n`` last rows of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("rn") <= n).drop("rn")


def evenly_sampled(df: DataFrame, count: int, size: int) -> DataFrame:
    """``count`` rows spread evenly over ``seq`` 0 .. size - 1, both ends included."""
    if count < 2:
        return df.where(F.col("seq") == 0) if count else df.limit(0)
    wanted = {round(i * (size - 1) / (count - 1)) for i in range(count)}
    return df.where(F.col("seq").isin(sorted(wanted)))


def key_frames(df: DataFrame, key: str, order: str, frames: int, metres: float) -> DataFrame:
    """The first frame of each track, then those ``frames`` later or ``metres`` away from the last key frame."""
    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order)
        keep, last, since = [], None, 0
        for p in t[["x", "y", "z"]].itertuples(index=False):
            since += 1
            if last is None or since >= frames or math.dist(p, last) >= metres:
                keep.append(True)
                last, since = p, 0
            else:
                keep.append(False)
        return t[keep]

    return df.groupBy(key).applyInPandas(run, df.schema)


def merged(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """Several sources as one, by their first valid timestamp."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order)


def sampled_points(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """A share of the points with a return."""
    return df.where("range_mm > 0").sample(ratio, seed)


def sampled_map(df: DataFrame, ratio: float, most: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A map of ``most`` points at most: a share of each key frame's points with a return, chosen by a hash of their keys, the same for one seed."""
    h = F.xxhash64(F.lit(seed), *keys)
    share = F.pmod(h, F.lit(1 << 32)) < int(ratio * (1 << 32))
    return df.where((F.col("range_mm") > 0) & share).orderBy(h, *keys).limit(most)


def chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), size):
            yield b.iloc[i : i + size]
