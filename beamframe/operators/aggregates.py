"""Voxel grids, frame statistics, digests and the registration system."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["vx", "vy", "vz"]


def voxels(df: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return df.withColumns({f"v{k}": F.floor(F.col(a) * (1 / size)).cast("int") for k, a in zip("xyz", axes, strict=True)})


def voxel_average(df: DataFrame, size: float, fields: list[str], min_points: int = 1, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Mean of all fields of each voxel that has ``min_points``."""
    out = voxels(df, size, axes).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in fields])
    return out.where(F.col("n") >= min_points)


def voxel_first(df: DataFrame, size: float, order: list[str], fields: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The first point of each voxel in input order; the least number of points isn't applied here."""
    return voxels(df, size, axes).groupBy(*CELL).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("p")).select(*CELL, "p.*")


def voxel_last(df: DataFrame, size: float, order: list[str], fields: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """What random replacement keeps with one point a voxel: the last."""
    return voxels(df, size, axes).groupBy(*CELL).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("p")).select(*CELL, "p.*")


def voxel_spaced(df: DataFrame, size: float, order: list[str], most: int, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Up to ``most`` points a voxel, in input order, none nearer than sqrt(size**2 / most) to one admitted before."""
    gap2 = size * size / most

    def run(t):  # noqa: ANN001, ANN202
        t = t.sort_values(order)
        kept: list[int] = []
        p = t[list(axes)].to_numpy(float)
        for i in range(len(p)):
            if len(kept) == most:
                break
            if not kept or ((p[kept] - p[i]) ** 2).sum(axis=1).min() >= gap2:
                kept.append(i)
        return t.iloc[kept]

    cells = voxels(df, size, axes)
    return cells.groupBy(*CELL).applyInPandas(run, cells.schema)


def _xorshift_jumps() -> list[np.ndarray]:
    """The generator's step as a matrix over bits, and its powers of two: column k is what bit k of a state becomes."""
    def step(x: int) -> int:
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        return x ^ ((x << 5) & 0xFFFFFFFF)

    def apply(columns: list[int], x: int) -> int:
        out = 0
        for k in range(32):
            if x >> k & 1:
                out ^= columns[k]
        return out

    powers = [[step(1 << k) for k in range(32)]]
    for _ in range(39):
        powers.append([apply(powers[-1], c) for c in powers[-1]])
    return [np.array(p, np.uint32) for p in powers]


def xorshift(count: np.ndarray, seed: int = 42) -> np.ndarray:
    """The number that a 32-bit xorshift generator (13, 17, 5) gives at its ``count``-th call, for an array of counts."""
    count = np.asarray(count, np.int64)
    x = np.full(len(count), seed, np.uint32)
    for i, columns in enumerate(_xorshift_jumps()):
        on = (count >> i) & 1 == 1
        if not on.any():
            continue
        now, out = x[on], np.zeros(int(on.sum()), np.uint32)
        for k in range(32):
            out ^= np.where(now >> np.uint32(k) & np.uint32(1), columns[k], np.uint32(0))
        x[on] = out
    return x


def voxel_random(df: DataFrame, size: float, order: list[str], fields: list[str], most: int, axes: tuple[str, ...] = ("x", "y", "z"), seed: int = 42) -> DataFrame:
    """Up to ``most`` points a voxel (``slot``): the first fill it, each further one replaces the slot that a generator picks, in input order.

    The generator is called once for each replacement of the whole input, in order; its
    k-th number is computed by jumping ahead, so no task walks through the points.
    """
    from beamframe.operators.selection import numbered

    cells = voxels(df, size, axes).withColumn("_i", F.row_number().over(Window.partitionBy(*CELL).orderBy(*order)) - 1)
    more = numbered(cells.where(F.col("_i") >= most), order)

    def pick(k: pd.Series) -> pd.Series:
        return pd.Series((xorshift(k.to_numpy() + 1, seed).astype("u8") * most >> 32).astype("int32"))

    placed = cells.where(F.col("_i") < most).withColumn("slot", F.col("_i").cast("int")).unionByName(more.withColumn("slot", F.pandas_udf(pick, "int")("seq")).drop("seq"))
    last = placed.groupBy(*CELL, "slot").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("p"))
    return last.select(*CELL, "slot", "p.*")


def voxel_custom(df: DataFrame, size: float, bucket, schema: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:  # noqa: ANN001
    """A user's own bucket: a function of a voxel's points (a pandas frame) to what it keeps, of the given schema. A voxel's points are one group."""
    return voxels(df, size, axes).groupBy(*CELL).applyInPandas(bucket, schema)


def voxel_shuffled(df: DataFrame, size: float, index: str, seed: int, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The index of one pseudo-random point of each voxel, the same for one seed."""
    return voxels(df, size, axes).groupBy(*CELL).agg(F.min_by(index, F.struct(F.md5(F.concat_ws(":", F.lit(seed), index)), index)).alias(index))


def voxel_normals(df: DataFrame, size: float) -> DataFrame:
    """Mean position and renormalised mean of unit normals; points without a finite normal are left out."""
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    ok = df.withColumn("len", length).where((F.col("len") > 1e-12) & ~F.isnan("len") & (F.col("len") < math.inf))
    mean = voxels(ok, size).groupBy(*CELL).agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.sum(F.col(f"n{a}") / F.col("len")).alias(f"n{a}") for a in "xyz"])
    total = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return mean.withColumn("len", total).withColumns({f"n{a}": F.col(f"n{a}") / F.col("len") for a in "xyz"}).drop("len")


def near_voxels(df: DataFrame, origin: tuple[int, int, int], most: float) -> DataFrame:
    """Voxels within a distance, in voxels, of the origin's."""
    d2 = sum((F.col(c) - o) * (F.col(c) - o) for c, o in zip(CELL, origin, strict=True))
    return df.where(d2 <= most * most)


def evicted(df: DataFrame, origin: tuple[int, int, int], most: float) -> tuple[DataFrame, DataFrame]:
    """(voxels that stay, voxels that are removed): extraction of what lies farther than ``most`` voxels from the origin's."""
    d2 = sum((F.col(c) - o) * (F.col(c) - o) for c, o in zip(CELL, origin, strict=True))
    return df.where(d2 <= most * most), df.where(d2 > most * most)


def frame_stats(df: DataFrame, keys: list[str], ts: str, size: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.col(size) == 0).alias("missing"))


def stream_stats(df: DataFrame, key: str, ts: str, size: str) -> DataFrame:
    """Per stream: count, first and last receive time, average size as a whole number."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("messages"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.floor(F.sum(size) / F.count(F.lit(1))).cast("long").alias("avg_size"))


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def valid_span(df: DataFrame, keys: list[str], ts: str, valid: Column) -> DataFrame:
    """First and last timestamp of the valid rows."""
    return df.where(valid).groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def trimmed_voxel_size(df: DataFrame, frame: str, value: str, order: list[str], low: float = 0.92, high: float = 0.96) -> DataFrame:
    """Per frame the ranges from ceil(low n) to floor(high n) of the sorted ones, both included; the mean of all / 46 * 2 in metres."""
    w = Window.partitionBy(frame)
    ranked = df.where(F.col(value) > 0).withColumn("i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    kept = ranked.where((F.col("i") >= F.ceil(F.lit(low) * F.col("n"))) & (F.col("i") <= F.floor(F.lit(high) * F.col("n"))))
    return kept.agg(F.count(F.lit(1)).alias("used"), (F.avg(value) * 0.001 / 46 * 2).alias("voxel_size"))


def linear_system(pairs: DataFrame, kernel: float, plane: bool = False) -> DataFrame:
    """Sums of the weighted normal equations of point pairs (p.. moved onto q..): 21 of J'J, 6 of J'r, with robust weights; with ``plane`` of the distances along n.. only."""
    r = {a: F.col(f"p{a}") - F.col(f"q{a}") for a in "xyz"}
    if plane:
        n = {a: F.col(f"n{a}") for a in "xyz"}
        e = sum((n[a] * r[a] for a in "xyz"), F.lit(0.0))
        p = {a: F.col(f"p{a}") for a in "xyz"}
        j = [n["x"], n["y"], n["z"], p["y"] * n["z"] - p["z"] * n["y"], p["z"] * n["x"] - p["x"] * n["z"], p["x"] * n["y"] - p["y"] * n["x"]]
        w = F.pow(F.lit(kernel) / (F.lit(kernel) + e * e), 2)
        sums = {f"h{i}{k}": j[i] * j[k] * w for i in range(6) for k in range(i, 6)} | {f"b{i}": j[i] * e * w for i in range(6)}
        return pairs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    r2 = sum((r[a] * r[a] for a in "xyz"), F.lit(0.0))
    w = F.pow(F.lit(kernel) / (F.lit(kernel) + r2), 2)
    x, y, z, one, none = F.col("px"), F.col("py"), F.col("pz"), F.lit(1.0), F.lit(0.0)
    rows = {"x": [one, none, none, none, z, -y], "y": [none, one, none, -z, none, x], "z": [none, none, one, y, -x, none]}
    jj = {f"h{i}{j}": sum((rows[a][i] * rows[a][j] for a in "xyz"), F.lit(0.0)) * w for i in range(6) for j in range(i, 6)}
    jr = {f"b{i}": sum((rows[a][i] * r[a] for a in "xyz"), F.lit(0.0)) * w for i in range(6)}
    return pairs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (jj | jr).items()])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of a field by name, linear between values, and ``spread``: the median distance from the median."""
    wanted = df.groupBy(*keys).agg(*[F.percentile(value, s).alias(n) for n, s in shares.items()], F.percentile(value, 0.5).alias("_median"))
    off = df.join(wanted.select(*keys, "_median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_median")), 0.5).alias("spread"))
    return wanted.drop("_median").join(off, keys)


def digest(df: DataFrame, keys: list[str], value: Column, order: list[str]) -> DataFrame:
    """MD5 and SHA-256 of a field's values of each frame in order; a frame is one record, so its list is bounded."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda s: s["v"]), "|")
    return df.groupBy(*keys).agg(joined.alias("t")).select(*keys, F.md5("t").alias("md5"), F.sha2("t", 256).alias("sha256"))


def zone_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Occupancy of zones: pixels inside, at near or nearer (occlusion), without a return where the zone is rendered, and the ranges of those inside."""
    inside = (F.col("range_mm") > 0) & F.col("range_mm").between(F.col("near_mm"), F.col("far_mm"))
    r = F.when(inside, F.col("range_mm"))
    return hits.groupBy(*keys).agg(
        F.count_if(inside).alias("count"),
        F.count_if((F.col("range_mm") > 0) & (F.col("range_mm") <= F.col("near_mm"))).alias("occlusion"),
        F.count_if((F.col("range_mm") == 0) & (F.col("near_mm") > 0)).alias("invalid"),
        F.min(r).alias("min_range"),
        F.max(r).alias("max_range"),
        F.avg(r).alias("mean_range"),
    )


def zone_bits(hits: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """All zones that hold a pixel, as bits."""
    inside = (F.col("range_mm") > 0) & F.col("range_mm").between(F.col("near_mm"), F.col("far_mm"))
    return hits.groupBy(*keys).agg(F.bit_or(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(zone).cast("int"))).otherwise(F.lit(0).cast("long"))).alias("zone_mask"))
