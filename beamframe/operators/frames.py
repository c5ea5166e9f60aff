"""Frames and frame sets as rows: validity, comparison, summaries, sets, objects, array views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_columns(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_col, last_col, valid): the first and last column whose status has bit 0, and how many there are; null and 0 without any."""
    col = F.when(F.col("status").bitwiseAND(1) == 1, F.col("col"))
    return columns.groupBy(*keys).agg(F.min(col).alias("first_col"), F.max(col).alias("last_col"), F.count(col).alias("valid"))


def complete(columns: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """(keys, complete): whether all columns of the window have a valid status; a window whose start lies behind its end wraps round the frame.

    ``columns`` has a row for each column of a frame; one that is missing in the window makes it incomplete only if it has a row.
    """
    c = F.col("col")
    inside = c.between(start, end) if start <= end else (c <= end) | (c >= start)
    return columns.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(inside, F.col("status").bitwiseAND(1) == 1)), F.lit(True)).alias("complete"))


def only_complete(members: DataFrame, complete_frames: DataFrame, set_key: str, keys: list[str]) -> DataFrame:
    """Members of frame sets whose frame is complete; sets without any go, slots of others become null.

    ``members``: (set_key, sensor_idx, keys ...), the frame's keys null in an empty slot.
    """
    ok = complete_frames.where("complete").select(*keys).withColumn("_ok", F.lit(True))
    marked = members.join(ok, keys, "left")
    kept = marked.withColumn("_any", F.max(F.coalesce("_ok", F.lit(False))).over(Window.partitionBy(set_key))).where("_any")
    frame = [k for k in keys if k != "sensor_idx"]
    return kept.withColumns({k: F.when(F.col("_ok"), F.col(k)) for k in frame}).select(*members.columns)


def valid_members(members: DataFrame, frame: str = "frame_id") -> DataFrame:
    """The filled slots of frame sets."""
    return members.where(F.col(frame).isNotNull())


def packet_times(packets: DataFrame, keys: list[str]) -> DataFrame:
    """First, last, least and largest valid host time of the packets of a frame: of each kind (lidar, imu, zone), and of all.

    A packet is valid if it came (``host_ts`` not 0) and holds a valid column (``valid``). First and last go by
    packet number; of all kinds, first and least take the least of the kinds', last and largest the largest.
    """
    ok = F.col("valid") & (F.col("host_ts") != 0)
    out = []
    for kind in ("lidar", "imu", "zone"):
        of = ok & (F.col("kind") == kind)
        ts, no = F.when(of, F.col("host_ts")), F.when(of, F.col("packet_no"))
        out += [F.min_by("host_ts", no).alias(f"first_{kind}"), F.max_by("host_ts", no).alias(f"last_{kind}"), F.min(ts).alias(f"min_{kind}"), F.max(ts).alias(f"max_{kind}")]
    t = packets.groupBy(*keys).agg(*out)
    kinds = ("lidar", "imu", "zone")
    return t.withColumns({f"{n}_any": pick(*[F.col(f"{n}_{k}") for k in kinds]) for n, pick in (("first", F.least), ("last", F.greatest), ("min", F.least), ("max", F.greatest))})


def unequal_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Frames (keys) that differ in any row between two tables: equal frames have the same rows as often.

    Rows are folded to a count and order-free sums of two hashes before the shuffle, so a
    frame costs a few numbers, not its pixels.
    """
    columns = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")

    def folded(df: DataFrame, side: str) -> DataFrame:
        h = F.xxhash64(*columns)
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum(h.cast("decimal(20,0)")).alias(f"h_{side}"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias(f"x_{side}"))

    both = folded(a, "a").join(folded(b, "b"), keys, "full")
    same = F.lit(True)
    for c in "nhx":
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return both.where(~same).select(*keys)


def field_summary(points: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, min, mean, max) of each numeric field of a frame."""
    stats = F.array(*[F.struct(F.lit(f).alias("field"), F.min(f).cast("double").alias("min"), F.avg(f).alias("mean"), F.max(f).cast("double").alias("max")) for f in fields])
    return points.groupBy(*keys).agg(stats.alias("_s")).select(*keys, F.inline("_s"))


def concatenated(clouds: list[DataFrame], fields: list[str]) -> DataFrame:
    """The clouds of a frame set's members as one, each point with its member's number."""
    out = None
    for i, c in enumerate(clouds):
        one = c.select(F.lit(i).alias("member"), *fields)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a frame set without members has no cloud")
    return out


def tee(df: DataFrame, path: str, consumers: list[Callable[[DataFrame], object]]) -> list[object]:
    """One pass over a source for several consumers: it is written once to a shared folder, and each reads that."""
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    return [f(held) for f in consumers]


def set_table(members: DataFrame, set_key: str) -> DataFrame:
    """Frame sets as they are kept: one row a set with (sensor_idx, frame_id) of its members by sensor."""
    return members.where("frame_id is not null").groupBy(set_key).agg(F.array_sort(F.collect_list(F.struct("sensor_idx", "frame_id"))).alias("members"))  # as many as sensors


def set_members(sets: DataFrame, sensors: DataFrame, set_key: str) -> DataFrame:
    """Kept frame sets as slots again, one for each sensor, null where a set lacks it."""
    filled = sets.select(set_key, F.inline("members"))
    slots = sets.select(set_key).withColumn("_k", F.lit(0)).join(F.broadcast(sensors.agg(F.collect_set("sensor_idx").alias("_s")).withColumn("_k", F.lit(0))), "_k").select(set_key, F.explode("_s").alias("sensor_idx"))  # sensors of one rig
    return slots.join(filled, [set_key, "sensor_idx"], "left")


def named_classes(objects: DataFrame, classes: dict[int, str], column: str = "class_id") -> DataFrame:
    """``class_name`` by id; "unknown" for ids without a name."""
    names = F.create_map(*[F.lit(x) for p in classes.items() for x in p]) if classes else F.create_map().cast("map<int,string>")
    return objects.withColumn("class_name", F.coalesce(names[F.col(column).cast("int")], F.lit("unknown")))


def with_instances(points: DataFrame, objects: DataFrame, keys: list[str], field: str = "instance") -> DataFrame:
    """Pixels with the object that their instance id names in their frame; 0 is no object."""
    named = objects.withColumnRenamed("object_id", field)
    return points.where(F.col(field) != 0).join(named, [*keys, field]).unionByName(points.where(F.col(field) == 0), allowMissingColumns=True)


def instance_extents(points: DataFrame, keys: list[str], field: str = "instance") -> DataFrame:
    """Objects of per-pixel instance ids: points, centre and extents of each."""
    return points.where(F.col(field) != 0).groupBy(*keys, field).agg(
        F.count(F.lit(1)).alias("points"), *[((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"], *[(F.max(a) - F.min(a)).alias(f"e{a}") for a in "xyz"]
    )


def rolled(packets: DataFrame, key: str, order: str, frame: str, per_file: int, largest: int = 65535) -> DataFrame:
    """``border``: whether a packet begins a frame (its id lies ahead of all before); ``chunk``: the file that it goes to, ``per_file`` frames each."""
    from beamframe.operators.windows import wrapped_difference

    w = Window.partitionBy(key).orderBy(order)
    step = wrapped_difference(F.lag(frame).over(w), F.col(frame), largest)
    marked = packets.withColumn("border", F.coalesce(step > 0, F.lit(True)))
    number = F.sum(F.col("border").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("chunk", F.floor((number - 1) / per_file).cast("int"))


def limited(packets: DataFrame, ts: str, duration_ns: int) -> DataFrame:
    """The packets of the first ``duration_ns``."""
    first = packets.agg(F.min(ts)).first()[0]
    return packets.limit(0) if first is None else packets.where(F.col(ts) < first + duration_ns)


def newest_frames(frames: DataFrame, key: str, order: str, queue: int, batch: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped counts) of a queue that holds ``queue`` frames and drops the oldest: what a consumer gets that takes the queue once a ``batch``."""
    w = Window.partitionBy(key, batch).orderBy(F.desc(order))
    ranked = frames.withColumn("_i", F.row_number().over(w))
    dropped = ranked.groupBy(key, batch).agg(F.count_if(F.col("_i") > queue).alias("dropped"))
    return ranked.where(F.col("_i") <= queue).drop("_i"), dropped


# ---------------------------------------------------------------- arrays of fields

#: Numpy types of field types.
FIELD_TYPES = {"UINT8": "u1", "UINT16": "u2", "UINT32": "u4", "UINT64": "u8", "INT8": "i1", "INT16": "i2", "INT32": "i4", "INT64": "i8", "FLOAT32": "f4", "FLOAT64": "f8", "FLOAT16": "f2", "CHAR": "S1"}


def uint_view(kind: str) -> Callable[[Column], Column]:
    """The bits of a number of a field type as an unsigned number of its size (as a signed long for 8 bytes)."""
    dtype = np.dtype("<" + FIELD_TYPES[kind])

    @F.pandas_udf("long")
    def view(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy().astype(dtype).view(f"<u{dtype.itemsize}").astype(np.uint64).view(np.int64))

    return view


def from_bits(kind: str) -> Callable[[Column], Column]:
    dtype = np.dtype("<" + FIELD_TYPES[kind])

    @F.pandas_udf("double")
    def view(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy().astype(np.int64).view(np.uint64).astype(f"<u{dtype.itemsize}").view(dtype).astype(float))

    return view


def subview(field: Column, shape: list[int], index: list[int | tuple[int, int] | None]) -> Column:
    """A part of a row-major array column: per axis a number (drops the axis), bounds, or None for all."""
    bounds = [(0, n) if i is None else (i, i + 1) if isinstance(i, int) else i for i, n in zip([*index, *[None] * (len(shape) - len(index))], shape, strict=True)]
    if any(not 0 <= a < b <= n for (a, b), n in zip(bounds, shape, strict=True)):
        raise ValueError("the part lies outside the array")
    at = np.arange(int(np.prod(shape))).reshape(shape)[tuple(slice(a, b) for a, b in bounds)].ravel()
    if len(at) and (np.diff(at) == 1).all():
        return F.slice(field, int(at[0]) + 1, len(at))
    return F.transform(F.array(*[F.lit(int(k)) for k in at]), lambda k: F.get(field, k))


def reshape(size: int, shape: list[int]) -> list[int]:
    """A row-major array's new shape, one axis may be -1; the column itself stays as it is."""
    known = int(np.prod([n for n in shape if n != -1]))
    if shape.count(-1) > 1 or (size % known if -1 in shape else size != known):
        raise ValueError(f"{size} elements don't fit {shape}")
    return [size // known if n == -1 else n for n in shape]


def to_numpy(df: DataFrame, keys: list[str], row: str, col: str, fields: list[str], height: int, width: int) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Frames as dense arrays, one at a time, pixels without a row as 0."""
    ordered = df.select(*keys, row, col, *fields).repartition(*keys).sortWithinPartitions(*keys)
    key, held = None, {}
    for r in ordered.toLocalIterator():
        now = tuple(r[k] for k in keys)
        if now != key:
            if key is not None:
                yield key, held
            key, held = now, {f: np.zeros((height, width)) for f in fields}
        for f in fields:
            held[f][r[row], r[col]] = r[f] if r[f] is not None else 0
    if key is not None:
        yield key, held


def dense(df: DataFrame, keys: list[str], fields: list[str], height: int, width: int) -> DataFrame:
    """Frames in compact form: (keys, an array of height x width of each field, row by row), missing pixels 0."""
    kinds = ", ".join([*[f"{k} {df.schema[k].dataType.simpleString()}" for k in keys], *[f"{f} array<double>" for f in fields]])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = t.column("row").to_numpy() * width + t.column("col").to_numpy()
        out = {k: pa.array([v.as_py()], t.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        for f in fields:
            x = np.zeros(height * width)
            x[at] = t.column(f).to_numpy()
            out[f] = [x]
        return pa.table(out)

    return df.select(*keys, "row", "col", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields]).groupBy(*keys).applyInArrow(run, kinds)


def positions_of(haystack: Column, needle: Column) -> Column:
    """The first place of a byte string in another, from 0; -1 if it isn't there."""
    return F.instr(haystack, needle) - 1
