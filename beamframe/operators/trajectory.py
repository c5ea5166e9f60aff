"""Trajectories: poses at any time by SE(3) interpolation, poses of frames, corrected tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import rigid
from beamframe.operators.joins import asof_bracket

IDENTITY = [float(i % 5 == 0) for i in range(16)]
POSE = "array<double>"


def identity() -> Column:
    return F.array(*[F.lit(x) for x in IDENTITY])


def translation(x: Column, y: Column, z: Column) -> Column:
    """A pose without rotation, as an array of 16."""
    at = {3: x, 7: y, 11: z}
    return F.array(*[at.get(i, F.lit(v)).cast("double") for i, v in enumerate(IDENTITY)])


def planar(x: Column, y: Column, yaw: Column) -> Column:
    """A pose in the plane."""
    at = {0: F.cos(yaw), 1: -F.sin(yaw), 4: F.sin(yaw), 5: F.cos(yaw), 3: x, 7: y}
    return F.array(*[at.get(i, F.lit(v)).cast("double") for i, v in enumerate(IDENTITY)])


def segments(knots: DataFrame, key: str, ts: str, pose: str) -> DataFrame:
    """(key, ts, seg): each knot but the last with its follower."""
    w = Window.partitionBy(key).orderBy(ts)
    seg = F.struct(F.col(ts).alias("t0"), F.col(pose).alias("p0"), F.lead(ts).over(w).alias("t1"), F.lead(pose).over(w).alias("p1"))
    return knots.select(key, ts, seg.alias("seg")).where("seg.t1 is not null")


def pose_at(events: DataFrame, knots: DataFrame, key: str, ts: str, pose: str, span: int | None = None, bounds: float | None = None) -> DataFrame:
    """``pose`` of each event: between two knots a exp(log(a^-1 b) t); outside, the first or last pair goes on.

    ``bounds``: None for no limit; else how far outside an event may lie, as a share of
    the first or last pair's time, before its pose is null. A key of fewer than two knots
    has no poses.
    """
    seg = asof_bracket(events, segments(knots, key, ts, pose), key, ts, "seg", span)
    s = F.coalesce("v0", "v1")
    out = seg.withColumn("_s", s).withColumn("_t", (F.col(ts) - F.col("_s.t0")).cast("double") / (F.col("_s.t1") - F.col("_s.t0")))
    inside = F.col("_s").isNotNull()
    if bounds is not None:
        inside = inside & (F.col("_t") >= -bounds) & (F.col("_t") <= 1 + bounds)
    known, rest = out.where(inside), out.where(~F.coalesce(inside, F.lit(False)))
    keep = events.columns
    return known.select(*keep, rigid.pose_interp("_s.p0", "_s.p1", "_t").alias(pose)).unionByName(rest.select(*keep, F.lit(None).cast(POSE).alias(pose)))


def pose_at_columns(objects: DataFrame, columns: DataFrame, key: str, ts: str, pose: str, span: int | None = None) -> DataFrame:
    """``pose`` of objects between the valid columns around them; a column's own time gives its pose; null outside the frame's columns."""
    valid = columns.where(F.col("status").bitwiseAND(1) == 1).select(key, ts, pose)
    b = asof_bracket(objects, valid, key, ts, pose, span)
    inside = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    width = F.col("t1") - F.col("t0")
    share = F.when(width == 0, F.lit(0.0)).otherwise((F.col(ts) - F.col("t0")).cast("double") / width)
    known = b.where(inside).select(*objects.columns, rigid.pose_interp("v0", "v1", share).alias(pose))
    return known.unionByName(b.where(~inside).select(*objects.columns, F.lit(None).cast(POSE).alias(pose)))


def not_increasing(knots: DataFrame, key: str, order: str, ts: str) -> DataFrame:
    """Knots whose time doesn't lie behind that of the knot before: a track with any is invalid."""
    return knots.withColumn("_before", F.lag(ts).over(Window.partitionBy(key).orderBy(order))).where(F.col(ts) <= F.col("_before")).drop("_before")


def predicted_pose(df: DataFrame, key: str, ts: str, pose: str) -> DataFrame:
    """Constant velocity: the pose at each row's time from the two before it; the identity before there are two, then the last one."""
    w = Window.partitionBy(key).orderBy(ts)
    back = lambda c, n: F.lag(c, n).over(w)
    wide = df.select("*", back(ts, 1).alias("_t1"), back(ts, 2).alias("_t2"), back(pose, 1).alias("_p1"), back(pose, 2).alias("_p2"))
    share = (F.col(ts) - F.col("_t2")).cast("double") / (F.col("_t1") - F.col("_t2"))
    first = F.coalesce("_p2", "_p1", identity())
    second = F.coalesce("_p1", identity())
    return wide.select(*df.columns, rigid.pose_interp(first, second, F.coalesce(share, F.lit(1.0))).alias("predicted"))


def edge_poses(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_pose, last_pose) of the valid columns of each frame, the identity where it has none."""
    ok = F.col("status").bitwiseAND(1) == 1
    col = F.when(ok, F.col("col"))
    return columns.groupBy(*keys).agg(F.coalesce(F.min_by("pose", col), identity()).alias("first_pose"), F.coalesce(F.max_by("pose", col), identity()).alias("last_pose"))


def poses_of_frames(columns: DataFrame, frame_poses: DataFrame, key: str, seq: str, width: int, span: int | None = None) -> DataFrame:
    """A pose of each column from one pose a frame: frame k's pose holds at k + 0.5, column c of frame k lies at k + c / width.

    ``seq``: the frame's position from 0, in both tables.
    """
    knots = frame_poses.select(key, (F.col(seq) + 0.5).alias("_at"), "pose")
    events = columns.drop("pose").withColumn("_at", F.col(seq) + F.col("col") / F.lit(float(width)))
    return pose_at(events, knots, key, "_at", "pose", span, bounds=1.5).drop("_at")


def deform(ts: np.ndarray, poses: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A track bent so that it begins at ``start`` and ends at ``end``: the steps take the correction by their share of time, and what is left at the end is spread again.

    ``poses``: n x 4 x 4, n of 2 or more.
    """
    n = len(poses)
    if n < 2 or len(ts) != n:
        raise ValueError("a track of two or more poses with a time each is needed")
    steps = rigid.pose_log(rigid.inverse(poses[:-1]) @ poses[1:])
    total = float(ts[-1] - ts[0])
    share = np.diff(ts) / total if total > 0 else np.full(n - 1, 1 / (n - 1))
    wanted = rigid.pose_log(rigid.inverse(start) @ end)
    moved = rigid.pose_exp(steps + share[:, None] * (wanted - steps.sum(axis=0)))
    out = np.empty_like(poses)
    out[0] = start
    for i in range(n - 1):
        out[i + 1] = out[i] @ moved[i]
    rest = rigid.pose_log(end @ rigid.inverse(out[-1]))
    at = (ts - ts[0]) / total if total > 0 else np.arange(n) / (n - 1)
    return rigid.pose_exp(at[:, None] * rest) @ out


def updated_track(poses: DataFrame, nodes: DataFrame, key: str, ts: str, pose: str) -> DataFrame:
    """A dense track corrected by its optimised key poses: the poses from one key pose up to the next are bent to run from the one to the other.

    A key pose begins its own segment; only the very last pose of a track ends one. Poses before
    the first and behind the last key pose stay, and so does a segment of one pose. A segment is
    the unit of work, so a track of any length is dealt by segments; key poses that aren't among
    the track's times are ignored.
    """
    known = nodes.join(poses.select(key, ts), [key, ts]).select(key, ts, F.col(pose).alias("_new"))
    w = Window.partitionBy(key).orderBy(ts)
    seg = F.struct(F.col(ts).alias("a"), F.lead(ts).over(w).alias("z"), F.col("_new").alias("start"), F.lead("_new").over(w).alias("end"))
    ends = poses.groupBy(key).agg(F.max(ts).alias("_end"))
    segment = known.select(key, ts, seg.alias("seg")).join(ends, key).where(F.col("seg.z").isNotNull() | (F.col(ts) < F.col("_end"))).select(key, ts, "seg")
    placed = asof_bracket(poses, segment, key, ts, "seg").select(*poses.columns, F.col("v0").alias("_seg"))
    names = poses.columns

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(ts)
        if len(t) > 1:
            s = t["_seg"].iloc[0]
            m = lambda x: np.asarray(x, float).reshape(4, 4)
            bent = deform(t[ts].to_numpy(float), np.stack([m(x) for x in t[pose]]), m(s["start"]), m(s["end"]))
            t = t.assign(**{pose: list(bent.reshape(-1, 16))})
        return t[names]

    inside = F.col("_seg").isNotNull() & F.col("_seg.z").isNotNull()
    bent = placed.where(inside).withColumn("_a", F.col("_seg.a")).groupBy(key, "_a").applyInPandas(run, poses.schema)
    return bent.unionByName(placed.where(~inside).select(*names))


def gravity_aligned(means: DataFrame, keys: list[str], fix_yaw: bool = False) -> DataFrame:
    """(keys, rotation): the rotation of each mean acceleration (ax, ay, az) to +z, as an array of 9."""
    names = list(keys)
    kinds = ", ".join(f"{k} {means.schema[k].dataType.simpleString()}" for k in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            r = [rigid.gravity_rotation(np.array(a), fix_yaw).ravel() for a in t[["ax", "ay", "az"]].itertuples(index=False)]
            yield t[names].assign(rotation=r)

    return means.mapInPandas(run, f"{kinds}, rotation array<double>")


def plumb(imu: DataFrame, keys: list[str], order: str, most: int = 101) -> DataFrame:
    """The mean acceleration of a sensor's first valid finite measurements: enough of them tell the plumb line."""
    a = [F.col("acc")[i] for i in range(3)]
    finite = ~F.isnan(a[0]) & ~F.isnan(a[1]) & ~F.isnan(a[2]) & (F.greatest(*[F.abs(x) for x in a]) < float("inf"))
    ok = imu.where((F.col("status").bitwiseAND(1) == 1) & finite)
    first = ok.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_i") <= most)
    return first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a[i]).alias(n) for i, n in enumerate(("ax", "ay", "az"))])
