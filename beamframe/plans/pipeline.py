"""Verbs on a source, chained: each returns a new plan, nothing runs before a consumer asks."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import scalar
from beamframe.operators import aggregates, filters, images, mapping, projection, selection, trajectory, zones
from beamframe.sources import clouds, store
from beamframe.streaming import collator

#: Verbs that users registered: name -> function of (frames, arguments).
REGISTERED: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTERED[name] = f
        return f

    return add


class Poser(Protocol):
    """What gives poses to columns of frames."""

    def __call__(self, columns: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class DetectionConfig:
    """Settings of the detector of clusters: how near points of one object lie, and how many it needs."""

    reach: float = 0.5
    least_points: int = 5


#: Settings by kind of detector; users add theirs.
DETECTORS: dict[str, type] = {"clusters": DetectionConfig}


def detection_config(kind: str = "clusters", **settings: object) -> object:
    """Settings of a kind of detector; names that it doesn't have are left out with a warning."""
    if kind.lower() not in DETECTORS:
        raise ValueError(f"unknown detector {kind}; there are {', '.join(sorted(DETECTORS))}")
    made = DETECTORS[kind.lower()]
    known = {f.name for f in fields(made)}
    for name in settings.keys() - known:
        warnings.warn(f"a detector of kind {kind} has no setting {name}", stacklevel=2)
    return made(**{k: v for k, v in settings.items() if k in known})


@dataclass(frozen=True)
class Pipeline:
    df: DataFrame
    height: int = 128
    width: int = 1024

    def _with(self, df: DataFrame) -> Pipeline:
        return Pipeline(df, self.height, self.width)

    def slice(self, start: int | None, stop: int | None, step: int = 1) -> Pipeline:
        """By ``frame_seq``, a plain range predicate that reaches the scan."""
        return self._with(selection.slice_frames(self.df, start, stop, step, "frame_seq"))

    def clip(self, fields: list[str], lo: float, hi: float) -> Pipeline:
        return self._with(filters.clip(self.df, fields, lo, hi))

    def filter(self, name: str, lo: float, hi: float, fields: list[str]) -> Pipeline:
        if name in "uv":
            return self._with(filters.filter_uv(self.df, name, lo, hi, self.height if name == "u" else self.width, fields))
        if name in "xyz":
            return self._with(filters.filter_xyz(self.df, name, lo, hi, fields))
        return self._with(filters.filter_field(self.df, name, lo, hi, fields))

    def mask(self, image: DataFrame, fields: list[str]) -> Pipeline:
        return self._with(filters.mask(self.df, image, fields))

    def reduce(self, factor: int) -> Pipeline:
        return Pipeline(selection.reduce_by_factor(self.df, factor, self.height), self.height // factor, self.width)

    def select(self, rows: list[int]) -> Pipeline:
        return Pipeline(selection.select_rows(self.df, rows, self.height), len(rows), self.width)

    def single(self, sensor: int) -> Pipeline:
        return self._with(selection.single(self.df, sensor))

    def destagger(self) -> Pipeline:
        return self._with(projection.destagger(self.df, self.width))

    def xyz(self, lut: DataFrame) -> Pipeline:
        return self._with(projection.cartesian(self.df.join(lut, ["sensor_idx", "row", "col"])))

    def dewarp(self, columns: DataFrame) -> Pipeline:
        return self._with(projection.dewarp(self.df, columns, ["sensor_idx", "frame_id", "col"]))

    def normals(self) -> DataFrame:
        return images.normals(self.df, self.height, self.width)

    def ground(self, cell: float = 0.5) -> Pipeline:
        return self._with(images.ground(self.df, cell))

    def time_slice(self, start_s: float, stop_s: float, step: int = 1) -> Pipeline:
        """Seconds after the first frame, by ``ts_ns``."""
        first = self.df.agg(F.min("ts_ns")).first()[0]
        if first is None:
            return self
        kept = self.df.where((F.col("ts_ns") - first).between(int(start_s * 1e9), int(stop_s * 1e9)))
        return self._with(kept if step == 1 else kept.where((F.dense_rank().over(Window.orderBy("frame_id")) - 1) % step == 0))

    def words(self, text: str) -> Pipeline:
        """A slice as text: "10:20:2" by frames, "1:2s" by time."""
        parts, by_time = scalar.parse_slice(text)
        start, stop, step = [*parts, *[None] * (3 - len(parts))]
        return self.time_slice(start or 0.0, stop if stop is not None else float("inf"), int(step or 1)) if by_time else self.slice(start, stop, step or 1)

    def range_gate(self, low_m: float, high_m: float) -> Pipeline:
        return self._with(filters.range_gate(self.df, low_m, high_m))

    def zones(self, zone_table: DataFrame, rendered: DataFrame) -> DataFrame:
        return zones.monitor(self.df, zone_table, rendered, "frame_id", "sensor_idx")

    def poses(self, track: DataFrame, key: str = "sensor_idx") -> Pipeline:
        """``pose`` of each row at its time on a track."""
        return self._with(trajectory.pose_at(self.df, track, key, "ts_ns", "pose"))

    def slam(self, size: float) -> DataFrame:
        return mapping.slam(self.df.where("range_mm > 0"), "sensor_idx", "frame_id", size)

    def clusters(self, config: DetectionConfig | None = None) -> DataFrame:
        c = config or DetectionConfig()
        return images.clusters(self.df, c.reach).where(F.col("n") >= c.least_points)

    def info(self, sensors: DataFrame) -> DataFrame:
        """What is known of the sensors that have frames here."""
        return sensors.join(self.df.select("sensor_idx").distinct(), "sensor_idx", "left_semi")

    def collate(self, sensors: int, dt: int = collator.DT) -> DataFrame:
        frames = self.df.groupBy("sensor_idx", "frame_id").agg(F.max("ts_ns").alias("ts")).withColumn("session", F.lit(0))
        return collator.collate(frames, "session", sensors, dt)

    def images(self, field: str) -> DataFrame:
        return store.field_images(self.df, ["sensor_idx", "frame_id"], field, self.height, self.width)

    def csv(self, path: str) -> None:
        clouds.write_points(self.df, path)

    def apply(self, verb: str, *args: object) -> Pipeline:
        return self._with(REGISTERED[verb](self.df, *args))

    def voxels(self, size: float, fields: list[str]) -> DataFrame:
        return aggregates.voxel_average(self.df, size, fields)

    def stats(self) -> DataFrame:
        return self.df.groupBy("sensor_idx").agg(F.countDistinct("frame_id").alias("frames"), F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("range_mm") > 0).alias("returns"))

    def save(self, path: str) -> None:
        clouds.write_frames(self.df, path)
