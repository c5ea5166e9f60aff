"""Zones: sets of named volumes, their rendered images, and the monitor that turns ranges into zone states."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.sources.clouds import parse_stl

#: Slots of a state packet, the id of an empty slot, zones of a set, triangles of a zone.
SLOTS, EMPTY_ID, MOST_ZONES, MOST_TRIANGLES = 16, 255, 128, 2048
#: Modes of a zone, and their numbers in its state.
MODES = {"NONE": 0, "OCCUPANCY": 1, "VACANCY": 2}

STATE = "slot int, live int, id int, error_flags int, trigger_type int, trigger_status int, triggered_frames long, count long, occlusion_count long, invalid_count long, max_count long, min_range long, max_range long, mean_range long"


def counted(points: DataFrame, rendered: DataFrame, keys: list[str], pixel: list[str] = ("row", "col")) -> DataFrame:
    """Occupancy of each zone in each frame (``keys``) from points with ``range_mm`` and rendered pixels (zone_id, near_mm, far_mm).

    Inside: near <= range <= far and a return; occlusion: a return at near or nearer;
    invalid: no return where the zone is rendered. Ranges are 0 where nothing is inside.
    The zones' pixels are few and known (zones x pixels of a sensor), the points are not:
    Spark broadcasts the image below its size limit, and joins by pixel above it. All
    sums are partial before the shuffle, so a frame's points never meet in one place.
    """
    hit = points.join(rendered.select(*pixel, "zone_id", "near_mm", "far_mm"), list(pixel))
    r = F.col("range_mm")
    inside = (r > 0) & r.between(F.col("near_mm"), F.col("far_mm"))
    return hit.groupBy(*keys, "zone_id").agg(
        F.count_if(inside).alias("count"),
        F.count_if((r > 0) & (r <= F.col("near_mm"))).alias("occlusion_count"),
        F.count_if((r == 0) & (F.col("near_mm") > 0)).alias("invalid_count"),
        F.coalesce(F.min(F.when(inside, r)), F.lit(0)).cast("long").alias("min_range"),
        F.coalesce(F.max(F.when(inside, r)), F.lit(0)).cast("long").alias("max_range"),
        F.coalesce(F.floor(F.avg(F.when(inside, r))), F.lit(0)).cast("long").alias("mean_range"),
    )


def states(counts: DataFrame, zones: DataFrame, rendered: DataFrame, frame: str, sensor: str | None = None) -> DataFrame:
    """The 16 zone states of each frame: live zones in slot order, then empty slots.

    ``zones``: (zone_id, slot, mode, point_count, frame_count). A zone triggers while it
    holds at least (occupancy) or fewer than (vacancy) ``point_count`` points; it alerts
    once it has triggered in ``frame_count`` frames in a row, and counts the alerts. Runs
    are numbered by window functions, one zone's frames in order.
    """
    keys = [sensor] if sensor else []
    most = rendered.groupBy("zone_id").agg(F.count_if(F.col("near_mm") < F.col("far_mm")).alias("max_count"))
    frames = counts.select(*keys, frame).distinct()
    live = F.broadcast(zones.join(most, "zone_id", "left").withColumn("slot", F.col("slot").cast("int")))  # 16 zones at most
    every = frames.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).join(live, "slot", "left")
    sums = ["count", "occlusion_count", "invalid_count", "max_count", "min_range", "max_range", "mean_range"]
    c = every.join(counts, [*keys, frame, "zone_id"], "left").fillna(0, sums)
    trigger = ((F.col("mode") == "OCCUPANCY") & (F.col("count") >= F.col("point_count"))) | ((F.col("mode") == "VACANCY") & (F.col("count") < F.col("point_count")))
    w = Window.partitionBy(*keys, "slot").orderBy(frame)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_t", F.coalesce(trigger, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_t"), 0).otherwise(1)).over(w.rowsBetween(*up_to)))
    run = F.sum(F.when(F.col("_t"), 1).otherwise(0)).over(Window.partitionBy(*keys, "slot", "_run").orderBy(frame).rowsBetween(*up_to))
    c = c.withColumn("_trigger", run).withColumn("_frame", F.row_number().over(w))
    # with a frame_count below 1 a zone alerts in every frame
    alerts = F.when(F.col("frame_count") <= 0, F.col("_frame")).otherwise(F.greatest(F.lit(0), F.col("_trigger") - F.col("frame_count") + 1))
    is_live = F.col("zone_id").isNotNull()
    mode = F.create_map(*[F.lit(x) for p in MODES.items() for x in p])[F.col("mode")]
    own = {"live": is_live, "id": F.coalesce("zone_id", F.lit(EMPTY_ID)), "error_flags": F.lit(0), "trigger_type": F.coalesce(mode, F.lit(0)), "trigger_status": F.coalesce(F.col("_alerts") > 0, F.lit(False)), "triggered_frames": F.coalesce("_alerts", F.lit(0))}
    kinds = [f.split() for f in STATE.split(", ")]
    return c.withColumn("_alerts", alerts).select(*keys, frame, *[own.get(n, F.col(n)).cast(k).alias(n) for n, k in kinds])


def monitor(points: DataFrame, zones: DataFrame, rendered: DataFrame, frame: str, sensor: str | None = None, pixel: list[str] = ("row", "col")) -> DataFrame:
    """Zone states of frames of points."""
    if not zones.take(1):
        raise ValueError("a zone set needs a zone")
    keys = [sensor] if sensor else []
    found = counted(points, rendered, [*keys, frame], pixel)
    seen = points.select(*keys, frame).distinct()
    padded = seen.join(found, [*keys, frame], "left")
    return states(padded, zones, rendered, frame, sensor)


def masked(points: DataFrame, zones: DataFrame, rendered: DataFrame, keys: list[str], pixel: list[str] = ("row", "col")) -> DataFrame:
    """``zone_mask``: bit k of a pixel for the live zone in slot k that holds it."""
    slots = rendered.join(zones.select("zone_id", "slot"), "zone_id").groupBy(*pixel).agg(F.collect_list(F.struct("slot", "near_mm", "far_mm")).alias("_zones"))  # at most 16 a pixel
    bit = lambda z: F.when((F.col("range_mm") > 0) & F.col("range_mm").between(z["near_mm"], z["far_mm"]), F.call_function("shiftleft", F.lit(1).cast("long"), z["slot"].cast("int"))).otherwise(F.lit(0).cast("long"))
    mask = F.aggregate(F.coalesce("_zones", F.array().cast("array<struct<slot:int,near_mm:bigint,far_mm:bigint>>")), F.lit(0).cast("long"), lambda acc, z: acc.bitwiseOR(bit(z)))
    return points.join(slots, list(pixel), "left").withColumn("zone_mask", mask).drop("_zones")


# ---------------------------------------------------------------- meshes and rendered images


def bounding_spheres(triangles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, radius): the centroid of a mesh's corners, and the farthest corner from it."""
    corners = triangles.select(*keys, F.explode(F.array(*[F.struct(*[F.col(f"v{i}{a}").cast("double").alias(a) for a in "xyz"]) for i in range(3)])).alias("p")).select(*keys, "p.*")
    centre = corners.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    far = sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return corners.join(centre, keys).groupBy(*keys, "cx", "cy", "cz").agg(F.sqrt(F.max(far)).alias("radius"))


def rendered_mm(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Near and far of ray hits in whole millimetres, halves away from 0; pixels that round to nothing go."""
    mm = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return hits.select(*keys, mm("near").alias("near_mm"), mm("far").alias("far_mm")).where("far_mm > 0")


def check_rendered(rendered: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, pixels, problem): zones out of sight, and zones of fewer pixels than the points that trigger them."""
    area = rendered.groupBy("zone_id").agg(F.count_if(F.col("near_mm") < F.col("far_mm")).alias("pixels"))
    seen = zones.join(area, "zone_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))
    problem = F.when(F.col("pixels") == 0, "out of sight").when(F.col("pixels") < F.col("point_count"), "fewer pixels than points")
    return seen.select("zone_id", "pixels", problem.alias("problem")).where("problem is not null")


@dataclass
class Zone:
    point_count: int
    frame_count: int
    mode: str
    label: str = ""
    stl_name: str | None = None
    coordinate_frame: str | None = None
    stl: bytes | None = None
    zrb: bytes | None = None


@dataclass
class ZoneSet:
    """A set of zones as its folder or archive holds it: metadata.json beside the meshes and images."""

    zones: dict[int, Zone]
    live: list[int]
    label: str = ""
    sensor_to_body: list[float] | None = None
    issues: list[tuple[str, str, str]] = field(default_factory=list)

    def check(self) -> None:
        if not self.zones:
            raise ValueError("a zone set needs a zone")
        if len(self.zones) > MOST_ZONES or any(not 0 <= z < MOST_ZONES for z in self.zones):
            raise ValueError(f"zone ids lie in 0 to {MOST_ZONES - 1}")
        if len(self.live) > SLOTS or any(z not in self.zones for z in self.live):
            raise ValueError("live zones must be of the set, 16 at most")
        if any(z.stl is None and z.zrb is None for z in self.zones.values()):
            raise ValueError("every zone needs a mesh or a rendered image")
        shapes = {image_shape(z.zrb) for z in self.zones.values() if z.zrb}
        if len(shapes) > 1:
            raise ValueError("all rendered images must have one resolution")

    def triangles(self, spark: SparkSession) -> DataFrame:
        """(zone_id, v0x .. v2z) of all meshes."""
        rows = []
        for k, z in self.zones.items():
            if z.stl is not None:
                mesh = parse_stl(z.stl)
                if len(mesh) > MOST_TRIANGLES:
                    raise ValueError(f"zone {k} has more than {MOST_TRIANGLES} triangles")
                rows += [(k, *map(float, t.ravel())) for t in mesh]
        names = ", ".join(["zone_id int", *[f"v{i}{a} double" for i in range(3) for a in "xyz"]])
        return spark.createDataFrame(rows, names)

    def table(self, spark: SparkSession) -> DataFrame:
        """(zone_id, slot, mode, point_count, frame_count, label) of the live zones."""
        rows = [(k, i, self.zones[k].mode, self.zones[k].point_count, self.zones[k].frame_count, self.zones[k].label) for i, k in enumerate(self.live)]
        return spark.createDataFrame(rows, "zone_id int, slot int, mode string, point_count int, frame_count int, label string")

    def document(self) -> str:
        out: dict = {"label": self.label, "power_on_live_ids": self.live, "zones": {}}
        if self.sensor_to_body is not None:
            out["sensor_to_body_transform"] = self.sensor_to_body
        for k, z in self.zones.items():
            one: dict = {"point_count": z.point_count, "frame_count": z.frame_count, "mode": z.mode, "label": z.label}
            if z.stl is not None:
                one["stl"] = {"file_name": z.stl_name or f"{k}.stl", "coordinate_frame": z.coordinate_frame or "BODY", "hash": hashlib.sha256(z.stl).hexdigest()}
            if z.zrb is not None:
                one["zrb"] = {"file_name": f"{k}.zrb", "hash": hashlib.sha256(z.zrb).hexdigest()}
            out["zones"][str(k)] = one
        return json.dumps(out, sort_keys=True)

    def archive(self) -> bytes:
        self.check()
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as f:
            f.writestr("metadata.json", self.document())
            for k, z in self.zones.items():
                if z.stl is not None:
                    f.writestr(z.stl_name or f"{k}.stl", z.stl)
                if z.zrb is not None:
                    f.writestr(f"{k}.zrb", z.zrb)
        return held.getvalue()


def parse_zone_set(files: dict[str, bytes]) -> ZoneSet:
    """A zone set of its files; zones of an unknown mode are left out and named in ``issues``; a file that doesn't match its hash is an error."""
    doc = json.loads(files["metadata.json"])
    missing = [k for k in ("zones", "power_on_live_ids") if k not in doc]
    if missing:
        raise ValueError(f"metadata.json lacks {', '.join(missing)}")

    def named(part: dict | None) -> bytes | None:
        if part is None:
            return None
        data = files[part["file_name"]]
        if part.get("hash") and hashlib.sha256(data).hexdigest() != part["hash"].lower():
            raise ValueError(f"{part['file_name']} doesn't match its hash")
        return data

    zones, issues = {}, []
    for k, z in doc["zones"].items():
        if z.get("mode") not in MODES:
            issues.append((f"zones.{k}.mode", f"unknown mode {z.get('mode')}", "critical"))
            continue
        stl = z.get("stl")
        zones[int(k)] = Zone(int(z["point_count"]), int(z["frame_count"]), z["mode"], z.get("label", ""), stl and stl["file_name"], stl and stl.get("coordinate_frame"), named(stl), named(z.get("zrb")))
    return ZoneSet(zones, [int(x) for x in doc["power_on_live_ids"]], doc.get("label", ""), doc.get("sensor_to_body_transform"), issues)


def load_zone_set(spark: SparkSession, path: str) -> ZoneSet:
    """A folder or an archive; read through Spark, so any store works. A set has a few small files."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    if len(rows) == 1 and rows[0]["path"].endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(bytes(rows[0]["content"]))) as f:
            return parse_zone_set({n: f.read(n) for n in f.namelist()})
    return parse_zone_set({r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in rows})


_IMAGE = "<4sIIf"
_HEAD = struct.calcsize(_IMAGE)


def write_image(near_mm: np.ndarray, far_mm: np.ndarray, bin_m: float = 0.1) -> bytes:
    """Near and far as 16-bit bins side by side, column by column, behind a head with a hash of them."""
    if near_mm.shape != far_mm.shape or not near_mm.size:
        raise ValueError("both images are needed, of one size")
    bins = [np.floor(x / (bin_m * 1000) + 0.5) for x in (near_mm, far_mm)]
    if max(b.max() for b in bins) > 0xFFFF:
        raise ValueError("a range exceeds what a bin can hold")
    data = (bins[0].astype(np.uint32) | (bins[1].astype(np.uint32) << 16)).T.astype("<u4").tobytes()
    return struct.pack(_IMAGE, b"ZIMG", *near_mm.shape, bin_m) + hashlib.sha256(data).digest() + data


def image_shape(blob: bytes) -> tuple[int, int]:
    kind, rows, cols, _ = struct.unpack_from(_IMAGE, blob)
    if kind != b"ZIMG":
        raise ValueError("not a rendered zone")
    return rows, cols


def read_image(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = image_shape(blob)
    data = blob[_HEAD + 32 :]
    if hashlib.sha256(data).digest() != blob[_HEAD : _HEAD + 32]:
        raise ValueError("a rendered zone doesn't match its hash")
    mm = struct.unpack_from(_IMAGE, blob)[3] * 1000
    both = np.frombuffer(data, "<u4").reshape(cols, rows).T
    return np.round((both & 0xFFFF) * mm).astype(np.int64), np.round((both >> 16) * mm).astype(np.int64)


def images(zone_set: ZoneSet, spark: SparkSession) -> DataFrame:
    """(zone_id, row, col, near_mm, far_mm) of the rendered images of a set."""
    blobs = spark.createDataFrame([(k, z.zrb) for k, z in zone_set.zones.items() if z.zrb], "zone_id int, blob binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for k, blob in zip(t["zone_id"], t["blob"], strict=True):
                near, far = read_image(bytes(blob))
                row, col = np.nonzero(far > 0)
                yield pd.DataFrame({"zone_id": np.int32(k), "row": row.astype(np.int32), "col": col.astype(np.int32), "near_mm": near[row, col], "far_mm": far[row, col]})

    return blobs.mapInPandas(run, "zone_id int, row int, col int, near_mm long, far_mm long")
