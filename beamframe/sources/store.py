"""The frame store's other sides: images of fields, checksums, metadata versions, summaries, writing in the background, captures as a sink."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from threading import BoundedSemaphore

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Fixed values: (bit depth, colour type) by bytes of a pixel: grey, grey, RGB, RGBA, RGBA of 16 bits.
PNG_KINDS = {1: (8, 0), 2: (16, 0), 3: (8, 2), 4: (8, 6), 8: (16, 6)}


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """An image of unsigned numbers of 8, 16, 32 or 64 bits, or of three bytes, as a PNG: each row as its difference from the row above."""
    size = 3 if image.ndim == 3 else image.dtype.itemsize
    if size not in PNG_KINDS or image.dtype.kind != "u":
        raise ValueError(f"no image kind for {image.dtype} of {image.ndim} axes")
    h, w = image.shape[:2]
    rows = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, w * size)
    above = np.vstack([np.zeros((1, w * size), np.uint8), rows[:-1]])
    body = np.hstack([np.full((h, 1), 2, np.uint8), rows - above]).tobytes()
    depth, kind = PNG_KINDS[size]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """What ``encode_png`` wrote; a chunk that doesn't match its checksum is an error."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", None
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(name + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk doesn't match its checksum")
        if name == b"IHDR":
            w, h, depth, kind = struct.unpack_from(">IIBB", part)
            shape = (h, w, {v: k for k, v in PNG_KINDS.items()}[depth, kind])
        elif name == b"IDAT":
            body += part
        at += 12 + n
    h, w, size = shape
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * size)
    if (rows[:, 0] != 2).any():
        raise ValueError("a filter that isn't written here")
    full = np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8)
    if size == 3:
        return full.reshape(h, w, 3)
    return np.ascontiguousarray(full).view(f">u{size}").reshape(h, w).astype(f"u{size}")


def field_images(frames: DataFrame, keys: list[str], field: str, height: int, width: int, kind: str = "u4") -> DataFrame:
    """(keys, image): a field of each frame as a PNG; pixels without a row are 0."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = np.zeros((height, width), kind)
        x[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column(field).to_numpy()
        return pa.table({k: pa.array([v.as_py()], t.schema.field(k).type) for k, v in zip(keys, key, strict=True)} | {"image": pa.array([encode_png(x)], pa.binary())})

    return frames.select(*keys, "row", "col", F.coalesce(F.col(field).cast("long"), F.lit(0)).alias(field)).groupBy(*keys).applyInArrow(run, f"{kinds}, image binary")


def image_pixels(images: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys, row, col, field) of such images again."""
    kinds = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = decode_png(b.column("image")[i].as_py())
                row, col = (c.ravel().astype(np.int32) for c in np.indices(x.shape))
                own = {k: pa.array([b.column(k)[i].as_py()] * x.size, b.schema.field(k).type) for k in keys}
                yield pa.RecordBatch.from_pydict(own | {"row": pa.array(row), "col": pa.array(col), field: pa.array(x.ravel().astype(np.int64))})

    return images.select(*keys, "image").mapInArrow(run, f"{kinds}, row int, col int, {field} long")


def checksums(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, crc): a checksum of each chunk that doesn't depend on the order of its rows: the sum of their 64-bit hashes.

    Not of CRCs: the same change flips the same bits of each row's CRC, so changes of several rows cancel in a sum.
    Times count to the microsecond, in UTC.
    """
    rest = [c for c in df.columns if c not in keys]
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    row = F.xxhash64(F.to_json(F.struct(*rest), {"timeZone": "UTC", "timestampFormat": f"{micros}XXX", "timestampNTZFormat": micros}))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("crc"))


def damaged(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose rows don't match their checksum, are missing, or weren't known."""
    now = checksums(df, keys).withColumnsRenamed({"rows": "_rows", "crc": "_crc"})
    both = known.join(now, keys, "full")
    return both.where(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("crc").eqNullSafe(F.col("_crc")))).select(*keys)


def write_metadata(spark: SparkSession, store: str, document: str) -> int:
    """A new version of a store's metadata document beside its frames; older versions stay. Returns its number."""
    number = max([r["version"] for r in _versions(spark, store).select("version").collect()], default=0) + 1
    spark.createDataFrame([(number, document)], "version int, document string").coalesce(1).write.mode("append").parquet(f"{store}/_versions")
    return number


def _versions(spark: SparkSession, store: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "version int, document string")
    return spark.read.schema("version int, document string").parquet(f"{store}/_versions")


def metadata(spark: SparkSession, store: str, version: int | None = None) -> str | None:
    """The newest document, or an older version: going back is writing it again."""
    rows = _versions(spark, store).where("true" if version is None else f"version = {int(version)}").orderBy(F.desc("version")).limit(1).collect()
    return rows[0]["document"] if rows else None


def store_info(frames: DataFrame) -> DataFrame:
    """A line for each sensor of a store: frames, columns, time span, share of valid columns, frames a second."""
    g = frames.groupBy("sensor_idx").agg(F.countDistinct("frame_id").alias("frames"), F.count(F.lit(1)).alias("columns"), F.count_if(F.col("status").bitwiseAND(1) == 1).alias("valid"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
    return g.withColumn("rate_hz", F.when(F.col("end_ns") > F.col("start_ns"), (F.col("frames") - 1) / ((F.col("end_ns") - F.col("start_ns")) / 1e9)))


def store_dump(frames: DataFrame) -> DataFrame:
    """(sensor_idx, document): each sensor's summary as JSON."""
    info = store_info(frames)
    return info.select("sensor_idx", F.to_json(F.struct(*[c for c in info.columns if c != "sensor_idx"])).alias("document"))


class BackgroundWriter:
    """Jobs that write while the caller goes on: at most ``queue`` wait, then ``write`` blocks. Each returns a future; leaving the block waits for all."""

    def __init__(self, threads: int = 1, queue: int = 10) -> None:
        self.pool, self.room = ThreadPoolExecutor(threads), BoundedSemaphore(queue)

    def write(self, df: DataFrame, path: str, mode: str = "append") -> Future:
        self.room.acquire()
        done = self.pool.submit(lambda: df.write.mode(mode).parquet(path))
        done.add_done_callback(lambda _: self.room.release())
        return done

    def __enter__(self) -> BackgroundWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(wait=True)


class Captures(DataSource):
    """``df.write.format("capture").save(path)``: packets (ts_ns, src, dst, src_port, dst_port, payload) as captures, one a partition, in the partition's order."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        folder = self.options["path"].removeprefix("file:")

        class Writer(DataSourceWriter):
            def write(self, rows: Iterator) -> WriterCommitMessage:
                import os

                from pyspark import TaskContext

                from beamframe.sources import captures

                os.makedirs(folder, exist_ok=True)
                number = TaskContext.get().partitionId()
                fields = ("ts_ns", "src", "dst", "src_port", "dst_port", "payload")
                path = f"{folder}/part-{number:05d}.pcap"
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as f:
                    f.write(captures.head())
                    for k, r in enumerate(rows):
                        f.write(captures.records(k, *[r[c] for c in fields]))
                os.replace(f.name, path)
                return WriterCommitMessage()

        return Writer()


def rolled_captures(packets: DataFrame, chunk: str, ts: str = "ts_ns") -> DataFrame:
    """Packets dealt so that a chunk of frames is one partition, in time order: one capture a chunk."""
    n = packets.agg(F.max(chunk)).first()[0]
    return packets.repartitionById((n or 0) + 1, F.col(chunk)).sortWithinPartitions(ts)


def save_model(cloud: DataFrame, size: float, per_file: int, path: str) -> None:
    """A cloud thinned to the mean of each voxel, as text files of ``per_file`` points: x y z."""
    from beamframe.operators.aggregates import voxel_average

    voxel_average(cloud, size, ["x", "y", "z"]).select(F.format_string("%.4f %.4f %.4f", "x", "y", "z")).write.option("maxRecordsPerFile", per_file).text(path)


def map_parts(cloud: DataFrame, size: float, per_file: int) -> DataFrame:
    """(part, x, y, z): the points of a map by the file that they go to, in the order of their voxels."""
    from beamframe.operators.aggregates import CELL, voxel_average
    from beamframe.operators.selection import numbered

    return numbered(voxel_average(cloud, size, ["x", "y", "z"]), CELL).select(F.floor(F.col("seq") / per_file).cast("int").alias("part"), *CELL, "x", "y", "z")

