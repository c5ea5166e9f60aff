"""Point clouds, meshes, poses and metadata in their usual file formats."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numpy types of PLY and PCD properties.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(data: bytes) -> np.ndarray:
    """n x 3 coordinates of the vertex element."""
    head, _, body = data.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    kind = next(x[1] for x in lines if x[:1] == ["format"])
    count, fields, inside = 0, [], False
    for x in lines:
        if x[:1] == ["element"]:
            inside = x[1] == "vertex"
            count = int(x[2]) if inside else count
        elif x[:1] == ["property"] and inside:
            fields.append((x[2], PLY_TYPES[x[1]]))
    return _columns(body, count, fields, kind.startswith("ascii"), ">" if "big" in kind else "<")


def _columns(body: bytes, count: int, fields: list[tuple[str, str]], ascii_: bool, order: str) -> np.ndarray:
    if ascii_:
        table = np.array(body.split()[: count * len(fields)], float).reshape(count, len(fields))
        return table[:, [[f for f, _ in fields].index(a) for a in "xyz"]]
    rows = np.frombuffer(body, np.dtype([(f, order + t) for f, t in fields]), count)
    return np.column_stack([rows[a] for a in "xyz"]).astype(float)


def parse_pcd(data: bytes) -> np.ndarray:
    head, at = {}, 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii").split()
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
        at = end + 1
    if head["DATA"][0] == "binary_compressed":
        raise ValueError("compressed PCD files aren't supported")
    kinds = {"F": "f", "U": "u", "I": "i"}
    fields = [(f, kinds[t] + s) for f, t, s in zip(head["FIELDS"], head["TYPE"], head["SIZE"], strict=True)]
    return _columns(data[at:], int(head["POINTS"][0]), fields, head["DATA"][0] == "ascii", "<")


def parse_stl(data: bytes) -> np.ndarray:
    """n x 3 x 3 corners of a binary or ascii mesh."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        rows = np.frombuffer(data, np.dtype([("n", "<3f4"), ("v", "<9f4"), ("a", "<u2")]), offset=84)
        return rows["v"].reshape(-1, 3, 3).astype(float)
    if not data.lstrip().startswith(b"solid"):
        raise ValueError("not an STL file")
    v = [line.split()[1:4] for line in data.decode("ascii").splitlines() if line.split()[:1] == ["vertex"]]
    return np.array(v, float).reshape(-1, 3, 3)


def write_stl(triangles: np.ndarray) -> bytes:
    rows = np.zeros(len(triangles), np.dtype([("n", "<3f4"), ("v", "<9f4"), ("a", "<u2")]))
    rows["v"] = triangles.reshape(-1, 9)
    return b"\0" * 80 + struct.pack("<I", len(rows)) + rows.tobytes()


def write_ply(points: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + points.astype("<f4").tobytes()


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of PLY and PCD files; a file is the unit of parallel work."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for name, content in zip(t["path"], t["content"], strict=True):
                p = (parse_ply if name.lower().endswith(".ply") else parse_pcd)(content)
                for at in range(0, len(p), 65536):
                    yield pd.DataFrame(p[at : at + 65536], columns=["x", "y", "z"]).assign(path=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "x double, y double, z double, path string")


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Poses, 12 numbers a line, as arrays of 16."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    return spark.read.text(path).where("trim(value) <> ''").select(F.concat(numbers, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).alias("pose"))


def write_trajectory(df: DataFrame, path: str, tum: bool = False) -> None:
    """timestamp, position, quaternion as CSV, or separated by spaces."""
    df.select("timestamp", "x", "y", "z", "qx", "qy", "qz", "qw").write.options(header=not tum, sep=" " if tum else ",").csv(path)


def write_points(df: DataFrame, path: str, per_file: int = 5_000_000) -> None:
    """Denormalised points as CSV, rolled at a number of rows."""
    df.write.options(header=True, maxRecordsPerFile=per_file).csv(path)


def write_frames(df: DataFrame, path: str) -> None:
    """The frame store: partitioned by sensor, clustered by frame and time, so that time and sensor predicates prune."""
    df.repartitionByRange("sensor_idx", "frame_id").sortWithinPartitions("sensor_idx", "frame_id").write.partitionBy("sensor_idx").parquet(path)


def messages(spark: SparkSession, path: str, sensors: list[int], start_ns: int, end_ns: int, fields: list[str]) -> DataFrame:
    """Range scan of the frame store: both predicates and the fields reach the scan."""
    return spark.read.parquet(path).where(F.col("sensor_idx").isin(sensors) & F.col("ts_ns").between(start_ns, end_ns)).select("sensor_idx", "ts_ns", *fields)


def sensor_rows(document: str) -> tuple[dict, list[tuple[int, float, float, int]], list[tuple[str, str, str]]]:
    """(sensor, beams, issues (path, message, severity)) of a metadata document, nested or flat."""
    doc = json.loads(document)
    issues: list[tuple[str, str, str]] = []
    beams = doc.get("beam_intrinsics", doc)
    form = doc.get("lidar_data_format", doc.get("data_format", {}))
    info = doc.get("sensor_info", doc)
    azimuth, altitude = beams.get("beam_azimuth_angles", []), beams.get("beam_altitude_angles", [])
    shifts = form.get("pixel_shift_by_row", [0] * len(azimuth))
    if not azimuth or len(azimuth) != len(altitude) or len(shifts) != len(azimuth):
        issues.append(("beam_intrinsics", "angles and shifts must be lists of one length", "critical"))
    if not form:
        issues.append(("lidar_data_format", "missing", "warning"))
    sensor = {
        "sn": int(info.get("prod_sn") or 0),
        "prod_line": info.get("prod_line", ""),
        "fw_rev": info.get("build_rev") or info.get("image_rev", ""),
        "h": len(azimuth),
        "w": form.get("columns_per_frame", 1024),
        "columns_per_packet": form.get("columns_per_packet", 16),
        "window": form.get("column_window", [0, form.get("columns_per_frame", 1024) - 1]),
        "profile": form.get("udp_profile_lidar", "LEGACY"),
    }
    return sensor, [(i, float(a), float(b), int(s)) for i, (a, b, s) in enumerate(zip(azimuth, altitude, shifts, strict=False))], issues


#: Bytes of a point and place of its colour by the format of a LAS file's points.
LAS_POINTS = {0: (20, None), 1: (28, None), 2: (26, 20), 3: (34, 28), 6: (30, None), 7: (36, 30), 8: (38, 30)}


def parse_las(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z, intensity and, where there are any, red, green, blue of an uncompressed LAS file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, begin = data[25], struct.unpack_from("<I", data, 96)[0]
    kind, size, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0x80 or kind & 0x3F not in LAS_POINTS:
        raise ValueError(f"points of format {kind} aren't supported")
    if minor >= 4 and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    scale, offset = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    rows = np.frombuffer(data, np.uint8, count * size, begin).reshape(count, size)
    xyz = np.ascontiguousarray(rows[:, :12]).view("<i4") * scale + offset
    out = dict(zip("xyz", xyz.T, strict=True)) | {"intensity": np.ascontiguousarray(rows[:, 12:14]).view("<u2").ravel().astype(float)}
    colour = LAS_POINTS[kind & 0x3F][1]
    if colour:
        rgb = np.ascontiguousarray(rows[:, colour : colour + 6]).view("<u2")
        out |= dict(zip(("red", "green", "blue"), rgb.T.astype(float), strict=True))
    return out


def write_las(points: np.ndarray, intensity: np.ndarray | None = None, rgb: np.ndarray | None = None, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file."""
    kind, size = (2, 26) if rgb is not None else (0, 20)
    low = points.min(axis=0) if len(points) else np.zeros(3)
    rows = np.zeros((len(points), size), np.uint8)
    rows[:, :12] = np.round((points - low) / scale).astype("<i4").view(np.uint8).reshape(len(points), 12)
    if intensity is not None:
        rows[:, 12:14] = intensity.astype("<u2")[:, None].view(np.uint8)
    if rgb is not None:
        rows[:, 20:26] = np.ascontiguousarray(rgb.astype("<u2")).view(np.uint8).reshape(len(points), 6)
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, kind, size, len(points))
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *low.tolist())
    high = points.max(axis=0) if len(points) else np.zeros(3)
    struct.pack_into("<6d", head, 179, *[x for a in range(3) for x in (high[a], low[a])])
    return bytes(head) + rows.tobytes()


def parse_attributes(data: bytes) -> dict[str, np.ndarray]:
    """All numbers of the points of a PLY, PCD or LAS file, by name; colours as red, green, blue, a packed colour taken apart."""
    if data[:4] == b"LASF":
        return parse_las(data)
    out: dict[str, np.ndarray] = {}
    if data.startswith(b"ply"):
        head, _, body = data.partition(b"end_header\n")
        lines = [x.split() for x in head.decode("ascii").splitlines()]
        kind = next(x[1] for x in lines if x[:1] == ["format"])
        at = next(i for i, x in enumerate(lines) if x[:2] == ["element", "vertex"])
        count, fields = int(lines[at][2]), []
        for x in lines[at + 1 :]:
            if x[0] != "property":
                break
            fields.append((x[2], PLY_TYPES[x[1]]))
        order = ">" if "big" in kind else "<"
        ascii_ = kind.startswith("ascii")
    else:
        head, at = {}, 0
        while "DATA" not in head:
            end = data.index(b"\n", at)
            words = data[at:end].decode("ascii").split()
            if words and not words[0].startswith("#"):
                head[words[0]] = words[1:]
            at = end + 1
        fields = [(f, {"F": "f", "U": "u", "I": "i"}[t] + s) for f, t, s in zip(head["FIELDS"], head["TYPE"], head["SIZE"], strict=True)]
        count, order, ascii_, body = int(head["POINTS"][0]), "<", head["DATA"][0] == "ascii", data[at:]
    if ascii_:
        table = np.array(body.split()[: count * len(fields)], float).reshape(count, len(fields))
        out = {f: table[:, i] for i, (f, _) in enumerate(fields)}
    else:
        rows = np.frombuffer(body, np.dtype([(f, order + t) for f, t in fields]), count)
        out = {f: rows[f] for f, _ in fields}
    for name in ("rgb", "rgba"):
        if name in out:
            x = out.pop(name)
            bits = np.ascontiguousarray(x.astype("<f4")).view("<u4") if x.dtype.kind == "f" and not ascii_ else x.astype(np.uint32)
            out |= {"red": bits >> 16 & 255, "green": bits >> 8 & 255, "blue": bits & 255}
    return {k: np.asarray(v, float) for k, v in out.items()}


def read_coloured(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, red, green, blue, intensity of PLY, PCD and LAS files; null for what a file lacks."""
    names = ["x", "y", "z", "red", "green", "blue", "intensity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for name, content in zip(t["path"], t["content"], strict=True):
                p = parse_attributes(bytes(content))
                n = len(p["x"])
                for at in range(0, n, 65536):
                    yield pd.DataFrame({k: p[k][at : at + 65536] if k in p else np.full(min(n - at, 65536), np.nan) for k in names}).assign(path=name)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{k} double" for k in names) + ", path string")
    return found.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in names[3:]})


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(path, v0x .. v2z) of STL meshes."""
    names = [f"v{i}{a}" for i in range(3) for a in "xyz"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for name, content in zip(t["path"], t["content"], strict=True):
                yield pd.DataFrame(parse_stl(bytes(content)).reshape(-1, 9), columns=names).assign(path=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{k} double" for k in names) + ", path string")


#: What a source is by the end of its name.
KINDS = {".pcap": "capture", ".pcapng": "capture", ".parquet": "frames", ".bag": "recording", ".mcap": "recording", ".ply": "cloud", ".pcd": "cloud", ".las": "coloured", ".stl": "mesh", ".json": "metadata", ".txt": "poses"}
#: Kinds that can't be read here, and why.
REFUSED = {".laz": "compressed LAS files aren't read"}


def io_type(uri: str) -> str:
    """What a source is, by its name: a folder of frames or recordings, a file by its end, a URL."""
    name = uri.lower().rstrip("/")
    if "://" in uri and not uri.startswith(("file://", "hdfs://", "s3a://", "viewfs://", "abfss://", "gs://")):
        return "url"
    for end, why in REFUSED.items():
        if name.endswith(end):
            raise ValueError(f"{uri}: {why}")
    for end, kind in KINDS.items():
        if name.endswith(end):
            return kind
    if "." not in name.rsplit("/", 1)[-1]:
        return "frames"
    raise ValueError(f"unknown kind of source: {uri}")


def open_source(spark: SparkSession, uri: str | list[str], fields: list[str] | None = None, sensor_idx: int | None = None, reader: str | None = None) -> DataFrame:
    """Any source, or several of one kind in one table.

    ``fields`` and ``sensor_idx`` reach the scan of a frame store; ``reader`` names a registered reader instead of the one by name.
    """
    uris = [uri] if isinstance(uri, str) else list(uri)
    kinds = {reader or io_type(u) for u in uris}
    if len(kinds) != 1:
        raise ValueError(f"sources of different kinds: {', '.join(sorted(kinds)) or 'none'}")
    kind = kinds.pop()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    out = None
    for u in uris:
        one = READERS[kind](spark, u)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if sensor_idx is not None and "sensor_idx" in out.columns:
        out = out.where(F.col("sensor_idx") == sensor_idx)
    return out if fields is None else out.select(*fields)


def open_packet_source(spark: SparkSession, uri: str | list[str]) -> DataFrame:
    """Packets (host_ts, payload and what the source tells of their way) of captures or recordings."""
    from beamframe.sources import captures, recordings

    uris = [uri] if isinstance(uri, str) else list(uri)
    kinds = {io_type(u) for u in uris}
    if len(kinds) != 1 or not kinds <= {"capture", "recording"}:
        raise ValueError("packets come from captures or recordings, of one kind")
    out = None
    for u in uris:
        one = captures.read_packets(spark, u).withColumnRenamed("ts_ns", "host_ts") if kinds == {"capture"} else recordings.message_packets(recordings.read_messages(spark, u))
        out = one if out is None else out.unionByName(one)
    return out


def _captures(spark: SparkSession, uri: str) -> DataFrame:
    from beamframe.sources.captures import read_packets

    return read_packets(spark, uri)


def _recordings(spark: SparkSession, uri: str) -> DataFrame:
    from beamframe.sources.recordings import read_messages

    return read_messages(spark, uri)


def _metadata(spark: SparkSession, uri: str) -> DataFrame:
    from beamframe.sources.metadata import read

    return read(spark, uri)[0]


#: Readers by kind; ``add_reader`` adds to them.
READERS = {"capture": _captures, "recording": _recordings, "frames": lambda s, u: s.read.parquet(u), "cloud": read_cloud, "coloured": read_coloured, "mesh": read_mesh, "poses": read_kitti, "metadata": _metadata}


def add_reader(kind: str, reader, ends: tuple[str, ...] = ()) -> None:  # noqa: ANN001
    """A reader of a user's own kind, and the ends of names that it takes."""
    if kind in READERS:
        raise ValueError(f"there is a reader for {kind}")
    READERS[kind] = reader
    KINDS.update(dict.fromkeys(ends, kind))
