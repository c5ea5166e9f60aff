"""Sensor packets: layouts as data, headers as column expressions, pixel blocks by numpy on whole batches.

A layout says where a number lies: (first bit, bits) of little-endian bytes. Headers
are read by JVM expressions over the payload; pixels, IMU and zone measurements, of
which a packet has many, by Arrow stages that see a batch of payloads as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a pixel by profile, (first bit, bits, shift up), and the bytes of a pixel.
LEGACY = {"RANGE": (0, 20, 0), "FLAGS": (28, 4, 0), "REFLECTIVITY": (32, 8, 0), "SIGNAL": (48, 16, 0), "NEAR_IR": (64, 16, 0)}
LOW = {"RANGE": (0, 15, 3), "FLAGS": (15, 1, 0), "REFLECTIVITY": (16, 8, 0), "NEAR_IR": (24, 8, 4)}
LOW_WINDOW = {"RANGE": (0, 15, 3), "FLAGS": (15, 1, 0), "REFLECTIVITY": (16, 8, 0), "WINDOW": (24, 8, 0)}
LOW_ZONE = LOW | {"ZONE_MASK": (32, 16, 0), "WINDOW": (48, 8, 0)}
LOW_DUAL = LOW | {"RANGE2": (32, 15, 3), "FLAGS2": (47, 1, 0), "REFLECTIVITY2": (48, 8, 0), "WINDOW": (56, 8, 0)}
SINGLE = {"RANGE": (0, 19, 0), "FLAGS": (19, 5, 0), "REFLECTIVITY": (32, 8, 0), "SIGNAL": (48, 16, 0), "NEAR_IR": (64, 16, 0), "WINDOW": (88, 8, 0)}
SINGLE_ZONE = {"RANGE": (0, 19, 0), "FLAGS": (19, 5, 0), "REFLECTIVITY": (32, 8, 0), "WINDOW": (40, 8, 0), "SIGNAL": (48, 16, 0), "NEAR_IR": (64, 16, 0), "ZONE_MASK": (80, 16, 0)}
TWO_RETURNS = {"RANGE": (0, 19, 0), "FLAGS": (19, 5, 0), "REFLECTIVITY": (24, 8, 0), "RANGE2": (32, 19, 0), "FLAGS2": (51, 5, 0), "REFLECTIVITY2": (56, 8, 0), "SIGNAL": (64, 16, 0), "SIGNAL2": (80, 16, 0)}
DUAL = TWO_RETURNS | {"NEAR_IR": (96, 16, 0), "WINDOW": (120, 8, 0)}
FIVE_WORDS = TWO_RETURNS | {"NEAR_IR": (96, 16, 0)}
DUAL_ZONE = TWO_RETURNS | {"ZONE_MASK": (96, 16, 0), "WINDOW": (120, 8, 0)}
COLOUR = {"RANGE": (0, 19, 0), "FLAGS": (19, 5, 0), "REFLECTIVITY": (24, 8, 0), "SIGNAL": (32, 16, 0), "NEAR_IR": (48, 16, 0), "R": (64, 16, 0), "G": (80, 16, 0), "B": (96, 16, 0)}
DUAL_COLOUR = TWO_RETURNS | {"NEAR_IR": (96, 16, 0), "R": (112, 16, 0), "G": (128, 16, 0), "B": (144, 16, 0)}

PROFILES: dict[str, tuple[int, dict[str, tuple[int, int, int]]]] = {
    "LEGACY": (12, LEGACY),
    "RNG19_RFL8_SIG16_NIR16_DUAL": (16, DUAL),
    "RNG19_RFL8_SIG16_NIR16": (12, SINGLE),
    "RNG15_RFL8_NIR8": (4, LOW),
    "FIVE_WORD_PIXEL": (20, FIVE_WORDS),
    "FUSA_RNG15_RFL8_NIR8_DUAL": (8, LOW_DUAL),
    "RNG15_RFL8_NIR8_DUAL": (8, LOW_DUAL),
    "OFF": (0, {}),
    "RNG15_RFL8_NIR8_ZONE16": (8, LOW_ZONE),
    "RNG19_RFL8_SIG16_NIR16_ZONE16": (12, SINGLE_ZONE),
    "RNG15_RFL8_WIN8": (4, LOW_WINDOW),
    "RNG19_RFL8_SIG16_ZONE16_DUAL": (16, DUAL_ZONE),
    "RNG19_RFL8_SIG16_NIR16_RGB16": (16, COLOUR),
    "RNG19_RFL8_SIG16_NIR16_RGB16_DUAL": (20, DUAL_COLOUR),
}
#: Profiles of a host application: name -> (bytes of a pixel, fields); 32 in all at most.
CUSTOM: dict[str, tuple[int, dict[str, tuple[int, int, int]]]] = {}
MOST_PROFILES = 32

# Fixed values: (first bit, bits) of the packet headers; what a header lacks reads as 0.
STANDARD_HEADER = {"packet_type": (0, 16), "frame_id": (16, 16), "init_id": (32, 24), "prod_sn": (56, 40), "alert_flags": (96, 8), "countdown_thermal_shutdown": (128, 8), "countdown_shot_limiting": (136, 8), "thermal_shutdown": (144, 4), "shot_limiting": (152, 4)}
FUSA_HEADER = {"packet_type": (0, 8), "frame_id": (32, 32), "init_id": (8, 24), "prod_sn": (88, 40), "alert_flags": (64, 8), "countdown_thermal_shutdown": (128, 8), "countdown_shot_limiting": (136, 8), "thermal_shutdown": (144, 4), "shot_limiting": (152, 4)}
LEGACY_HEADER = {"frame_id": (80, 16)}
HEADER_FIELDS = list(STANDARD_HEADER)
COLUMN_HEADER = {"timestamp": (0, 64), "measurement_id": (64, 16)}
#: Bits of a zone's measurement.
ZONE_FIELDS = {"live": (0, 1), "id": (8, 8), "error_flags": (16, 8), "trigger_type": (26, 2), "trigger_status": (31, 1), "triggered_frames": (32, 32), "count": (64, 32), "occlusion_count": (96, 32), "invalid_count": (128, 32), "max_count": (160, 32), "min_range": (192, 19), "max_range": (224, 19), "mean_range": (256, 19)}
ZONES, ZONE_BYTES, ZONE_HASH = 16, 36, 32
IMU_BYTES, NMEA_BLOCK, NMEA_CHARS = 36, 100, 85
#: Standard gravity (the legacy IMU reports multiples of it), and the reflected polynomial of the packet CRC.
GRAVITY, CRC_POLY = 9.80665, 0xC96C5795D7870F42


def add_profile(name: str, pixel_bytes: int, fields: dict[str, tuple[int, int, int]]) -> None:
    """Register a packet profile."""
    if name in PROFILES or name in CUSTOM:
        raise ValueError(f"the profile {name} is there already")
    if len(PROFILES) + len(CUSTOM) >= MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    if any(first < 0 or bits <= 0 or first + bits > 8 * pixel_bytes for first, bits, _ in fields.values()):
        raise ValueError("a field lies outside the pixel")
    CUSTOM[name] = (pixel_bytes, dict(fields))


def profile(name: str) -> tuple[int, dict[str, tuple[int, int, int]]]:
    try:
        return PROFILES.get(name) or CUSTOM[name]
    except KeyError:
        raise ValueError(f"unknown profile {name}") from None


def returns(name: str) -> int:
    """Returns of a pixel."""
    return sum(f in profile(name)[1] for f in ("RANGE", "RANGE2"))


@dataclass(frozen=True)
class Format:
    """The sizes of a sensor's packets."""

    profile: str = "RNG19_RFL8_SIG16_NIR16"
    rows: int = 128
    columns_per_packet: int = 16
    columns_per_frame: int = 1024
    fusa: bool = False
    imu_profile: str = "LEGACY"
    imu_measurements: int = 0
    custom: tuple | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.custom is None and self.profile in CUSTOM:  # travels with the format to the executors
            object.__setattr__(self, "custom", CUSTOM[self.profile])
        if self.lidar_bytes > 65535:
            raise ValueError("a lidar packet can't exceed 65535 bytes")
        if self.legacy and self.imu_profile != "LEGACY":
            raise ValueError("legacy lidar packets don't mix with other IMU packets")

    @property
    def legacy(self) -> bool:
        return self.profile == "LEGACY"

    @property
    def pixel(self) -> tuple[int, dict[str, tuple[int, int, int]]]:
        return self.custom or profile(self.profile)

    @property
    def header(self) -> dict[str, tuple[int, int]]:
        return LEGACY_HEADER if self.legacy else FUSA_HEADER if self.fusa else STANDARD_HEADER

    @property
    def header_bytes(self) -> int:
        return 0 if self.legacy else 32

    @property
    def column_header_bytes(self) -> int:
        return 16 if self.legacy else 12

    @property
    def column_bytes(self) -> int:
        return self.column_header_bytes + self.rows * self.pixel[0] + (4 if self.legacy else 0)

    @property
    def status(self) -> tuple[int, int]:
        return (8 * (self.column_bytes - 4), 32) if self.legacy else (80, 16)

    @property
    def footer_bytes(self) -> int:
        return self.header_bytes

    @property
    def lidar_bytes(self) -> int:
        return self.header_bytes + self.columns_per_packet * self.column_bytes + self.footer_bytes

    @property
    def imu_bytes(self) -> int:
        return 48 if self.imu_profile == "LEGACY" else self.header_bytes + NMEA_BLOCK + self.imu_measurements * IMU_BYTES + self.footer_bytes

    @property
    def zone_bytes(self) -> int:
        return self.header_bytes + 8 + ZONE_HASH + ZONES * ZONE_BYTES + self.footer_bytes

    @property
    def has_crc(self) -> bool:
        return not (self.legacy or self.fusa or self.profile == "FUSA_RNG15_RFL8_NIR8_DUAL")

    @property
    def max_frame_id(self) -> int:
        return (1 << 32) - 1 if self.fusa else (1 << 16) - 1


# ---------------------------------------------------------------- headers, as expressions


def bits_at(payload: Column, first: int, bits: int) -> Column:
    """An unsigned little-endian number of up to 56 bits (64 if it begins with a byte; then as a signed long) of a binary column."""
    start, skip = divmod(first, 8)
    size = -(-(skip + bits) // 8)
    if size > 8:
        raise ValueError("the number spans more than 8 bytes")
    digits = F.hex(F.substring(payload, start + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    if size == 8:
        high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
        word = F.shiftleft(high, 32).bitwiseOR(low)
    else:
        word = F.conv(swapped, 16, 10).cast("long")
    word = F.shiftrightunsigned(word, skip) if skip else word
    return word if bits == 64 else word.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def packet_header(payload: Column, fmt: Format) -> dict[str, Column]:
    """All header fields; what the format lacks is 0."""
    return {k: bits_at(payload, *fmt.header[k]) if k in fmt.header else F.lit(0).cast("long") for k in HEADER_FIELDS}


def guessed_type(payload: Column, fmt: Format) -> Column:
    """What a packet is by its size."""
    n = F.octet_length(payload)
    return F.when(n == fmt.imu_bytes, "imu").when(n == fmt.zone_bytes, "zone").otherwise("lidar")


def validation(payload: Column, kind: Column, fmt: Format, init_id: Column, sn: Column) -> Column:
    """NONE, PACKET_SIZE or ID; ids of 0, in the packet or the metadata, match all."""
    head = packet_header(payload, fmt)
    wanted = F.when(kind == "imu", fmt.imu_bytes).when(kind == "zone", fmt.zone_bytes).otherwise(fmt.lidar_bytes)
    differs = lambda a, b: (a != 0) & (b != 0) & (a != b)
    no_ids = (kind == "imu") & F.lit(fmt.imu_profile == "LEGACY")
    return F.when(F.octet_length(payload) != wanted, "PACKET_SIZE").when(no_ids, "NONE").when(differs(head["init_id"], init_id) | differs(head["prod_sn"], sn), "ID").otherwise("NONE")


def stored_crc(payload: Column) -> Column:
    """The CRC in a packet's last 8 bytes, as 16 hexadecimal digits."""
    digits = F.hex(F.substring(payload, -8, 8))
    return F.lower(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8))]))


def frame_status(thermal_shutdown: Column, shot_limiting: Column) -> Column:
    """Both states packed: thermal shutdown in bits 0 to 3, shot limiting in bits 4 to 7."""
    return thermal_shutdown.bitwiseAND(15).bitwiseOR(F.shiftleft(shot_limiting.bitwiseAND(15), 4))


def unpacked_status(status: Column) -> dict[str, Column]:
    return {"thermal_shutdown": status.bitwiseAND(15), "shot_limiting": F.shiftright(status, 4).bitwiseAND(15)}


# ---------------------------------------------------------------- batches of payloads


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(CRC_POLY), table >> np.uint64(1))
    return table


def crc64(rows: np.ndarray) -> np.ndarray:
    """The CRC of each row of a byte matrix."""
    table, crc = _crc_table(), np.full(len(rows), np.iinfo(np.uint64).max)
    for k in range(rows.shape[1]):
        crc = table[(rows[:, k] ^ crc).astype(np.uint8)] ^ (crc >> np.uint64(8))
    return ~crc


def take_bits(rows: np.ndarray, first: int, bits: int, up: int = 0) -> np.ndarray:
    """An unsigned number of each row (last axis: bytes)."""
    start, skip = divmod(first, 8)
    out = np.zeros(rows.shape[:-1], np.uint64)
    for k in range(-(-(skip + bits) // 8)):
        out |= rows[..., start + k].astype(np.uint64) << np.uint64(8 * k)
    out = out >> np.uint64(skip)
    if bits < 64:
        out &= np.uint64((1 << bits) - 1)
    return out << np.uint64(up)


def put_bits(rows: np.ndarray, value: np.ndarray, first: int, bits: int, up: int = 0) -> None:
    start, skip = divmod(first, 8)
    word = value.astype(np.uint64) >> np.uint64(up)
    if bits < 64:
        word = word & np.uint64((1 << bits) - 1)
    word = word << np.uint64(skip)
    for k in range(-(-(skip + bits) // 8)):
        rows[..., start + k] |= (word >> np.uint64(8 * k)).astype(np.uint8)


def columns_of(rows: np.ndarray, fmt: Format) -> np.ndarray:
    """(packets, columns, bytes of a column) of lidar packets."""
    return rows[:, fmt.header_bytes : fmt.header_bytes + fmt.columns_per_packet * fmt.column_bytes].reshape(len(rows), fmt.columns_per_packet, fmt.column_bytes)


def pixels_of(rows: np.ndarray, fmt: Format) -> np.ndarray:
    """(packets, columns, rows, bytes of a pixel)."""
    size = fmt.pixel[0]
    c = columns_of(rows, fmt)[..., fmt.column_header_bytes : fmt.column_header_bytes + fmt.rows * size]
    return c.reshape(*c.shape[:2], fmt.rows, size)


def matrices(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``payload`` that have ``size`` bytes, their bytes as a matrix)."""
    payload = [x.as_buffer() if x.is_valid else b"" for x in batch.column("payload")]
    at = np.array([i for i, x in enumerate(payload) if len(x) == size], np.int64)
    data = np.stack([np.frombuffer(payload[i], np.uint8) for i in at]) if len(at) else np.zeros((0, size), np.uint8)
    return at, data


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel().astype(np.int64)))


def _header_columns(data: np.ndarray, fmt: Format, times: int) -> dict[str, pa.Array]:
    return {k: pa.array(np.repeat(take_bits(data, *fmt.header[k]).astype(np.int64) if k in fmt.header else np.zeros(len(data), np.int64), times)) for k in ("frame_id", "init_id", "prod_sn", "alert_flags")}


def decode_columns(packets: DataFrame, fmt: Format, keep: list[str] = ()) -> DataFrame:
    """Lidar packets (``payload`` and columns to keep) as one row per measurement column: its header and an array of each field, by row.

    Payloads of another size are left out; ``validation`` tells them.
    """
    fields = fmt.pixel[1]
    kept = list(keep)
    kinds = ", ".join([*[f"{c} {packets.schema[c].dataType.simpleString()}" for c in kept], *[f"{c} long" for c in ("frame_id", "init_id", "prod_sn", "alert_flags")], "ts_ns long, col int, status long", *[f"{f} array<long>" for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data = matrices(b, fmt.lidar_bytes)
            if not len(at):
                continue
            cols, px, n = columns_of(data, fmt), pixels_of(data, fmt), fmt.columns_per_packet
            out = {c: b.column(c).take(pa.array(np.repeat(at, n))) for c in kept} | _header_columns(data, fmt, n)
            out |= {"ts_ns": pa.array(take_bits(cols, 0, 64).ravel().view(np.int64)), "col": pa.array(take_bits(cols, 64, 16).ravel().astype(np.int32)), "status": pa.array(take_bits(cols, *fmt.status).ravel().astype(np.int64))}
            out |= {f: _lists(take_bits(px, *where).reshape(-1, fmt.rows)) for f, where in fields.items()}
            yield pa.RecordBatch.from_pydict(out)

    return packets.select("payload", *kept).mapInArrow(run, kinds)


def decode_points(packets: DataFrame, fmt: Format, keep: list[str] = ()) -> DataFrame:
    """One row per pixel; an invalid column's pixels are left out."""
    fields = list(fmt.pixel[1])
    c = decode_columns(packets, fmt, keep).where(F.col("status").bitwiseAND(1) == 1)
    return c.select(*keep, "frame_id", "init_id", "ts_ns", "col", F.posexplode(F.arrays_zip(*fields)).alias("row", "px")).select(*keep, "frame_id", "init_id", "ts_ns", "col", "row", "px.*")


def encode_columns(columns: DataFrame, fmt: Format, keys: list[str]) -> DataFrame:
    """The inverse: (keys, frame_id, init_id, prod_sn, packet_no, payload) of measurement columns, packets in order of their first timestamp.

    A frame's columns of one packet meet by grouping; columns that are missing are zero, with status 0. The CRC is written where the format has one.
    Ids of frames wrap: where a table holds more frames than ids, ``keys`` must tell them apart. A column that comes twice is an error.
    """
    fields = fmt.pixel[1]
    per = fmt.columns_per_packet
    wanted = ["ts_ns", "col", "status", *fields]
    packed = columns.withColumn("packet_no", F.floor(F.col("col") / per).cast("int")).groupBy(*keys, "frame_id", "init_id", "prod_sn", "packet_no").agg(F.collect_list(F.struct(*wanted)).alias("c"))
    kinds = ", ".join([*[f"{c} {columns.schema[c].dataType.simpleString()}" for c in keys], "frame_id long, init_id long, prod_sn long, packet_no int, first_ts long, payload binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.zeros((b.num_rows, fmt.lidar_bytes), np.uint8)
            head = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in ("frame_id", "init_id", "prod_sn")}
            for k, v in head.items():
                if k in fmt.header and not fmt.legacy:
                    put_bits(rows, v, *fmt.header[k])
            if not fmt.legacy:
                put_bits(rows, np.ones(len(rows), np.uint64), *fmt.header["packet_type"])
            lists = b.column("c")
            flat, of = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            get = lambda name: flat.field(flat.type.get_field_index(name))  # noqa: B023, E731
            col = get("col").to_numpy().astype(np.int64)
            if len(np.unique(of * per + col % per)) < len(of):
                raise ValueError("a column of a frame comes twice; frames of the same id need a key")
            no = b.column("packet_no").to_numpy().astype(np.int64)
            cols = np.zeros((b.num_rows, per, fmt.column_bytes), np.uint8)
            put_bits(cols, no[:, None] * per + np.arange(per)[None, :], *COLUMN_HEADER["measurement_id"])
            if fmt.legacy:
                put_bits(cols, np.repeat(head["frame_id"][:, None], per, axis=1), *LEGACY_HEADER["frame_id"])
            one = cols[of, col % per]
            put_bits(one, get("ts_ns").to_numpy().astype(np.int64).view(np.uint64), *COLUMN_HEADER["timestamp"])
            put_bits(one, get("status").to_numpy().astype(np.uint64), *fmt.status)
            size = fmt.pixel[0]
            px = one[:, fmt.column_header_bytes : fmt.column_header_bytes + fmt.rows * size].reshape(len(one), fmt.rows, size)
            for f, where in fields.items():
                put_bits(px, get(f).flatten().to_numpy().reshape(len(one), fmt.rows).astype(np.uint64), *where)
            one[:, fmt.column_header_bytes : fmt.column_header_bytes + fmt.rows * size] = px.reshape(len(one), -1)
            cols[of, col % per] = one
            rows[:, fmt.header_bytes : fmt.header_bytes + per * fmt.column_bytes] = cols.reshape(b.num_rows, -1)
            if fmt.has_crc:
                rows[:, -8:] = crc64(rows[:, :-8]).astype("<u8")[:, None].view(np.uint8)
            ts = np.full(b.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(ts, of, get("ts_ns").to_numpy().astype(np.int64))
            out = {c: b.column(c) for c in keys} | {c: b.column(c) for c in ("frame_id", "init_id", "prod_sn", "packet_no")}
            yield pa.RecordBatch.from_pydict(out | {"first_ts": pa.array(ts), "payload": pa.array([r.tobytes() for r in rows], pa.binary())})

    return packed.mapInArrow(run, kinds)


def with_crc(packets: DataFrame) -> DataFrame:
    """``crc``: the CRC of all but the last 8 bytes, as 16 hexadecimal digits."""
    kinds = packets.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload = [x.as_py() or b"" for x in b.column("payload")]
            size = np.array([max(len(x) - 8, 0) for x in payload], np.int64)
            out = np.zeros(len(payload), np.uint64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                out[at] = crc64(np.stack([np.frombuffer(payload[i][:n], np.uint8) for i in at]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f"{x:016x}" for x in out.tolist()])], names=[*b.schema.names, "crc"])

    return packets.mapInArrow(run, f"{kinds}, crc string")


def decode_imu(packets: DataFrame, fmt: Format, keep: list[str] = ()) -> DataFrame:
    """IMU packets as one row per measurement: (frame_id, i, ts_ns, measurement_id, status, acc, gyro, nmea, nmea_ts), in m/s^2 and rad/s."""
    kept = list(keep)
    kinds = ", ".join([*[f"{c} {packets.schema[c].dataType.simpleString()}" for c in kept], "frame_id long, i int, ts_ns long, measurement_id int, status int, acc array<float>, gyro array<float>, nmea string, nmea_ts long"])
    legacy = fmt.imu_profile == "LEGACY"
    per = 1 if legacy else fmt.imu_measurements

    def triples(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 3, pa.int32()), pa.array(np.ascontiguousarray(x, np.float32).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data = matrices(b, fmt.imu_bytes)
            if not len(at):
                continue
            many = len(at) * per
            if legacy:
                six = np.ascontiguousarray(data[:, 24:48]).view("<f4")
                acc, gyro = six[:, :3] * np.float32(GRAVITY), six[:, 3:] * np.float32(np.pi / 180)
                ts, number, status, frame = take_bits(data, 128, 64), np.zeros(many), np.ones(many), np.zeros(len(at), np.int64)
                nmea, nmea_ts = [None] * many, np.zeros(many, np.int64)
            else:
                start = fmt.header_bytes + NMEA_BLOCK
                m = data[:, start : start + per * IMU_BYTES].reshape(many, IMU_BYTES)
                six = np.ascontiguousarray(m[:, 12:36]).view("<f4")
                acc, gyro = six[:, :3], six[:, 3:]
                ts, number, status = take_bits(m, 0, 64), take_bits(m, 64, 16), take_bits(m, 80, 16) & np.uint64(1)
                frame = take_bits(data, *fmt.header["frame_id"]).astype(np.int64)
                text = [bytes(r[fmt.header_bytes + 8 : fmt.header_bytes + 8 + NMEA_CHARS]).split(b"\0")[0].decode("ascii", "replace") for r in data]
                nmea, nmea_ts = np.repeat(np.array(text, object), per).tolist(), np.repeat(take_bits(data, 8 * fmt.header_bytes, 64).astype(np.int64), per)
            out = {c: b.column(c).take(pa.array(np.repeat(at, per))) for c in kept}
            out |= {"frame_id": pa.array(np.repeat(frame, per)), "i": pa.array(np.tile(np.arange(per, dtype=np.int32), len(at))), "ts_ns": pa.array(ts.astype(np.int64)), "measurement_id": pa.array(number.astype(np.int32)), "status": pa.array(status.astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out | {"acc": triples(acc), "gyro": triples(gyro), "nmea": pa.array(nmea, pa.string()), "nmea_ts": pa.array(nmea_ts)})

    return packets.select("payload", *kept).mapInArrow(run, kinds)


def decode_zones(packets: DataFrame, fmt: Format, keep: list[str] = ()) -> DataFrame:
    """Zone packets as 16 rows each: the zone's slot, the packet's timestamp and zone-set hash, and the 13 members of its state."""
    kept = list(keep)
    kinds = ", ".join([*[f"{c} {packets.schema[c].dataType.simpleString()}" for c in kept], "frame_id long, slot int, ts_ns long, zone_set string", *[f"{f} long" for f in ZONE_FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data = matrices(b, fmt.zone_bytes)
            if not len(at):
                continue
            start = fmt.header_bytes + 8 + ZONE_HASH
            m = data[:, start : start + ZONES * ZONE_BYTES].reshape(-1, ZONE_BYTES)
            hashes = [bytes(r[fmt.header_bytes + 8 : start]).hex() for r in data]
            out = {c: b.column(c).take(pa.array(np.repeat(at, ZONES))) for c in kept}
            frame = take_bits(data, *fmt.header["frame_id"]).astype(np.int64) if not fmt.legacy else np.zeros(len(at), np.int64)
            out |= {"frame_id": pa.array(np.repeat(frame, ZONES)), "slot": pa.array(np.tile(np.arange(ZONES, dtype=np.int32), len(at))), "ts_ns": pa.array(np.repeat(take_bits(data, 8 * fmt.header_bytes, 64).astype(np.int64), ZONES)), "zone_set": pa.array(np.repeat(np.array(hashes, object), ZONES).tolist(), pa.string())}
            yield pa.RecordBatch.from_pydict(out | {f: pa.array(take_bits(m, *where).astype(np.int64)) for f, where in ZONE_FIELDS.items()})

    return packets.select("payload", *kept).mapInArrow(run, kinds)


def words_of(payload: bytes, fmt: Format) -> np.ndarray:
    """A lidar packet's pixels as raw 32-bit words: (columns, rows, words)."""
    px = pixels_of(np.frombuffer(payload, np.uint8)[None, :], fmt)[0]
    return np.ascontiguousarray(px).view("<u4")


def hex_dump(payload: bytes, width: int = 16) -> str:
    """Offsets and bytes, ``width`` a line."""
    return "\n".join(f"{i:08x}  {payload[i : i + width].hex(' ')}" for i in range(0, len(payload), width))
