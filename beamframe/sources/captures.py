"""Packet captures: read through Spark's binary files, a file is the unit of parallel work; and synthetic frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ts_ns long, src string, dst string, src_port int, dst_port int, ip_id int, more boolean, frag_offset int, payload binary"


#: Bytes before the IP header by link type (none, Ethernet, raw, cooked, raw IPv4, cooked 2).
LINKS = {0: 4, 1: 14, 101: 0, 113: 16, 228: 0, 276: 20}


def _classic(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(ns, link, frame) of a classic capture."""
    magic = data[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
        yield sec * 10**9 + frac * (1 if nano else 1000), link, data[at + 16 : at + 16 + size]
        at += 16 + size


def _blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """The same of a block-structured capture: sections of either byte order, interfaces of their own link and clock."""
    at, order = 0, "<"
    interfaces: list[tuple[int, int, bool]] = []
    while at + 12 <= len(data):
        kind = data[at : at + 4]
        if kind == b"\n\r\r\n":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        number, size = struct.unpack_from(order + "II", data, at)
        if size < 12:
            raise ValueError("a block of no size")
        body = data[at + 8 : at + size - 4]
        if number == 1:
            link, power, binary, o = struct.unpack_from(order + "H", body)[0], 6, False, 8
            while o + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, o)
                if code == 0:
                    break
                if code == 9:
                    power, binary = body[o + 4] & 0x7F, bool(body[o + 4] & 0x80)
                o += 4 + -(-n // 4) * 4
            interfaces.append((link, power, binary))
        elif number == 6:
            which, high, low, held = struct.unpack_from(order + "IIII", body)
            link, power, binary = interfaces[which]
            ticks = high << 32 | low
            yield ticks * 10**9 >> power if binary else ticks * 10**9 // 10**power, link, body[20 : 20 + held]
        elif number == 3 and interfaces:
            held = struct.unpack_from(order + "I", body)[0]
            yield 0, interfaces[0][0], body[4 : 4 + held]
        at += size


def packets(data: bytes) -> Iterator[tuple]:
    """IPv4 UDP packets and fragments of a capture (classic or in blocks; Ethernet, cooked or raw link)."""
    if data[:4] == b"\n\r\r\n":
        frames = _blocks(data)
    elif data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        frames = _classic(data)
    else:
        raise ValueError("not a capture")
    address = lambda b: ".".join(map(str, b))
    for ns, link, frame in frames:
        ip = frame[LINKS[link] :]
        if len(ip) < 20 or ip[0] >> 4 != 4 or ip[9] != 17:
            continue
        words = (ip[0] & 15) * 4
        total, ident, flags = struct.unpack_from(">HHH", ip, 2)
        offset, more = (flags & 0x1FFF) * 8, bool(flags & 0x2000)
        body = ip[words:total]
        sport, dport = struct.unpack_from(">HH", body) if offset == 0 and len(body) >= 8 else (None, None)
        yield ns, address(ip[12:16]), address(ip[16:20]), sport, dport, ident, more, offset, body


def head() -> bytes:
    """The beginning of a raw-link nanosecond capture."""
    return struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 1 << 18, 101)


def records(number: int, ts: int, src: str, dst: str, sport: int, dport: int, payload: bytes, mtu: int = 1500) -> bytes:
    """One datagram, fragmented to ``mtu``."""
    out = []
    body = struct.pack(">HHHH", sport, dport, (8 + len(payload)) & 0xFFFF, 0) + bytes(payload)
    step = (mtu - 20) // 8 * 8
    for at in range(0, len(body), step):
        part = body[at : at + step]
        flags = (0x2000 if at + step < len(body) else 0) | at // 8
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(part), number & 0xFFFF, flags, 64, 17, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
        out.append(struct.pack("<IIII", ts // 10**9, ts % 10**9, len(ip) + len(part), len(ip) + len(part)) + ip + part)
    return b"".join(out)


def write(packets: list[tuple[int, str, str, int, int, bytes]], mtu: int = 1500) -> bytes:
    """A capture of (ts_ns, src, dst, src_port, dst_port, payload)."""
    return head() + b"".join(records(k, *p, mtu=mtu) for k, p in enumerate(packets))


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Captures as packets. Files come through Spark's own reader, so any store works; a file is the unit of parallel work."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for t in batches:
            for content in t["content"]:
                rows = []
                for p in packets(content):
                    rows.append(p)
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def reassembled(raw: DataFrame) -> DataFrame:
    """Whole UDP payloads: fragments of one datagram grouped, ordered and joined; incomplete ones are left out."""
    g = raw.groupBy("src", "dst", "ip_id", F.floor(F.col("ts_ns") / 30_000_000_000).alias("epoch")).agg(
        F.min("ts_ns").alias("ts_ns"), F.max("src_port").alias("src_port"), F.max("dst_port").alias("dst_port"), F.array_sort(F.collect_list(F.struct("frag_offset", "more", "payload"))).alias("parts")
    )
    whole = F.aggregate("parts", F.lit(0), lambda at, p: F.when(p["frag_offset"] == at, at + F.octet_length(p["payload"])).otherwise(F.lit(-1)))
    done = g.where((whole > 0) & ~F.element_at("parts", -1)["more"])
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["payload"]))
    return done.select("ts_ns", "src", "dst", "src_port", "dst_port", F.substring(joined, 9, 1 << 30).alias("payload"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Whole UDP payloads of captures."""
    raw = read_pcap(spark, path)
    single = raw.where("frag_offset = 0 and not more").select("ts_ns", "src", "dst", "src_port", "dst_port", F.substring("payload", 9, 1 << 30).alias("payload"))
    return single.unionByName(reassembled(raw.where("frag_offset > 0 or more")))


def capture_frames(spark: SparkSession, path: str, sensors: DataFrame, formats: dict, soft: bool = False) -> tuple[dict[int, DataFrame], DataFrame]:
    """(columns of each sensor's frames, counts of packets left out and why) of captures: packets go to the sensors of their ports, lidar packets become the columns of frames.

    ``sensors``: sensor_idx, port, init_id, sn; ``formats``: the packet format of each sensor.
    """
    from beamframe.operators import packets as streams

    p = streams.matched(read_packets(spark, path).withColumnRenamed("ts_ns", "host_ts"), sensors, formats, soft)
    known = {i: streams.frame_columns(p.where((F.col("sensor_idx") == i) & (F.col("kind") == "lidar")), fmt) for i, fmt in formats.items()}
    return known, streams.problems(p)


def packet_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    """Packets as they arrive as files in a folder: the stand-in for live sensors. ``per_trigger`` files a batch bound what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


class FrameRange(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class SyntheticFrames(DataSource):
    """``spark.read.format("synthetic_frames")``: frames of a default sensor, by options frames, height, width."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_frames"

    def schema(self) -> str:
        return "sensor_idx int, frame_id long, row int, col int, range_mm long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        options = self.options

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [FrameRange(k, k + 1) for k in range(int(options.get("frames", "1")))]

            def read(self, partition: FrameRange) -> Iterator[tuple]:
                h, w = int(options.get("height", "32")), int(options.get("width", "512"))
                for f in range(partition.start, partition.end):
                    for r in range(h):
                        for c in range(w):
                            yield 0, f, r, c, (f * 31 + r * 17 + c * 7) % 50_000

        return Reader()
