"""Streams of packets: which sensor sent them, where frames begin, and frames assembled of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import packets as pk
from beamframe.operators.windows import wrapped_difference


def matched(packets: DataFrame, sensors: DataFrame, formats: dict[int, pk.Format], soft: bool = False) -> DataFrame:
    """Each packet with ``sensor_idx``, ``kind`` (lidar, imu, zone) and ``problem`` (null, UNMATCHED, ID or PACKET_SIZE).

    ``packets``: dst_port, payload. ``sensors``: sensor_idx, port (one row a port), init_id, sn.
    A packet goes to the first sensor of its port that accepts it. None does: a wrong id counts
    before a wrong size; with ``soft`` a packet of the wrong id goes to the sensor all the same,
    which is an error if several sensors of the port take it so. Ports are few: a rig's sensors.
    """
    ports = sensors.select("sensor_idx", F.col("port").alias("dst_port"), F.col("init_id").alias("_init"), F.col("sn").alias("_sn"))
    tried = None
    for idx, fmt in formats.items():
        p = packets.join(F.broadcast(ports.where(F.col("sensor_idx") == idx)), "dst_port")  # the ports of one sensor
        kind = pk.guessed_type(F.col("payload"), fmt)
        p = p.select(*packets.columns, F.lit(idx).alias("sensor_idx"), kind.alias("kind"), pk.validation(F.col("payload"), kind, fmt, F.col("_init"), F.col("_sn")).alias("_found"))
        tried = p if tried is None else tried.unionByName(p)
    if tried is None:
        return packets.select("*", F.lit(None).cast("int").alias("sensor_idx"), F.lit(None).cast("string").alias("kind"), F.lit("UNMATCHED").alias("problem"))
    shared = sensors.groupBy("port").agg(F.countDistinct("sensor_idx").alias("n")).where("n > 1").limit(1).count() > 0
    known = packets.join(F.broadcast(ports.select("dst_port").distinct()), "dst_port", "left_anti")
    if shared:
        # a packet tried by several sensors keeps its best verdict, then the first sensor's
        rank = F.when(F.col("_found") == "NONE", 0).when(F.col("_found") == "ID", 1).otherwise(2)
        if soft and tried.where("_found = 'ID'").groupBy(*packets.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError("soft matching doesn't work with several sensors at a port")
        best = Window.partitionBy(*packets.columns).orderBy(rank, "sensor_idx")
        tried = tried.withColumn("_i", F.row_number().over(best)).where(F.col("_i") == 1).drop("_i")
    accepted = F.col("_found").isin("NONE", "ID") if soft else F.col("_found") == "NONE"
    out = tried.select(*packets.columns, F.when(accepted, F.col("sensor_idx")).alias("sensor_idx"), "kind", F.when(~accepted, F.col("_found")).alias("problem"))
    return out.unionByName(known.select(*packets.columns, F.lit(None).cast("int").alias("sensor_idx"), F.lit(None).cast("string").alias("kind"), F.lit("UNMATCHED").alias("problem")))


def problems(matched_packets: DataFrame) -> DataFrame:
    """(problem, n): how many packets were left out, and why."""
    return matched_packets.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def frame_index(packets: DataFrame, key: str, order: str, frame: str, largest: int = 65535) -> DataFrame:
    """(key, order, frame): where each frame begins. Only ids that lie ahead of all begun before count, so late packets don't begin one.

    Ids are unwrapped by the signed steps from packet to packet; a frame begins where the
    unwrapped id exceeds its maximum so far. That holds while a step is less than half the range.
    """
    w = Window.partitionBy(key).orderBy(order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = packets.withColumn("_step", F.coalesce(wrapped_difference(F.lag(frame).over(w), F.col(frame), largest), F.lit(0)))
    placed = stepped.withColumn("_at", F.sum("_step").over(up_to))
    before = F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_most", before).where(F.col("_most").isNull() | (F.col("_at") > F.col("_most"))).select(key, order, frame)


def frame_columns(packets: DataFrame, fmt: pk.Format, sensor: str = "sensor_idx", order: str = "host_ts") -> DataFrame:
    """Lidar packets as the columns of frames: of a column that came twice the later packet counts."""
    c = pk.decode_columns(packets, fmt, [sensor, order])
    last = [x for x in c.columns if x not in (sensor, "init_id", "frame_id", "col")]
    return c.groupBy(sensor, "init_id", "frame_id", "col").agg(F.max_by(F.struct(*last), F.col(order)).alias("_c")).select(sensor, "init_id", "frame_id", "col", "_c.*")


def frame_headers(packets: DataFrame, fmt: pk.Format, sensor: str = "sensor_idx", order: str = "host_ts") -> DataFrame:
    """(sensor, init_id, frame_id, packets, first_ts, last_ts, alert_flags, frame_status ...) of lidar packets, without touching pixels."""
    h = pk.packet_header(F.col("payload"), fmt)
    p = packets.where(F.octet_length("payload") == fmt.lidar_bytes).select(sensor, order, *[c.alias(n) for n, c in h.items()])
    last = F.struct(order, "countdown_thermal_shutdown", "countdown_shot_limiting", pk.frame_status(F.col("thermal_shutdown"), F.col("shot_limiting")).alias("frame_status"))
    g = p.groupBy(sensor, "init_id", "frame_id").agg(F.count(F.lit(1)).alias("packets"), F.min(order).alias("first_ts"), F.max(order).alias("last_ts"), F.bit_or("alert_flags").alias("alert_flags"), F.max(last).alias("_l"))
    return g.select(sensor, "init_id", "frame_id", "packets", "first_ts", "last_ts", "alert_flags", *[F.col(f"_l.{c}").alias(c) for c in ("countdown_thermal_shutdown", "countdown_shot_limiting", "frame_status")])


def frame_points(columns: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Columns of frames as one row per pixel of their valid columns."""
    valid = columns.where(F.col("status").bitwiseAND(1) == 1)
    return valid.select(*keys, "col", "ts_ns", F.posexplode(F.arrays_zip(*fields)).alias("row", "_px")).select(*keys, "row", "col", "ts_ns", "_px.*")


def ordered_packets(*streams: DataFrame, ts: str = "first_ts") -> DataFrame:
    """Packets of several kinds of a frame in one stream by time, their kinds' numbers breaking ties."""
    out = None
    for i, s in enumerate(streams):
        one = s.select(F.col(ts).alias("ts"), F.lit(i).alias("stream"), "payload")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("ts", "stream")

