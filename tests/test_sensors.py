import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.functions import packets as pk
from beamframe.operators import frames, zones
from beamframe.operators import packets as streams
from beamframe.sources import captures, clouds, metadata, recordings, store

rng = np.random.default_rng(11)
FORMATS = [
    pk.Format("LEGACY", rows=4, columns_per_packet=2, columns_per_frame=8),
    pk.Format("RNG19_RFL8_SIG16_NIR16_DUAL", rows=4, columns_per_packet=2, columns_per_frame=8),
    pk.Format("FUSA_RNG15_RFL8_NIR8_DUAL", rows=4, columns_per_packet=2, columns_per_frame=8, fusa=True),
    pk.Format("RNG19_RFL8_SIG16_ZONE16_DUAL", rows=4, columns_per_packet=2, columns_per_frame=8),
]


def test_crc_check_value():
    assert pk.crc64(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0x995DC9BBDF1939FA


def columns_table(spark, fmt, missing=()):
    rows, fields = [], fmt.pixel[1]
    for f in (3, 4):
        for c in range(fmt.columns_per_frame):
            if (f, c) not in missing:
                px = [[int(x) for x in rng.integers(0, 1 << bits, fmt.rows) << up] for _, bits, up in fields.values()]
                rows.append((0, f, 0 if fmt.legacy else 7, 0 if fmt.legacy else 99, c, 10**12 + f * 1000 + c, 1, *px))
    return spark.createDataFrame(rows, "sensor_idx int, frame_id long, init_id long, prod_sn long, col int, ts_ns long, status long, " + ", ".join(f"{f} array<long>" for f in fields))


@pytest.mark.parametrize("fmt", FORMATS, ids=lambda f: f.profile)
def test_columns_to_packets_and_back(spark, fmt):
    c = columns_table(spark, fmt, missing={(4, 5)})
    sent = pk.encode_columns(c, fmt, ["sensor_idx"]).collect()
    assert all(len(r["payload"]) == fmt.lidar_bytes for r in sent) and len(sent) == 8
    p = spark.createDataFrame([(0, bytearray(r["payload"])) for r in sent] + [(0, bytearray(b"short"))], "sensor_idx int, payload binary")
    names = ["frame_id", "init_id", "col", "ts_ns", "status", *fmt.pixel[1]]
    got = pk.decode_columns(p, fmt, ["sensor_idx"]).where("status = 1").select(names).collect()
    assert sorted(map(str, got)) == sorted(map(str, c.select(names).collect()))
    assert pk.decode_columns(p, fmt).where("status = 0").select("frame_id", "col").collect() == [(4, 5)]
    h = p.where(F.octet_length("payload") > 5).select(*[x.alias(k) for k, x in pk.packet_header(F.col("payload"), fmt).items()])
    assert {(r["frame_id"], r["init_id"], r["prod_sn"]) for r in h.collect()} == {(3, 0, 0), (4, 0, 0)} if fmt.legacy else {(3, 7, 99), (4, 7, 99)}
    if fmt.has_crc:
        checked = pk.with_crc(p.where(F.octet_length("payload") > 5)).withColumn("stored", pk.stored_crc(F.col("payload")))
        assert checked.where("crc = stored").count() == 8


def test_custom_profile(spark, monkeypatch):
    monkeypatch.setattr(pk, "CUSTOM", {})
    pk.add_profile("MINE", 6, {"RANGE": (4, 21, 0), "RANGE2": (25, 20, 1)})
    fmt = pk.Format("MINE", rows=3, columns_per_packet=2, columns_per_frame=4)
    c = columns_table(spark, fmt)
    sent = pk.encode_columns(c, fmt, ["sensor_idx"])
    got = pk.decode_columns(sent.select("sensor_idx", "payload"), fmt).select("frame_id", "col", "RANGE", "RANGE2").collect()
    assert sorted(map(str, got)) == sorted(map(str, c.select("frame_id", "col", "RANGE", "RANGE2").collect())) and pk.returns("MINE") == 2
    with pytest.raises(ValueError):
        pk.add_profile("MINE", 6, {})
    with pytest.raises(ValueError):
        pk.add_profile("OTHER", 2, {"RANGE": (4, 21, 0)})


def test_imu_and_zone_packets(spark):
    fmt = pk.Format("RNG15_RFL8_NIR8", rows=2, columns_per_packet=1, imu_profile="ACCEL32_GYRO32_NMEA", imu_measurements=2)
    body = bytearray(fmt.imu_bytes)
    struct.pack_into("<HH", body, 0, 1, 42)
    struct.pack_into("<Q", body, 32, 777)
    body[40:46] = b"$GPRMC"
    for i in range(2):
        struct.pack_into("<QHH6f", body, 132 + 36 * i, 1000 + i, i, 1, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5 + i)
    got = pk.decode_imu(spark.createDataFrame([(bytes(body),)], "payload binary"), fmt).orderBy("i").collect()
    assert [(r["frame_id"], r["ts_ns"], r["acc"], r["gyro"], r["nmea"], r["nmea_ts"]) for r in got] == [(42, 1000 + i, [1.5, 2.5, 3.5], [4.5, 5.5, 6.5 + i], "$GPRMC", 777) for i in range(2)]
    z = bytearray(fmt.zone_bytes)
    struct.pack_into("<Q", z, 32, 5)
    z[40:72] = bytes(range(32))
    at = 72 + 36 * 2
    z[at : at + 4] = bytes((1, 9, 0, 0x80 | 2 << 2))
    struct.pack_into("<8I", z, at + 4, 3, 40, 5, 6, 100, 1111, 2222, 1666)
    r = pk.decode_zones(spark.createDataFrame([(bytes(z),)], "payload binary"), fmt).where("live = 1").collect()
    assert len(r) == 1 and r[0]["zone_set"] == bytes(range(32)).hex()
    assert [r[0][k] for k in ("slot", "ts_ns", *list(pk.ZONE_FIELDS)[1:])] == [2, 5, 9, 0, 2, 1, 3, 40, 5, 6, 100, 1111, 2222, 1666]


def test_packets_of_shared_ports(spark):
    fmt = pk.Format("RNG15_RFL8_NIR8", rows=2, columns_per_packet=1)
    p = bytearray(fmt.lidar_bytes)
    struct.pack_into("<I", p, 4, 5)
    packets = spark.createDataFrame([(k, 7000, bytes(p)) for k in range(3)] + [(9, 7000, b"x")], "k int, dst_port int, payload binary")
    sensors = spark.createDataFrame([(0, 7000, 4, 0), (1, 7000, 5, 0)], "sensor_idx int, port int, init_id long, sn long")
    got = {r["k"]: (r["sensor_idx"], r["problem"]) for r in streams.matched(packets, sensors, {0: fmt, 1: fmt}).collect()}
    assert got == {0: (1, None), 1: (1, None), 2: (1, None), 9: (None, "PACKET_SIZE")}
    none = sensors.withColumn("init_id", F.col("init_id") + 10)
    assert {r["problem"] for r in streams.matched(packets, none, {0: fmt, 1: fmt}).collect()} == {"ID", "PACKET_SIZE"}
    with pytest.raises(ValueError):
        streams.matched(packets, none, {0: fmt, 1: fmt}, soft=True)
    one = streams.matched(packets, none.where("sensor_idx = 0"), {0: fmt}, soft=True)
    assert {r["k"]: r["sensor_idx"] for r in one.collect()} == {0: 0, 1: 0, 2: 0, 9: None}
    assert {r["problem"]: r["n"] for r in streams.problems(one).collect()} == {"PACKET_SIZE": 1}


def test_index_skips_late_packets_and_wraps(spark):
    ids = [65533, 65533, 65534, 65533, 65535, 0, 65535, 1, 0, 2]
    got = streams.frame_index(spark.createDataFrame([(0, i, f) for i, f in enumerate(ids)], "s int, i int, f int"), "s", "i", "f").orderBy("i").collect()
    assert [r["f"] for r in got] == [65533, 65534, 65535, 0, 1, 2]


DOC = {
    "sensor_info": {"prod_sn": "122", "prod_line": "AB-1-4", "build_rev": "v3.1.0", "initialization_id": 8},
    "beam_intrinsics": {"beam_azimuth_angles": [1.0, -1.0, 1.0, -1.0], "beam_altitude_angles": [3.0, 1.0, -1.0, -3.0], "lidar_origin_to_beam_origin_mm": 12.5},
    "lidar_data_format": {"columns_per_frame": 512, "columns_per_packet": 16, "column_window": [0, 511], "pixel_shift_by_row": [0, 3, 6, 9], "udp_profile_lidar": "RNG15_RFL8_NIR8"},
    "config_params": {"lidar_mode": "512x10", "udp_port_lidar": 7502},
}


def test_metadata(spark):
    sensor, beams, issues = metadata.parse(json.dumps(DOC))
    assert not issues and (sensor["sn"], sensor["h"], sensor["w"], sensor["fps"], sensor["init_id"], sensor["beam_to_lidar"][3]) == (122, 4, 512, 10, 8, 12.5)
    assert beams[1] == (122, 1, -1.0, 1.0, 3) and metadata.expected_of(sensor) == (32, 512)
    flat = {"prod_sn": "5", "prod_line": "x", "build_rev": "v2", "lidar_mode": "1024x10", "beam_azimuth_angles": [0.0], "beam_altitude_angles": [0.0], "data_format": {"columns_per_frame": 1024, "columns_per_packet": 16, "udp_profile_lidar": "LEGACY"}}
    assert metadata.parse(json.dumps(flat))[0]["sn"] == 5 and not metadata.parse(json.dumps(flat))[2]
    bad = json.loads(json.dumps(DOC))
    bad["beam_intrinsics"]["beam_azimuth_angles"] = [1.0]
    bad["lidar_data_format"] |= {"column_window": [0, 512], "udp_profile_lidar": "NO"}
    bad["config_params"]["lidar_mode"] = "7x7"
    critical = {p for p, _, s in metadata.parse(json.dumps(bad))[2] if s == "critical"}
    assert critical == {"config_params.lidar_mode", "beam_intrinsics", "lidar_data_format.pixel_shift_by_row", "lidar_data_format.column_window", "lidar_data_format.udp_profile_lidar"}
    assert metadata.parse("[1]")[2][0][2] == "critical" and metadata.parse("{")[2][0][2] == "critical"
    sensors, b, i = metadata.tables(spark, [json.dumps(DOC), json.dumps(flat)])
    assert sensors.count() == 2 and b.count() == 5 and i.count() == 0
    assert {r["sn"]: (r["packets"], r["returns"]) for r in metadata.expected(sensors).collect()} == {122: (32, 1), 5: (64, 1)}
    default, rows = metadata.default("2048x10")
    assert len(rows) == 64 and rows[0][4] == 36 and default["w"] == 2048
    with pytest.raises(ValueError):
        metadata.default("1x1")
    assert metadata.differences(default, metadata.default("1024x10")[0]) == ["w", "win_end"]


def test_extrinsics_and_resolution():
    pose = metadata.extrinsics_text("1 2 3 0 0 90")
    assert np.allclose(np.array(pose).reshape(4, 4)[:3], [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3]])
    back = metadata.parse_extrinsics(metadata.write_extrinsics([("122", pose)]))
    assert back[0][0] == "122" and np.allclose(back[0][1], pose)
    assert np.allclose(metadata.extrinsics_text("1 2 3 0 0 0 2"), metadata.extrinsics_text("1,2,3,0,0,0")) and metadata.extrinsics_text("identity")[0] == 1
    with pytest.raises(ValueError):
        metadata.extrinsics_text("1 2")
    assert metadata.resolve("/a/run_12.pcap", ["/a/run_1.json", "/a/run_12_x.json", "/a/other.json"]) == "/a/run_12_x.json"
    assert metadata.resolve("/a/run.pcap", ["/a/zzz.json"]) is None


def test_zone_sets(spark, tmp_path):
    box = rng.normal(size=(4, 3, 3)).astype("f4").astype(float)
    near, far = rng.integers(0, 50, (4, 8)) * 100, rng.integers(50, 90, (4, 8)) * 100
    z = zones.ZoneSet({3: zones.Zone(5, 2, "OCCUPANCY", "door", stl=clouds.write_stl(box)), 4: zones.Zone(1, 1, "VACANCY", zrb=zones.write_image(near, far))}, [4, 3], "set")
    (tmp_path / "z.zip").write_bytes(z.archive())
    back = zones.load_zone_set(spark, str(tmp_path / "z.zip"))
    assert back.live == [4, 3] and back.zones[3].label == "door" and back.triangles(spark).count() == 4
    px = zones.images(back, spark).orderBy("row", "col").collect()
    assert [r["far_mm"] for r in px] == far.ravel().tolist() and [r["near_mm"] for r in px] == near.ravel().tolist()
    files = {"metadata.json": z.document().replace('"VACANCY"', '"SOMETHING"').encode(), "3.stl": clouds.write_stl(box), "4.zrb": z.zones[4].zrb}
    assert zones.parse_zone_set(files).issues[0][0] == "zones.4.mode"
    with pytest.raises(ValueError, match="hash"):
        zones.parse_zone_set({"metadata.json": z.document().encode(), "3.stl": b"other", "4.zrb": z.zones[4].zrb})
    for broken in (zones.ZoneSet({}, []), zones.ZoneSet({1: zones.Zone(1, 1, "NONE")}, []), zones.ZoneSet(z.zones, [9])):
        with pytest.raises(ValueError):
            broken.check()


def test_zone_rules(spark):
    """Two zones over four pixels, frame by frame, against the rules by hand."""
    rendered = spark.createDataFrame([(7, 0, c, 1000, 2000) for c in range(4)], "zone_id int, row int, col int, near_mm long, far_mm long")
    zone = spark.createDataFrame([(7, 0, "OCCUPANCY", 2, 2)], "zone_id int, slot int, mode string, point_count int, frame_count int")
    ranges = [[1000, 2000, 0, 500], [1500, 1500, 1000, 999], [0, 0, 0, 0], [1500, 1501, 1, 1], [1500, 1501, 1, 1], [1500, 1501, 1, 1]]
    p = spark.createDataFrame([(f, 0, c, r) for f, row in enumerate(ranges) for c, r in enumerate(row)], "frame_id int, row int, col int, range_mm long")
    s = zones.monitor(p, zone, rendered, "frame_id").orderBy("frame_id", "slot").collect()
    assert len(s) == 96 and all(r["id"] == 255 and not r["live"] for r in s if r["slot"])
    got = [(r["count"], r["occlusion_count"], r["invalid_count"], r["min_range"], r["max_range"], r["mean_range"], r["trigger_status"], r["triggered_frames"]) for r in s if not r["slot"]]
    assert got == [(2, 2, 1, 1000, 2000, 1500, 0, 0), (3, 2, 0, 1000, 1500, 1333, 1, 1), (0, 0, 4, 0, 0, 0, 0, 0), (2, 2, 0, 1500, 1501, 1500, 0, 0), (2, 2, 0, 1500, 1501, 1500, 1, 1), (2, 2, 0, 1500, 1501, 1500, 1, 2)]
    problems = zones.check_rendered(rendered, zone.withColumn("point_count", F.lit(5)))
    assert problems.collect()[0]["problem"] == "fewer pixels than points"


def test_recordings(spark, tmp_path):
    payload = bytes(range(200))
    sent = [("/a", "lidar_driver/PacketMsg", "ros1", 10**18 + k, recordings.packet_message(payload[: 50 + k])) for k in range(5)]
    sent += [("/a/metadata", "std_msgs/String", "ros1", 10**18, struct.pack("<I", 3) + b"{ }")]
    (tmp_path / "a.mcap").write_bytes(recordings.write_mcap(sent))
    (tmp_path / "b.mcap").write_bytes(recordings.write_mcap([(t, k, "cdr", n, recordings.packet_message(payload[:7], "cdr")) for t, k, _, n, _ in sent[:1]], compress=False))
    (tmp_path / "c.bag").write_bytes(recordings.write_bag(sent, compress=True))
    for name, want in (("a.mcap", 5), ("c.bag", 5), ("b.mcap", 1)):
        m = recordings.read_messages(spark, str(tmp_path / name))
        p = recordings.message_packets(m).orderBy("host_ts").collect()
        assert [bytes(r["payload"]) for r in p] == ([payload[: 50 + k] for k in range(5)] if want == 5 else [payload[:7]])
    assert recordings.message_metadata(recordings.read_messages(spark, str(tmp_path / "a.mcap"))).first()["document"] == "{ }"
    both = clouds.open_packet_source(spark, [str(tmp_path / "a.mcap"), str(tmp_path / "b.mcap")])
    assert both.count() == 6
    with pytest.raises(ValueError):
        recordings.read_messages(spark, str(tmp_path)).count() and list(recordings.bag_messages(b"no"))


def test_captures_in_blocks_and_as_a_sink(spark, tmp_path):
    sent = [(1_700_000_000_000_000_000 + k, "10.0.0.1", "10.0.0.2", 7000, 7502, bytes([k]) * (100 + 900 * k)) for k in range(4)]
    classic = captures.write(sent)
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body) + -len(body) % 4) + body + b"\0" * (-len(body) % 4) + struct.pack("<I", 12 + len(body) + -len(body) % 4)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHBxxx", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for ns, _, frame in captures._classic(classic):
        out += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    assert list(captures.packets(out)) == list(captures.packets(classic))
    (tmp_path / "n.pcapng").write_bytes(out)
    got = clouds.open_source(spark, str(tmp_path / "n.pcapng")).collect()
    assert sorted((r["ts_ns"], bytes(r["payload"])) for r in got) == [(t, p) for t, *_, p in sent]
    spark.dataSource.register(store.Captures)
    df = spark.createDataFrame([(*r, k // 2) for k, r in enumerate(sent)], "ts_ns long, src string, dst string, src_port int, dst_port int, payload binary, chunk int")
    store.rolled_captures(df, "chunk").write.format("capture").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.pcap"))) == 2
    again = captures.read_packets(spark, str(tmp_path / "out"))
    assert sorted((r["ts_ns"], bytes(r["payload"])) for r in again.collect()) == [(t, p) for t, *_, p in sent]


def test_frames_of_a_capture(spark, tmp_path):
    fmt = FORMATS[1]
    c = columns_table(spark, fmt)
    sent = sorted(pk.encode_columns(c, fmt, ["sensor_idx"]).collect(), key=lambda r: r["first_ts"])
    body = [(10**18 + k, "10.0.0.1", "10.0.0.2", 7000, 7502, bytes(r["payload"])) for k, r in enumerate(sent)]
    body += [(10**18 + 99, "10.0.0.1", "10.0.0.2", 7000, 7502, b"wrong"), (10**18 + 100, "10.0.0.1", "10.0.0.2", 7000, 9999, b"other")]
    (tmp_path / "c.pcap").write_bytes(captures.write(body))
    sensors = spark.createDataFrame([(0, 7502, 7, 99)], "sensor_idx int, port int, init_id long, sn long")
    frames_, left_out = captures.capture_frames(spark, str(tmp_path / "c.pcap"), sensors, {0: fmt})
    names = ["frame_id", "col", "ts_ns", *fmt.pixel[1]]
    assert sorted(map(str, frames_[0].select(names).collect())) == sorted(map(str, c.select(names).collect()))
    assert {r["problem"]: r["n"] for r in left_out.collect()} == {"PACKET_SIZE": 1, "UNMATCHED": 1}


def test_coloured_clouds(spark, tmp_path):
    p = rng.normal(size=(50, 3)) * 10
    rgb = rng.integers(0, 256, (50, 3))
    (tmp_path / "a.las").write_bytes(clouds.write_las(p, rng.integers(0, 99, 50), rgb))
    (tmp_path / "b.las").write_bytes(clouds.write_las(p))
    got = clouds.read_coloured(spark, str(tmp_path / "a.las")).toPandas()
    assert np.allclose(got[["x", "y", "z"]], p, atol=0.001) and (got[["red", "green", "blue"]].to_numpy() == rgb).all()
    assert clouds.read_coloured(spark, str(tmp_path / "b.las")).where("red is null").count() == 50
    ascii_ply = "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 6\n"
    assert clouds.parse_attributes(ascii_ply.encode())["blue"][0] == 6
    pcd = b"FIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nPOINTS 1\nDATA binary\n" + struct.pack("<3fI", 1, 2, 3, 0x0A0B0C)
    assert [int(clouds.parse_attributes(pcd)[c][0]) for c in ("red", "green", "blue")] == [10, 11, 12]


def test_sources_by_name(spark, tmp_path):
    assert clouds.io_type("a/b.pcapng") == "capture" and clouds.io_type("https://x/y") == "url" and clouds.io_type("s3a://b/c.ply") == "cloud" and clouds.io_type("/some/folder") == "frames"
    for bad in ("x.laz", "x.unknown"):
        with pytest.raises(ValueError):
            clouds.io_type(bad)
    with pytest.raises(ValueError):
        clouds.open_source(spark, ["a.pcap", "b.ply"])
    spark.range(10).selectExpr("cast(id % 2 as int) sensor_idx", "id ts_ns", "id v").write.parquet(str(tmp_path / "f.parquet"))
    plan = clouds.open_source(spark, str(tmp_path / "f.parquet"), ["v"], sensor_idx=1)
    assert sorted(r["v"] for r in plan.collect()) == [1, 3, 5, 7, 9]
    clouds.add_reader("mine", lambda s, u: s.range(3), (".mine",))
    try:
        assert clouds.open_source(spark, "x.mine").count() == 3
        with pytest.raises(ValueError):
            clouds.add_reader("mine", None)
    finally:
        del clouds.READERS["mine"], clouds.KINDS[".mine"]
    (tmp_path / "m.json").write_text(json.dumps(DOC))
    assert clouds.open_source(spark, str(tmp_path / "m.json")).first()["sn"] == 122


def test_images_and_store(spark, tmp_path):
    for kind in ("u1", "u2", "u4", "u8"):
        x = rng.integers(0, 1 << 8 * int(kind[1]) - (kind == "u8"), (7, 9), dtype=np.uint64 if kind == "u8" else np.int64).astype(kind)
        assert (store.decode_png(store.encode_png(x)) == x).all()
    rgb = rng.integers(0, 256, (5, 6, 3)).astype("u1")
    assert (store.decode_png(store.encode_png(rgb)) == rgb).all()
    broken = bytearray(store.encode_png(rgb))
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        store.decode_png(bytes(broken))
    path = str(tmp_path / "store")
    f = spark.range(100).selectExpr("cast(id % 2 as int) sensor_idx", "id div 10 frame_id", "id col", "id * 1000000000 ts_ns", "1 status")
    with store.BackgroundWriter(queue=2) as w:
        jobs = [w.write(f.where(f"frame_id = {k}"), path) for k in range(4)]
    assert all(j.done() and j.exception() is None for j in jobs) and spark.read.parquet(path).count() == 40
    assert store.metadata(spark, path) is None
    assert [store.write_metadata(spark, path, d) for d in ("one", "two")] == [1, 2]
    assert store.metadata(spark, path) == "two" and store.metadata(spark, path, 1) == "one"
    assert json.loads(store.store_dump(f).where("sensor_idx = 1").first()["document"])["frames"] == 10
    store.save_model(spark.range(100).selectExpr("id / 10.0 x", "0.0 y", "0.0 z").selectExpr("cast(x as double) x", "cast(y as double) y", "cast(z as double) z"), 1.0, 3, str(tmp_path / "model"))
    assert spark.read.text(str(tmp_path / "model")).count() == 10


def test_arrays(spark):
    df = spark.createDataFrame([(list(range(24)),)], "a array<int>")
    x = np.arange(24).reshape(2, 3, 4)
    for index in ([1], [None, 2], [None, (1, 3), 0], [0, 1, (1, 3)]):
        want = x[tuple(slice(None) if i is None else slice(*i) if isinstance(i, tuple) else i for i in index)].ravel().tolist()
        assert df.select(frames.subview(F.col("a"), [2, 3, 4], index).alias("v")).first()["v"] == want
    with pytest.raises(ValueError):
        frames.subview(F.col("a"), [2, 3, 4], [2])
    assert frames.reshape(24, [4, -1]) == [4, 6]
    with pytest.raises(ValueError):
        frames.reshape(24, [5, -1])
    px = spark.createDataFrame([(1, 0, 1, 5.0), (1, 1, 2, None), (2, 1, 0, 7.0)], "f int, row int, col int, v double")
    dense = dict(frames.to_numpy(px, ["f"], "row", "col", ["v"], 2, 3))
    assert dense[(1,)]["v"].tolist() == [[0, 5, 0], [0, 0, 0]] and dense[(2,)]["v"][1, 0] == 7


def test_tee_reads_a_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(50).mapInArrow(count, "id long")
    assert frames.tee(df, str(tmp_path / "t"), [lambda d: d.count(), lambda d: d.agg(F.max("id")).first()[0]]) == [50, 49]
    assert seen.value == 50
