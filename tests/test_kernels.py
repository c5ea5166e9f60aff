import numpy as np
import pytest

from beamframe.functions import rigid, scalar
from beamframe.operators import images, registration
from beamframe.operators.filters import axis_bounds
from beamframe.operators.selection import numbered, slice_frames
from beamframe.sources import captures, clouds
from beamframe.streaming.batcher import Batcher, difference
from beamframe.streaming.collator import Collator

rng = np.random.default_rng(1)


def test_exp_log_round_trip():
    x = rng.uniform(-1, 1, (50, 6))
    assert np.allclose(rigid.pose_log(rigid.pose_exp(x)), x, atol=1e-8)
    p = rigid.pose_exp(x)
    assert np.allclose(rigid.inverse(p) @ p, np.eye(4), atol=1e-9)
    assert np.allclose(rigid.from_quaternion(rigid.quaternion(p[:, :3, :3])), p[:, :3, :3])


def test_interpolation_ends_and_beyond():
    a, b = rigid.pose_exp(rng.normal(size=(2, 6)))
    assert np.allclose(rigid.interpolate(a, b, np.array(0.0)), a)
    assert np.allclose(rigid.interpolate(a, b, np.array(1.0)), b)
    step = rigid.pose_exp(np.array([0, 0, 0, 1.0, 0, 0]))
    track = np.stack([np.eye(4), step, step @ step])
    assert np.allclose(rigid.interpolate_track(np.array([3.0, -1.0]), np.array([0.0, 1.0, 2.0]), track)[:, 0, 3], [3, -1])
    with pytest.raises(ValueError):
        rigid.interpolate_track(np.array([0.0]), np.array([1.0, 1.0]), track[:2])


def test_euler_and_gravity():
    e = rng.uniform(-1, 1, (20, 3))
    assert np.allclose(rigid.to_euler(rigid.from_euler(e)), e)
    v = rng.normal(size=3)
    assert np.allclose(rigid.gravity_rotation(v) @ v / np.linalg.norm(v), [0, 0, 1])


def test_wrapping_counter():
    assert [difference(65535, 0, 65535), difference(0, 65535, 65535), difference(5, 9, 65535)] == [1, -1, 4]


def feed(packets, expected=2):
    b, out = Batcher(expected), []
    for p in packets:
        out += b.put(*p)
    return out, list(b.finish())


def test_batcher_rules():
    frames, rest = feed([(1, 65535, 0, 10), (1, 65535, 1, 11), (1, 65535, 1, 12), (1, 0, 0, 13), (1, 0, 1, 14)])
    assert [(f["frame_id"], f["complete"]) for f in frames] == [(65535, True), (0, True)] and frames[1]["dropped"] == 1 and not rest
    frames, rest = feed([(1, 1, 0, 1), (1, 2, 0, 2), (1, 2, 1, 3), (1, 1, 1, 4)])
    assert [f["frame_id"] for f in frames] == [1, 2] and all(f["complete"] for f in frames)
    frames, _ = feed([(1, 1, 0, 1), (1, 2, 0, 2), (1, 3, 0, 3), (1, 4, 0, 4), (1, 5, 0, 5)])
    assert frames[0]["frame_id"] == 1 and not frames[0]["complete"]
    frames, rest = feed([(1, 7, 0, 1), (2, 3, 0, 2)])
    assert [f["frame_id"] for f in frames + rest] == [7, 3]
    frames, _ = feed([(1, 1, 0, 0), (1, 1, 1, 5)])
    assert not frames


def test_collator_rules():
    def run(frames, **k):
        c, out = Collator(2, 100, **k), []
        for f in frames:
            out += c.put(*f)
        return out + list(c.finish())

    assert run([(0, 1, 0), (1, 1, 50), (0, 2, 100), (0, 3, 150), (1, 2, 260)]) == [{0: 1, 1: 1}, {0: 2}, {0: 3}, {1: 2}]
    assert run([(0, 1, 0), (1, 1, 99)]) == [{0: 1, 1: 1}]
    assert run([(0, 1, 0), (1, 1, 80), (0, 2, 100)], latency={0: 0, 1: 20}) == [{0: 1}, {1: 1, 0: 2}]


@pytest.mark.parametrize("cut", [(None, None, 1), (2, 9, 3), (-5, None, 2), (None, -3, 1), (-100, 100, 4)])
def test_slice_is_pythons(spark, cut):
    df = numbered(spark.range(23).withColumnRenamed("id", "v"), ["v"])
    assert sorted(r["v"] for r in slice_frames(df, *cut).collect()) == list(range(23))[slice(*cut)]


def test_slice_errors_and_bounds():
    with pytest.raises(ValueError):
        slice_frames(None, 0, 1, 0)
    assert axis_bounds(0.25, 1.0, 64) == (16, 64) and axis_bounds(float("-inf"), 3, 64) == (0, 3)
    with pytest.raises(ValueError):
        axis_bounds(0, 65, 64)


def test_plane_normals_face_the_sensor():
    y, x = np.mgrid[-4:4:16j, -4:4:16j]
    n = images.surface_normals(np.dstack([x, y, np.full_like(x, 5.0)]))
    assert np.allclose(n[1:-1, 1:-1], [0, 0, -1], atol=1e-6)


def test_ground_is_the_floor():
    floor = np.column_stack([rng.uniform(0, 10, (500, 2)), rng.normal(0, 0.02, 500)])
    box = np.column_stack([rng.uniform(4, 5, (80, 2)), rng.uniform(1, 2, 80)])
    g = images.ground_mask(np.concatenate([floor, box]), 1.0)
    assert g[:500].mean() > 0.95 and g[500:].sum() == 0


def test_clusters_and_equalisation():
    p = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(10, 0.1, (30, 3))])
    assert len(set(images.cluster_labels(p, 1.0))) == 2
    out = images.clahe(rng.random((32, 64)))
    assert out.shape == (32, 64) and 0 <= out.min() and out.max() <= 1.0001


def test_align_against_brute_force(spark):
    own = np.random.default_rng(7)
    q = own.uniform(-3, 3, (150, 3))
    p = (q - [0.1, -0.05, 0.08]) @ rigid.pose_exp(np.array([0.01, -0.02, 0.03, 0, 0, 0]))[:3, :3]
    frame = lambda x: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, x double, y double, z double")
    want = np.eye(4)
    for _ in range(30):
        moved = p @ want[:3, :3].T + want[:3, 3]
        d2 = ((moved[:, None] - q[None]) ** 2).sum(axis=2)
        near = d2.argmin(axis=1)
        h, b = np.zeros((6, 6)), np.zeros(6)
        for k in np.flatnonzero(d2.min(axis=1) < 1):
            x, y, z = moved[k]
            j = np.array([[1, 0, 0, 0, z, -y], [0, 1, 0, -z, 0, x], [0, 0, 1, y, -x, 0]])
            r = moved[k] - q[near[k]]
            w = (0.5 / (0.5 + r @ r)) ** 2
            h, b = h + w * j.T @ j, b + w * j.T @ r
        step = np.linalg.lstsq(h, -b, rcond=None)[0]
        want = rigid.pose_exp(np.concatenate([step[3:], step[:3]])) @ want
        if step @ step < 1e-8:
            break
    assert np.allclose(registration.align(frame(p), frame(q), 1.0, 0.5), want, atol=1e-6)


def test_icp_query_takes_the_whole_cloud(spark, monkeypatch):
    from beamframe import catalogue

    seen = []
    monkeypatch.setattr(registration, "align", lambda source, target, *a, **k: seen.append((source.count(), target.count(), target.select("id").distinct().count(), len(a), k)) or np.eye(4))
    catalogue.queries()["q_icp"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert seen == [(n, n, n, 2, {})]


def test_graph_closes_a_loop():
    quarter = [0.0, 0.0, np.pi / 2, 0.0, 0.0, 0.0]
    ahead = rigid.pose_log(rigid.pose_exp(np.array([0, 0, 0, 1.0, 0, 0])) @ rigid.pose_exp(np.array(quarter)))
    edges = [(i, i + 1, list(ahead)) for i in range(3)] + [(3, 0, list(ahead))]
    p = registration.solve_graph(4, edges)
    assert np.allclose(p[2][:2, 3], [1, 1], atol=1e-4)


def test_capture_round_trip(spark, tmp_path):
    sent = [(1_700_000_000_000_000_000 + k, "10.0.0.1", "10.0.0.2", 7000 + k % 2, 7502, bytes([k]) * (100 + 900 * k)) for k in range(6)]
    (tmp_path / "a.pcap").write_bytes(captures.write(sent))
    got = captures.reassembled(captures.read_pcap(spark, str(tmp_path / "a.pcap"))).collect()
    assert sorted((r["ts_ns"], r["src_port"], bytes(r["payload"])) for r in got) == [(t, s, p) for t, _, _, s, _, p in sent]


def test_cloud_files(spark, tmp_path):
    p = rng.normal(size=(100, 3)).astype("f4").astype(float)
    assert np.allclose(clouds.parse_ply(clouds.write_ply(p)), p)
    assert np.allclose(clouds.parse_pcd(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n"), [[1, 2, 3], [4, 5, 6]])
    t = rng.normal(size=(5, 3, 3)).astype("f4").astype(float)
    assert np.allclose(clouds.parse_stl(clouds.write_stl(t)), t)
    (tmp_path / "c.ply").write_bytes(clouds.write_ply(p))
    assert clouds.read_cloud(spark, str(tmp_path / "c.ply")).count() == 100
    (tmp_path / "k.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n")
    assert clouds.read_kitti(spark, str(tmp_path / "k.txt")).first()["pose"][3] == 5.0


def test_parsers():
    assert scalar.parse_length("5cm") == pytest.approx(0.05) and scalar.parse_length("-3") == -3
    assert scalar.parse_slice("10:20:2") == ([10, 20, 2], False) and scalar.parse_slice("1:2s") == ([1.0, 2.0], True)
    assert scalar.packets_per_frame(1024, 16, 0, 1023) == (64, 1024)
