import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.functions import rigid
from beamframe.operators import joins, mapping, trajectory

rng = np.random.default_rng(12)


def random_poses(n, scale=1.0):
    return rigid.pose_exp(rng.normal(size=(n, 6)) * scale)


def poses_table(spark, ts, poses, key=0):
    return spark.createDataFrame([(key, int(t), p.ravel().tolist()) for t, p in zip(ts, poses, strict=True)], "k int, ts long, pose array<double>")


@pytest.mark.parametrize("span", [None, 7, 100])
def test_pose_at_against_numpy(spark, span):
    knots = np.cumsum(rng.integers(1, 20, 30))
    poses = random_poses(30, 0.4)
    ask = np.concatenate([rng.integers(-30, knots[-1] + 30, 60), knots[:3], knots[-2:]])
    events = spark.createDataFrame([(0, int(t), i) for i, t in enumerate(ask)], "k int, ts long, i int")
    got = trajectory.pose_at(events, poses_table(spark, knots, poses), "k", "ts", "pose", span).orderBy("i").collect()
    want = rigid.interpolate_track(ask.astype(float), knots.astype(float), poses)
    assert np.allclose([r["pose"] for r in got], want.reshape(-1, 16), atol=1e-9)
    bounded = trajectory.pose_at(events, poses_table(spark, knots, poses), "k", "ts", "pose", span, bounds=0.5).orderBy("i").collect()
    low, high = knots[0] - 0.5 * (knots[1] - knots[0]), knots[-1] + 0.5 * (knots[-1] - knots[-2])
    assert [r["pose"] is None for r in bounded] == [not low <= t <= high for t in ask]


def test_asof_of_one_long_key(spark):
    """Tens of thousands of knots and events on one key, cut in buckets or not, give the same in linear time."""
    n = 60_000
    knots = spark.range(n).selectExpr("0 k", "id * 10 ts", "id v")
    events = spark.range(n).selectExpr("0 k", "id * 10 + id % 10 ts", "id e")
    for span in (None, 5000):
        wrong = joins.asof_bracket(events, knots, "k", "ts", "v", span).where(f"v0 != e or (ts % 10 > 0 and v1 != e + 1 and e < {n - 1}) or (ts % 10 = 0 and v1 != e)")
        assert wrong.count() == 0


def test_track_update_against_numpy(spark):
    ts, poses = np.arange(0, 40) * 5, random_poses(40, 0.3)
    nodes = {0: random_poses(1)[0], 50: random_poses(1)[0], 55: random_poses(1)[0], 195: random_poses(1)[0]}
    given = [*nodes.items(), (77, np.eye(4))]  # no pose at 77
    got = trajectory.updated_track(poses_table(spark, ts, poses), poses_table(spark, [t for t, _ in given], [p for _, p in given]), "k", "ts", "pose").orderBy("ts").collect()
    want, at = poses.copy(), sorted(nodes)
    for a, z in zip(at[:-1], at[1:], strict=True):
        i, j = a // 5, z // 5 + (z == 195)
        if j - i > 1:
            want[i:j] = trajectory.deform(ts[i:j].astype(float), poses[i:j], nodes[a], nodes[z])
    assert np.allclose([r["pose"] for r in got], want.reshape(-1, 16), atol=1e-8)
    bent = trajectory.deform(ts.astype(float), poses, nodes[0], nodes[50])
    assert np.allclose(bent[0], nodes[0]) and np.allclose(bent[-1], nodes[50])
    with pytest.raises(ValueError):
        trajectory.deform(ts[:1], poses[:1], nodes[0], nodes[50])


def test_conversions():
    p = random_poses(50)
    assert np.allclose(rigid.from_position_quaternion(rigid.to_position_quaternion(p)), p)
    x = np.array([1.0, 2, 3, 0.1, -0.2, 0.3])
    assert np.allclose(rigid.to_euler(rigid.from_position_euler(x)[:3, :3]), x[3:])
    for a in rng.normal(size=(20, 3)):
        for fix in (False, True):
            r = rigid.gravity_rotation(a, fix)
            assert np.allclose(r @ a, [0, 0, np.linalg.norm(a)]) and np.isclose(np.linalg.det(r), 1)
        assert abs(np.arctan2(r[1, 0], r[0, 0])) < 1e-12


def test_nearest_in_a_local_map():
    m = mapping.LocalMap(1.0, 100.0)
    m.points = rng.uniform(-5, 5, (400, 3))
    m._index()
    q = rng.uniform(-6, 6, (200, 3))
    near, d2 = m.nearest(q, 1.0)
    d = ((q[:, None] - m.points[None]) ** 2).sum(axis=2)
    for i in range(len(q)):
        best = d[i].min()
        assert (near[i] < 0) == (best >= 1.0)
        assert near[i] < 0 or np.isclose(d[i, near[i]], best) and np.isclose(d2[i], best)
    grown = mapping.LocalMap(1.0, 3.0, most=4)
    grown.add(m.points)
    keys, n = np.unique(grown.keys, return_counts=True)
    assert n.max() <= 4 and set(keys) == set(m.keys)
    grown.cull(np.zeros(3))
    assert (np.linalg.norm(grown.points, axis=1) <= 3).all() and len(grown.points)


def room(n=3000):
    """Points on the walls and the floor of a room with a pillar."""
    a = rng.uniform([-10, -6, 0], [10, 6, 3], (n, 3))
    face = rng.integers(0, 6, n)
    for k, (axis, v) in enumerate([(0, -10), (0, 10), (1, -6), (1, 6), (2, 0)]):
        a[face == k, axis] = v
    turn = rng.uniform(0, 2 * np.pi, n)
    pillar = np.column_stack([3 + np.cos(turn), -2 + np.sin(turn), a[:, 2]])
    return np.where((face == 5)[:, None], pillar, a)


def test_odometry_finds_the_motion(spark):
    world = room()
    step = rigid.pose_exp(np.array([0, 0, 0.02, 0.15, 0.05, 0.0]))
    truth, rows = [np.eye(4)], []
    for _ in range(5):
        truth.append(truth[-1] @ step)
    for f, p in enumerate(truth):
        own = (world - p[:3, 3]) @ p[:3, :3]
        rows += [(s, f, *map(float, x)) for s in (0, 1) for x in own]
    points = spark.createDataFrame(rows, "s int, f int, x double, y double, z double")
    got = {(r["s"], r["f"]): np.array(r["pose"]).reshape(4, 4) for r in mapping.slam(points, "s", "f", size=0.5).collect()}
    assert len(got) == 12
    for (_, f), pose in got.items():
        assert np.allclose(pose, truth[f], atol=0.03)
    known = mapping.fixed_map(spark.createDataFrame(world.tolist(), "x double, y double, z double"), 0.2)
    found = mapping.slam(points.where("s = 0"), "s", "f", size=0.5, fixed=known)
    assert all(np.allclose(np.array(r["pose"]).reshape(4, 4), truth[r["f"]], atol=0.05) for r in found.collect())
    with pytest.raises(ValueError):
        mapping.fixed_map(points.select("x", "y", "z"), 0.2, most=10)


def test_too_few_columns_keep_the_prediction():
    s = mapping.Slam(0.5)
    for k in range(3):
        s.put(room() + [0.1 * k, 0, 0], columns=1.0)
    guess = s.predict()
    assert np.allclose(s.put(room() + 5, columns=0.3), guess)


def test_align_without_a_guess():
    target = room(6000)
    for angle, shift in ((0.0, (1.0, 0.5)), (2.0, (-3.0, 2.0)), (np.pi, (4.0, -1.0))):
        pose = rigid.pose_exp(np.array([0, 0, angle, 0, 0, 0]))
        pose[:2, 3] = shift
        source = (room(6000) - pose[:3, 3]) @ pose[:3, :3]
        got, sure = mapping.align_pair(source, target)
        # a room is the same after half a turn but for its pillar
        assert np.allclose(got[:3, 3], pose[:3, 3], atol=0.15) and np.allclose(got[:3, :3], pose[:3, :3], atol=0.03) and sure > 0.5


def test_rig_extrinsics(spark):
    from beamframe.sources import metadata

    world = room(4000)
    pose = rigid.pose_exp(np.array([0, 0, 0.5, 0, 0, 0]))
    pose[:2, 3] = 1.0, -0.5
    rows = [(7, *map(float, x)) for x in world] + [(9, *map(float, x)) for x in (room(4000) - pose[:3, 3]) @ pose[:3, :3]]
    document = mapping.rig_extrinsics(spark.createDataFrame(rows, "sn int, x double, y double, z double"), "sn", 7)
    got = dict(metadata.parse_extrinsics(document))
    assert np.allclose(np.array(got["9"]).reshape(4, 4), pose, atol=0.15) and np.allclose(got["7"], np.eye(4).ravel())


def test_imu_motion(spark):
    """A body that turns at a steady rate and falls freely, and one at rest."""
    rows = []
    for i in range(101):
        rows += [("turn", i * 10_000_000, [0.0, 0.0, 0.0], [0.0, 0.0, 0.5], [1.0, 0.0, 0.0]), ("rest", i * 10_000_000, [0.0, 0.0, 9.80665], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])]
    m = mapping.imu_motion(spark.createDataFrame(rows, "f string, ts_ns long, acc array<double>, gyro array<double>, v0 array<double>"), ["f"])
    last = {r["f"]: r for r in m.where("ts_ns = 1000000000").collect()}
    p = np.array(last["turn"]["pose"]).reshape(4, 4)
    assert np.isclose(np.arctan2(p[1, 0], p[0, 0]), 0.5) and np.allclose(p[:3, 3], [1, 0, -9.80665 / 2], atol=1e-6)
    assert np.allclose(last["rest"]["pose"], np.eye(4).ravel()) and np.allclose(last["rest"]["velocity"], 0)


def test_gps_constraints_by_hand(spark):
    rows = [(0, i, 48.0 + 1e-5 * i if i != 3 else None, 11.0, i * 10, 4.0 * i if i != 5 else None, 0.0, 2.0) for i in range(12)]
    f = spark.createDataFrame(rows, "k int, i int, lat double, lon double, fix_ts long, px double, py double, pz double")
    got = mapping.gps_constraints(f, "k", "i", 10.0).orderBy("ts_ns").collect()
    assert [r["ts_ns"] for r in got] == [10, 40, 70, 100]
    assert np.isclose(got[0]["y"], 0) and np.isclose(got[1]["y"], 3 * 1.112, atol=0.01) and all(r["weighs_z"] and r["z"] == 2.0 for r in got)


def test_graphs():
    truth = random_poses(30, 0.5)
    c = [mapping.Constraint("POSE_TO_POSE", i, j, rigid.inverse(truth[i]) @ truth[j]) for i, j in [*[(k, k + 1) for k in range(29)], (29, 0), (5, 20)]]
    c.append(mapping.Constraint("ABSOLUTE_POSE", 3, pose=truth[3]))
    p = rng.normal(size=(4, 3))
    move = lambda k, x: truth[k][:3, :3] @ x + truth[k][:3, 3]
    c.append(mapping.Constraint("ABSOLUTE_POINT", 9, point_a=p[0], point_b=move(9, p[0])))
    c.append(mapping.Constraint("POINT_TO_POINT", 11, 12, point_a=p[1], point_b=(move(11, p[1]) - truth[12][:3, 3]) @ truth[12][:3, :3]))
    start = truth @ random_poses(30, 0.02)
    start[0] = truth[0]
    for loss in mapping.LOSSES:
        found = mapping.solve(start, c, loss)
        assert np.allclose(found, truth, atol=1e-5) and mapping.error(found, c) < 1e-9 < mapping.error(start, c)
    far = [mapping.Constraint("POSE_TO_POSE", i, i + 1, np.eye(4)) for i in range(4)] + [mapping.Constraint("POSE_TO_POSE", 0, 4, rigid.pose_exp(np.array([0, 0, 0, 50.0, 0, 0])))]
    flat = np.tile(np.eye(4), (5, 1, 1))
    assert abs(mapping.solve(flat, far, "CAUCHY")[4][0, 3]) < 1 < mapping.solve(flat, far, "TRIVIAL")[4][0, 3]


def test_a_long_graph_is_sparse():
    n = 3000
    step = rigid.pose_exp(np.array([0, 0, 0.01, 1.0, 0, 0]))
    truth = np.stack([np.eye(4)] * n)
    for i in range(1, n):
        truth[i] = truth[i - 1] @ step
    c = [mapping.Constraint("POSE_TO_POSE", i, i + 1, step) for i in range(n - 1)]
    found = mapping.solve(truth, c, rounds=2)
    assert np.allclose(found, truth, atol=1e-6)


def test_constraint_documents():
    eye = np.eye(4).ravel().tolist()
    doc = {"constraints": [
        {"type": "ABSOLUTE_POSE", "timestamp": 5, "pose": eye, "rotation_weight": 2}, {"type": "ABSOLUTE_POSE", "timestamp": 5, "pose": {"x": 1, "rz": 0.5}, "translation_weight": [1, 2, 3]},
        {"type": "POSE_TO_POSE", "timestamp1": 1, "timestamp2": 2}, {"type": "ABSOLUTE_POSE", "pose": [1]}, {"type": "NOTHING"}, {"type": "POSE_TO_POSE", "timestamp1": 1, "timestamp2": 2, "translation_weight": [1, -1, 1]},
    ]}
    good, issues = mapping.parse_constraints(json.dumps(doc))
    assert len(good) == 3 and good[1]["translation_weights"] == [1.0, 2.0, 3.0] and good[0]["rotation_weight"] == 2
    assert {p for p, _, _ in issues} == {"$.constraints[3].timestamp", "$.constraints[3].pose", "$.constraints[4].type", "$.constraints[5].translation_weight"}
    assert mapping.parse_constraints(mapping.write_constraints(good))[0] == good
    assert mapping.parse_constraints("{}")[1][0][2] == "critical"


def test_loop_needs_a_gap(spark):
    """Once round a square and again: loops of the second round, at least the gap apart."""
    pts = [(x, y) for x, y in [*[(k, 0) for k in range(5)], *[(5, k) for k in range(5)], *[(5 - k, 5) for k in range(5)], *[(0, 5 - k) for k in range(5)]]] * 2
    rows = [(0, i, i * 5_000_000_000, float(x), float(y), 0.0, float(i)) for i, (x, y) in enumerate(pts)]
    p = spark.createDataFrame(rows, "k int, i int, ts long, x double, y double, z double, travelled double")
    got = {r["i"]: r["candidate"] for r in mapping.loop_closures(p, "k", "i", "ts", 6.0, 1.0).collect()}
    firsts = sorted(got)
    assert firsts and all(b - a >= 6 for a, b in zip(firsts[:-1], firsts[1:], strict=True)) and all(got[i] == i - 20 for i in firsts if i > 21)


def test_optimised_frames(spark):
    truth = random_poses(6, 0.3)
    edges = [(i, j, (rigid.inverse(truth[i]) @ truth[j]).ravel().tolist()) for i, j in [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0)]]
    got = mapping.optimised(spark, [(i, p.ravel().tolist()) for i, p in enumerate(truth @ random_poses(6, 0.01))], edges).orderBy("index").collect()
    own = np.array([r["pose"] for r in got]).reshape(-1, 4, 4)
    assert np.allclose(rigid.inverse(own[0]) @ own[3], rigid.inverse(truth[0]) @ truth[3], atol=1e-5)
    nodes = spark.createDataFrame([(0, i, p.ravel().tolist()) for i, p in enumerate(truth)], "k int, i int, pose array<double>")
    diff = mapping.odometry_constraints(nodes, "k", "i", "pose").where(F.col("a") == 2).first()["diff"]
    assert np.allclose(diff, edges[2][2])
