"""Kernels on whole frames and state machines against slow, plain versions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.operators import aggregates, filters, images, joins, projection, selection, trajectory, windows
from beamframe.plans import pipeline
from beamframe.plans.pipeline import Pipeline
from beamframe.streaming import batcher, collator

rng = np.random.default_rng(21)


def test_normals_pixel_by_pixel():
    h, w, reach = 6, 10, 2.0
    xyz = rng.normal(size=(h, w, 3)) + [5, 0, 0]
    xyz[rng.random((h, w)) < 0.3] = 0
    got = images.surface_normals(xyz, reach=reach)
    unit = lambda v: v / np.linalg.norm(v)
    for r in range(h):
        for c in range(w):
            p = xyz[r, c]
            if not p.any():
                assert not got[r, c].any()
                continue

            def nearer(options, p=p):
                found = [(np.linalg.norm(q - p), k, s * (q - p)) for k, (q, s) in enumerate(options) if q is not None and q.any()]
                found = [f for f in found if f[0] <= reach]
                return min(found, key=lambda f: f[:2])[2] if found else None

            v = nearer([(xyz[r + 1, c] if r + 1 < h else None, 1), (xyz[r - 1, c] if r else None, -1)])
            a = nearer([(xyz[r, (c + 1) % w], 1), (xyz[r, c - 1], -1)])
            beam = -unit(p)
            if v is not None and a is not None:
                n = np.cross(a, v)
                n = n if n @ beam >= 0 else -n
            elif v is None and a is None:
                n = beam
            else:
                one = unit(v if v is not None else a)
                n = beam - (beam @ one) * one
            assert np.allclose(got[r, c], unit(n), atol=1e-9)


def test_ground_cell_by_cell():
    p = np.column_stack([rng.uniform(0, 6, 400), rng.uniform(0, 6, 400), rng.normal(0, 0.03, 400)])
    p[(p[:, 0] > 3) & (p[:, 0] < 5) & (p[:, 1] < 5), 2] += 1.5  # a box
    p = p[~((p[:, 0] < 1) & (p[:, 1] < 1))]  # a hole
    cell, share, slope, height = 1.0, 0.15, 0.3, 0.3
    cells = {}
    low = np.floor(p[:, :2] / cell).astype(int).min(axis=0)
    for x in p:
        cells.setdefault(tuple(np.floor(x[:2] / cell).astype(int) - low), []).append(x[2])
    shape = [max(k[i] for k in cells) + 1 for i in (0, 1)]
    z = {k: sorted(v)[math.floor(share * (len(v) - 1))] for k, v in cells.items()}
    every = [(i, j) for i in range(shape[0]) for j in range(shape[1])]
    around = lambda k: [n for n in ((k[0] - 1, k[1]), (k[0] + 1, k[1]), (k[0], k[1] - 1), (k[0], k[1] + 1)) if n in every]
    while len(z) < len(every):
        z |= {k: np.mean([z[n] for n in around(k) if n in z]) for k in every if k not in z and any(n in z for n in around(k))}
    first = min(every, key=lambda k: z[k])
    ok, todo = {first}, [first]
    while todo:
        k = todo.pop()
        for n in around(k):
            if n not in ok and z[n] - z[k] <= slope * cell:
                ok.add(n)
                todo.append(n)
    want = [(k := tuple(np.floor(x[:2] / cell).astype(int) - low)) in ok and x[2] - z[k] <= height for x in p]
    assert images.ground_mask(p, cell, share, slope, height).tolist() == want and 0 < sum(want) < len(p)


def test_equalisation_pixel_by_pixel():
    image, tiles, bins, limit = rng.random((24, 32)), 4, 16, 2.0
    h, w = image.shape
    th, tw = h // tiles, w // tiles
    level = np.minimum((image * bins).astype(int), bins - 1)
    maps = {}
    for i in range(tiles):
        for j in range(tiles):
            count = [0.0] * bins
            for v in level[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel():
                count[v] += 1
            top = max(1.0, limit * th * tw / bins)
            over = sum(max(c - top, 0) for c in count)
            maps[i, j] = np.cumsum([min(c, top) + over / bins for c in count]) / (th * tw)
    got = images.clahe(image, tiles, bins, limit)
    for y in range(h):
        for x in range(w):
            fy, fx = (min(max((v - (t - 1) / 2) / t, 0), tiles - 1) for v, t in ((y, th), (x, tw)))
            y0, x0 = int(fy), int(fx)
            at = lambda i, j, y=y, x=x: maps[min(i, tiles - 1), min(j, tiles - 1)][level[y, x]]
            want = (1 - fy + y0) * ((1 - fx + x0) * at(y0, x0) + (fx - x0) * at(y0, x0 + 1)) + (fy - y0) * ((1 - fx + x0) * at(y0 + 1, x0) + (fx - x0) * at(y0 + 1, x0 + 1))
            assert np.isclose(got[y, x], want)


def test_clusters_by_reach():
    p = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ([0, 0, 0], [6, 0, 0], [0, 7, 1])])
    label = images.cluster_labels(p, 1.0)
    assert len(set(label)) == 3 and all(len(set(label[k * 40 : k * 40 + 40])) == 1 for k in range(3))


def packets(n=400, sensors=2):
    """Packets of frames of four, some lost, late, repeated; a sensor that begins anew."""
    r, rows, seq = random.Random(3), [], 0
    for s in range(sensors):
        sent = [(1 if f < 30 else 2, (65530 + f) % 65536, k, 1 + f * 10 + k) for f in range(n // 4 // sensors * 2) for k in range(4) if r.random() > 0.05]
        for i in range(len(sent) - 6):
            if r.random() < 0.1:
                j = i + r.randrange(1, 6)
                sent[i], sent[j] = sent[j], sent[i]
        for x in sent:
            rows.append((s, seq, *x))
            seq += 1
    return rows


def arrived(spark, query, table, rows):
    """The rows of a running query's memory table once there are enough of them, or after a minute (state with timeouts never settles)."""
    for _ in range(120):
        if query.exception() or spark.table(table).count() >= rows:
            break
        time.sleep(0.5)
    query.stop()
    return spark.table(table).collect()


def test_batches_and_stream_agree(spark, tmp_path):
    schema = "sensor_idx int, seq long, init_id long, frame_id long, packet_no int, host_ts long"
    rows = packets()
    df = spark.createDataFrame(rows, schema)
    want = {}
    for s in (0, 1):
        b = batcher.Batcher(4)
        out = [x for r in rows if r[0] == s for x in b.put(*r[2:])]
        want[s] = out, list(b.finish())
    exact = batcher.batch_exact(df, 4).collect()
    key = lambda s, x: (s, x["init_id"], x["frame_id"], x["packets"], x["distinct_packets"], x["complete"], x["first_ts"], x["last_ts"], x["dropped"])
    assert sorted(key(r["sensor_idx"], r) for r in exact) == sorted(key(s, x) for s, (a, z) in want.items() for x in [*a, *z])
    assert any(not r["complete"] for r in exact) and any(r["dropped"] for r in exact)
    # files arrive in the order of their names; a stream keeps the last frames open until a sensor falls silent
    step = len(rows) // 5 + 1
    for k in range(5):
        spark.createDataFrame([r for r in rows if k * step <= r[1] < (k + 1) * step], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = batcher.batch_stream(stream, 4).writeStream.format("memory").queryName("batched").option("checkpointLocation", str(tmp_path / "cp")).start()
    got = arrived(spark, q, "batched", sum(len(a) for a, _ in want.values()))
    assert sorted(key(r["sensor_idx"], r) for r in got) == sorted(key(s, x) for s, (a, _) in want.items() for x in a)


def test_sets_and_stream_agree(spark, tmp_path):
    r = random.Random(8)
    rows = sorted((f * 100_000_000 + i * 1_000_000 + r.randrange(90_000_000), i, f) for f in range(40) for i in range(3) if r.random() > 0.1)
    df = spark.createDataFrame([(0, ts, i, f) for ts, i, f in rows], "session int, ts long, sensor_idx int, frame_id long")
    c = collator.Collator(3)
    sets = [s for ts, i, f in rows for s in c.put(i, f, ts)]
    rest = list(c.finish())
    got = collator.collate(df, "session", 3).collect()
    table = lambda sets: sorted((n, i, f) for n, s in enumerate(sets) for i, f in s.items())
    assert sorted((x["set_id"], x["sensor_idx"], x["frame_id"]) for x in got) == table([*sets, *rest])
    for k in range(4):
        df.where(f"frame_id div 10 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = collator.collate_stream(stream, "session", 3).writeStream.format("memory").queryName("collated").option("checkpointLocation", str(tmp_path / "cp")).start()
    streamed = sorted((x["set_id"], x["sensor_idx"], x["frame_id"]) for x in arrived(spark, q, "collated", len(table(sets))))
    # a set that spans two files is closed by the frames that come, so the stream gives the same but the open last one
    assert [x for x in streamed if x[0] < len(sets) - 1] == [x for x in table(sets) if x[0] < len(sets) - 1]


def test_timing_of_synchronised_sensors():
    T = collator.Timing
    locked = {"phase_locked": True, "own_clock": False}
    assert collator.synchronised([T(10, **locked), T(10, **locked)])
    assert not collator.synchronised([T(10, **locked)]) and not collator.synchronised([T(10, **locked), T(20, **locked)]) and not collator.synchronised([T(10, **locked), T(10)])
    got, period = collator.latencies([T(10, phase_offset=0, **locked), T(10, phase_offset=180_000, **locked)])
    assert period == 100_000_000 and got == {0: 0, 1: 50_000_000}
    # 350 and 10 degrees lie 20 apart, not 340
    assert collator.latencies([T(10, phase_offset=350_000, **locked), T(10, phase_offset=10_000, **locked)])[0] == {0: 0, 1: pytest.approx(5_555_555, abs=2)}
    assert collator.latencies([T(10, azimuth_window=(0, 90_000), **locked), T(10, azimuth_window=(0, 90_000), imu_in_frame=True, **locked)])[0] == {0: 25_000_000, 1: 0}
    with pytest.raises(ValueError):
        collator.latencies([T(0)])


def test_rays_against_a_box(spark):
    """Near and far of rays on a cube of side 2 around (5, 0, 0), against its slabs."""
    corners = np.array([[x, y, z] for x in (4, 6) for y in (-1, 1) for z in (-1, 1)], float)
    faces = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    tri = [(*corners[a], *corners[b], *corners[c]) for q in faces for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    t = spark.createDataFrame([tuple(map(float, x)) for x in tri], ", ".join(f"v{i}{a} double" for i in range(3) for a in "xyz"))
    d = np.column_stack([np.ones(300), rng.uniform(-0.4, 0.4, (300, 2))])
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    rays = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(d)], "row int, col int, dx double, dy double, dz double")
    got = {r["col"]: (r["near"], r["far"]) for r in joins.ray_hits(rays, t).collect()}
    for i, v in enumerate(d):
        low = np.max([min(a / v[k], b / v[k]) for k, (a, b) in enumerate([(4, 6), (-1, 1), (-1, 1)])])
        high = np.min([max(a / v[k], b / v[k]) for k, (a, b) in enumerate([(4, 6), (-1, 1), (-1, 1)])])
        assert (i in got) == (low < high)
        assert i not in got or np.allclose(got[i], (low, high))


def test_small_operators(spark):
    c = spark.createDataFrame([(0, 0, 1, 100, [1.0] * 16), (0, 1, 1, 200, [2.0] * 16), (0, 2, 0, 300, [3.0] * 16)], "f int, col int, status int, ts_ns long, pose array<double>")
    o = spark.createDataFrame([(0, 7, 150), (0, 8, 250), (0, 9, 50)], "f int, object_id int, ts_ns long")
    assert {r["object_id"]: r["body_to_world"][0] for r in joins.objects_at(o, c, ["f"]).collect()} == {7: 1.0, 8: 2.0}
    px = spark.createDataFrame([(0, 0, 0, 1500, 1.0, 0.0, 0.0), (0, 0, 1, 5000, 1.0, 0.0, 0.0), (0, 0, 2, 1500, 1.0, 0.0, 0.0), (0, 1, 1, 1500, 0.0, 1.0, 0.0)], "f int, row int, col int, range_mm long, dx double, dy double, dz double")
    px = px.withColumns({k: F.lit(0.0) for k in ("ox", "oy", "oz")}).withColumns({k: F.col(k) / 1000 for k in ("dx", "dy", "dz")})
    pose = np.eye(4)
    pose[:3, 3] = 1, 2, 3
    cols = c.withColumn("pose", F.array(*[F.lit(float(x)) for x in pose.ravel()]))
    got = projection.dewarp_frame(px, cols, ["f", "col"], 1.0, 2.0).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["ts_ns"], r["x"], r["y"], r["z"]) for r in got] == [(0, 0, 100, 2.5, 2, 3), (1, 1, 200, 1, 3.5, 3)]
    n = spark.createDataFrame([(0.1, 0.1, 0.1, 0.0, 0.0, 2.0), (0.2, 0.2, 0.2, 0.0, 2.0, 0.0), (0.3, 0.3, 0.3, float("nan"), 0.0, 0.0), (0.4, 0.4, 0.4, 0.0, 0.0, 0.0)], "x double, y double, z double, nx double, ny double, nz double")
    r = aggregates.voxel_normals(n, 1.0).first()
    assert np.allclose([r["x"], r["nx"], r["ny"], r["nz"]], [0.15, 0, 2**-0.5, 2**-0.5])
    e = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.05, 0.3, 0.4, 0.01])], "k int, i int, e double")
    assert np.allclose([r["threshold"] for r in windows.adaptive_threshold(e, "k", ["i"], "e", 0.1, 2.0).orderBy("i").collect()], [2.0, 0.3, math.sqrt(0.125), math.sqrt(0.125)])
    m = spark.createDataFrame([(0, t, 2.0 * t, 0.0) for t in (0, 1, 3, 7)], "k int, t int, x double, y double")
    assert [r["p_x"] for r in windows.predicted_position(m, "k", "t", ["x", "y"]).orderBy("t").collect()][2:] == [6.0, 14.0]
    s = spark.range(100).withColumnRenamed("id", "seq")
    assert [r["seq"] for r in selection.evenly_sampled(s, 4, 100).orderBy("seq").collect()] == [0, 33, 66, 99] and selection.evenly_sampled(s, 1, 100).count() == 1
    empty = s.limit(0)
    assert selection.at_index(empty, -1).count() == 0 and selection.slice_frames(empty, -3, None).count() == 0
    beams = spark.createDataFrame([(r, float(r)) for r in range(4)], "row int, altitude_deg double")
    kept, _ = selection.select_beams(beams, [3, 1], 4)
    assert sorted((r["row"], r["altitude_deg"]) for r in kept.collect()) == [(0, 3.0), (1, 1.0)]
    q = spark.range(1000).selectExpr("id", "id % 3 range_mm")
    a = selection.sampled_map(q, 0.5, 200, ["id"])
    assert a.count() == 200 and a.where("range_mm = 0").count() == 0 and sorted(a.collect()) == sorted(selection.sampled_map(q, 0.5, 200, ["id"]).collect())
    with pytest.raises(ValueError):
        filters.resolved(q, ["id"], {"id": "COLUMN"})
    assert filters.resolved(q, ["range_mm", "gone"], {}) == ["range_mm"] and filters.resolved(q, None, {"range_mm": "PIXEL"}) == ["range_mm"]


def test_xorshift_is_the_generator():
    x, want = 42, []
    for _ in range(50):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        want.append(x)
    assert aggregates.xorshift(np.arange(1, 51)).tolist() == want


def test_point_to_plane(spark):
    from beamframe.functions import rigid
    from beamframe.operators import registration

    q = rng.uniform(-3, 3, (600, 3))
    n = np.zeros_like(q)
    for k in range(3):  # three walls
        q[k::3, k], n[k::3, k] = 0.0, 1.0
    move = rigid.pose_exp(np.array([0.02, -0.01, 0.03, 0.05, -0.04, 0.06]))
    p = (q - move[:3, 3]) @ move[:3, :3]
    target = spark.createDataFrame([(i, *map(float, x), *map(float, m)) for i, (x, m) in enumerate(zip(q, n, strict=True))], "id int, x double, y double, z double, nx double, ny double, nz double")
    source = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id int, x double, y double, z double")
    assert np.allclose(registration.align(source, target, 0.5, 1.0, plane=True), move, atol=2e-3)


def test_verbs(spark, tmp_path):
    df = spark.range(4 * 8 * 16).selectExpr("0 sensor_idx", "id div 128 frame_id", "id div 128 frame_seq", "cast(id div 16 % 8 as int) row", "cast(id % 16 as int) col", "id % 500 range_mm", "id * 1000000 ts_ns")
    p = Pipeline(df, height=8, width=16)
    assert p.words("1:3").df.select("frame_id").distinct().count() == 2 and p.words("0:0.2s").df.select("frame_id").distinct().count() == 2
    assert p.reduce(2).height == 4 and p.select([1, 5]).df.select("row").distinct().count() == 2
    assert p.clip(["range_mm"], 10, 100).df.where("range_mm > 100").count() == 0 and p.filter("u", 0, 4, ["range_mm"]).df.where("row < 4 and range_mm > 0").count() == 0
    assert p.range_gate(0.1, 0.2).df.agg(F.min("range_mm")).first()[0] == 100 and p.stats().first()["frames"] == 4
    assert p.collate(1).count() == 4 and p.images("range_mm").count() == 4
    info = spark.createDataFrame([(0, "a"), (1, "b")], "sensor_idx int, name string")
    assert [r["name"] for r in p.info(info).collect()] == ["a"]
    p.save(str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == df.count()
    p.csv(str(tmp_path / "c"))
    track = spark.createDataFrame([(0, 0, trajectory.IDENTITY), (0, 10**9, trajectory.IDENTITY)], "sensor_idx int, ts_ns long, pose array<double>")
    assert p.poses(track).df.where("pose is null").count() == 0
    pipeline.register("double")(lambda d: d.withColumn("range_mm", F.col("range_mm") * 2))
    assert p.apply("double").df.agg(F.max("range_mm")).first()[0] == 998
    with pytest.warns(UserWarning):
        assert pipeline.detection_config("CLUSTERS", reach=2.0, other=1).reach == 2.0
    with pytest.raises(ValueError):
        pipeline.detection_config("classic")
