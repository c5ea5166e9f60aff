"""Queries of trajectories, zones, mapping and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from beamframe.functions import rigid
from beamframe.operators import frames, joins, mapping, trajectory, zones
from beamframe.plans.registry import q6, query
from beamframe.plans.standins import POINTS, TRACK, cloud, micro, points, table, track

#: Knots of a track: a user's events with even ids, one a time; the others ask for poses.
KNOTS = f"(SELECT user_id, ts_us, max(milli) AS milli FROM {TRACK} WHERE event_id % 2 = 0 GROUP BY 1, 2)"
ASKED = f"(SELECT * FROM {TRACK} WHERE event_id % 2 = 1)"
DAY = 86_400_000_000


def _knots(spark, sf):
    return track(spark, sf).where("event_id % 2 = 0").groupBy("user_id", "ts_us").agg(F.max("milli").alias("milli"))


def _asked(spark, sf):
    return track(spark, sf).where("event_id % 2 = 1")


def _x(spark, sf):
    zero = F.lit(0.0)
    return _knots(spark, sf).select("user_id", "ts_us", trajectory.translation(F.col("milli") / 1000, F.col("milli") / -2000, zero).alias("pose"))


BRACKET = f"""SELECT e.event_id, coalesce(b.ts_us, 0) AS t0, coalesce(b.milli, -1) AS v0, coalesce(a.ts_us, 0) AS t1, coalesce(a.milli, -1) AS v1 FROM {ASKED} e
    ASOF LEFT JOIN {KNOTS} b ON e.user_id = b.user_id AND e.ts_us >= b.ts_us ASOF LEFT JOIN {KNOTS} a ON e.user_id = a.user_id AND e.ts_us <= a.ts_us"""


@query(BRACKET)
def q_pose_asof_buckets(spark, sf):
    """The same brackets when each key is cut in days, with the knots next to a day carried in."""
    return joins.asof_bracket(_asked(spark, sf), _knots(spark, sf), "user_id", "ts_us", "milli", span=DAY).select("event_id", "t0", "v0", "t1", "v1").fillna({"t0": 0, "t1": 0, "v0": -1, "v1": -1})


#: Segments between followers, and which one an event goes by: the last that begins before it, else the first.
SEGMENTS = f"(SELECT * FROM (SELECT user_id, ts_us AS t0, milli AS v0, lead(ts_us) OVER w AS t1, lead(milli) OVER w AS v1 FROM {KNOTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)) WHERE t1 IS NOT NULL)"
PLACED = f"""(SELECT e.event_id, e.ts_us, coalesce(s.t0, f.t0) AS t0, coalesce(s.v0, f.v0) AS v0, coalesce(s.t1, f.t1) AS t1, coalesce(s.v1, f.v1) AS v1 FROM {ASKED} e
    ASOF LEFT JOIN {SEGMENTS} s ON e.user_id = s.user_id AND e.ts_us >= s.t0
    LEFT JOIN (SELECT user_id, arg_min(t0, t0) AS t0, arg_min(v0, t0) AS v0, arg_min(t1, t0) AS t1, arg_min(v1, t0) AS v1 FROM {SEGMENTS} GROUP BY 1) f ON e.user_id = f.user_id)"""


def _r4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def r4(c):  # noqa: ANN001, ANN201
    return F.floor(c * 1e4 + 0.5) / 1e4


@query(f"SELECT event_id, {_r4('v0 / 1000 + (v1 - v0) / 1000 * (ts_us - t0) / (t1 - t0)')} AS x, {_r4('v0 / -2000 - (v1 - v0) / 2000 * (ts_us - t0) / (t1 - t0)')} AS y FROM {PLACED}")
def q_pose_interp(spark, sf):
    """Poses of a track without rotation at any time, the ends going on."""
    p = trajectory.pose_at(_asked(spark, sf), _x(spark, sf), "user_id", "ts_us", "pose", span=DAY)
    return p.select("event_id", r4(F.col("pose")[3]).alias("x"), r4(F.col("pose")[7]).alias("y"))


@query(f"SELECT event_id, floor(cos(a) * 1e5 + 0.5) / 1e5 AS c, floor(sin(a) * 1e5 + 0.5) / 1e5 AS s FROM (SELECT event_id, a0 + (CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END) * u AS a FROM (SELECT event_id, v0 % 3 AS a0, v1 % 3 - v0 % 3 AS d, CAST(ts_us - t0 AS DOUBLE) / (t1 - t0) AS u FROM {PLACED}) WHERE u BETWEEN 0 AND 1)")
def q_pose_turn(spark, sf):
    """Poses that turn on the spot: the angle between two knots goes the shorter way round; none outside the track."""
    k = _knots(spark, sf).select("user_id", "ts_us", trajectory.planar(F.lit(0.0), F.lit(0.0), (F.col("milli") % 3).cast("double")).alias("pose"))
    p = trajectory.pose_at(_asked(spark, sf), k, "user_id", "ts_us", "pose", bounds=0.0).where("pose is not null")
    return p.select("event_id", (F.floor(F.col("pose")[0] * 1e5 + 0.5) / 1e5).alias("c"), (F.floor(F.col("pose")[4] * 1e5 + 0.5) / 1e5).alias("s"))


@query(f"SELECT e.event_id, CASE WHEN b.ts_us = a.ts_us THEN b.milli / 1000 ELSE {_r4('b.milli / 1000 + (a.milli - b.milli) / 1000 * (e.ts_us - b.ts_us) / (a.ts_us - b.ts_us)')} END AS x FROM {ASKED} e ASOF LEFT JOIN {KNOTS} b ON e.user_id = b.user_id AND e.ts_us >= b.ts_us ASOF LEFT JOIN {KNOTS} a ON e.user_id = a.user_id AND e.ts_us <= a.ts_us")
def q_pose_at_columns(spark, sf):
    """Objects between the columns of their frame; null outside."""
    c = _x(spark, sf).withColumn("status", F.lit(1))
    p = trajectory.pose_at_columns(_asked(spark, sf), c, "user_id", "ts_us", "pose")
    return p.select("event_id", r4(F.col("pose")[3]).alias("x"))


@query(f"SELECT user_id, ts_us FROM (SELECT user_id, ts_us, lag(ts_us) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {TRACK}) WHERE ts_us <= before")
def q_not_increasing(spark, sf):
    return trajectory.not_increasing(track(spark, sf), "user_id", "event_id", "ts_us").select("user_id", "ts_us")


@query(f"""SELECT user_id, ts_us, {_r4('CASE WHEN p1 IS NULL THEN 0 WHEN p2 IS NULL THEN p1 ELSE p2 + (p1 - p2) * (ts_us - t2) / (t1 - t2) END')} AS x FROM (
    SELECT user_id, ts_us, lag(ts_us) OVER w AS t1, lag(ts_us, 2) OVER w AS t2, lag(milli / 1000) OVER w AS p1, lag(milli / 1000, 2) OVER w AS p2 FROM {KNOTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us))""")
def q_predicted_pose(spark, sf):
    p = trajectory.predicted_pose(_x(spark, sf), "user_id", "ts_us", "pose")
    return p.select("user_id", "ts_us", r4(F.col("predicted")[3]).alias("x"))


@query("SELECT l_orderkey, coalesce(arg_min(x, l_linenumber) FILTER (s = 1), 0) AS first_x, coalesce(arg_max(x, l_linenumber) FILTER (s = 1), 0) AS last_x FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS x, max(l_partkey % 2) AS s FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def q_edge_poses(spark, sf):
    zero = F.lit(0.0)
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias("x"), F.max(F.col("l_partkey") % 2).alias("status"))
    p = trajectory.edge_poses(one.withColumn("pose", trajectory.translation(F.col("x"), zero, zero)), ["l_orderkey"])
    return p.select("l_orderkey", F.col("first_pose")[3].alias("first_x"), F.col("last_pose")[3].alias("last_x"))


#: A frame pose for each customer of a nation, in order: at k + 0.5; four columns a frame.
FRAMES = "(SELECT c_nationkey AS session, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seq, c_acctbal AS x FROM customer)"


@query(f"""WITH f AS (SELECT *, lead(x) OVER w AS nx, lag(x) OVER w AS px, count(*) OVER (PARTITION BY session) AS n FROM {FRAMES} WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, CAST(col AS INTEGER) AS col, {_r4('CASE WHEN (col >= 2 AND nx IS NOT NULL) OR px IS NULL THEN x + (nx - x) * (col / 4.0 - 0.5) ELSE px + (x - px) * (col / 4.0 + 0.5) END')} AS x FROM f, range(4) c(col) WHERE n > 1""")
def q_kitti_poses(spark, sf):
    """Columns of frames between the poses of whole frames."""
    zero = F.lit(0.0)
    f = table(spark, sf, "customer").select(F.col("c_nationkey").alias("session"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("seq"), F.col("c_acctbal").alias("x"))
    poses = f.select("session", "seq", trajectory.translation(F.col("x"), zero, zero).alias("pose"))
    columns = poses.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3))))
    out = trajectory.poses_of_frames(columns, poses, "session", "seq", 4).where("pose is not null")
    return out.select("session", "seq", "col", r4(F.col("pose")[3]).alias("x"))


#: Key poses: each tenth event of a user, moved by a metre for each.
DENSE = f"(SELECT user_id, ts_us, milli / 1000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts_us) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {KNOTS})"


@query(f"""WITH d AS {DENSE}, k AS (SELECT user_id, ts_us, i, x + i / 10 AS nx, lead(ts_us) OVER w AS zt, lead(i) OVER w AS zi, lead(x + i / 10) OVER w AS zx, n FROM d WHERE i % 10 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)),
s AS (SELECT d.*, k.i AS a, k.nx, k.zx, k.zi, CASE WHEN k.zi = d.n - 1 THEN k.zi ELSE k.zi - 1 END AS z FROM d JOIN k ON d.user_id = k.user_id AND (d.i BETWEEN k.i AND k.zi - 1 OR (d.i = k.zi AND k.zi = d.n - 1)) WHERE k.zi IS NOT NULL),
e AS (SELECT s.user_id, s.ts_us, s.x, s.nx, s.zx, p.x AS ax, q.x AS qx, p.ts_us AS pt, q.ts_us AS qt FROM s JOIN d p ON p.user_id = s.user_id AND p.i = s.a JOIN d q ON q.user_id = s.user_id AND q.i = s.z)
SELECT user_id, ts_us, {_r4('CASE WHEN qt = pt THEN x ELSE nx + (x - ax) + (zx - nx - (qx - ax)) * (ts_us - pt) / (qt - pt) END')} AS x FROM e
UNION ALL SELECT user_id, ts_us, {_r4('x')} FROM d WHERE (user_id, i) NOT IN (SELECT user_id, i FROM s)""")
def q_track_update(spark, sf):
    """A dense track bent to its corrected key poses."""
    zero = F.lit(0.0)
    d = _knots(spark, sf).select("user_id", "ts_us", (F.col("milli") / 1000).alias("x"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts_us")) - 1).alias("i"))
    dense = d.select("user_id", "ts_us", trajectory.translation(F.col("x"), zero, zero).alias("pose"))
    keys = d.where("i % 10 = 0").select("user_id", "ts_us", trajectory.translation(F.col("x") + F.col("i") / 10, zero, zero).alias("pose"))
    return trajectory.updated_track(dense, keys, "user_id", "ts_us", "pose").select("user_id", "ts_us", r4(F.col("pose")[3]).alias("x"))


@query(f"""SELECT user_id, count(*) AS n, {_r4('avg(milli % 7)')} AS ax, {_r4('avg(milli % 11)')} AS ay, {_r4('avg(9.8 + milli % 3)')} AS az FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {TRACK} WHERE event_id % 3 <> 0) WHERE i <= 25 GROUP BY user_id""")
def q_plumb(spark, sf):
    m = F.col("milli")
    imu = track(spark, sf).select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, 1).otherwise(0).alias("status"), F.array((m % 7).cast("double"), (m % 11).cast("double"), 9.8 + (m % 3)).alias("acc"))
    return trajectory.plumb(imu, ["user_id"], "event_id", 25).select("user_id", "n", *[r4(F.col(a)).alias(a) for a in ("ax", "ay", "az")])


@query(f"SELECT user_id, {_r4('sqrt(m)')} AS tilt FROM (SELECT user_id, power(avg(milli % 7), 2) + power(avg(milli % 11), 2) + power(avg(9.8 + milli % 3), 2) AS m FROM {TRACK} GROUP BY user_id)")
def q_gravity(spark, sf):
    """Mean accelerations turned to +z: what is left along z is their length."""
    m = F.col("milli")
    means = track(spark, sf).groupBy("user_id").agg(F.avg(m % 7).alias("ax"), F.avg(m % 11).alias("ay"), F.avg(9.8 + m % 3).alias("az"))
    r = trajectory.gravity_aligned(means, ["user_id"], fix_yaw=True).join(means, "user_id")
    return r.select("user_id", r4(F.col("rotation")[6] * F.col("ax") + F.col("rotation")[7] * F.col("ay") + F.col("rotation")[8] * F.col("az")).alias("tilt"))


# ------------------------------------------------------------- zones

RENDERED = '(SELECT CAST(z AS INTEGER) AS zone_id, z * 5000 AS near_mm, z * 5000 + 20000 AS far_mm, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM range(4) a(z), range(32) b(r), range(512) d(c) WHERE r % 4 <> z)'
ZONES = [(0, 0, "OCCUPANCY", 40, 2), (1, 1, "VACANCY", 40, 1), (2, 3, "OCCUPANCY", 30, 3), (3, 5, "NONE", 1, 1)]
ZONE_ROWS = ", ".join(f"({a}, {b}, '{c}', {d}, {e})" for a, b, c, d, e in ZONES)


def _rendered(spark):
    px = spark.range(4 * 32 * 512).select((F.col("id") / (32 * 512)).cast("int").alias("zone_id"), (F.col("id") / 512 % 32).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"))
    return px.where(F.col("row") % 4 != F.col("zone_id")).withColumn("near_mm", F.col("zone_id").cast("long") * 5000).withColumn("far_mm", F.col("near_mm") + 20000)


def _zones(spark):
    return spark.createDataFrame(ZONES, "zone_id int, slot int, mode string, point_count int, frame_count int")


def _scan(spark, sf):
    """Line items as frames of ranges: a sixtieth of the parts is a frame; some have no return."""
    p = points(spark, sf)
    return p.select((F.col("l_partkey") % 60).alias("frame_id"), "row", "col", F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("range_mm")).alias("range_mm"))


SCAN = f'(SELECT l_partkey % 60 AS frame_id, "row", col, CASE WHEN l_linenumber = 7 THEN 0 ELSE range_mm END AS range_mm FROM {POINTS})'


@query(f"""WITH z AS (SELECT * FROM (VALUES {ZONE_ROWS}) t(zone_id, slot, mode, point_count, frame_count)), r AS {RENDERED},
c AS (SELECT frame_id, zone_id, count(*) FILTER (inside) AS n, count(*) FILTER (range_mm > 0 AND range_mm <= near_mm) AS occ, count(*) FILTER (range_mm = 0 AND near_mm > 0) AS inv, min(range_mm) FILTER (inside) AS lo, max(range_mm) FILTER (inside) AS hi, floor(avg(range_mm) FILTER (inside)) AS mid
    FROM (SELECT s.frame_id, s.range_mm, r.*, range_mm > 0 AND range_mm BETWEEN near_mm AND far_mm AS inside FROM {SCAN} s JOIN r ON s."row" = r."row" AND s.col = r.col) GROUP BY 1, 2),
m AS (SELECT zone_id, count(*) FILTER (near_mm < far_mm) AS most FROM r GROUP BY 1),
f AS (SELECT DISTINCT frame_id FROM {SCAN}),
e AS (SELECT f.frame_id, x.slot, z.zone_id, z.mode, z.frame_count, coalesce(m.most, 0) AS most, coalesce(n, 0) AS n, coalesce(occ, 0) AS occ, coalesce(inv, 0) AS inv, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(mid, 0) AS mid,
    coalesce((mode = 'OCCUPANCY' AND coalesce(n, 0) >= point_count) OR (mode = 'VACANCY' AND coalesce(n, 0) < point_count), false) AS t FROM f CROSS JOIN range(16) x(slot) LEFT JOIN z ON z.slot = x.slot LEFT JOIN m ON m.zone_id = z.zone_id LEFT JOIN c ON c.frame_id = f.frame_id AND c.zone_id = z.zone_id),
g AS (SELECT *, sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY slot ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
h AS (SELECT *, greatest(0, sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY slot, run ORDER BY frame_id ROWS UNBOUNDED PRECEDING) - frame_count + 1) AS alerts FROM g)
SELECT frame_id, CAST(slot AS INTEGER) AS slot, CASE WHEN zone_id IS NULL THEN 0 ELSE 1 END AS live, coalesce(zone_id, 255) AS id, 0 AS error_flags, CASE mode WHEN 'OCCUPANCY' THEN 1 WHEN 'VACANCY' THEN 2 ELSE 0 END AS trigger_type,
    CASE WHEN zone_id IS NOT NULL AND alerts > 0 THEN 1 ELSE 0 END AS trigger_status, CAST(CASE WHEN zone_id IS NULL THEN 0 ELSE alerts END AS BIGINT) AS triggered_frames, n AS "count", occ AS occlusion_count, inv AS invalid_count, most AS max_count, lo AS min_range, hi AS max_range, CAST(mid AS BIGINT) AS mean_range FROM h""")
def q_zone_monitor(spark, sf):
    return zones.monitor(_scan(spark, sf), _zones(spark), _rendered(spark), "frame_id")


@query(f"""WITH z AS (SELECT * FROM (VALUES {ZONE_ROWS}) t(zone_id, slot, mode, point_count, frame_count)), r AS (SELECT * FROM {RENDERED} JOIN z USING (zone_id))
SELECT zone_mask, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, p.col, p."row", range_mm, coalesce(CAST(bit_or(CASE WHEN range_mm > 0 AND range_mm BETWEEN near_mm AND far_mm THEN CAST(1 AS BIGINT) << slot ELSE 0 END) AS BIGINT), 0) AS zone_mask
    FROM (SELECT *, row_number() OVER () AS i FROM {POINTS}) p LEFT JOIN r ON p."row" = r."row" AND p.col = r.col GROUP BY p.i, 1, 2, 3, 4, 5, 6) GROUP BY 1""")
def q_zone_mask(spark, sf):
    return zones.masked(points(spark, sf), _zones(spark), _rendered(spark), ["l_orderkey"]).groupBy("zone_mask").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_size, count(*) AS corners, " + _r4("avg(x)") + " AS cx FROM (SELECT p_size, unnest([p_retailprice, p_partkey % 100, p_size]) AS x FROM part) GROUP BY p_size")
def q_mesh_centre(spark, sf):
    """Parts as triangles of a mesh by size: their corners' centroid."""
    t = table(spark, sf, "part")
    x = [F.col("p_retailprice"), F.col("p_partkey") % 100, F.col("p_size")]
    mesh = t.select("p_size", *[x[i].cast("double").alias(f"v{i}x") for i in range(3)], *[F.lit(0.0).alias(f"v{i}{a}") for i in range(3) for a in "yz"])
    s = zones.bounding_spheres(mesh, ["p_size"])
    return s.join(t.groupBy("p_size").agg((F.count(F.lit(1)) * 3).alias("corners")), "p_size").select("p_size", "corners", r4(F.col("cx")).alias("cx"))


@query("SELECT p_size, " + _r4("max(abs(x - c))") + " AS radius FROM (SELECT p_size, x, avg(x) OVER (PARTITION BY p_size) AS c FROM (SELECT p_size, unnest([p_retailprice, p_partkey % 100, p_size]) AS x FROM part)) GROUP BY p_size")
def q_mesh_radius(spark, sf):
    t = table(spark, sf, "part")
    x = [F.col("p_retailprice"), F.col("p_partkey") % 100, F.col("p_size")]
    mesh = t.select("p_size", *[x[i].cast("double").alias(f"v{i}x") for i in range(3)], *[F.lit(0.0).alias(f"v{i}{a}") for i in range(3) for a in "yz"])
    return zones.bounding_spheres(mesh, ["p_size"]).select("p_size", r4(F.col("radius")).alias("radius"))


# ------------------------------------------------------------- mapping


def _path(spark, sf):
    """Users' tracks in the plane: x by the value, y by the hour; with the way travelled."""
    from beamframe.operators import windows

    t = track(spark, sf).select("user_id", "event_id", (F.col("ts_us") * 1000).alias("ts_ns"), (F.col("milli") / 20000).alias("x"), F.floor(F.col("ts_us") / 3_600_000_000).cast("double").alias("h"))
    t = t.withColumns({"y": F.col("h") % 12, "z": F.lit(0.0)})
    return windows.distance_travelled(t, "user_id", ["event_id"], ["x", "y", "z"])


PATH = f"""(SELECT user_id, event_id, ts_us * 1000 AS ts_ns, x, y, sum(sqrt(coalesce(power(x - px, 2) + power(y - py, 2), 0))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS travelled FROM (
    SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS px, lag(y) OVER (PARTITION BY user_id ORDER BY event_id) AS py FROM (SELECT user_id, event_id, ts_us, milli / 20000 AS x, CAST(ts_us // 3600000000 % 12 AS DOUBLE) AS y FROM {TRACK})))"""


@query(f"""WITH RECURSIVE p AS {PATH},
c AS (SELECT a.user_id, a.event_id, b.event_id AS candidate, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d2, abs(a.ts_ns - b.ts_ns) > 10000000000 AS far, floor(a.x / 0.5) <> floor(b.x / 0.5) OR floor(a.y / 0.5) <> floor(b.y / 0.5) AS other
    FROM p a JOIN p b ON a.user_id = b.user_id AND b.event_id < a.event_id AND a.travelled - b.travelled >= 30 AND abs(a.x - b.x) <= 0.5 AND abs(a.y - b.y) <= 0.5 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.25),
s AS (SELECT user_id, event_id, travelled, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM p WHERE (user_id, event_id) IN (SELECT user_id, event_id FROM c)),
g AS (SELECT user_id, event_id, i, travelled AS last, true AS open FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, CASE WHEN s.travelled - g.last >= 30 THEN s.travelled ELSE g.last END, s.travelled - g.last >= 30 FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.i + 1)
SELECT c.user_id, c.event_id, arg_min(candidate, [CASE WHEN other THEN 1.0 ELSE 0.0 END, d2, candidate]) AS candidate FROM c JOIN g ON c.user_id = g.user_id AND c.event_id = g.event_id AND g.open WHERE far GROUP BY 1, 2""")
def q_loop_closures(spark, sf):
    return mapping.loop_closures(_path(spark, sf), "user_id", "event_id", "ts_ns", 30.0, 0.5).select("user_id", "event_id", "candidate")


@query(f"""WITH RECURSIVE t AS (SELECT user_id, event_id, ts_ns, x AS px, y AS py, CASE WHEN event_id % 3 <> 0 THEN 48 + y / 1000 END AS lat, CASE WHEN event_id % 3 <> 0 THEN 11 + x / 1000 END AS lon, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {PATH}),
k AS (SELECT user_id, ts_ns, px, py, lat, lon, i, CASE WHEN lat IS NULL THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS since, lat AS lat0, lon AS lon0, lat IS NOT NULL AS used FROM t WHERE i = 2
    UNION ALL SELECT user_id, ts_ns, px, py, lat, lon, i, CASE WHEN hit THEN 0 ELSE way END, CASE WHEN hit THEN coalesce(lat0, lat) ELSE lat0 END, CASE WHEN hit THEN coalesce(lon0, lon) ELSE lon0 END, hit
    FROM (SELECT t.user_id, t.ts_ns, t.px, t.py, t.lat, t.lon, t.i, k.lat0, k.lon0, k.since + sqrt(power(t.px - k.px, 2) + power(t.py - k.py, 2)) AS way, t.lat IS NOT NULL AND (k.lat0 IS NULL OR k.since + sqrt(power(t.px - k.px, 2) + power(t.py - k.py, 2)) >= 10) AS hit FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1))
SELECT user_id, ts_ns, {_r4('radians(lon - lon0) * prime * cos(radians(lat0))')} AS x, {_r4('radians(lat - lat0) * prime * (1 - 6.69437999014e-3) / (1 - 6.69437999014e-3 * s * s)')} AS y, 0.0::DOUBLE AS z, true AS weighs_z
FROM (SELECT *, sin(radians(lat0)) AS s, 6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians(lat0)), 2)) AS prime FROM k WHERE used)""")
def q_gps_constraints(spark, sf):
    p = _path(spark, sf)
    f = p.select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, 48 + F.col("y") / 1000).alias("lat"), F.when(F.col("event_id") % 3 != 0, 11 + F.col("x") / 1000).alias("lon"), F.col("ts_ns").alias("fix_ts"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    g = mapping.gps_constraints(f, "user_id", "event_id", 10.0)
    return g.withColumns({"x": r4(F.col("x")), "y": r4(F.col("y"))})


@query()
def q_slam(spark, sf):
    """Odometry over sessions of frames: suppliers' clouds, a frame for every eighth part."""
    p = cloud(spark, sf).select((F.col("l_suppkey") % 4).alias("session"), (F.col("l_partkey") % 8).alias("frame"), "x", "y", "z")
    return mapping.slam(p, "session", "frame", size=2.0)


@query()
def q_localise(spark, sf):
    p = cloud(spark, sf)
    known = mapping.fixed_map(p, 2.0)
    return mapping.slam(p.select((F.col("l_suppkey") % 4).alias("session"), (F.col("l_partkey") % 8).alias("frame"), "x", "y", "z"), "session", "frame", size=2.0, fixed=known)


@query(f"SELECT user_id, {_r4('cos(coalesce(sum(w), 0))')} AS c FROM (SELECT user_id, (milli % 5) / 1e5 * (lead(t) OVER (PARTITION BY user_id ORDER BY t) - t) / 1e9 AS w FROM (SELECT user_id, ts_us AS t, max(milli) AS milli FROM {TRACK} GROUP BY 1, 2)) GROUP BY user_id")
def q_imu_motion(spark, sf):
    """Turning about z at rest: the angle is the sum of rate by time."""
    t = track(spark, sf).groupBy("user_id", "ts_us").agg(F.max("milli").alias("milli"))
    zero = F.lit(0.0)
    imu = t.select("user_id", F.col("ts_us").alias("ts_ns"), F.array(zero, zero, F.lit(9.80665)).alias("acc"), F.array(zero, zero, F.col("milli") % 5 / 1e5).alias("gyro"), F.array(zero, zero, zero).alias("v0"))
    m = mapping.imu_motion(imu, ["user_id"])
    last = m.groupBy("user_id").agg(F.max_by("pose", "ts_ns").alias("p"))
    return last.select("user_id", (F.floor(F.col("p")[0] * 1e4 + 0.5) / 1e4).alias("c"))


@query()
def q_align_clouds(spark, sf):
    p = cloud(spark, sf).select((F.col("l_suppkey") % 3).cast("int").alias("sensor_idx"), "x", "y", "z")
    return mapping.align_clouds(p, "sensor_idx", 0, cell=2.0)


@query("SELECT o_custkey, o_orderkey AS a, b FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
def q_odometry_constraints(spark, sf):
    zero = F.lit(0.0)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", trajectory.translation(F.col("o_totalprice"), zero, zero).alias("pose"))
    return mapping.odometry_constraints(o, "o_custkey", "o_orderkey", "pose").select("o_custkey", "a", "b")


@query(f"SELECT user_id, {q6('avg(milli) / 1000')} AS x FROM {KNOTS} GROUP BY user_id")
def q_frame_dense(spark, sf):
    """Dense arrays of frames, and their means again."""
    k = _knots(spark, sf)
    px = k.select("user_id", F.lit(0).alias("row"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts_us")) - 1).cast("int").alias("col"), F.col("milli").alias("v"))
    n = k.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    d = frames.dense(px, ["user_id"], ["v"], 1, 4096).join(n, "user_id")
    return d.select("user_id", micro(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n") / 1000).alias("x"))


@query(f"SELECT event_id, {_r4('milli / 1000')} AS x, {_r4('-milli / 1000')} AS back FROM {TRACK}")
def q_pose_algebra(spark, sf):
    """A pose composed with itself and its inverse."""
    zero = F.lit(0.0)
    p = track(spark, sf).withColumn("p", trajectory.planar(F.col("milli") / 1000, zero, zero))
    p = p.withColumn("i", rigid.pose_inverse("p"))
    return p.select("event_id", r4(rigid.pose_compose(rigid.pose_compose("p", "i"), "p")[3]).alias("x"), r4(F.col("i")[3]).alias("back"))
