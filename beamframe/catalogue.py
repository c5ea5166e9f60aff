"""Queries of the lidar operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.functions import scalar
from beamframe.operators import aggregates as agg
from beamframe.operators import filters, images, joins, projection, registration, selection, windows
from beamframe.plans.registry import QUERIES, SQL, Query, q6, query
from beamframe.plans.standins import CLOUD, LINE_ORDER, POINTS, TRACK, cloud, epoch_us, micro, points, table, track
from beamframe.streaming import batcher, collator

L = ", ".join(LINE_ORDER)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ------------------------------------------------------------- filters


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice BETWEEN 10000 AND 40000 THEN l_extendedprice ELSE 0 END AS l_extendedprice, CASE WHEN l_quantity BETWEEN 10000 AND 40000 THEN l_quantity ELSE 0 END AS l_quantity FROM {POINTS}")
def q_clip(spark, sf):
    return filters.clip(points(spark, sf), ["l_extendedprice", "l_quantity", "missing"], 10000, 40000).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN -1 ELSE l_extendedprice END AS l_extendedprice FROM {POINTS}")
def q_filter_field(spark, sf):
    return filters.filter_field(points(spark, sf), "l_quantity", 10, 20, ["l_extendedprice"], -1).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f'SELECT l_orderkey, l_linenumber, CASE WHEN "row" >= 8 AND "row" < 16 THEN 0 ELSE range_mm END AS range_u, CASE WHEN (col + shift) % 512 >= 128 AND (col + shift) % 512 < 512 THEN 0 ELSE range_mm END AS range_v FROM {POINTS}')
def q_filter_uv(spark, sf):
    both = points(spark, sf).withColumn("range_u", F.col("range_mm")).withColumn("range_v", F.col("range_mm"))
    u = filters.filter_uv(both, "u", 8, 16, 32, ["range_u"])
    return filters.filter_uv(u, "v", 0.25, float("inf"), 512, ["range_v"], shift="shift").select("l_orderkey", "l_linenumber", "range_u", "range_v")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN y BETWEEN 2 AND 5 THEN 0 ELSE z END AS z FROM {CLOUD}")
def q_filter_xyz(spark, sf):
    return filters.filter_xyz(cloud(spark, sf), "y", 2, 5, ["z"]).select("l_orderkey", "l_linenumber", "z")


@query(f'SELECT l_orderkey, l_linenumber, CASE WHEN ("row" + col) % 3 = 0 THEN 0 ELSE range_mm END AS range_mm FROM {POINTS}')
def q_mask(spark, sf):
    image = spark.range(32 * 512).select((F.col("id") / 512).cast("int").alias("row"), (F.col("id") % 512).cast("int").alias("col"))
    image = image.withColumn("mask", F.when((F.col("row") + F.col("col")) % 3 == 0, 0).otherwise(1))
    return filters.mask(points(spark, sf), image, ["range_mm"]).select("l_orderkey", "l_linenumber", "range_mm")


@query(f"SELECT l_orderkey, l_linenumber, range_mm FROM {POINTS} WHERE range_mm >= 12346 AND range_mm <= 30000")
def q_range_gate(spark, sf):
    return filters.range_gate(points(spark, sf), 12.3456, 30.0).select("l_orderkey", "l_linenumber", "range_mm")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey & 3 > 0)")
def q_frame_complete(spark, sf):
    columns = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_partkey").bitwiseAND(3) > 0, 1).otherwise(0).alias("status"))
    return filters.complete_frames(columns, ["l_orderkey"])


# ------------------------------------------------------------- selection


@query(f'SELECT l_orderkey, l_linenumber, CAST("row" // 4 AS INTEGER) AS "row" FROM {POINTS} WHERE "row" % 4 = 0')
def q_reduce(spark, sf):
    return selection.reduce_by_factor(points(spark, sf), 4, 32).select("l_orderkey", "l_linenumber", "row")


@query(f'SELECT l_orderkey, l_linenumber, CASE "row" WHEN 31 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS "row" FROM {POINTS} WHERE "row" IN (31, 5, 7)')
def q_select(spark, sf):
    return selection.select_rows(points(spark, sf), [31, 5, 7], 32).select("l_orderkey", "l_linenumber", "row")


ORDERED = "(SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, count(*) OVER () AS n FROM orders)"


@query(f"SELECT o_orderkey, seq FROM {ORDERED} WHERE seq >= greatest(0, n - 500) AND seq < n - 20 AND (seq - greatest(0, n - 500)) % 3 = 0")
def q_slice(spark, sf):
    return selection.slice_frames(selection.numbered(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]), -500, -20, 3).select("o_orderkey", "seq")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM (SELECT *, date_diff('day', min(o_orderdate) OVER (), o_orderdate) AS d FROM orders) WHERE d BETWEEN 10 AND 400) WHERE i % 5 = 0")
def q_time_slice(spark, sf):
    days = table(spark, sf, "orders").withColumn("d", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    return selection.time_slice(days, "d", 10, 400, 5, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id % 4 = 2")
def q_single(spark, sf):
    return selection.single(table(spark, sf, "events").withColumn("sensor_idx", F.col("user_id") % 4), 2).select("event_id")


@query(f"SELECT o_orderkey FROM {ORDERED} WHERE seq = n - 3")
def q_index(spark, sf):
    return selection.at_index(selection.numbered(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]), -3).select("o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def q_newest(spark, sf):
    return selection.newest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("SELECT o_orderkey, o_orderdate FROM orders")
def q_merge_sources(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return selection.merged([o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")], ["o_orderdate", "o_orderkey"]).drop("o_orderstatus")


@query(f"""WITH RECURSIVE t AS (SELECT user_id, ts_us, event_id, value AS x, CAST(milli % 7 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts_us) AS i FROM {TRACK}),
k AS (SELECT *, x AS lx, y AS ly, 0 AS since, true AS keep FROM t WHERE i = 1
    UNION ALL SELECT user_id, ts_us, event_id, x, y, z, i, CASE WHEN hit THEN x ELSE lx END, CASE WHEN hit THEN y ELSE ly END, CASE WHEN hit THEN 0 ELSE since + 1 END, hit
    FROM (SELECT t.*, k.lx, k.ly, k.since, k.since + 1 >= 10 OR sqrt(power(t.x - k.lx, 2) + power(t.y - k.ly, 2)) >= 50 AS hit FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1))
SELECT user_id, ts_us, event_id, x, y, z FROM k WHERE keep""")
def q_key_frames(spark, sf):
    t = track(spark, sf).select("user_id", "ts_us", "event_id", F.col("value").alias("x"), (F.col("milli") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return selection.key_frames(t, "user_id", "ts_us", 10, 50.0)


# ------------------------------------------------------------- projection

DIRECTION = "cos(2 * pi() - col * (2 * pi() / 512) - radians(\"row\" / 10.0)) * cos(radians(\"row\" - 16.0)) AS dx, sin(2 * pi() - col * (2 * pi() / 512) - radians(\"row\" / 10.0)) * cos(radians(\"row\" - 16.0)) AS dy, sin(radians(\"row\" - 16.0)) AS dz"


def _directed(spark, sf):
    d = projection.beam_direction(F.col("col"), F.col("row") / 10.0, F.col("row") - 16.0, 512)
    return points(spark, sf).withColumns({k: v * 1e-3 for k, v in d.items()} | {k: F.lit(0.0) for k in ("ox", "oy", "oz")})


@query(f'SELECT l_orderkey, l_linenumber, (col + shift) % 512 AS col FROM {POINTS}')
def q_destagger(spark, sf):
    return projection.destagger(points(spark, sf), 512).select("l_orderkey", "l_linenumber", "col")


@query(f"SELECT l_orderkey, l_linenumber, {q6('range_mm * dx / 1000')} AS x, {q6('range_mm * dy / 1000')} AS y, {q6('range_mm * dz / 1000')} AS z FROM (SELECT *, {DIRECTION} FROM {POINTS})")
def q_xyz(spark, sf):
    return projection.cartesian(_directed(spark, sf)).select("l_orderkey", "l_linenumber", *[micro(F.col(a)).alias(a) for a in "xyz"])


@query(f"SELECT l_orderkey, l_linenumber, {q6('range_mm * dy / 1000 + col')} AS x, {q6('-range_mm * dx / 1000 + 2 * col')} AS y, {q6('range_mm * dz / 1000')} AS z FROM (SELECT *, {DIRECTION} FROM {POINTS})")
def q_dewarp(spark, sf):
    c = F.col("col").cast("double")
    one, none = F.lit(1.0), F.lit(0.0)
    poses = spark.range(512).select(F.col("id").cast("int").alias("col")).withColumn("pose", F.array(none, one, none, c, -one, none, none, c * 2, none, none, one, none, none, none, none, one))
    return projection.dewarp(projection.cartesian(_directed(spark, sf)), poses, ["col"]).select("l_orderkey", "l_linenumber", *[micro(F.col(a)).alias(a) for a in "xyz"])


@query(f"SELECT l_orderkey, l_linenumber, {q6('0.5 * x - y + 3')} AS x, {q6('x + 0.5 * y')} AS y, {q6('z - 1')} AS z FROM {CLOUD}")
def q_transform(spark, sf):
    out = projection.transform(cloud(spark, sf), [0.5, -1.0, 0.0, 3.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, 1.0])
    return out.select("l_orderkey", "l_linenumber", *[micro(F.col(a)).alias(a) for a in "xyz"])


@query("SELECT event_id, (event_id & 7) AS flag, (event_id & 2040) >> 3 AS signal, (event_id & 15) << 4 AS scaled FROM events")
def q_bitfield_decode(spark, sf):
    out = projection.decode(table(spark, sf, "events"), "event_id", {"flag": (7, 0), "signal": (2040, 3), "scaled": (15, -4)})
    return out.select("event_id", "flag", "signal", "scaled")


@query("SELECT event_id, CAST(event_id & 1 = 1 AS BOOLEAN) AS valid, bit_count(event_id) AS bits FROM events")
def q_bit_tests(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.valid(F.col("event_id")).alias("valid"), F.bit_count("event_id").cast("tinyint").alias("bits"))


# ------------------------------------------------------------- voxels

V = "CAST(floor(x * 0.2) AS INTEGER) AS vx, CAST(floor(y * 0.2) AS INTEGER) AS vy, CAST(floor(z * 0.2) AS INTEGER) AS vz"


@query(f"SELECT vx, vy, vz, n, {q6('sx / n')} AS x, {q6('sz / n')} AS z FROM (SELECT vx, vy, vz, count(*) AS n, sum(x) AS sx, sum(z) AS sz FROM (SELECT *, {V} FROM {CLOUD}) GROUP BY vx, vy, vz)")
def q_voxel_avg(spark, sf):
    return agg.voxel_average(cloud(spark, sf), 5.0, ["x", "z"]).withColumns({a: micro(F.col(a)) for a in "xz"})


@query(f"SELECT vx, vy, vz, count(*) AS n FROM (SELECT *, {V} FROM {CLOUD}) GROUP BY vx, vy, vz HAVING count(*) >= 20")
def q_voxel_min_pts(spark, sf):
    return agg.voxel_average(cloud(spark, sf), 5.0, [], 20)


@query(f"SELECT vx, vy, vz, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY {L}) AS rn FROM (SELECT *, {V} FROM {CLOUD})) WHERE rn = 1")
def q_voxel_first(spark, sf):
    return agg.voxel_first(cloud(spark, sf), 5.0, LINE_ORDER, ["x", "y", "z"])


@query(f"SELECT vx, vy, vz, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) AS rn FROM (SELECT *, {V} FROM {CLOUD})) WHERE rn = 1")
def q_voxel_last(spark, sf):
    return agg.voxel_last(cloud(spark, sf), 5.0, LINE_ORDER, ["x", "y", "z"])


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY {L}) AS i FROM (SELECT *, {V} FROM {CLOUD})),
k AS (SELECT vx, vy, vz, x, y, z, i, [x] AS kx, [y] AS ky, [z] AS kz, true AS keep FROM t WHERE i = 1
    UNION ALL SELECT vx, vy, vz, x, y, z, i, CASE WHEN hit THEN list_append(kx, x) ELSE kx END, CASE WHEN hit THEN list_append(ky, y) ELSE ky END, CASE WHEN hit THEN list_append(kz, z) ELSE kz END, hit
    FROM (SELECT t.vx, t.vy, t.vz, t.x, t.y, t.z, t.i, kx, ky, kz, len(kx) < 3 AND list_min(list_transform(range(1, len(kx) + 1), lambda j: power(kx[j] - t.x, 2) + power(ky[j] - t.y, 2) + power(kz[j] - t.z, 2))) >= 25.0::DOUBLE / 3 AS hit
        FROM k JOIN t ON t.vx = k.vx AND t.vy = k.vy AND t.vz = k.vz AND t.i = k.i + 1))
SELECT vx, vy, vz, x, y, z FROM k WHERE keep""")
def q_voxel_spaced(spark, sf):
    return agg.voxel_spaced(cloud(spark, sf), 5.0, LINE_ORDER, 3).select("vx", "vy", "vz", "x", "y", "z")


@query("SELECT CAST(floor(c_acctbal / 100 * 0.2) AS INTEGER) AS vx, 0 AS vy, 0 AS vz, arg_min(c_custkey, [md5('42:' || c_custkey), CAST(c_custkey AS VARCHAR)]) AS i FROM customer GROUP BY 1")
def q_voxel_shuffled(spark, sf):
    return agg.voxel_shuffled(table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), 5.0, "i", 42)


@query(f"SELECT vx, vy, vz, count(*) AS n FROM (SELECT *, {V} FROM {CLOUD}) WHERE (vx - 2) * (vx - 2) + vy * vy + (vz - 4) * (vz - 4) <= 9 GROUP BY vx, vy, vz")
def q_voxel_evict(spark, sf):
    return agg.near_voxels(agg.voxel_average(cloud(spark, sf), 5.0, []), (2, 0, 4), 3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destagger, project, gate, correct for motion, average by voxel."""
    staged = projection.destagger(_directed(spark, sf_dir), 512)
    poses = spark.range(512).select(F.col("id").cast("int").alias("col"))
    x = F.col("col") / 512.0
    one, none = F.lit(1.0), F.lit(0.0)
    poses = poses.withColumn("pose", F.array(one, none, none, x, none, one, none, none, none, none, one, none, none, none, none, one))
    gated = filters.range_gate(projection.cartesian(staged), 1.0, 60.0)
    return agg.voxel_average(projection.dewarp(gated, poses, ["col"]), 0.5, ["x", "y", "z"])


@query(f"""SELECT count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points FROM (SELECT count(*) AS n FROM (
    SELECT range_mm * dx / 1000 + c2 / 512.0 AS x, range_mm * dy / 1000 AS y, range_mm * dz / 1000 AS z FROM (
        SELECT range_mm, col AS c2, {DIRECTION} FROM (SELECT * REPLACE ((col + shift) % 512 AS col) FROM {POINTS}) WHERE range_mm BETWEEN 1000 AND 60000))
    GROUP BY floor(floor(x * 1e9 + 0.5) / 1e9 * 0.5), floor(floor(y * 1e9 + 0.5) / 1e9 * 0.5), floor(floor(z * 1e9 + 0.5) / 1e9 * 0.5))""")
def q_pipeline_points(spark, sf):
    d = projection.beam_direction(F.col("col"), F.col("row") / 10.0, F.col("row") - 16.0, 512)
    staged = projection.destagger(points(spark, sf), 512).withColumns({k: v * 1e-3 for k, v in d.items()} | {k: F.lit(0.0) for k in ("ox", "oy", "oz")})
    xyz = filters.range_gate(projection.cartesian(staged), 1.0, 60.0).withColumn("x", F.col("x") + F.col("col") / 512.0)
    snapped = xyz.withColumns({a: F.floor(F.col(a) * 1e9 + 0.5) / 1e9 for a in "xyz"})
    return agg.voxel_average(snapped, 2.0, []).agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("points"))


# ------------------------------------------------------------- joins


@query(f"""WITH e AS {TRACK}, k AS (SELECT user_id, ts_us, max(milli) AS milli FROM e WHERE event_type = 'view' GROUP BY user_id, ts_us)
SELECT e.event_id, coalesce(b.ts_us, -1) AS t0, coalesce(b.milli, -1) AS v0, coalesce(a.ts_us, -1) AS t1, coalesce(a.milli, -1) AS v1 FROM e
ASOF LEFT JOIN k b ON e.user_id = b.user_id AND e.ts_us >= b.ts_us ASOF LEFT JOIN k a ON e.user_id = a.user_id AND e.ts_us <= a.ts_us WHERE e.event_type <> 'view'""")
def q_pose_asof(spark, sf):
    t = track(spark, sf)
    knots = t.where("event_type = 'view'").groupBy("user_id", "ts_us").agg(F.max("milli").alias("milli"))
    return joins.asof_bracket(t.where("event_type <> 'view'").drop("milli"), knots, "user_id", "ts_us", "milli").select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("t0", "v0", "t1", "v1")])


@query(f"""WITH e AS {TRACK}, k AS (SELECT user_id, ts_us, max(milli) AS milli FROM e WHERE event_type = 'view' GROUP BY user_id, ts_us)
SELECT e.event_id, floor((CASE WHEN a.ts_us = b.ts_us THEN b.milli ELSE b.milli + (a.milli - b.milli) * ((e.ts_us - b.ts_us) / (a.ts_us - b.ts_us)) END) * 1e3 + 0.5) / 1e3 AS value_at FROM e
ASOF LEFT JOIN k b ON e.user_id = b.user_id AND e.ts_us >= b.ts_us ASOF LEFT JOIN k a ON e.user_id = a.user_id AND e.ts_us <= a.ts_us WHERE e.event_type <> 'view'""")
def q_interp_linear(spark, sf):
    t = track(spark, sf)
    knots = t.where("event_type = 'view'").groupBy("user_id", "ts_us").agg(F.max("milli").alias("milli"))
    found = joins.asof_bracket(t.where("event_type <> 'view'").drop("milli"), knots, "user_id", "ts_us", "milli")
    share = (F.col("ts_us") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    value = F.when(F.col("t0") == F.col("t1"), F.col("v0").cast("double")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * share)
    return found.select("event_id", (F.floor(value * 1e3 + 0.5) / 1e3).alias("value_at"))


NN = "(SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 40.0 AS y FROM supplier)"
NC = "(SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 40.0 AS y FROM customer)"


def _plane(spark, sf, name, p):
    return table(spark, sf, name).select(F.col(f"{p}_{'suppkey' if p == 's' else 'custkey'}").alias("id"), F.col(f"{p}_acctbal").alias("x"), (F.col(f"{p}_nationkey") * 40.0).alias("y"))


@query(f"SELECT id, point FROM (SELECT c.id, s.id AS point, row_number() OVER (PARTITION BY c.id ORDER BY (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), s.id) AS rn FROM {NC} c, {NN} s WHERE (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) < 6400) WHERE rn = 1")
def q_nn(spark, sf):
    s = _plane(spark, sf, "supplier", "s").withColumnRenamed("id", "sid")
    return joins.nearest(_plane(spark, sf, "customer", "c"), s, ["x", "y"], 80.0, "id", "sid").select("id", F.col("sid").alias("point"))


@query(f"SELECT a.id AS id, b.id AS candidate FROM {NN} a JOIN {NN} b ON b.id < a.id AND a.id - b.id >= 5 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40000")
def q_loop_candidates(spark, sf):
    poses = _plane(spark, sf, "supplier", "s").withColumn("travelled", F.col("id").cast("double"))
    return joins.loop_candidates(poses, ["x", "y"], 200.0, "id", "travelled", 5.0).select("id", "candidate")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS lidar_n, coalesce(b.n, 0) AS imu_n FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 5 > 0 GROUP BY 1) b ON a.k = b.k")
def q_port_full_join(spark, sf):
    e = table(spark, sf, "events")
    side = lambda kind, m, name: e.where((F.col("event_type") == kind) & (F.col("user_id") % m > 0)).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return joins.stream_ports(side("view", 3, "lidar_n"), side("click", 5, "imu_n"), "k").fillna(0)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def q_unmatched(spark, sf):
    return joins.unmatched(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("k")), "k").select(F.col("k").alias("o_orderkey"))


@query(f'SELECT l_orderkey, l_linenumber, n_name FROM {POINTS} p JOIN nation ON n_nationkey = "row" % 25')
def q_sensor_join(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("sn"), "n_name")
    return joins.with_sensor(points(spark, sf).withColumn("sn", (F.col("row") % 25).cast("int")), n).select("l_orderkey", "l_linenumber", "n_name")


ZONES = "(SELECT CAST(z AS INTEGER) AS zone_id, z * 8000 AS near_mm, z * 8000 + 20000 AS far_mm, CAST(r AS INTEGER) AS \"row\" FROM range(4) a(z), range(32) b(r) WHERE r % 4 <> z)"


def _zones(spark):
    px = spark.range(128).select((F.col("id") / 32).cast("int").alias("zone_id"), (F.col("id") % 32).cast("int").alias("row"))
    return px.where(F.col("row") % 4 != F.col("zone_id")).withColumn("near_mm", F.col("zone_id").cast("long") * 8000).withColumn("far_mm", F.col("near_mm") + 20000)


@query(f"""SELECT zone_id, count(*) FILTER (inside) AS "count", count(*) FILTER (range_mm > 0 AND range_mm <= near_mm) AS occlusion, count(*) FILTER (range_mm = 0 AND near_mm > 0) AS invalid,
    min(range_mm) FILTER (inside) AS min_range, max(range_mm) FILTER (inside) AS max_range, {q6('sum(range_mm) FILTER (inside) / count(*) FILTER (inside)')} AS mean_range
    FROM (SELECT *, range_mm > 0 AND range_mm BETWEEN near_mm AND far_mm AS inside FROM {POINTS} p JOIN {ZONES} z ON p."row" = z."row") GROUP BY zone_id""")
def q_zone_counts(spark, sf):
    return agg.zone_counts(joins.zone_hits(points(spark, sf), _zones(spark), ["row"]), ["zone_id"]).withColumn("mean_range", micro(F.col("mean_range")))


@query(f'SELECT l_orderkey, l_linenumber, CAST(bit_or(CASE WHEN range_mm BETWEEN near_mm AND far_mm THEN CAST(1 AS BIGINT) << zone_id ELSE 0 END) AS BIGINT) AS zone_mask FROM {POINTS} p JOIN {ZONES} z ON p."row" = z."row" GROUP BY l_orderkey, l_linenumber')
def q_zone_bits(spark, sf):
    return agg.zone_bits(joins.zone_hits(points(spark, sf), _zones(spark), ["row"]), ["l_orderkey", "l_linenumber"], "zone_id")


# ------------------------------------------------------------- aggregates


@query("SELECT user_id, count(*) AS packets, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event_id % 1000 = 0) AS missing FROM events GROUP BY user_id")
def q_stats(spark, sf):
    return agg.frame_stats(table(spark, sf, "events").withColumn("size", F.col("event_id") % 1000), ["user_id"], "ts", "size")


@query("SELECT event_type, count(*) AS messages, min(ts) AS start_ts, max(ts) AS end_ts, CAST(sum(event_id % 1000) // count(*) AS BIGINT) AS avg_size FROM events GROUP BY event_type")
def q_stream_stats(spark, sf):
    return agg.stream_stats(table(spark, sf, "events").withColumn("size", F.col("event_id") % 1000), "event_type", "ts", "size")


@query("SELECT event_type, length(props) AS size, count(*) AS n FROM events GROUP BY event_type, length(props)")
def q_stream_hist(spark, sf):
    return agg.histogram(table(spark, sf, "events").withColumn("size", F.length("props").cast("long")), "event_type", "size")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_id % 2 = 1 GROUP BY user_id")
def q_valid_span(spark, sf):
    return agg.valid_span(table(spark, sf, "events"), ["user_id"], "ts", scalar.valid(F.col("event_id")))


@query(f"""SELECT count(*) AS used, floor(sum(range_mm) / count(*) * 0.001 / 46 * 2 * 1e6 + 0.5) / 1e6 AS voxel_size FROM (
    SELECT range_mm, row_number() OVER (PARTITION BY l_suppkey ORDER BY range_mm, {L}) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM {POINTS} WHERE range_mm > 0)
    WHERE i >= ceil(CAST(0.92 AS DOUBLE) * n) AND i <= floor(CAST(0.96 AS DOUBLE) * n)""")
def q_voxel_size_percentile(spark, sf):
    return agg.trimmed_voxel_size(points(spark, sf), "l_suppkey", "range_mm", LINE_ORDER).withColumn("voxel_size", micro(F.col("voxel_size")))


@query("SELECT user_id, ts_us FROM (SELECT user_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM " + TRACK + ") WHERE i = n // 2")
def q_median_col(spark, sf):
    w = Window.partitionBy("user_id")
    t = track(spark, sf).withColumn("i", F.row_number().over(w.orderBy("ts_us", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return t.where(F.col("i") == F.floor(F.col("n") / 2)).select("user_id", "ts_us")


@query("SELECT n_regionkey, md5(string_agg(n_name, '|' ORDER BY n_nationkey)) AS md5, sha256(string_agg(n_name, '|' ORDER BY n_nationkey)) AS sha256 FROM nation GROUP BY n_regionkey")
def q_digest(spark, sf):
    return agg.digest(table(spark, sf, "nation"), ["n_regionkey"], F.col("n_name"), ["n_nationkey"])


W = "pow(2.0 / (2.0 + pow(x * 0.01, 2) + pow(y * 0.02, 2) + pow(0.01 * z, 2)), 2)"


#: The rows of J by coordinate, and the residuals, as SQL.
_J = {"x": ["1", "0", "0", "0", "z", "-y"], "y": ["0", "1", "0", "-z", "0", "x"], "z": ["0", "0", "1", "y", "-x", "0"]}
_R = {"x": "0.01 * x", "y": "0.02 * y", "z": "0.01 * z"}
_SUMS = {f"h{i}{j}": " + ".join(f"({_J[a][i]}) * ({_J[a][j]})" for a in "xyz") for i in range(6) for j in range(i, 6)} | {f"b{i}": " + ".join(f"({_J[a][i]}) * ({_R[a]})" for a in "xyz") for i in range(6)}


@query(f"SELECT n, {', '.join(f'CAST(round({k} / 10) AS BIGINT) AS {k}' for k in _SUMS)} FROM (SELECT count(*) AS n, {', '.join(f'sum({W} * ({v})) AS {k}' for k, v in _SUMS.items())} FROM {CLOUD})")
def q_linear_system(spark, sf):
    c = cloud(spark, sf).select(*[F.col(a).alias(f"p{a}") for a in "xyz"], (F.col("x") * 0.99).alias("qx"), (F.col("y") * 0.98).alias("qy"), (F.col("z") * 0.99).alias("qz"))
    s = agg.linear_system(c, 2.0)
    return s.select("n", *[F.round(F.col(k) / 10).cast("long").alias(k) for k in _SUMS])


@query(f"""SELECT CAST(floor(c_acctbal / 500) AS INTEGER) AS vx, CAST(slot AS INTEGER) AS slot, arg_max(c_custkey, c_custkey) AS c_custkey FROM (
    WITH RECURSIVE r(k, v) AS (SELECT CAST(0 AS BIGINT), CAST(42 AS BIGINT) UNION ALL SELECT k + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT k, xor(b, b >> 17) AS c FROM (SELECT k, xor(v, (v << 13) & 4294967295) AS b FROM r WHERE k < (SELECT count(*) FROM customer)))),
    p AS (SELECT c_custkey, c_acctbal, row_number() OVER (PARTITION BY floor(c_acctbal / 500) ORDER BY c_custkey) - 1 AS i FROM customer),
    q AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS k FROM p WHERE i >= 3)
    SELECT c_custkey, c_acctbal, i AS slot FROM p WHERE i < 3 UNION ALL SELECT c_custkey, c_acctbal, (v * 3) >> 32 FROM q JOIN r USING (k)) GROUP BY 1, 2""")
def q_voxel_random(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return agg.voxel_random(c, 500.0, ["c_custkey"], ["c_custkey"], 3).select("vx", "slot", "c_custkey")


@query("SELECT vx, vy, vz FROM (SELECT CAST(floor(l_quantity * 0.2) AS INTEGER) AS vx, CAST(floor(l_discount * 100 * 0.2) AS INTEGER) AS vy, CAST(floor(l_extendedprice / 1000 * 0.2) AS INTEGER) AS vz FROM lineitem GROUP BY 1, 2, 3) WHERE (vx - 2) * (vx - 2) + vy * vy + (vz - 4) * (vz - 4) > 9")
def q_voxel_evicted(spark, sf):
    return agg.evicted(agg.voxel_average(cloud(spark, sf), 5.0, []), (2, 0, 4), 3)[1].select("vx", "vy", "vz")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def q_voxel_custom(spark, sf):
    """A bucket of a user's own."""
    import pandas as pd

    p = table(spark, sf, "part").select("p_size", F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return agg.voxel_custom(p, 1.0, lambda t: pd.DataFrame({"p_size": t["p_size"].iloc[:1], "n": [len(t)]}), "p_size int, n long")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN y * 2 BETWEEN 2 AND 5 THEN 0 ELSE z END AS RANGE, CASE WHEN y BETWEEN 2 AND 5 THEN 0 ELSE z END AS RANGE2 FROM {CLOUD}")
def q_filter_frames(spark, sf):
    """Coordinates of another frame, and of the second return."""
    c = cloud(spark, sf).select("l_orderkey", "l_linenumber", F.col("z").alias("RANGE"), F.col("z").alias("RANGE2"), (F.col("y") * 2).alias("body_y"), F.col("y").alias("body_y2"))
    return filters.filter_xyz(c, "y", 2, 5, ["RANGE", "RANGE2"], frame="body_").select("l_orderkey", "l_linenumber", "RANGE", "RANGE2")


# ------------------------------------------------------------- sequences


@query(f"SELECT event_id, coalesce(CASE WHEN d > 32768 THEN d - 65536 ELSE d END, 0) AS step FROM (SELECT event_id, ((f - lag(f) OVER (PARTITION BY user_id ORDER BY ts_us, event_id)) % 65536 + 65536) % 65536 AS d FROM (SELECT *, (event_id * 977) % 65536 AS f FROM {TRACK}))")
def q_frame_id_diff(spark, sf):
    t = track(spark, sf).withColumn("f", F.col("event_id") * 977 % 65536)
    return windows.frame_steps(t, "user_id", ["ts_us", "event_id"], "f").select("event_id", F.coalesce("step", F.lit(0)).alias("step"))


@query(f"SELECT event_id, CAST(sum(abs(milli - p)) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS travelled FROM (SELECT *, coalesce(lag(milli) OVER (PARTITION BY user_id ORDER BY ts_us, event_id), milli) AS p FROM {TRACK})")
def q_distance_travelled(spark, sf):
    out = windows.distance_travelled(track(spark, sf), "user_id", ["ts_us", "event_id"], ["milli"])
    return out.select("event_id", F.col("travelled").cast("long").alias("travelled"))


@query(f"SELECT user_id, {q6('list_reduce(list(CAST(milli AS DOUBLE) ORDER BY ts_us, event_id), lambda a, x: a * 0.75 + x * 0.25)')} AS smoothed FROM {TRACK} GROUP BY user_id")
def q_ema(spark, sf):
    t = track(spark, sf).withColumn("v", F.col("milli").cast("double"))
    return windows.smoothed(t, "user_id", ["ts_us", "event_id"], "v", 0.75).withColumn("smoothed", micro(F.col("smoothed")))


@query(f"SELECT event_id, coalesce(ts_us < max(ts_us) OVER w, false) AS late FROM {TRACK} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def q_monotonic(spark, sf):
    return windows.out_of_order(track(spark, sf), "user_id", ["event_id"], "ts_us").select("event_id", "late")


@query(f"""WITH h AS (SELECT event_id, user_id, ts_us, milli >= 30000 AS hit FROM {TRACK}),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM h),
t AS (SELECT event_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS trigger FROM g)
SELECT event_id, CAST(trigger AS BIGINT) AS "trigger", CAST(greatest(0, trigger - 2) AS BIGINT) AS alert FROM t""")
def q_zone_trigger_run(spark, sf):
    out = windows.trigger_runs(track(spark, sf), "user_id", ["ts_us", "event_id"], F.col("milli") >= 30000, 3)
    return out.select("event_id", "trigger", "alert")


@query(f"SELECT event_id, max(ts_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fixed FROM {TRACK}")
def q_time_correction(spark, sf):
    return windows.corrected_time(track(spark, sf), "user_id", ["event_id"], "ts_us").select("event_id", "fixed")


@query(f"""WITH g AS (SELECT CAST(l_suppkey % 4 AS BIGINT) AS frame_id, CAST(l_orderkey % 16 AS INTEGER) AS r, CAST(l_partkey % 32 AS INTEGER) AS c, CAST(max(floor(l_extendedprice)) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT frame_id, r, c, coalesce(v - lag(v) OVER (PARTITION BY frame_id, c ORDER BY r), 0) AS d FROM g),
m AS (SELECT frame_id, r, d FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, r ORDER BY d, c) AS i, count(*) OVER (PARTITION BY frame_id, r) AS n FROM d) WHERE i = n // 2 + 1),
s AS (SELECT frame_id, r, sum(d) OVER (PARTITION BY frame_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS level FROM m),
l AS (SELECT frame_id, regr_slope(level, r) AS a, regr_intercept(level, r) AS b FROM s GROUP BY frame_id),
x AS (SELECT frame_id, r, level - (a * r + b) AS rest FROM s JOIN l USING (frame_id))
SELECT frame_id, r AS "row", floor((rest - min(rest) OVER (PARTITION BY frame_id)) * 1e3 + 0.5) / 1e3 AS "offset" FROM x""")
def q_row_median_cumsum(spark, sf):
    g = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("frame_id"), (F.col("l_orderkey") % 16).cast("int").alias("row"), (F.col("l_partkey") % 32).cast("int").alias("col"))
    out = windows.row_offsets(g.agg(F.max(F.floor("l_extendedprice")).cast("double").alias("v")), "v")
    return out.withColumn("offset", F.floor(F.col("offset") * 1e3 + 0.5) / 1e3)


# ------------------------------------------------------------- scalar functions


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) * 1000) % 1000000000 AS VARCHAR), 9, '0') AS text FROM events")
def q_ns_to_string(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.ns_to_string(epoch_us(F.col("ts")) * 1000).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))




# ------------------------------------------------------------- packets, frames and sets


def _packets(spark, sf):
    """Events as packets of four sensors: frames of six hours, numbered from each sensor's clock, columns by type."""
    t = table(spark, sf, "events").select("event_id", "user_id", "event_type", epoch_us(F.col("ts")).alias("ts_us"))
    return t.select(
        (F.col("user_id") % 4).cast("int").alias("sensor_idx"),
        F.lit(0).cast("long").alias("init_id"),
        F.pmod(F.floor(F.col("ts_us") / 21_600_000_000), F.lit(65536)).alias("frame_id"),
        F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(8)).cast("int").alias("packet_no"),
        (F.col("ts_us") * 1000).alias("host_ts"),
        F.col("event_id").alias("seq"),
    )


@query("""SELECT CAST(user_id % 4 AS INTEGER) AS sensor_idx, CAST((epoch_us(ts) // 21600000000) % 65536 AS BIGINT) AS frame_id, count(*) AS packets, count(DISTINCT event_type) AS distinct_packets,
    min(epoch_us(ts) * 1000) AS first_ts, max(epoch_us(ts) * 1000) AS last_ts FROM events GROUP BY 1, 2""")
def q_frame_batch(spark, sf):
    return batcher.batch_summary(_packets(spark, sf)).drop("init_id")


@query()
def q_batch_exact(spark, sf):
    return batcher.batch_exact(_packets(spark, sf), expected=5)


@query("""WITH RECURSIVE f AS (SELECT CAST(user_id % 4 AS INTEGER) AS sensor_idx, CAST((epoch_us(ts) // 21600000000) % 65536 AS BIGINT) AS frame_id, max(epoch_us(ts) * 1000) AS ts FROM events GROUP BY 1, 2),
t AS (SELECT frame_id // 16 AS session, sensor_idx, frame_id, ts, row_number() OVER (PARTITION BY frame_id // 16 ORDER BY ts, sensor_idx) AS i FROM f),
s AS (SELECT session, sensor_idx, frame_id, i, CAST(0 AS BIGINT) AS set_id, CAST(0 AS BIGINT) AS closed, ts AS first_ts, [sensor_idx] AS slots FROM t WHERE i = 1
    UNION ALL SELECT session, sensor_idx, frame_id, i, mine, CASE WHEN len(held) = 4 THEN mine + 1 ELSE mine END, CASE WHEN len(held) = 4 THEN NULL ELSE begun END, CASE WHEN len(held) = 4 THEN [] ELSE held END
    FROM (SELECT t.session, t.sensor_idx, t.frame_id, t.i, s.closed + CASE WHEN flush THEN 1 ELSE 0 END AS mine, CASE WHEN flush OR s.first_ts IS NULL THEN t.ts ELSE s.first_ts END AS begun, CASE WHEN flush THEN [t.sensor_idx] ELSE list_append(s.slots, t.sensor_idx) END AS held
        FROM (SELECT s.*, t.sensor_idx AS ns, t.ts AS nts, (coalesce(t.ts >= s.first_ts + 10800000000000, false) OR list_contains(s.slots, t.sensor_idx)) AND len(s.slots) > 0 AS flush FROM s JOIN t ON t.session = s.session AND t.i = s.i + 1) s JOIN t ON t.session = s.session AND t.i = s.i + 1))
SELECT session, set_id, sensor_idx, frame_id FROM s""")
def q_collate(spark, sf):
    frames = batcher.batch_summary(_packets(spark, sf)).select(F.floor(F.col("frame_id") / 16).alias("session"), "sensor_idx", "frame_id", F.col("last_ts").alias("ts"))
    return collator.collate(frames, "session", sensors=4, dt=10_800_000_000_000)


# ------------------------------------------------------------- kernels on whole frames


def _three(f: str) -> str:
    return ", ".join(f.format(a=a) for a in "xyz")


@query(f"""WITH g AS (SELECT l_suppkey % 8 AS frame_id, "row", col, range_mm * 0.001 AS m, row_number() OVER (PARTITION BY l_suppkey % 8, "row", col ORDER BY {L}) AS i FROM {POINTS}),
d AS (SELECT *, {DIRECTION} FROM g WHERE i = 1),
p AS (SELECT frame_id, "row", col, {_three("m * d{a} AS {a}")} FROM d),
n AS (SELECT p.*, sqrt(p.x * p.x + p.y * p.y + p.z * p.z) AS far, {", ".join(f"{k}.{a} - p.{a} AS {k}{a}" for k in ("u", "w", "r", "l") for a in "xyz")} FROM p
    LEFT JOIN p u ON u.frame_id = p.frame_id AND u.col = p.col AND u."row" = p."row" + 1 AND (u.x <> 0 OR u.y <> 0 OR u.z <> 0) LEFT JOIN p w ON w.frame_id = p.frame_id AND w.col = p.col AND w."row" = p."row" - 1 AND (w.x <> 0 OR w.y <> 0 OR w.z <> 0)
    LEFT JOIN p r ON r.frame_id = p.frame_id AND r."row" = p."row" AND r.col = (p.col + 1) % 512 AND (r.x <> 0 OR r.y <> 0 OR r.z <> 0) LEFT JOIN p l ON l.frame_id = p.frame_id AND l."row" = p."row" AND l.col = (p.col + 511) % 512 AND (l.x <> 0 OR l.y <> 0 OR l.z <> 0)),
k AS (SELECT *, {", ".join(f"coalesce(sqrt({k}x * {k}x + {k}y * {k}y + {k}z * {k}z), 1e300) AS d{k}" for k in ("u", "w", "r", "l"))} FROM n WHERE far > 0),
v AS (SELECT *, {_three("-{a} / far AS q{a}")}, least(du, dw) <= 10 AS has_v, least(dr, dl) <= 10 AS has_h, {_three("CASE WHEN du <= dw THEN u{a} ELSE -w{a} END AS v{a}")}, {_three("CASE WHEN dr <= dl THEN r{a} ELSE -l{a} END AS h{a}")} FROM k),
o AS (SELECT *, {_three("CASE WHEN has_v THEN v{a} ELSE h{a} END AS o{a}")}, hy * vz - hz * vy AS cx, hz * vx - hx * vz AS cy, hx * vy - hy * vx AS cz FROM v),
f AS (SELECT *, (qx * ox + qy * oy + qz * oz) / (ox * ox + oy * oy + oz * oz) AS s, CASE WHEN cx * qx + cy * qy + cz * qz < 0 THEN -1 ELSE 1 END AS way FROM o),
e AS (SELECT frame_id, "row", col, {_three("CASE WHEN has_v AND has_h THEN way * c{a} WHEN has_v OR has_h THEN q{a} - s * o{a} ELSE q{a} END AS e{a}")} FROM f)
SELECT frame_id, "row", col, {_three("floor(e{a} / sqrt(ex * ex + ey * ey + ez * ez) * 1e4 + 0.5) / 1e4 AS n{a}")} FROM e""")
def q_normals(spark, sf):
    p = projection.cartesian(_directed(spark, sf)).withColumn("frame_id", F.col("l_suppkey") % 8)
    one = p.groupBy("frame_id", "row", "col").agg(F.min_by(F.struct("x", "y", "z"), F.struct(*LINE_ORDER)).alias("p")).select("frame_id", "row", "col", "p.*")
    n = images.normals(one, 32, 512, reach=10.0).where("nx <> 0 or ny <> 0 or nz <> 0")
    return n.select("frame_id", "row", "col", *[(F.floor(F.col(a) * 1e4 + 0.5) / 1e4).alias(a) for a in ("nx", "ny", "nz")])


@query(f"""WITH RECURSIVE p AS (SELECT l_suppkey % 8 AS frame_id, l_orderkey AS point_id, l_linenumber, z, floor(x / 5) AS i, floor(y / 5) AS j FROM {CLOUD}),
c AS (SELECT frame_id, i, j, z FROM (SELECT frame_id, i, j, z, row_number() OVER (PARTITION BY frame_id, i, j ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY frame_id, i, j) AS n FROM p) WHERE k = floor(0.15::DOUBLE * (n - 1))),
r(frame_id, i, j) AS (SELECT frame_id, arg_min(i, [z, i, j]), arg_min(j, [z, i, j]) FROM c GROUP BY 1
    UNION SELECT b.frame_id, b.i, b.j FROM r JOIN c a ON a.frame_id = r.frame_id AND a.i = r.i AND a.j = r.j JOIN c b ON b.frame_id = a.frame_id AND abs(b.i - a.i) + abs(b.j - a.j) = 1 AND b.z - a.z <= 0.3::DOUBLE * 5)
SELECT p.frame_id, p.point_id, p.l_linenumber, CAST(CASE WHEN r.frame_id IS NOT NULL AND p.z - c.z <= 0.3 THEN 1 ELSE 0 END AS SMALLINT) AS ground FROM p JOIN c USING (frame_id, i, j) LEFT JOIN r ON r.frame_id = p.frame_id AND r.i = p.i AND r.j = p.j""")
def q_ground(spark, sf):
    p = cloud(spark, sf).select((F.col("l_suppkey") % 8).alias("frame_id"), F.col("l_orderkey").alias("point_id"), "l_linenumber", "x", "y", "z")
    return images.ground(p, cell=5.0).select("frame_id", "point_id", "l_linenumber", "ground")


@query(f"""WITH g AS (SELECT l_suppkey % 4 AS frame_id, "row", col % 64 AS col, max(l_extendedprice) AS v FROM {POINTS} GROUP BY 1, 2, 3),
px AS (SELECT f.frame_id, r AS "row", c AS col, coalesce(v, 0) AS v, g.v IS NOT NULL AS seen FROM (SELECT DISTINCT frame_id FROM g) f CROSS JOIN range(32) a(r) CROSS JOIN range(64) b(c) LEFT JOIN g ON g.frame_id = f.frame_id AND g."row" = r AND g.col = c),
lim AS (SELECT frame_id, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.995) AS b FROM px WHERE ("row" * 64 + col) % 4 = 0 AND v > 0 GROUP BY 1),
e AS (SELECT px.*, least(255, greatest(0, floor(least(1.0, greatest(0.0, (v - a) / greatest(b - a, 1e-12))) * 256))) AS level FROM px JOIN lim USING (frame_id)),
h AS (SELECT frame_id, "row" // 4 AS i, col // 8 AS j, level AS k, count(*) AS n FROM e GROUP BY 1, 2, 3, 4),
o AS (SELECT frame_id, i, j, sum(greatest(n - 1, 0)) AS over FROM h GROUP BY 1, 2, 3),
p AS (SELECT *, least(7, greatest(0, ("row" - 1.5) / 4)) AS y, least(7, greatest(0, (col - 3.5) / 8)) AS x FROM e WHERE seen),
w AS (SELECT frame_id, "row", col, level, floor(y) + dy AS i, floor(x) + dx AS j, (CASE dy WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE dx WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS share FROM p CROSS JOIN range(2) a(dy) CROSS JOIN range(2) b(dx)),
m AS (SELECT w.frame_id, w."row", w.col, w.share, ((w.level + 1) * any_value(o.over) / 256 + coalesce(sum(least(h.n, 1)) FILTER (h.k <= w.level), 0)) / 32 AS v FROM w JOIN o ON o.frame_id = w.frame_id AND o.i = w.i AND o.j = w.j JOIN h ON h.frame_id = w.frame_id AND h.i = w.i AND h.j = w.j GROUP BY w.frame_id, w."row", w.col, w.share, w.level, w.i, w.j)
SELECT frame_id, "row", CAST(col AS INTEGER) AS col, floor(sum(share * v) * 1e4 + 0.5) / 1e4 AS shown FROM m WHERE share > 0 GROUP BY 1, 2, 3""")
def q_clahe(spark, sf):
    g = points(spark, sf).groupBy((F.col("l_suppkey") % 4).alias("frame_id"), "row", (F.col("col") % 64).alias("col")).agg(F.max("l_extendedprice").alias("v"))
    return images.equalised(g, "v", 32, 64).withColumn("shown", F.floor(F.col("shown") * 1e4 + 0.5) / 1e4).withColumn("row", F.col("row").cast("long"))


@query("""WITH RECURSIVE p AS (SELECT CAST(c_custkey % 16 AS INTEGER) AS f, c_acctbal / 10 AS x, CAST(c_nationkey AS DOUBLE) AS y, floor(c_acctbal / 10 / 0.8::DOUBLE) AS cx, floor(c_nationkey / 0.8::DOUBLE) AS cy FROM customer),
c AS (SELECT DISTINCT f, cx, cy FROM p), e AS (SELECT a.f, a.cx, a.cy, b.cx AS dx, b.cy AS dy FROM c a JOIN c b ON a.f = b.f AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
r(f, cx, cy, ox, oy) AS (SELECT f, cx, cy, cx, cy FROM c UNION SELECT r.f, r.cx, r.cy, e.dx, e.dy FROM r JOIN e ON r.f = e.f AND r.ox = e.cx AND r.oy = e.cy),
l AS (SELECT f, cx, cy, min([ox, oy]) AS o FROM r GROUP BY 1, 2, 3)
SELECT p.f AS frame_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, 0.0::DOUBLE AS z_min, 0.0::DOUBLE AS z_max, count(*) AS n FROM p JOIN l USING (f, cx, cy) GROUP BY p.f, o""")
def q_clusters(spark, sf):
    """Euclidean clustering, an extension: detections of the open operators' interface."""
    p = table(spark, sf, "customer").select((F.col("c_custkey") % 16).cast("int").alias("frame_id"), F.col("c_custkey").alias("point_id"), (F.col("c_acctbal") / 10).alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return images.clusters(p, 0.8).drop("object_id")


@query()
def q_icp(spark, sf):
    target = cloud(spark, sf).select(F.monotonically_increasing_id().alias("id"), "x", "y", "z")
    source = projection.transform(target, [1.0, 0.0, 0.0, 0.05, 0.0, 1.0, 0.0, -0.04, 0.0, 0.0, 1.0, 0.03, 0.0, 0.0, 0.0, 1.0])
    box = target.agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()
    # the edge of a cell that holds one point of an even cloud, but more than the shift of 0.07
    reach = max(0.1, (box["x"] * box["y"] * box["z"] / box["n"]) ** (1 / 3)) if box["n"] else 0.1
    pose = registration.align(source, target, reach, 1.0)
    return spark.createDataFrame([(i, j, float(pose[i, j])) for i in range(4) for j in range(4)], "r int, c int, v double")


# the other parts of the catalogue register themselves
from beamframe import catalogue_more, catalogue_sensors, catalogue_tracks  # noqa: E402, F401
