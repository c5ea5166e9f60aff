"""As-of lookups, spatial neighbours, zones and stream matching.

Spatial joins meet by grid cell: a distance predicate alone would be a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_bracket(events: DataFrame, knots: DataFrame, key: str, ts: str, value: str, span: int | None = None) -> DataFrame:
    """Each event with the knots at or before and at or after it: t0, v0, t1, v1 (null outside).

    One union and one sort per key instead of a range join, in time linear in the rows;
    knots have unique times per key. With ``span`` a key is cut in buckets of that much
    time, each sorted by a task of its own; the knots next to a bucket are carried in, so
    results are the same and a key may hold any share of the rows.
    """
    kinds = dict(knots.dtypes)
    bucket = F.floor(F.col(ts) / span).cast("long") if span else F.lit(0).cast("long")
    both = events.withColumn("_knot", F.lit(None).cast(f"struct<t:{kinds[ts]},v:{kinds[value]}>")).unionByName(
        knots.select(key, ts, F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_knot")), allowMissingColumns=True
    ).withColumn("_bucket", bucket)
    w = Window.partitionBy(key, "_bucket")
    found = both.withColumn("_b", F.last("_knot", True).over(w.orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.withColumn("_a", F.last("_knot", True).over(w.orderBy(F.desc(ts)).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.where("_knot is null")
    if span:
        ends = both.groupBy(key, "_bucket").agg(F.max("_knot.t").alias("high"), F.min("_knot.t").alias("low"), F.max_by("_knot", "_knot.t").alias("last"), F.min_by("_knot", "_knot.t").alias("first"))
        per_key = Window.partitionBy(key)
        ends = ends.withColumn("_before", F.last("last", True).over(per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        ends = ends.withColumn("_after", F.last("first", True).over(per_key.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)))
        found = found.join(ends.select(key, "_bucket", "_before", "_after"), [key, "_bucket"]).withColumn("_b", F.coalesce("_b", "_before")).withColumn("_a", F.coalesce("_a", "_after"))
    return found.select(*events.columns, F.col("_b.t").alias("t0"), F.col("_b.v").alias("v0"), F.col("_a.t").alias("t1"), F.col("_a.v").alias("v1"))


def interpolate(bracketed: DataFrame, ts: str) -> DataFrame:
    """Linear value between the two knots of ``asof_bracket``; at a knot its value; null outside."""
    span = F.col("t1") - F.col("t0")
    return bracketed.withColumn("value_at", F.when(span == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(ts) - F.col("t0")) / span))


def _cells(df: DataFrame, axes: list[str], size: float, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": F.floor(F.col(a) / size).cast("long") for i, a in enumerate(axes)})


def cell_pairs(queries: DataFrame, points: DataFrame, axes: list[str], size: float, on: list[str] = ()) -> DataFrame:
    """Pairs of a query and the points of its own and neighbouring cells; point columns get the prefix p_."""
    q = _cells(queries, axes, size, "c")
    for i in range(len(axes)):
        q = q.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + d for d in (-1, 0, 1)])))
    p = _cells(points, axes, size, "c")
    cells = [f"c{i}" for i in range(len(axes))]
    p = p.select(*[F.col(c) if c in cells or c in on else F.col(c).alias(f"p_{c}") for c in p.columns])
    return q.join(p, [*on, *cells]).drop(*cells)


def _distance2(axes: list[str]):  # noqa: ANN202
    return sum(((F.col(a) - F.col(f"p_{a}")) * (F.col(a) - F.col(f"p_{a}")) for a in axes), F.lit(0.0))


def nearest(queries: DataFrame, points: DataFrame, axes: list[str], size: float, query: str, point: str, on: list[str] = ()) -> DataFrame:
    """The nearest point of each query that is nearer than ``size``, ties by the point's id; others are left out."""
    pairs = cell_pairs(queries, points, axes, size, on).withColumn("d2", _distance2(axes)).where(F.col("d2") < size * size)
    return pairs.groupBy(query).agg(F.min(F.struct("d2", f"p_{point}")).alias("m")).select(query, F.col(f"m.p_{point}").alias(point), "m.d2")


def loop_candidates(poses: DataFrame, axes: list[str], size: float, index: str, travelled: str, apart: float, on: list[str] = ()) -> DataFrame:
    """Earlier poses in reach that lie at least ``apart`` back on the path, by distance and index."""
    pairs = cell_pairs(poses, poses, axes, size, on).where((F.col(f"p_{index}") < F.col(index)) & (F.col(travelled) - F.col(f"p_{travelled}") >= apart))
    return pairs.withColumn("d2", _distance2(axes)).where(F.col("d2") <= size * size).select(*on, index, F.col(f"p_{index}").alias("candidate"), "d2")


def with_columns_of(points: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Header values of a column on all its pixels."""
    return points.join(columns, keys)


def with_sensor(frames: DataFrame, sensors: DataFrame, key: str = "sn") -> DataFrame:
    """Sensor metadata by serial number; Spark broadcasts it only below its size limit."""
    return frames.join(sensors, key)


def stream_ports(lidar: DataFrame, imu: DataFrame, key: str) -> DataFrame:
    """Lidar and imu streams of one source side by side; one may lack the other."""
    return lidar.join(imu, key, "full")


def guessed_ports(lidar: DataFrame, imu: DataFrame, key: str, lidar_port: int = 0, imu_port: int = 0) -> DataFrame:
    """(key, lidar_port, imu_port) that a source's streams may use: every pairing of its lidar and imu streams, one of them null where it has none; ports that the metadata names (not 0) must be met where a stream is there."""
    both = stream_ports(lidar.select(key, F.col("port").alias("lidar_port")).distinct(), imu.select(key, F.col("port").alias("imu_port")).distinct(), key)
    for name, port in (("lidar_port", lidar_port), ("imu_port", imu_port)):
        if port:
            both = both.where(F.col(name).isNull() | (F.col(name) == port))
    return both


def unmatched(packets: DataFrame, sensors: DataFrame, key: str) -> DataFrame:
    return packets.join(sensors.select(key).distinct(), key, "left_anti")


def zone_hits(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel with the zones that are rendered at it."""
    return points.join(zones, keys)


def ray_hits(rays: DataFrame, triangles: DataFrame, cell_deg: float = 2.0, edge: Column | None = None, slack: float = 1e-9) -> DataFrame:
    """Nearest and farthest positive hit of each ray (from the origin) on a triangle mesh.

    Rays and triangles meet by direction cell: a triangle is listed in every cell of
    the azimuth/elevation box of its bounding sphere, so only rays that can hit it are
    tested. A single hit counts from 0. Equal directions and equal triangles are tested
    once. Nearer to a triangle's edge than ``slack`` (a share of its size) rounding
    decides: there ``edge`` counts, if given, a condition on dx ... dz and v0x ... v2z.
    """
    def cross(a: list, b: list) -> list:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a: list, b: list):  # noqa: ANN202
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    v = [[F.col(f"v{i}{a}") for a in "xyz"] for i in range(3)]
    centre = [(v[0][k] + v[1][k] + v[2][k]) / 3 for k in range(3)]
    reach = F.sqrt(F.greatest(*[dot([p[k] - centre[k] for k in range(3)], [p[k] - centre[k] for k in range(3)]) for p in v]))
    far = F.sqrt(dot(centre, centre))
    half = F.when(reach >= far, F.lit(180.0)).otherwise(F.degrees(F.asin(reach / F.nullif(far, F.lit(0.0)))))
    az, el = F.degrees(F.atan2(centre[1], centre[0])), F.degrees(F.asin(centre[2] / F.nullif(far, F.lit(0.0))))
    top = F.abs(F.coalesce(el, F.lit(90.0))) + F.coalesce(half, F.lit(180.0))
    wide = F.when(top >= 89.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(half)) / F.cos(F.radians(el))))))
    cells = int(360 / cell_deg)
    span = lambda mid, by: F.sequence(F.floor((mid - by) / cell_deg), F.floor((mid + by) / cell_deg))
    distinct = triangles.groupBy(*[f"v{i}{a}" for i in range(3) for a in "xyz"]).agg(F.count(F.lit(1)).alias("n"))
    t = distinct.withColumn("ca", F.explode(F.array_distinct(F.transform(span(F.coalesce(az, F.lit(0.0)), F.coalesce(wide, F.lit(180.0))), lambda c: F.pmod(c, F.lit(cells))))))
    t = t.withColumn("ce", F.explode(span(F.coalesce(el, F.lit(0.0)), F.coalesce(half, F.lit(180.0)))))
    r = rays.select("dx", "dy", "dz").distinct().withColumn("ca", F.pmod(F.floor(F.degrees(F.atan2("dy", "dx")) / cell_deg), F.lit(cells))).withColumn("ce", F.floor(F.degrees(F.asin(F.col("dz") / F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))) / cell_deg))
    d = [F.col("dx"), F.col("dy"), F.col("dz")]
    e1, e2 = [[v[i][k] - v[0][k] for k in range(3)] for i in (1, 2)]
    h = cross(d, e2)
    det = dot(e1, h)
    s = [-x for x in v[0]]
    u = dot(s, h) / det
    q = cross(s, e1)
    w, at = dot(d, q) / det, dot(e2, q) / det
    near = lambda by: (u >= by) & (w >= by) & (u + w <= 1 - by)
    hit = (F.abs(det) > 1e-12) & (at > 0) & (near(0) if edge is None else near(slack) | near(-slack) & edge)
    found = r.join(t, ["ca", "ce"]).where(hit).withColumn("at", at)
    found = found.groupBy("dx", "dy", "dz").agg(F.sum("n").alias("n"), F.min("at").alias("near"), F.max("at").alias("far"))
    g = rays.select("row", "col", "dx", "dy", "dz").join(found, ["dx", "dy", "dz"]).groupBy("row", "col")
    return g.agg(F.when(F.sum("n") == 1, F.lit(0.0)).otherwise(F.min("near")).alias("near"), F.max("far").alias("far"))


def objects_at(objects: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Objects anchored to the pose of their frame's column nearest before their time."""
    ahead = objects.join(columns.where(F.col("status").bitwiseAND(1) == 1).select(*keys, F.col("ts_ns").alias("col_ts"), "pose"), keys).where("col_ts <= ts_ns")
    ids = [*keys, "object_id"]
    return ahead.groupBy(*ids).agg(F.max_by("pose", "col_ts").alias("body_to_world"))
