"""Small tables that show what went wrong on large ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe import catalogue
from beamframe.operators import registration
from beamframe.operators.selection import numbered
from beamframe.sources import store
from tests.compare import same

SF = "/root/testdata/sf0.001"


def with_more(folder, name, **add):
    """A folder with the first 300 rows of a table, and the same rows again with larger keys."""
    few = f"(SELECT * FROM '{SF}/{name}.parquet' LIMIT 300)"
    more = ", ".join(f"{k} + {v} AS {k}" for k, v in add.items())
    duckdb.connect().execute(f"COPY (SELECT * FROM {few} UNION ALL SELECT * REPLACE ({more}) FROM {few}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_numbers_follow_the_order_of_many_rows(spark):
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("v"), F.col("id").alias("more"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(rows, ["v"])
        assert got.count() == 300_000 and got.where("seq <> v or more * 7919 % 300000 <> v").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_changes_of_a_chunk_do_not_cancel(spark):
    chunk = lambda *v: spark.createDataFrame([(1, x) for x in v], "k long, v long")
    assert [r["k"] for r in store.damaged(chunk(1, 523), store.checksums(chunk(0, 522), ["k"]), ["k"]).collect()] == [1]  # sums of their CRC32 are equal
    assert store.damaged(chunk(522, 0), store.checksums(chunk(0, 522), ["k"]), ["k"]).count() == 0


def test_a_change_of_microseconds_is_damage(spark):
    at = lambda t: spark.sql(f"SELECT 1 AS k, timestamp_micros({t}) AS t, CAST(timestamp_micros({t}) AS timestamp_ntz) AS u")
    one = store.checksums(at(1_700_000_000_000_001), ["k"])
    assert store.damaged(at(1_700_000_000_000_002), one, ["k"]).count() == 1 and store.damaged(at(1_700_000_000_000_001), one, ["k"]).count() == 0


def test_frame_ids_beyond_16_bits(spark, tmp_path):
    sf = with_more(tmp_path, "events", event_id=64 * 65536)
    same(catalogue.queries()["q_frame_headers"](spark, sf), catalogue.oracle_sql()["q_frame_headers"], sf)


def test_frames_of_the_same_wrapped_id_stay_apart(spark, tmp_path):
    sf = with_more(tmp_path, "lineitem", l_orderkey=65536 * 97)
    same(catalogue.queries()["q_frame_packets"](spark, sf), catalogue.oracle_sql()["q_frame_packets"], sf)


def test_mean_ranges_beyond_19_bits(spark, tmp_path):
    sf = with_more(tmp_path, "events", event_id=1000, user_id=5_000_000_000)
    same(catalogue.queries()["q_zone_packets"](spark, sf), catalogue.oracle_sql()["q_zone_packets"], sf)


def test_rays_that_meet_an_edge(spark, tmp_path):
    duckdb.connect().execute(f"""COPY (SELECT CAST(range AS BIGINT) AS s_suppkey FROM range(703)) TO '{tmp_path}/supplier.parquet'""")
    duckdb.connect().execute(f"""COPY (SELECT CAST(k AS BIGINT) AS p_partkey, CAST(s AS INTEGER) AS p_size FROM range(800) a(k), range(1, 51) b(s)) TO '{tmp_path}/part.parquet'""")
    same(catalogue.queries()["q_ray_hits"](spark, str(tmp_path)), catalogue.oracle_sql()["q_ray_hits"], str(tmp_path))


def test_nearest_rows_against_brute_force():
    own = np.random.default_rng(3)
    for edge in (0.5, 7.0):
        p, q = own.integers(-4, 5, (400, 3)) / 2.0, own.integers(-4, 5, (300, 3)) + own.integers(0, 2, (300, 3)) / 4.0
        d2 = ((p[:, None] - q[None]) ** 2).sum(axis=2)
        assert registration.nearest_rows(p, q, edge).tolist() == np.where(d2.min(axis=1) < edge * edge, d2.argmin(axis=1), -1).tolist()


@pytest.mark.parametrize("plane", [False, True])
def test_blocks_do_not_change_a_pose(spark, monkeypatch, plane):
    own = np.random.default_rng(5)
    q = own.uniform(-3, 3, (600, 3))
    n = own.normal(size=(600, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    target = spark.createDataFrame([(k, *map(float, [*a, *b])) for k, (a, b) in enumerate(zip(q, n, strict=True))], "id long, x double, y double, z double, nx double, ny double, nz double")
    source = spark.createDataFrame([(k, *map(float, a + [0.2, -0.3, 0.25])) for k, a in enumerate(np.concatenate([q, q[:50]]))], "id long, x double, y double, z double")
    one = registration.align(source, target, 0.3, 0.5, iterations=6, plane=plane)
    deals, deal = [], registration._blocks
    monkeypatch.setattr(registration, "BLOCK", 40)
    monkeypatch.setattr(registration, "_blocks", lambda *a: deals.append(1) or deal(*a))
    assert np.allclose(registration.align(source, target, 0.3, 0.5, iterations=6, plane=plane), one, atol=1e-9) and deals
