"""Frames, points and tracks made of the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of lineitem rows up to identical rows.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(c: Column) -> Column:
    """Rounded to six places the way both engines agree on."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as pixels: 32 rows by 512 columns, a range in millimetres."""
    return table(spark, sf_dir, "lineitem").select(
        "*",
        F.lit(0).alias("sensor_idx"),
        F.col("l_orderkey").alias("frame_id"),
        (F.col("l_orderkey") % 32).cast("int").alias("row"),
        (F.col("l_partkey") % 512).cast("int").alias("col"),
        ((F.col("l_orderkey") % 32) * 3 % 17).cast("int").alias("shift"),
        F.floor("l_extendedprice").alias("range_mm"),
    )


POINTS = """(SELECT *, 0 AS sensor_idx, l_orderkey AS frame_id, CAST(l_orderkey % 32 AS INTEGER) AS "row", CAST(l_partkey % 512 AS INTEGER) AS col,
    CAST((l_orderkey % 32) * 3 % 17 AS INTEGER) AS shift, CAST(floor(l_extendedprice) AS BIGINT) AS range_mm FROM lineitem)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as a point cloud."""
    return table(spark, sf_dir, "lineitem").select("*", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))


CLOUD = "(SELECT *, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem)"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks of users: ts_us, and the value in thousandths as a whole number."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch_us(F.col("ts")).alias("ts_us"), F.floor(F.col("value") * 1000).alias("milli"), "value")


TRACK = "(SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us, CAST(floor(value * 1000) AS BIGINT) AS milli, value FROM events)"


def packed(df: DataFrame, size: Column | int, layout: list[tuple[str, int, int]], keep: list[str]) -> DataFrame:
    """Rows as packets: ``payload`` of ``size`` bytes with whole-number columns at (first bit, bits)."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from beamframe.functions.packets import put_bits

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("_size").to_numpy()
            rows = np.zeros((b.num_rows, int(sizes.max(initial=8))), np.uint8)
            for c, first, bits in layout:
                put_bits(rows, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), first, bits)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r[:n].tobytes() for r, n in zip(rows, sizes.tolist(), strict=True)], pa.binary())], names=[*keep, "payload"])

    wanted = list(dict.fromkeys([*keep, *[c for c, *_ in layout]]))
    return df.select(*wanted, (F.lit(size) if isinstance(size, int) else size).cast("int").alias("_size")).mapInArrow(run, f"{kinds}, payload binary")
