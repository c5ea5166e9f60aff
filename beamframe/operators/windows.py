"""Sequential functions over frames and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wrapped_difference(a: Column, b: Column, largest: int) -> Column:
    """b - a on a counter that wraps behind ``largest``, as the nearer of the two ways round."""
    turn = largest + 1
    ahead = F.pmod(b - a, F.lit(turn))
    return F.when(ahead > turn // 2, ahead - turn).otherwise(ahead)


def frame_steps(df: DataFrame, key: str, order: list[str], frame: str, largest: int = 65535) -> DataFrame:
    """``step``: the wrapped difference from the frame before."""
    before = F.lag(frame).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("step", wrapped_difference(before, F.col(frame), largest))


def trigger_runs(df: DataFrame, key: str, order: list[str], hit: Column, frame_count: int) -> DataFrame:
    """``trigger``: hits in a row so far; ``alert``: how many of them reach ``frame_count``."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_hit", hit).withColumn("_run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("trigger", run).withColumn("alert", F.greatest(F.lit(0), F.col("trigger") - frame_count + 1)).drop("_hit", "_run")


def distance_travelled(df: DataFrame, key: str, order: list[str], axes: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in axes), F.lit(0.0)))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("travelled", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def smoothed(df: DataFrame, key: str, order: list[str], value: str, damping: float) -> DataFrame:
    """The last of s = d s + (1 - d) x of each key, from its first value.

    In closed form: a value counts (1 - d) d^k, k values before the end, and the first one d^k.
    So a key's values are numbered and summed up, never gathered.
    """
    w = Window.partitionBy(key)
    last = F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) - 1
    first = F.row_number().over(w.orderBy(*order)) == 1
    weight = F.pow(F.lit(float(damping)), last) * F.when(first, F.lit(1.0)).otherwise(F.lit(1.0 - damping))
    return df.withColumn("_v", F.col(value) * weight).groupBy(key).agg(F.sum("_v").alias("smoothed"))


def out_of_order(df: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """``late``: whether a timestamp lies before one that came earlier."""
    before = F.max(ts).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("late", F.coalesce(F.col(ts) < before, F.lit(False)))


def corrected_time(df: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """``fixed``: timestamps that never step back (the largest so far)."""
    return df.withColumn("fixed", F.max(ts).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def adaptive_threshold(df: DataFrame, key: str, order: list[str], error: str, least: float, initial: float) -> DataFrame:
    """Root mean square of the model errors over ``least`` so far; the initial value before any."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    big = F.when(F.col(error) > least, F.col(error))
    n = F.count(big).over(w)
    return df.withColumn("threshold", F.when(n == 0, F.lit(initial)).otherwise(F.sqrt(F.sum(big * big).over(w) / n)))


def row_offsets(df: DataFrame, value: str) -> DataFrame:
    """Beam uniformity: the median difference of each row from the row above, summed up, without its trend and minimum.

    The median is the upper middle of the sorted differences.
    """
    above = F.lag(value).over(Window.partitionBy("frame_id", "col").orderBy("row"))
    diff = df.withColumn("d", F.coalesce(F.col(value) - above, F.lit(0.0)))
    w = Window.partitionBy("frame_id", "row")
    ranked = diff.withColumn("i", F.row_number().over(w.orderBy("d", "col"))).withColumn("n", F.count(F.lit(1)).over(w))
    median = ranked.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("frame_id", "row", "d")
    level = median.withColumn("level", F.sum("d").over(Window.partitionBy("frame_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    line = level.groupBy("frame_id").agg(F.regr_slope("level", F.col("row").cast("double")).alias("a"), F.regr_intercept("level", F.col("row").cast("double")).alias("b"))
    flat = level.join(line, "frame_id").withColumn("rest", F.col("level") - F.coalesce(F.col("a") * F.col("row") + F.col("b"), F.col("level")))
    return flat.withColumn("offset", F.col("rest") - F.min("rest").over(Window.partitionBy("frame_id"))).select("frame_id", "row", "offset")


def predicted_position(df: DataFrame, key: str, order: str, axes: list[str]) -> DataFrame:
    """Constant velocity: the next position from the last two, at the time of the row."""
    w = Window.partitionBy(key).orderBy(order)
    t1, t2 = F.lag(order, 1).over(w), F.lag(order, 2).over(w)
    share = (F.col(order) - t1) / (t1 - t2)
    return df.withColumns({f"p_{a}": F.lag(a, 1).over(w) + (F.lag(a, 1).over(w) - F.lag(a, 2).over(w)) * share for a in axes})


def neighbours(df: DataFrame, value: str, width: int, keys: list[str] = ("frame_id",)) -> DataFrame:
    """``up``, ``down``, ``left``, ``right``: a field at the pixels around, round the frame to the sides; null where there is none."""
    keys = list(keys)
    out = df
    for name, row, col in (("up", -1, 0), ("down", 1, 0), ("left", 0, -1), ("right", 0, 1)):
        # a pixel is the neighbour of the one that lies the other way
        there = df.select(*keys, (F.col("row") - row).cast("int").alias("row"), F.pmod(F.col("col") - col, F.lit(width)).cast("int").alias("col"), F.col(value).alias(name))
        out = out.join(there, [*keys, "row", "col"], "left")
    return out
