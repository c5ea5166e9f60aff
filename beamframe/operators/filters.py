"""Value-masking filters: matching pixels get ``invalid``, rows stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _overwrite(df: DataFrame, fields: list[str], hit: Column, invalid: float) -> DataFrame:
    """``invalid`` where ``hit``; fields that the frame lacks are skipped, types stay."""
    types = dict(df.dtypes)
    return df.withColumns({f: F.when(hit, F.lit(invalid).cast(types[f])).otherwise(F.col(f)) for f in fields if f in types})


def clip(df: DataFrame, fields: list[str], lo: float, hi: float, invalid: float = 0) -> DataFrame:
    """Values outside the closed interval, compared as doubles, become ``invalid``."""
    types = dict(df.dtypes)
    return df.withColumns({f: F.when(F.col(f).cast("double").between(lo, hi), F.col(f)).otherwise(F.lit(invalid).cast(types[f])) for f in fields if f in types})


def filter_field(df: DataFrame, field: str, lo: float, hi: float, fields: list[str], invalid: float = 0) -> DataFrame:
    """Where ``field`` lies inside the closed interval, ``fields`` become ``invalid``."""
    return _overwrite(df, fields, F.col(field).cast("double").between(lo, hi), invalid)


def axis_bounds(lo: float, hi: float, size: int) -> tuple[int, int]:
    """Floats in [0, 1] are shares of the axis, infinities are open, whole numbers are indices."""
    def one(v: float, end: int) -> int:
        if v in (float("inf"), float("-inf")):
            return end
        return int(v * size) if isinstance(v, float) and 0 <= v <= 1 else int(v)

    a, b = one(lo, 0), one(hi, size)
    if not 0 <= a <= b <= size:
        raise ValueError(f"bounds {lo}:{hi} don't fit an axis of {size}")
    return a, b


def filter_uv(df: DataFrame, axis: str, lo: float, hi: float, size: int, fields: list[str], invalid: float = 0, shift: str | None = None) -> DataFrame:
    """Half-open bounds over rows ("u") or destaggered columns ("v")."""
    a, b = axis_bounds(lo, hi, size)
    at = F.col("row") if axis == "u" else F.pmod(F.col("col") + (F.col(shift) if shift else F.lit(0)), F.lit(size))
    return _overwrite(df, fields, (at >= a) & (at < b), invalid)


def resolved(df: DataFrame, fields: list[str] | None, classes: dict[str, str]) -> list[str]:
    """The pixel fields that a filter writes: all of the frame's without a list; a listed field of another class is an error, one that the frame lacks is left out."""
    if fields is None:
        return [f for f in df.columns if classes.get(f) == "PIXEL"]
    wrong = [f for f in fields if f in df.columns and classes.get(f, "PIXEL") != "PIXEL"]
    if wrong:
        raise ValueError(f"not a field of pixels: {', '.join(wrong)}")
    return [f for f in fields if f in df.columns]


def filter_xyz(df: DataFrame, axis: str, lo: float, hi: float, fields: list[str], invalid: float = 0, frame: str = "") -> DataFrame:
    """Closed interval on a coordinate; pixels without a return sit at the origin and match if it is inside.

    ``frame``: the beginning of the coordinates' names, as there are of the sensor's, the body's and the
    world's frame ("body_" reads body_x ...). Fields of the second return (ending in 2) go by its own
    coordinates (x2 ...) where the frame has them.
    """
    def at(name: str) -> Column:
        return F.col(name).between(lo, hi)

    second = f"{frame}{axis}2"
    own = [f for f in fields if f.endswith("2") and second in df.columns]
    out = _overwrite(df, [f for f in fields if f not in own], at(f"{frame}{axis}"), invalid)
    return _overwrite(out, own, at(second), invalid) if own else out


def mask(df: DataFrame, image: DataFrame, fields: list[str], keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Pixels whose ``mask`` is 0 become 0. The image has a row per pixel of one sensor; pixels that it lacks stay."""
    flagged = df.join(image.select(*keys, "mask"), list(keys), "left")
    return _overwrite(flagged, fields, F.coalesce(F.col("mask") == 0, F.lit(False)), 0).drop("mask")


def range_gate(df: DataFrame, low_m: float, high_m: float, field: str = "range_mm") -> DataFrame:
    """Rows whose range in millimetres lies between two limits in metres."""
    return df.where((F.col(field) >= F.ceil(F.lit(low_m * 1e3))) & (F.col(field) <= F.floor(F.lit(high_m * 1e3))))


def complete_frames(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Frames all of whose columns are valid (bit 0 of the status)."""
    return columns.groupBy(*keys).agg(F.bool_and(F.col("status").bitwiseAND(1) == 1).alias("complete")).where("complete").drop("complete")
