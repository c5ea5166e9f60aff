"""Scalar column expressions and small parsers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84 semi-major axis in metres and first eccentricity squared.
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3


def nmea_position(sentence: Column) -> Column:
    """(lat, lon) in degrees of an RMC sentence with a fix, else null."""
    part = F.split(sentence, ",")

    def degrees(value: Column, side: Column, whole: int, negative: str) -> Column:
        d = F.substring(value, 1, whole).cast("double") + F.substring(value, whole + 1, 20).cast("double") / 60
        return F.when(side == negative, -d).otherwise(d)

    ok = F.rlike(part[0], F.lit(r"^\$..RMC$")) & (F.size(part) > 6) & (part[2] == "A")
    return F.when(ok, F.struct(degrees(part[3], part[4], 2, "S").alias("lat"), degrees(part[5], part[6], 3, "W").alias("lon")))


def local_metres(lat: Column, lon: Column, lat0: float, lon0: float) -> dict[str, Column]:
    """East and north of an origin on the ellipsoid's tangent plane there."""
    s = math.sin(math.radians(lat0))
    prime = WGS84_A / math.sqrt(1 - WGS84_E2 * s * s)
    meridian = prime * (1 - WGS84_E2) / (1 - WGS84_E2 * s * s)
    return {"east": F.radians(lon - lon0) * (prime * math.cos(math.radians(lat0))), "north": F.radians(lat - lat0) * meridian}


def relative_metres(lat: float, lon: float, lat0: float, lon0: float) -> tuple[float, float]:
    """The same of numbers."""
    s = math.sin(math.radians(lat0))
    prime = WGS84_A / math.sqrt(1 - WGS84_E2 * s * s)
    meridian = prime * (1 - WGS84_E2) / (1 - WGS84_E2 * s * s)
    return math.radians(lon - lon0) * prime * math.cos(math.radians(lat0)), math.radians(lat - lat0) * meridian


def valid(status: Column) -> Column:
    return status.bitwiseAND(1) == 1


def lidar_mode(mode: Column) -> Column:
    """Columns per frame and frames per second of "1024x10"."""
    part = F.split(mode, "x")
    return F.struct(part[0].cast("int").alias("columns"), part[1].cast("int").alias("fps"))


def version(text: Column) -> Column:
    """A sortable struct of a semantic version; a pre-release sorts before its release."""
    m = lambda i: F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?", i)
    return F.struct(m(1).cast("int").alias("major"), m(2).cast("int").alias("minor"), m(3).cast("int").alias("patch"), (m(4) == "").alias("release"), m(4).alias("pre"))


def product(line: Column) -> Column:
    """Form factor and beam count of a product line such as AB-1-128."""
    return F.struct(F.regexp_extract(line, r"^([A-Z]+-?[0-9A-Z]*)-(\d+)", 1).alias("form"), F.regexp_extract(line, r"^([A-Z]+-?[0-9A-Z]*)-(\d+)", 2).cast("int").alias("beams"))


def ns_to_string(ns: Column) -> Column:
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_micros(F.floor(ns / 1000)), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"))


def position_distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{k}") - F.col(f"{b}{k}")) ** 2 for k in "xyz"), F.lit(0.0)))


#: Metres of a length unit, seconds of a time unit.
LENGTHS = {"mm": 1e-3, "cm": 1e-2, "dm": 1e-1, "m": 1.0, "km": 1e3}
TIMES = {"ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}


def parse_length(text: str) -> float:
    m = re.fullmatch(r"([+-]?[0-9.]+|[+-]?inf)(mm|cm|dm|km|m)?", text)
    if not m:
        raise ValueError(f"not a length: {text}")
    return float(m[1]) * LENGTHS[m[2] or "m"]


def parse_slice(text: str) -> tuple[list[float | None], bool]:
    """"10:20:2" -> numbers; "1:2s" -> seconds (True)."""
    parts = text.split(":")
    unit = next((u for u in TIMES if parts[-1].endswith(u) or any(p.endswith(u) for p in parts)), None) if re.search(r"[a-z]", text) else None
    def one(p: str) -> float | None:
        if not p:
            return None
        m = re.fullmatch(r"(-?[0-9.]+)(ms|min|s|h)?", p)
        if not m:
            raise ValueError(f"not a slice: {text}")
        return float(m[1]) * TIMES[m[2] or unit] if unit else int(m[1])

    if not 1 <= len(parts) <= 3:
        raise ValueError(f"not a slice: {text}")
    return [one(p) for p in parts], unit is not None


def packets_per_frame(width: int, per_packet: int, start: int, end: int) -> tuple[int, int]:
    """(packets, valid columns) expected of a column window, which may wrap round the frame."""
    packets = -(-width // per_packet)
    a, b = start // per_packet, end // per_packet
    if start <= end:
        return b - a + 1, end - start + 1
    return min(packets, packets - a + b + (0 if a == b else 1)), width - start + end + 1


def half_to_float(bits: Column) -> Column:
    """Half-precision bits as a float, not-a-number as 0."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exp, frac = F.shiftright(bits.bitwiseAND(0x7C00), 10), bits.bitwiseAND(0x3FF)
    value = F.when(exp == 0, frac * F.lit(2.0**-24)).when((exp == 31) & (frac != 0), F.lit(0.0)).when(exp == 31, F.lit(math.inf)).otherwise((1 + frac / 1024.0) * F.pow(F.lit(2.0), exp - 15))
    return F.when((exp == 31) & (frac != 0), F.lit(0.0)).otherwise(sign * value)


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))
