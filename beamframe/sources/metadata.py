"""Sensor metadata: documents to tables with issues, defaults, extrinsics, and which document belongs to a capture."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.functions import packets as pk
from beamframe.functions import rigid
from beamframe.functions.scalar import packets_per_frame

#: The modes of a default sensor, the shift of each of four neighbouring rows by columns of a frame, rows, columns of a packet.
MODES = {"512x10": (512, 10), "512x20": (512, 20), "1024x10": (1024, 10), "1024x20": (1024, 20), "2048x10": (2048, 10), "4096x5": (4096, 5)}
SHIFTS = {512: (9, 6, 3, 0), 1024: (18, 12, 6, 0), 2048: (36, 24, 12, 0), 4096: (72, 48, 24, 0)}
DEFAULT_ROWS, DEFAULT_PER_PACKET = 64, 16
#: Fixed values of the default calibration: azimuths of four neighbouring rows, altitudes of the first and last row, the beams' distance from the axis.
DEFAULT_AZIMUTHS = (3.164, 1.055, -1.055, -3.164)
DEFAULT_ALTITUDES = (16.611, -16.611)
DEFAULT_ORIGIN_MM = 12.163
DEFAULT_LIDAR_TO_SENSOR = [-1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 36.18, 0.0, 0.0, 0.0, 1.0]

SENSOR = "sn long, prod_line string, fw_rev string, init_id long, h int, w int, columns_per_packet int, win_start int, win_end int, fps int, profile string, imu_profile string, header_type string, udp_port_lidar int, udp_port_imu int, beam_to_lidar array<double>, lidar_to_sensor array<double>, sensor_to_body array<double>"
BEAM = "sn long, row int, azimuth_deg double, altitude_deg double, pixel_shift int"
ISSUE = "path string, message string, severity string"


def _identity() -> list[float]:
    return [float(i % 5 == 0) for i in range(16)]


def _first(doc: dict, *paths: str) -> object:
    """The value at the first of the dotted paths that the document has."""
    for p in paths:
        at: object = doc
        for k in p.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if at is not None:
            return at
    return None


def parse(document: str) -> tuple[dict, list[tuple], list[tuple[str, str, str]]]:
    """(sensor, beams, issues) of a metadata document, grouped or flat.

    Critical issues: no document, angles that are missing or of different numbers, a number of
    columns, rates or a profile that can't be; what is left out gets its default and a warning.
    """
    issues: list[tuple[str, str, str]] = []
    try:
        doc = json.loads(document)
        if not isinstance(doc, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return {}, [], [("$", f"not a JSON object: {e}", "critical")]
    if "sensor_info" in doc and "prod_sn" in doc:
        issues.append(("$", "grouped and flat members are mixed", "warning"))

    def get(name: str, default: object, kind: type, *paths: str) -> object:
        value = _first(doc, *paths)
        if value is None:
            issues.append((paths[0], f"{name} is missing", "warning"))
            return default
        try:
            return kind(value)
        except (TypeError, ValueError):
            issues.append((paths[0], f"{name} isn't valid: {value!r}", "critical"))
            return default

    mode = get("mode", "1024x10", str, "config_params.lidar_mode", "lidar_mode")
    cols, fps = MODES.get(mode, (0, 0))
    if not cols:
        issues.append(("config_params.lidar_mode", f"unknown mode {mode}", "critical"))
        cols, fps = 1024, 10
    azimuth = _first(doc, "beam_intrinsics.beam_azimuth_angles", "beam_azimuth_angles") or []
    altitude = _first(doc, "beam_intrinsics.beam_altitude_angles", "beam_altitude_angles") or []
    for name, x in (("azimuth", azimuth), ("altitude", altitude)):
        if not isinstance(x, list) or not x or any(not isinstance(v, int | float) or not math.isfinite(v) for v in x):
            issues.append((f"beam_intrinsics.beam_{name}_angles", "not a list of numbers", "critical"))
    azimuth, altitude = (x if isinstance(x, list) else [] for x in (azimuth, altitude))
    if len(azimuth) != len(altitude):
        issues.append(("beam_intrinsics", f"{len(azimuth)} azimuths and {len(altitude)} altitudes", "critical"))
    form = "lidar_data_format." if "lidar_data_format" in doc else "data_format."
    w = get("columns_per_frame", cols, int, form + "columns_per_frame")
    shifts = _first(doc, form + "pixel_shift_by_row")
    if not isinstance(shifts, list) or len(shifts) != len(azimuth):
        if shifts is not None:
            issues.append((form + "pixel_shift_by_row", f"{len(shifts) if isinstance(shifts, list) else 0} shifts for {len(azimuth)} rows", "critical"))
        shifts = [0] * len(azimuth)
    window = _first(doc, form + "column_window")
    if not isinstance(window, list) or len(window) != 2 or any(not 0 <= x < w for x in window):
        if window is not None:
            issues.append((form + "column_window", f"not inside the frame: {window}", "critical"))
        window = [0, w - 1]
    profile = get("profile", "LEGACY", str, form + "udp_profile_lidar", "config_params.udp_profile_lidar")
    if profile not in pk.PROFILES and profile not in pk.CUSTOM:
        issues.append((form + "udp_profile_lidar", f"unknown profile {profile}", "critical"))
    matrix = lambda *paths: (x if isinstance(x := _first(doc, *paths), list) and len(x) == 16 else _identity())
    origin = _first(doc, "beam_intrinsics.lidar_origin_to_beam_origin_mm", "lidar_origin_to_beam_origin_mm") or 0.0
    sensor = {
        "sn": int(get("serial number", 0, int, "sensor_info.prod_sn", "prod_sn")),
        "prod_line": get("product line", "", str, "sensor_info.prod_line", "prod_line"),
        "fw_rev": get("firmware", "", str, "sensor_info.build_rev", "sensor_info.image_rev", "build_rev", "image_rev"),
        "init_id": int(_first(doc, "sensor_info.initialization_id", "initialization_id") or 0),
        "h": len(azimuth), "w": w, "columns_per_packet": get("columns_per_packet", DEFAULT_PER_PACKET, int, form + "columns_per_packet"),
        "win_start": int(window[0]), "win_end": int(window[1]), "fps": int(_first(doc, form + "fps") or fps), "profile": profile,
        "imu_profile": str(_first(doc, form + "udp_profile_imu") or "LEGACY"), "header_type": str(_first(doc, form + "header_type") or "STANDARD"),
        "udp_port_lidar": int(_first(doc, "config_params.udp_port_lidar", "udp_port_lidar") or 0), "udp_port_imu": int(_first(doc, "config_params.udp_port_imu", "udp_port_imu") or 0),
        "beam_to_lidar": [float(x) for x in matrix("beam_intrinsics.beam_to_lidar_transform", "beam_to_lidar_transform")],
        "lidar_to_sensor": [float(x) for x in matrix("lidar_intrinsics.lidar_to_sensor_transform", "lidar_to_sensor_transform")],
        "sensor_to_body": [float(x) for x in matrix("user_data.sensor_to_body", "extrinsics")],
    }
    if sensor["beam_to_lidar"] == _identity() and origin:
        sensor["beam_to_lidar"][3] = float(origin)
    beams = [(sensor["sn"], i, float(a), float(b), int(s)) for i, (a, b, s) in enumerate(zip(azimuth, altitude, shifts, strict=False))]
    return sensor, beams, issues


def default(mode: str = "1024x10", rows: int = DEFAULT_ROWS) -> tuple[dict, list[tuple]]:
    """(sensor, beams) of a default sensor: evenly spaced altitudes, four azimuths in turn."""
    if mode not in MODES or MODES[mode][0] not in SHIFTS:
        raise ValueError(f"unknown mode {mode}")
    w, fps = MODES[mode]
    top, bottom = DEFAULT_ALTITUDES
    beams = [(0, i, DEFAULT_AZIMUTHS[i % 4], top + (bottom - top) * i / max(rows - 1, 1), SHIFTS[w][i % 4]) for i in range(rows)]
    to_lidar = _identity()
    to_lidar[3] = DEFAULT_ORIGIN_MM
    sensor = {
        "sn": 0, "prod_line": "DEFAULT-64", "fw_rev": "UNKNOWN", "init_id": 0, "h": rows, "w": w, "columns_per_packet": DEFAULT_PER_PACKET, "win_start": 0, "win_end": w - 1, "fps": fps,
        "profile": "LEGACY", "imu_profile": "LEGACY", "header_type": "STANDARD", "udp_port_lidar": 0, "udp_port_imu": 0, "beam_to_lidar": to_lidar, "lidar_to_sensor": list(DEFAULT_LIDAR_TO_SENSOR), "sensor_to_body": _identity(),
    }
    return sensor, beams


def tables(spark: SparkSession, documents: Iterable[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sensors, beams, issues) of metadata documents, one of each sensor; sensors are few."""
    sensors, beams, issues = [], [], []
    for d in documents:
        s, b, i = parse(d)
        issues += i
        if s:
            sensors.append(tuple(s[c.split()[0]] for c in SENSOR.split(", ")))
            beams += b
    return spark.createDataFrame(sensors, SENSOR), spark.createDataFrame(beams, BEAM), spark.createDataFrame(issues, ISSUE)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables(spark, [bytes(r["content"]).decode() for r in spark.read.format("binaryFile").load(path).select("content").collect()])


def expected(sensors: DataFrame) -> DataFrame:
    """The sensors with their expected lidar packets and valid columns of a frame, and the returns of a pixel."""
    w, per, a, z = (F.col(c) for c in ("w", "columns_per_packet", "win_start", "win_end"))
    first, last, whole = F.floor(a / per), F.floor(z / per), F.ceil(w / per)
    wraps = z < a
    packets = F.when(F.col("profile") == "OFF", 0).when(~wraps, last - first + 1).when(first == last, whole).otherwise(whole - first + 1 + last)
    columns = F.when(wraps, z + (w - a) + 1).otherwise(z - a + 1)
    both = F.create_map(*[F.lit(x) for p in (*pk.PROFILES, *pk.CUSTOM) for x in (p, pk.returns(p))])
    return sensors.withColumns({"packets": packets.cast("int"), "valid_columns": columns.cast("int"), "returns": both[F.col("profile")].cast("int")})


def expected_of(sensor: dict) -> tuple[int, int]:
    return packets_per_frame(sensor["w"], sensor["columns_per_packet"], sensor["win_start"], sensor["win_end"])


def differences(a: dict, b: dict) -> list[str]:
    """Members in which two sensors differ; none: frames of the one fit the other."""
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def same_fields(sensors: DataFrame, others: DataFrame, key: str = "sn") -> DataFrame:
    """(key, equal): null-safe comparison of all members of two sensor tables; sensors of one side only are unequal."""
    members = [c for c in sensors.columns if c != key]
    both = sensors.alias("a").join(others.alias("b"), key, "full")
    equal = F.lit(True)
    for c in members:
        equal = equal & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.select(key, equal.alias("equal"))


# ---------------------------------------------------------------- extrinsics


def parse_extrinsics(document: str) -> list[tuple[str, list[float]]]:
    """(serial number, pose) of an extrinsics document: positions and quaternions by source frame."""
    out = []
    for t in json.loads(document).get("transforms", []):
        x = np.array([float(t[k]) for k in ("p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w")])
        out.append((str(t["source_frame"]), rigid.from_position_quaternion(x).ravel().tolist()))
    return out


def extrinsics_text(text: str) -> list[float]:
    """A pose as the command line takes it: 16 numbers, x y z roll pitch yaw in degrees, or x y z and a quaternion; "identity"."""
    if text.strip().lower() == "identity":
        return _identity()
    x = np.array([float(v) for v in text.replace(",", " ").split()])
    if len(x) == 16:
        return x.tolist()
    if len(x) == 7:
        return rigid.from_position_quaternion(x).ravel().tolist()
    if len(x) == 6:
        return rigid.from_position_euler(np.concatenate([x[:3], np.radians(x[3:])])).ravel().tolist()
    raise ValueError(f"not a pose: {text}")


def write_extrinsics(poses: Iterable[tuple[str, list[float]]], destination: str = "world") -> str:
    rows = []
    for sn, pose in poses:
        x = rigid.to_position_quaternion(np.asarray(pose, float).reshape(4, 4)).tolist()
        rows.append({"source_frame": str(sn), "destination_frame": destination} | dict(zip(("p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w"), x, strict=True)))
    return json.dumps({"transforms": rows})


def with_extrinsics(sensors: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """``sensor_to_body`` of (sn, pose) where there is one."""
    e = extrinsics.select(F.col("sn").cast("string").alias("_sn"), F.col("pose").alias("_pose"))
    return sensors.join(e, F.col("sn").cast("string") == F.col("_sn"), "left").withColumn("sensor_to_body", F.coalesce("_pose", "sensor_to_body")).drop("_sn", "_pose")


# ---------------------------------------------------------------- which document belongs to a capture


def resolve(capture: str, candidates: Iterable[str]) -> str | None:
    """The metadata document with the longest common beginning with the capture's name; the first by name of several."""
    name = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    def common(a: str, b: str) -> int:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    ranked = sorted((-common(name(capture), name(c)), c) for c in candidates if c.endswith(".json"))
    return ranked[0][1] if ranked and ranked[0][0] < 0 else None


def field_of_view(beams: DataFrame, key: str = "sn") -> DataFrame:
    """(key, vertical, horizontal, aspect) in degrees, from a sensor's beams.

    Angles of 0 don't count if there are two or more; a vertical field of 0 counts as one degree.
    A beam for each row turns the whole circle.
    """
    zeros = F.count_if(F.col("altitude_deg") == 0)
    angle = F.when(F.col("altitude_deg") != 0, F.col("altitude_deg"))
    spread = F.when(zeros > 1, F.max(angle) - F.min(angle)).otherwise(F.max("altitude_deg") - F.min("altitude_deg"))
    vertical = F.when((spread < 1e-9) & (F.count(F.lit(1)) > 1), F.lit(1.0)).otherwise(spread)
    return beams.groupBy(key).agg(vertical.alias("vertical"), F.lit(360.0).alias("horizontal")).withColumn("aspect", F.col("vertical") / F.col("horizontal"))
