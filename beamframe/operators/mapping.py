"""Mapping: registration against a growing or fixed map, motion from IMU, loop and GPS constraints, pose graphs.

A session is a sequence: each frame needs the pose of the one before. So sessions are
the unit of parallel work; within one, frames stream through a sorted partition and
only the local map, bounded by its reach, stays in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.functions import rigid, scalar
from beamframe.operators.joins import loop_candidates

# ---------------------------------------------------------------- local maps

#: Pairs of a query and a point that one step compares.
_PAIRS = 1 << 20
_NEAR = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], np.int64)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """One number of three cell numbers of 21 bits each."""
    c = (cells.astype(np.int64) + (1 << 20)) & ((1 << 21) - 1)
    return (c[..., 0] << 42) | (c[..., 1] << 21) | c[..., 2]


def one_per_cell(points: np.ndarray, size: float) -> np.ndarray:
    """Places of the first point of each voxel, in order."""
    _, first = np.unique(cell_keys(np.floor(points / size)), return_index=True)
    return np.sort(first)


class LocalMap:
    """Points by voxel, up to ``most`` a voxel and spaced by sqrt(size^2 / most), within ``reach`` of the sensor."""

    def __init__(self, size: float, reach: float, most: int = 20) -> None:
        self.size, self.reach, self.most = size, reach, most
        self.points = np.zeros((0, 3))
        self._index()

    def _index(self) -> None:
        keys = cell_keys(np.floor(self.points / self.size))
        order = np.argsort(keys, kind="stable")
        self.points, self.keys = self.points[order], keys[order]

    def add(self, points: np.ndarray) -> None:
        """New points thinned to the spacing among themselves and against the map's."""
        gap = self.size / np.sqrt(self.most)
        points = points[one_per_cell(points, gap)]
        if len(self.points):
            near, d2 = self.nearest(points, gap)
            points = points[(near < 0) | (d2 >= gap * gap)]
        both = np.concatenate([self.points, points])
        keys = cell_keys(np.floor(both / self.size))
        order = np.argsort(keys, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(keys[order], keys[order])
        self.points = both[np.sort(order[rank < self.most])]
        self._index()

    def cull(self, centre: np.ndarray) -> None:
        self.points = self.points[((self.points - centre) ** 2).sum(axis=1) <= self.reach**2]
        self._index()

    def nearest(self, queries: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest point nearer than ``most``, or -1; its squared distance), over a query's voxel and its 26 neighbours."""
        best, d2 = np.full(len(queries), -1), np.full(len(queries), min(most, np.inf) ** 2)
        if not len(self.points):
            return best, d2
        home = np.floor(queries / self.size).astype(np.int64)
        for step in _NEAR:
            key = cell_keys(home + step)
            first, n = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
            n = n - first
            on = np.flatnonzero(n)
            for part in np.split(on, np.flatnonzero(np.diff(np.cumsum(n[on]) // _PAIRS)) + 1) if len(on) else []:
                start = np.cumsum(n[part]) - n[part]
                of = np.repeat(np.arange(len(part)), n[part])
                at = np.arange(len(of)) - start[of] + first[part][of]
                d = ((self.points[at] - queries[part][of]) ** 2).sum(axis=1)
                least = np.minimum.reduceat(d, start)
                where = np.flatnonzero(d == least[of])
                nearest = at[where[np.searchsorted(of[where], np.arange(len(part)))]]
                better = least < d2[part]
                best[part[better]], d2[part[better]] = nearest[better], least[better]
        return best, d2


def system(p: np.ndarray, q: np.ndarray, kernel: float, normals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted normal equations of moving p onto q (rotation, then translation); with normals along them only."""
    r = p - q
    j = np.zeros((len(p), 3, 6))
    j[:, :, :3], j[:, :, 3:] = -rigid.skew(p), np.eye(3)
    if normals is None:
        w = (kernel / (kernel + (r * r).sum(axis=1))) ** 2
        return np.einsum("nki,n,nkj->ij", j, w, j), np.einsum("nki,n,nk->i", j, w, r)
    e = (normals * r).sum(axis=1)
    row = np.einsum("nk,nki->ni", normals, j)
    w = (kernel / (kernel + e * e)) ** 2
    return np.einsum("ni,n,nj->ij", row, w, row), row.T @ (w * e)


def register(points: np.ndarray, local: LocalMap, reach: float, kernel: float, rounds: int = 100, tolerance: float = 1e-4, normals: np.ndarray | None = None) -> np.ndarray:
    """The pose that moves points onto a map; the identity onto an empty one. ``normals`` are the map's, for point to plane."""
    pose = np.eye(4)
    if not len(local.points) or not len(points):
        return pose
    for _ in range(rounds):
        moved = points @ pose[:3, :3].T + pose[:3, 3]
        near, _ = local.nearest(moved, reach)
        on = near >= 0
        if not on.any():
            break
        h, g = system(moved[on], local.points[near[on]], kernel, None if normals is None else normals[near[on]])
        step = np.linalg.lstsq(h, -g, rcond=None)[0]
        pose = rigid.pose_exp(step) @ pose
        if step @ step < tolerance * tolerance:
            break
    return pose


class Threshold:
    """How far registration looks: the root mean square of the corrections above ``least``, the initial value before any."""

    def __init__(self, initial: float = 2.0, least: float = 0.1, reach: float = 100.0) -> None:
        self.initial, self.least, self.reach, self.total, self.n = initial, least, reach, 0.0, 0

    def value(self) -> float:
        return np.sqrt(self.total / self.n) if self.n else self.initial

    def update(self, correction: np.ndarray) -> None:
        angle = np.linalg.norm(rigid.so3_log(correction[:3, :3]))
        error = 2 * self.reach * np.sin(angle / 2) + np.linalg.norm(correction[:3, 3])
        if error > self.least:
            self.total, self.n = self.total + error * error, self.n + 1


@dataclass
class Slam:
    """Odometry of one session: constant velocity, registration of a thinned cloud, map update."""

    size: float = 1.0
    reach: float = 100.0
    least_columns: float = 0.5
    fixed: LocalMap | None = None
    start: np.ndarray = field(default_factory=lambda: np.eye(4))
    poses: list[np.ndarray] = field(default_factory=list)
    frames: int = 0

    def __post_init__(self) -> None:
        self.map = self.fixed or LocalMap(self.size, self.reach)
        self.threshold = Threshold(reach=self.reach)

    def predict(self) -> np.ndarray:
        if len(self.poses) > 1:
            return self.poses[-1] @ rigid.inverse(self.poses[-2]) @ self.poses[-1]
        return self.poses[-1] if self.poses else self.start

    def put(self, points: np.ndarray, columns: float = 1.0) -> np.ndarray:
        """The pose of the next frame from its points in the body's frame; ``columns``: its share of valid columns. With too few of them the prediction stands."""
        guess = self.predict()
        if columns < self.least_columns or not len(points):
            self.poses = [*self.poses[-1:], guess]
            return guess
        world = points @ guess[:3, :3].T + guess[:3, 3]
        fine = world[one_per_cell(world, self.size * 0.5)]
        sparse = fine[one_per_cell(fine, self.size * 1.5)]
        sigma = self.threshold.value()
        fix = register(sparse, self.map, 3 * sigma, sigma / 3)
        self.threshold.update(fix)
        pose = fix @ guess
        if self.fixed is None:
            self.frames += 1
            self.map.add(fine @ fix[:3, :3].T + fix[:3, 3])
            if self.frames % 10 == 0:
                self.map.cull(pose[:3, 3])
        self.poses = [*self.poses[-1:], pose]
        return pose


def slam(points: DataFrame, session: str, frame: str, size: float = 1.0, reach: float = 100.0, fixed: np.ndarray | None = None, start: np.ndarray | None = None) -> DataFrame:
    """(session, frame, pose): odometry of each session from points (x, y, z) in the body's frame.

    With ``fixed`` (n x 3) frames are registered against that map, which stays as it is; ``fixed_map`` bounds it.
    """
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in (session, frame))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Slam | None = None
        key: tuple | None = None
        held: list[np.ndarray] = []

        def fresh() -> Slam:
            known = None
            if fixed is not None:
                known = LocalMap(size, reach)
                known.points = fixed
                known._index()
            return Slam(size, reach, fixed=known, start=np.eye(4) if start is None else start)

        def done() -> tuple:
            return (*key, state.put(np.concatenate(held)).ravel().tolist())

        for t in batches:
            out = []
            change = (t[[session, frame]] != t[[session, frame]].shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change).tolist(), len(t)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                now = (t[session].iloc[a], t[frame].iloc[a])
                if key is None or now != key:
                    if key is not None:
                        out.append(done())
                    if key is None or now[0] != key[0]:
                        state = fresh()
                    key, held = now, []
                held.append(t[["x", "y", "z"]].iloc[a:z].to_numpy(float))
            if out:
                yield pd.DataFrame(out, columns=[session, frame, "pose"])
        if key is not None:
            yield pd.DataFrame([done()], columns=[session, frame, "pose"])

    return points.select(session, frame, "x", "y", "z").repartition(session).sortWithinPartitions(session, frame).mapInPandas(run, f"{kinds}, pose array<double>")


def fixed_map(points: DataFrame, size: float, most: int = 2_000_000) -> np.ndarray:
    """A map of one point a voxel for localisation, refused beyond ``most`` points: every task holds it."""
    from beamframe.operators.aggregates import voxel_average

    thin = voxel_average(points, size, ["x", "y", "z"])
    rows = thin.select("x", "y", "z").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"the map has more than {most} voxels; use a larger voxel, or cut it by region")
    return rows.to_numpy(float)


# ---------------------------------------------------------------- motion from the IMU


def imu_motion(imu: DataFrame, keys: list[str], gravity: float = 9.80665) -> DataFrame:
    """(keys, ts_ns, pose, velocity): the motion within each frame from its measurements (ts_ns, acc, gyro, v0), from rest of pose.

    Rotation integrates the angular velocity from measurement to measurement; velocity begins
    at ``v0`` and integrates the acceleration, turned into the frame's first attitude, less
    gravity along +z. A frame's measurements are few; each frame is a task's row group.
    """
    kinds = ", ".join(f"{k} {imu.schema[k].dataType.simpleString()}" for k in keys)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("ts_ns")
        ts = t["ts_ns"].to_numpy(np.int64)
        acc, gyro = (np.stack([np.asarray(x, float) for x in t[c]]) for c in ("acc", "gyro"))
        dt = np.diff(ts) * 1e-9
        turn = rigid.so3_exp(gyro[:-1] * dt[:, None]) if len(ts) > 1 else np.zeros((0, 3, 3))
        poses, speed = np.tile(np.eye(4), (len(ts), 1, 1)), np.zeros((len(ts), 3))
        speed[0] = np.asarray(t["v0"].iloc[0], float)
        down = np.array([0, 0, gravity])
        for i, h in enumerate(dt):
            a = poses[i, :3, :3] @ acc[i] - down
            poses[i + 1, :3, :3] = poses[i, :3, :3] @ turn[i]
            poses[i + 1, :3, 3] = poses[i, :3, 3] + speed[i] * h + 0.5 * a * h * h
            speed[i + 1] = speed[i] + a * h
        return t[[*keys, "ts_ns"]].assign(pose=list(poses.reshape(-1, 16)), velocity=list(speed))

    return imu.groupBy(*keys).applyInPandas(run, f"{kinds}, ts_ns long, pose array<double>, velocity array<double>")


# ---------------------------------------------------------------- constraints

#: Fixed value: seconds that the ends of a loop must lie apart.
LOOP_SECONDS = 10


def loop_closures(poses: DataFrame, key: str, index: str, ts: str, apart: float, cell: float) -> DataFrame:
    """(key, index, candidate, d2): a pose and an earlier one that it comes back to, one a pose at most.

    Candidates lie within ``cell`` and ``apart`` metres back on the path. Once a pose has any, the next
    that may have some lies ``apart`` metres on; of a pose's candidates the nearest more than LOOP_SECONDS
    away counts, those of its own cell first. ``poses``: x, y, z, travelled, ts in nanoseconds.
    The gate walks over poses with candidates only, one track at a time.
    """
    c = loop_candidates(poses, ["x", "y", "z"], cell, index, "travelled", apart, [key])
    about = lambda p: poses.select(key, F.col(index).alias(p), F.col(ts).alias(f"{p}_ts"), F.array(*[F.floor(F.col(a) / cell) for a in "xyz"]).alias(f"{p}_cell"))
    seen = c.select(key, index).distinct().join(poses.select(key, index, "travelled"), [key, index])

    def gate(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(index)
        last, keep = None, []
        for way in t["travelled"]:
            keep.append(last is None or way - last >= apart)
            last = way if keep[-1] else last
        return t[keep][[key, index]]

    schema = f"{key} {poses.schema[key].dataType.simpleString()}, {index} {poses.schema[index].dataType.simpleString()}"
    open_ = seen.groupBy(key).applyInPandas(gate, schema)
    ranked = c.join(open_, [key, index]).join(about(index).withColumnRenamed(f"{index}_ts", "_t").withColumnRenamed(f"{index}_cell", "_c"), [key, index]).join(about("candidate"), [key, "candidate"])
    far = ranked.where(F.abs(F.col("_t") - F.col("candidate_ts")) > LOOP_SECONDS * 1_000_000_000)
    best = F.min(F.struct((F.col("_c") != F.col("candidate_cell")).alias("other"), "d2", "candidate"))
    return far.groupBy(key, index).agg(best.alias("b")).select(key, index, "b.candidate", "b.d2")


def gps_constraints(fixes: DataFrame, key: str, order: str, spacing: float) -> DataFrame:
    """(key, ts_ns, x, y, z, weighs_z): absolute positions from the last fix of frames, ``spacing`` metres apart along the path.

    ``fixes``: a row a frame: order, lat, lon (null without a fix), fix_ts, px, py, pz (null where the
    frame has no pose). The first frame is left out; positions are metres east and north of the first fix used.
    """
    kind = fixes.schema[key].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(order).iloc[1:]
        out, since, before, origin = [], spacing, None, None
        for r in t.itertuples(index=False):
            posed = not (pd.isna(r.px) or pd.isna(r.py))
            if posed:
                if before is not None:
                    since += float(np.hypot(r.px - before[0], r.py - before[1]))
                before = (r.px, r.py)
            if (out and since < spacing) or pd.isna(r.lat) or pd.isna(r.lon) or not np.isfinite([r.lat, r.lon]).all():
                continue
            origin = origin or (r.lat, r.lon)
            east, north = scalar.relative_metres(r.lat, r.lon, *origin)
            out.append((getattr(r, key), int(r.fix_ts), east, north, float(r.pz) if posed else 0.0, posed))
            since = 0.0
        return pd.DataFrame(out, columns=[key, "ts_ns", "x", "y", "z", "weighs_z"])

    return fixes.groupBy(key).applyInPandas(run, f"{key} {kind}, ts_ns long, x double, y double, z double, weighs_z boolean")


KINDS = ("ABSOLUTE_POSE", "ABSOLUTE_POINT", "POSE_TO_POSE", "POINT_TO_POINT")
LOSSES = {
    "TRIVIAL": lambda s: np.ones_like(s),
    "HUBER": lambda s: np.where(s <= 1, 1.0, 1 / np.sqrt(np.maximum(s, 1e-12))),
    "CAUCHY": lambda s: 1 / (1 + s),
    "SOFT_L1": lambda s: 1 / np.sqrt(1 + s),
    "ARCTAN": lambda s: 1 / (1 + s * s),
}


@dataclass
class Constraint:
    """``a`` and ``b``: nodes (b None for absolute ones); ``pose``: 4 x 4; ``point_a``, ``point_b``: points in the nodes' frames, or the world for an absolute one."""

    kind: str
    a: int
    b: int | None = None
    pose: np.ndarray | None = None
    point_a: np.ndarray | None = None
    point_b: np.ndarray | None = None
    rotation_weight: float = 1.0
    translation_weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


def _pose_of(value: object) -> np.ndarray | None:
    if isinstance(value, list) and len(value) == 16:
        return np.array(value, float).reshape(4, 4)
    if isinstance(value, dict):
        return rigid.from_position_euler(np.array([float(value.get(k, 0)) for k in ("x", "y", "z", "rx", "ry", "rz")]))
    return None


#: Members that a constraint of each kind needs, beside its type.
NEEDED = {"ABSOLUTE_POSE": ("timestamp", "pose"), "ABSOLUTE_POINT": ("timestamp", "row", "col", "absolute_position"), "POSE_TO_POSE": ("timestamp1", "timestamp2"), "POINT_TO_POINT": ("timestamp1", "row1", "col1", "timestamp2", "row2", "col2")}


def parse_constraints(document: str) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """(constraints, issues) of a configuration: valid ones with all members, weights defaulting to 1; what is wrong by path."""
    issues: list[tuple[str, str, str]] = []
    try:
        doc = json.loads(document)
        listed = doc["constraints"]
        if not isinstance(listed, list):
            raise TypeError("not a list")
    except (ValueError, KeyError, TypeError) as e:
        return [], [("$.constraints", f"missing or invalid: {e}", "critical")]
    out = []
    for i, c in enumerate(listed):
        path = f"$.constraints[{i}]"
        kind = c.get("type") if isinstance(c, dict) else None
        if kind not in KINDS:
            issues.append((f"{path}.type", f"unknown type {kind}", "critical"))
            continue
        bad = [(f"{path}.{k}", "missing", "critical") for k in NEEDED[kind] if k not in c]
        for k in ("pose", "relative_pose", "transformation"):
            if k in c and _pose_of(c[k]) is None:
                bad.append((f"{path}.{k}", "neither 16 numbers nor x, y, z, rx, ry, rz", "critical"))
        weights = c.get("translation_weight", c.get("translation_weights", [1.0, 1.0, 1.0]))
        weights = [weights] * 3 if isinstance(weights, int | float) else weights
        if not isinstance(weights, list) or len(weights) != 3 or any(not isinstance(w, int | float) or w < 0 for w in weights):
            bad.append((f"{path}.translation_weight", "not three numbers of 0 or more", "critical"))
        if not isinstance(c.get("rotation_weight", 1.0), int | float):
            bad.append((f"{path}.rotation_weight", "not a number", "critical"))
        issues += bad
        if not bad:
            out.append(c | {"translation_weights": [float(w) for w in weights], "rotation_weight": float(c.get("rotation_weight", 1.0))})
    return out, issues


def write_constraints(constraints: list[dict]) -> str:
    return json.dumps({"constraints": constraints}, sort_keys=True)


def _residuals(r: np.ndarray, t: np.ndarray, group: dict[str, dict]) -> list[tuple[str, np.ndarray]]:
    out = []
    for kind, g in group.items():
        ra, ta = r[g["a"]], t[g["a"]]
        rb, tb = (r[g["b"]], t[g["b"]]) if kind in ("POSE_TO_POSE", "POINT_TO_POINT") else (None, None)
        inv = lambda m: np.swapaxes(m, -1, -2)
        move = lambda m, x: np.einsum("nij,nj->ni", m, x)
        if kind == "POSE_TO_POSE":
            e = np.concatenate([rigid.so3_log(inv(rb) @ ra @ g["pose"][:, :3, :3]), g["pose"][:, :3, 3] - move(inv(ra), tb - ta)], axis=1)
        elif kind == "ABSOLUTE_POSE":
            e = np.concatenate([rigid.so3_log(inv(ra) @ g["pose"][:, :3, :3]), ta - g["pose"][:, :3, 3]], axis=1)
        elif kind == "ABSOLUTE_POINT":
            e = move(ra, g["point_a"]) + ta - g["point_b"]
        else:
            e = move(ra, g["point_a"]) + ta - move(rb, g["point_b"]) - tb
        out.append((kind, e * g["weights"]))
    return out


def solve(start: np.ndarray, constraints: list[Constraint], loss: str = "TRIVIAL", rounds: int = 50, fix_first: bool = True, tolerance: float = 1e-10) -> np.ndarray:
    """Poses (n x 4 x 4) of a graph: Gauss-Newton with robust weights; each round solves its sparse system by conjugate gradients.

    What is held grows with nodes and constraints, never with their square. Key frames
    are few against the points, so the solver runs on one machine.
    """
    n = len(start)
    r, t = start[:, :3, :3].copy(), start[:, :3, 3].copy()
    group: dict[str, dict] = {}
    for kind in KINDS:
        own = [c for c in constraints if c.kind == kind]
        if own:
            point = kind.endswith("POINT")
            group[kind] = {
                "a": np.array([c.a for c in own]), "b": np.array([c.a if c.b is None else c.b for c in own]),
                "pose": None if point else np.stack([c.pose for c in own]),
                "point_a": np.stack([c.point_a for c in own]) if point else None, "point_b": np.stack([c.point_b for c in own]) if point else None,
                "weights": np.array([[*([] if point else [c.rotation_weight] * 3), *c.translation_weights] for c in own]),
            }
    eps = 1e-6

    def moved(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return r @ rigid.so3_exp(step[:, :3]), t + step[:, 3:]

    for _ in range(rounds):
        base = _residuals(r, t, group)
        blocks = []
        for kind, e in base:
            g = group[kind]
            w = LOSSES[loss]((e * e).sum(axis=1))
            two = kind in ("POSE_TO_POSE", "POINT_TO_POINT")
            jac = {s: np.zeros((len(e), e.shape[1], 6)) for s in ("a", "b")[: 1 + two]}
            for s, out in jac.items():
                for c in range(6):
                    # only this end of each constraint moves: a copy of the node beside the others
                    nodes = g[s]
                    d = np.zeros((len(e), 6))
                    d[:, c] = eps
                    rs, ts = r[nodes] @ rigid.so3_exp(d[:, :3]), t[nodes] + d[:, 3:]
                    one = {kind: g | {s: n + np.arange(len(e))}}
                    out[:, :, c] = (_residuals(np.concatenate([r, rs]), np.concatenate([t, ts]), one)[0][1] - e) / eps
            blocks.append((g, jac, e, w))
        grad, diag = np.zeros((n, 6)), np.full((n, 6, 6), np.eye(6) * 1e-9)
        for g, jac, e, w in blocks:
            for s, j in jac.items():
                np.add.at(grad, g[s], np.einsum("nki,n,nk->ni", j, w, e))
                np.add.at(diag, g[s], np.einsum("nki,n,nkj->nij", j, w, j))
        if fix_first:
            diag[0] += np.eye(6) * 1e12

        def times(x: np.ndarray) -> np.ndarray:
            y = x * 1e-9
            if fix_first:
                y[0] += x[0] * 1e12
            for g, jac, _, w in blocks:  # noqa: B023
                e = sum(np.einsum("nki,ni->nk", j, x[g[s]]) for s, j in jac.items()) * w[:, None]
                for s, j in jac.items():
                    np.add.at(y, g[s], np.einsum("nki,nk->ni", j, e))
            return y

        pre = np.linalg.inv(diag)
        x, rest = np.zeros((n, 6)), -grad
        z = np.einsum("nij,nj->ni", pre, rest)
        p, rz = z.copy(), float((rest * z).sum())
        for _ in range(10 * n + 50):
            if rz < 1e-24:
                break
            ap = times(p)
            alpha = rz / max(float((p * ap).sum()), 1e-300)
            x += alpha * p
            rest -= alpha * ap
            z = np.einsum("nij,nj->ni", pre, rest)
            new = float((rest * z).sum())
            p, rz = z + p * (new / rz), new
        r, t = moved(x)
        if np.abs(x).max() < tolerance:
            break
    out = np.tile(np.eye(4), (n, 1, 1))
    out[:, :3, :3], out[:, :3, 3] = r, t
    return rigid.orthonormal(out)


def error(poses: np.ndarray, constraints: list[Constraint]) -> float:
    """Sum of the squared weighted residuals."""
    total = 0.0
    for c in constraints:
        point = c.kind.endswith("POINT")
        g = {"a": np.array([c.a]), "b": np.array([c.a if c.b is None else c.b]), "pose": None if point else c.pose[None], "point_a": c.point_a[None] if point else None, "point_b": c.point_b[None] if point else None, "weights": np.array([[*([] if point else [c.rotation_weight] * 3), *c.translation_weights]])}
        total += float((_residuals(poses[:, :3, :3], poses[:, :3, 3], {c.kind: g})[0][1] ** 2).sum())
    return total


def odometry_constraints(nodes: DataFrame, key: str, index: str, pose: str) -> DataFrame:
    """(key, a, b, diff): each node with its follower and the pose from the one to the other."""
    w = Window.partitionBy(key).orderBy(index)
    pairs = nodes.select(key, F.col(index).alias("a"), F.lead(index).over(w).alias("b"), F.col(pose).alias("_p"), F.lead(pose).over(w).alias("_q")).where("b is not null")
    return pairs.select(key, "a", "b", rigid.pose_compose(rigid.pose_inverse("_p"), "_q").alias("diff"))


def optimised(spark: SparkSession, nodes: list[tuple[int, list[float]]], edges: list[tuple[int, int, list[float]]], loss: str = "HUBER") -> DataFrame:
    """(index, pose) of a graph of key frames with relative poses."""
    at = {k: i for i, (k, _) in enumerate(nodes)}
    start = np.array([p for _, p in nodes], float).reshape(-1, 4, 4)
    found = solve(start, [Constraint("POSE_TO_POSE", at[a], at[b], np.array(d, float).reshape(4, 4)) for a, b, d in edges], loss)
    return spark.createDataFrame([(k, p.ravel().tolist()) for (k, _), p in zip(nodes, found, strict=True)], "index long, pose array<double>")


# ---------------------------------------------------------------- alignment of whole clouds


def yaw_and_shift(source: np.ndarray, target: np.ndarray, cell: float, turns: int = 72, most: int = 4) -> list[np.ndarray]:
    """Up to ``most`` poses, turns about z with a shift in the plane, by correlation of occupancy images, the likeliest first.

    Both clouds become images of occupied cells; for each turn the shift of the best
    overlap comes from one product of their Fourier transforms. Turns whose neighbours do
    no better are kept. The height is the difference of the medians.
    """
    both = np.concatenate([source[:, :2], target[:, :2]])
    reach = np.abs(both - target[:, :2].mean(axis=0)).max() * 2 + cell
    size = 1 << int(np.ceil(np.log2(max(2 * reach / cell, 4))))
    middle = target[:, :2].mean(axis=0)

    def image(xy: np.ndarray) -> np.ndarray:
        at = np.floor((xy - middle) / cell).astype(int) + size // 2
        at = at[((at >= 0) & (at < size)).all(axis=1)]
        out = np.zeros((size, size))
        out[at[:, 0], at[:, 1]] = 1
        return out

    wanted = np.fft.rfft2(image(target[:, :2]))
    centre = source[:, :2].mean(axis=0)
    found, scores = [], np.zeros(turns)
    for k in range(turns):
        angle = 2 * np.pi * k / turns
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        own = image((source[:, :2] - centre) @ turn.T + middle)
        score = np.fft.irfft2(wanted * np.conj(np.fft.rfft2(own)), (size, size))
        i, j = np.unravel_index(int(score.argmax()), score.shape)
        scores[k] = score[i, j]
        pose = np.eye(4)
        pose[:2, :2] = turn
        pose[:2, 3] = middle + ((np.array([i, j]) + size // 2) % size - size // 2) * cell - turn @ centre
        pose[2, 3] = np.median(target[:, 2]) - np.median(source[:, 2])
        found.append(pose)
    peak = np.flatnonzero((scores >= np.roll(scores, 1)) & (scores >= np.roll(scores, -1)))
    return [found[k] for k in sorted(peak, key=lambda k: -scores[k])[:most]]


def cloud_normals(local: LocalMap, reach: float) -> np.ndarray:
    """A normal of each point of a map, from the spread of its neighbours; the z axis where there are too few."""
    out = np.tile([0.0, 0.0, 1.0], (len(local.points), 1))
    home = np.floor(local.points / local.size).astype(np.int64)
    total, second, n = np.zeros_like(local.points), np.zeros((len(local.points), 3, 3)), np.zeros(len(local.points))
    for step in _NEAR:
        key = cell_keys(home + step)
        first, count = np.searchsorted(local.keys, key), np.searchsorted(local.keys, key, side="right")
        count = count - first
        on = np.flatnonzero(count)
        for part in np.split(on, np.flatnonzero(np.diff(np.cumsum(count[on]) // _PAIRS)) + 1) if len(on) else []:
            of = np.repeat(part, count[part])
            at = np.arange(len(of)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + first[of]
            d = local.points[at] - local.points[of]
            near = (d * d).sum(axis=1) < reach * reach
            k, d = of[near], d[near]
            n += np.bincount(k, minlength=len(n))
            for i in range(3):
                total[:, i] += np.bincount(k, d[:, i], len(n))
                for j in range(3):
                    second[:, i, j] += np.bincount(k, d[:, i] * d[:, j], len(n))
    ok = n >= 5
    mean = total[ok] / n[ok, None]
    out[ok] = np.linalg.eigh(second[ok] / n[ok, None, None] - mean[:, :, None] * mean[:, None, :])[1][:, :, 0]
    return out


def align_pair(source: np.ndarray, target: np.ndarray, cell: float = 0.5, reach: float = 1.0) -> tuple[np.ndarray, float]:
    """(pose, confidence) that moves a cloud onto another without a first guess: turns and shifts by correlation, each refined point to plane, the best kept.

    Confidence is the share of the source's voxels with a point of the target within ``reach`` / 4.
    """
    local = LocalMap(cell, np.inf)
    local.points = target[one_per_cell(target, cell / 4)]
    local._index()
    normals = cloud_normals(local, 1.5 * cell)
    thin = source[one_per_cell(source, cell / 2)]
    wide = {}
    for r in (4 * cell, 2 * cell, cell):  # the farther it looks, the thinner the cloud
        some = one_per_cell(local.points, r / 3)
        held = LocalMap(r, np.inf)
        order = some[np.argsort(cell_keys(np.floor(local.points[some] / r)), kind="stable")]
        held.points = local.points[some]
        held._index()
        wide[r] = held, normals[order]
    def refined(pose: np.ndarray, r: float, rounds: int) -> np.ndarray:
        held, n = wide[r]
        some = thin[one_per_cell(thin, r / 2)]
        return register(some @ pose[:3, :3].T + pose[:3, 3], held, r, reach, rounds=rounds, normals=n) @ pose

    def share(pose: np.ndarray, most: float) -> float:
        near, _ = local.nearest(thin @ pose[:3, :3].T + pose[:3, 3], most)
        return float((near >= 0).mean())

    rough = [refined(p, 4 * cell, 15) for p in yaw_and_shift(source, target, cell)]
    pose = max(rough, key=lambda p: share(p, reach / 2))
    for r in (2 * cell, cell):
        pose = refined(pose, r, 20)
    return pose, share(pose, reach / 4)


def align_clouds(clouds: DataFrame, key: str, reference: object, cell: float = 0.5) -> DataFrame:
    """(key, pose, confidence): each cloud of a rig against the reference's, in parallel by cloud.

    Clouds are thinned to a voxel of cell / 4 by an aggregate first; the thinned reference goes to every task.
    """
    from beamframe.operators.aggregates import voxels

    thin = voxels(clouds.select(key, "x", "y", "z"), cell / 4).groupBy(key, "vx", "vy", "vz").agg(*[F.avg(a).alias(a) for a in "xyz"]).select(key, "x", "y", "z")
    target = thin.where(F.col(key) == reference).select("x", "y", "z").toPandas().to_numpy(float)
    kind = clouds.schema[key].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        pose, sure = align_pair(t[["x", "y", "z"]].to_numpy(float), target, cell)
        return pd.DataFrame([(t[key].iloc[0], pose.ravel().tolist(), sure)], columns=[key, "pose", "confidence"])

    return thin.where(F.col(key) != reference).groupBy(key).applyInPandas(run, f"{key} {kind}, pose array<double>, confidence double")


def rig_extrinsics(clouds: DataFrame, key: str, reference: object, cell: float = 0.5, least: float = 0.0) -> str:
    """The extrinsics document of a rig: each sensor's pose in the reference's frame, by alignment of their clouds; an error names sensors that align worse than ``least``."""
    from beamframe.sources.metadata import write_extrinsics

    found = align_clouds(clouds, key, reference, cell).collect()  # one row a sensor
    weak = sorted(str(r[key]) for r in found if r["confidence"] < least)
    if weak:
        raise ValueError(f"no alignment of {', '.join(weak)}")
    return write_extrinsics([(str(reference), np.eye(4).ravel().tolist()), *[(str(r[key]), r["pose"]) for r in found]], str(reference))
