"""Frames of several sensors to sets, in time order: one pure reducer."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Nanoseconds that a set may span where sensors aren't synchronised.
DT = 210_000_000


#: Thousandths of a degree of a whole turn.
TURN = 360_000


@dataclass(frozen=True)
class Timing:
    """What a sensor's configuration says about when its frames end: rates, phase lock and azimuth window in thousandths of a degree."""

    fps: float
    phase_locked: bool = False
    own_clock: bool = True
    phase_offset: int = 0
    azimuth_window: tuple[int, int] = (0, TURN)
    imu_in_frame: bool = False
    zones: bool = False


def synchronised(sensors: list[Timing]) -> bool:
    """Whether several sensors turn in step: one rate, all locked in phase, none on its own clock."""
    return len(sensors) > 1 and len({s.fps for s in sensors}) == 1 and all(s.phase_locked and not s.own_clock for s in sensors)


def latencies(sensors: list[Timing]) -> tuple[dict[int, int], int]:
    """(latency of each sensor's frame ends in nanoseconds, the least 0; the period) of synchronised sensors.

    A frame ends where its azimuth window ends, or with the turn if the window wraps or an IMU or
    zone packet comes last. Ends are taken around the turn so that they lie as close as they can.
    """
    if any(not s.fps for s in sensors):
        raise ValueError("a sensor's rate is 0")
    period = 1.0 / sensors[-1].fps
    ends = []
    for s in sensors:
        low, high = s.azimuth_window
        end = max(TURN if s.imu_in_frame or s.zones else 0, high if low < high else TURN)
        ends.append((s.phase_offset + end) % TURN / TURN / s.fps)
    around = [e if e < period * 0.5 else e - period for e in ends]
    if max(around) - min(around) < max(ends) - min(ends):
        ends = around
    first = min(ends)
    return {i: int((e - first) * 1e9) for i, e in enumerate(ends)}, int(period * 1e9)


class Collator:
    """Unsynchronised: a set closes when a frame is ``dt`` later than its first, a sensor comes twice, or all are there.
    Synchronised (``latency`` per sensor): when a frame comes half a period after it was due.
    """

    def __init__(self, sensors: int, dt: int = DT, latency: dict[int, int] | None = None) -> None:
        self.sensors, self.dt, self.latency = sensors, dt, latency
        self.slots: dict[int, int] = {}
        self.first_ts: int | None = None
        self.first_idx = 0

    def _take(self) -> dict[int, int]:
        out, self.slots, self.first_ts = self.slots, {}, None
        return out

    def put(self, idx: int, frame: int, ts: int) -> Iterator[dict[int, int]]:
        late = False
        if self.first_ts is not None:
            if self.latency is None:
                late = ts >= self.first_ts + self.dt
            else:
                late = ts > self.first_ts - self.latency[self.first_idx] + self.latency[idx] + self.dt / 2
        if (late or idx in self.slots) and self.slots:
            yield self._take()
        if self.first_ts is None or late:
            self.first_ts, self.first_idx = ts, idx
        self.slots[idx] = frame
        if len(self.slots) == self.sensors:
            yield self._take()

    def finish(self) -> Iterator[dict[int, int]]:
        if self.slots:
            yield self._take()


def collate(frames: DataFrame, key: str, sensors: int, dt: int = DT, latency: dict[int, int] | None = None) -> DataFrame:
    """(key, set_id, sensor_idx, frame_id) of frames by time; each session streams through a sorted partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, c, n = None, None, 0

        def rows(sets: Iterator[dict[int, int]]) -> list[tuple]:
            nonlocal n
            out = []
            for s in sets:
                out += [(session, n, i, f) for i, f in sorted(s.items())]
                n += 1
            return out

        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                if c is None or r[0] != session:
                    out += rows(c.finish()) if c else []
                    session, c, n = r[0], Collator(sensors, dt, latency), 0
                out += rows(c.put(r.sensor_idx, r.frame_id, r.ts))
            yield pd.DataFrame(out, columns=[key, "set_id", "sensor_idx", "frame_id"])
        if c:
            yield pd.DataFrame(rows(c.finish()), columns=[key, "set_id", "sensor_idx", "frame_id"])

    kind = frames.schema[key].dataType.simpleString()
    ordered = frames.select(key, "ts", "sensor_idx", "frame_id").repartition(key).sortWithinPartitions(key, "ts", "sensor_idx")
    return ordered.mapInPandas(run, f"{key} {kind}, set_id long, sensor_idx int, frame_id long")


def collate_stream(frames: DataFrame, key: str, sensors: int, dt: int = DT, latency: dict[int, int] | None = None, silence: str = "1 minute") -> DataFrame:
    """The same reducer as state of a stream of frames; a set that is open when a session falls silent closes then."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = frames.schema[key].dataType.simpleString()
    names = [key, "set_id", "sensor_idx", "frame_id"]
    minutes = int(pd.Timedelta(silence).total_seconds() * 1000)

    def run(session, tables, state):  # noqa: ANN001, ANN202
        c, n = Collator(sensors, dt, latency), 0
        if state.exists:
            c.slots, c.first_ts, c.first_idx, n = pickle.loads(state.get[0])  # the state's own bytes: plain values
        out = []

        def keep(sets: Iterator[dict[int, int]]) -> None:
            nonlocal n
            for s in sets:
                out.extend((session[0], n, i, f) for i, f in sorted(s.items()))
                n += 1

        if state.hasTimedOut:
            keep(c.finish())
            state.remove()
        else:
            for r in pd.concat(list(tables)).sort_values(["ts", "sensor_idx"]).itertuples(index=False):
                keep(c.put(r.sensor_idx, r.frame_id, r.ts))
            state.update((pickle.dumps((c.slots, c.first_ts, c.first_idx, n)),))
            state.setTimeoutDuration(minutes)
        yield pd.DataFrame(out, columns=names)

    return frames.select(key, "ts", "sensor_idx", "frame_id").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, set_id long, sensor_idx int, frame_id long", "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def index_table(members: DataFrame, key: str) -> DataFrame:
    """(key, set_id, first): the earliest frame of each set, where a reader begins to fetch it."""
    from pyspark.sql import functions as F

    return members.groupBy(key, "set_id").agg(F.min("frame_id").alias("first"))
