"""Packets to frames: one pure reducer, run over sorted batches or as keyed state of a stream.

Rules of the reducer, per sensor: a packet of the active frame is added and the frame
closes once all expected packets were seen; packets of finished or older frames are
dropped and counted; packets of later frames wait, smallest frame first, and when
LIMIT of them wait the active frame closes incomplete; a new init_id closes the active
frame and starts anew with the packet. The caller closes what is left at the end.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4


def difference(a: int, b: int, largest: int) -> int:
    """b - a on a wrapping counter, the nearer way round."""
    turn = largest + 1
    d = (b - a) % turn
    return d - turn if d > turn // 2 else d


@dataclass
class State:
    init: int | None = None
    frame: int | None = None
    finished: int | None = None
    seen: dict[int, int] = field(default_factory=dict)  # packet_no -> host_ts
    added: int = 0
    waiting: list[tuple[int, int, int]] = field(default_factory=list)  # frame, packet_no, host_ts
    dropped: int = 0


class Batcher:
    def __init__(self, expected: int, largest: int = 65535, limit: int = LIMIT, state: State | None = None) -> None:
        self.expected, self.largest, self.limit, self.s = expected, largest, limit, state or State()

    def _close(self) -> dict:
        s = self.s
        ts = [t for t in s.seen.values() if t]
        out = {"init_id": s.init, "frame_id": s.frame, "packets": s.added, "distinct_packets": len(s.seen), "complete": self._whole(), "first_ts": min(ts, default=0), "last_ts": max(ts, default=0), "dropped": s.dropped}
        s.finished, s.frame, s.seen, s.added, s.dropped = s.frame, None, {}, 0, 0
        return out

    def _whole(self) -> bool:
        return self.s.added >= self.expected and sum(t != 0 for t in self.s.seen.values()) == self.expected

    def _add(self, frame: int, no: int, ts: int) -> Iterator[dict]:
        s = self.s
        s.frame = frame
        s.seen[no] = ts
        s.added += 1
        if self._whole():
            yield self._close()

    def _old(self, frame: int) -> bool:
        return self.s.finished is not None and difference(self.s.finished, frame, self.largest) <= 0

    def _drain(self) -> Iterator[dict]:
        s = self.s
        while s.waiting:
            base = s.frame if s.frame is not None else s.waiting[0][0]
            s.waiting.sort(key=lambda w: difference(base, w[0], self.largest))
            frame, no, ts = s.waiting[0]
            step = 0 if s.frame is None else difference(s.frame, frame, self.largest)
            if (s.frame is None and self._old(frame)) or step < 0:
                s.waiting.pop(0)
                s.dropped += 1
            elif step == 0:
                s.waiting.pop(0)
                yield from self._add(frame, no, ts)
            elif len(s.waiting) >= self.limit:
                yield self._close()
            else:
                return

    def put(self, init: int, frame: int, no: int, ts: int) -> Iterator[dict]:
        s = self.s
        if init != s.init:
            active = s.frame is not None
            if active:
                yield self._close()
            s.init, s.finished, s.frame, s.seen, s.added, s.waiting = init, None, None, {}, 0, []
            if active:
                s.waiting.append((frame, no, ts))
            else:
                yield from self._add(frame, no, ts)
            return
        if not s.waiting:
            if self._old(frame):
                s.dropped += 1
                return
            if s.frame is None or s.frame == frame:
                yield from self._add(frame, no, ts)
                return
        s.waiting.append((frame, no, ts))
        yield from self._drain()

    def finish(self) -> Iterator[dict]:
        self.limit = 1
        yield from self._drain()
        if self.s.frame is not None:
            yield self._close()


_FRAME = "sensor_idx int, init_id long, frame_id long, packets long, distinct_packets long, complete boolean, first_ts long, last_ts long, dropped long"


def batch_summary(packets: DataFrame) -> DataFrame:
    """Frames of an archive, where order doesn't matter: one aggregate, no state."""
    return packets.groupBy("sensor_idx", "init_id", "frame_id").agg(
        F.count(F.lit(1)).alias("packets"), F.countDistinct("packet_no").alias("distinct_packets"), F.min("host_ts").alias("first_ts"), F.max("host_ts").alias("last_ts")
    )


def batch_exact(packets: DataFrame, expected: int, largest: int = 65535) -> DataFrame:
    """The reducer over each sensor's packets in arrival order (``seq``), streamed through sorted partitions."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sensor, b = None, None
        for t in batches:
            out = []
            for r in t.itertuples(index=False):
                if r.sensor_idx != sensor:
                    out += [{"sensor_idx": sensor} | x for x in (b.finish() if b else ())]
                    sensor, b = r.sensor_idx, Batcher(expected, largest)
                out += [{"sensor_idx": sensor} | x for x in b.put(r.init_id, r.frame_id, r.packet_no, r.host_ts)]
            if out:
                yield pd.DataFrame(out)
        if b and (rest := [{"sensor_idx": sensor} | x for x in b.finish()]):
            yield pd.DataFrame(rest)

    ordered = packets.select("sensor_idx", "seq", "init_id", "frame_id", "packet_no", "host_ts").repartition("sensor_idx").sortWithinPartitions("sensor_idx", "seq")
    return ordered.mapInPandas(run, _FRAME)


def batch_stream(packets: DataFrame, expected: int, largest: int = 65535) -> DataFrame:
    """The same reducer as state of a packet stream; open frames close when a sensor falls silent for a minute."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, tables, state):  # noqa: ANN001, ANN202
        b = Batcher(expected, largest, state=State(*pickle.loads(state.get[0])) if state.exists else None)  # the state's own bytes: plain values
        out = []
        if state.hasTimedOut:
            out = list(b.finish())
            state.remove()
        else:
            for t in tables:
                for r in t.sort_values("seq").itertuples(index=False):
                    out += b.put(r.init_id, r.frame_id, r.packet_no, r.host_ts)
            state.update((pickle.dumps(tuple(getattr(b.s, f.name) for f in fields(b.s))),))
            state.setTimeoutDuration(60_000)
        yield pd.DataFrame([{"sensor_idx": key[0]} | x for x in out], columns=[c.split()[0] for c in _FRAME.split(", ")])

    return packets.groupBy("sensor_idx").applyInPandasWithState(run, _FRAME, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
