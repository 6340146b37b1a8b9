"""Live cameras as streams: lost signals, and the n-th frames of all streams together."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

GAP_ROWS = "camera_id long, last_ts timestamp, gap_at timestamp, is_gap boolean"


def _micros(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts).dt.tz_localize(None).astype("datetime64[us]").astype("int64")).tolist()


class GapProcessor(StatefulProcessor):
    """Silence of one camera, by event-time timers.

    A frame at x sets a timer for x + limit unless a later one within the limit is
    known.  The timer fires when the watermark has passed it, so every frame up to
    there has come: if none followed x, the signal was lost.  Which rows come out
    thus depends on the frames alone, not on their batches.
    """

    def __init__(self, limit_us: int) -> None:
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("frames", StructType([StructField("state", StringType())]))

    def _known(self) -> list[int]:
        return json.loads(self.memory.get()[0]) if self.memory.exists() else []

    def _timer(self, at: int) -> int:
        return -(-(at + self.limit) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = set(self._known())
        for batch in rows:
            known.update(_micros(batch["ts"]))
        held = sorted(known)
        open_ = [x for x, y in zip(held, [*held[1:], None], strict=True) if y is None or y - x > self.limit]
        # frames behind the watermark that are followed can no longer be next to a new one
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = sorted({*open_, *[x for x in held if x >= passed]})
        set_already = set(self.handle.listTimers())
        for x in open_:
            if self._timer(x) not in set_already:
                self.handle.registerTimer(self._timer(x))
        self.memory.update((json.dumps(kept),))
        return iter([pd.DataFrame(columns=["camera_id", "last_ts", "gap_at", "is_gap"])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        due, held = expiredTimerInfo.getExpiryTimeInMs(), self._known()
        lost = [x for x, y in zip(held, [*held[1:], None], strict=True) if self._timer(x) <= due and (y is None or y - x > self.limit)]
        left = [x for x in held if self._timer(x) > due]
        self.memory.update((json.dumps(left),)) if left else self.memory.clear()
        at = lambda us: pd.Timestamp(us, unit="us")
        yield pd.DataFrame([(key[0], at(x), at(x + self.limit), True) for x in lost], columns=["camera_id", "last_ts", "gap_at", "is_gap"])

    def close(self) -> None:
        pass


def streaming_gaps(frames: DataFrame, limit: timedelta, late: str = "1 minute") -> DataFrame:
    """camera_id, last_ts, gap_at, is_gap: one row for each silence of more than
    ``limit`` in a stream of (camera_id, ts) frames, ``late`` at most; it comes when
    the watermark passes the limit, whether the signal returns or not."""
    timed = frames.where("camera_id is not null and ts is not null").select("camera_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    processor = GapProcessor(int(limit / timedelta(microseconds=1)))
    return timed.groupBy("camera_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=GAP_ROWS, outputMode="Append", timeMode="EventTime")


class OrdinalProcessor(StatefulProcessor):
    """Numbers the frames of one stream from 1, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = self.seen.get()[0] if self.seen.exists() else 0
        frames = pd.concat([batch["frame_no"] for batch in rows]).sort_values().tolist()
        self.seen.update((n + len(frames),))
        yield pd.DataFrame({"step": range(n + 1, n + 1 + len(frames)), "camera_id": key[0], "frame_no": frames})

    def close(self) -> None:
        pass


class BarrierProcessor(StatefulProcessor):
    """Holds the frames of one step until every stream has its own."""

    def __init__(self, cameras: list[int]) -> None:
        self.cameras = cameras

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", StructType([StructField("camera_id", LongType())]), StructType([StructField("frame_no", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for camera, frame in zip(batch["camera_id"], batch["frame_no"], strict=True):
                self.held.updateValue((int(camera),), (int(frame),))
        names = ["step", *[f"frame_{c}" for c in self.cameras]]
        if not all(self.held.containsKey((c,)) for c in self.cameras):
            return iter([pd.DataFrame(columns=names)])
        row = [key[0], *[self.held.getValue((c,))[0] for c in self.cameras]]
        self.held.clear()
        return iter([pd.DataFrame([row], columns=names)])

    def close(self) -> None:
        pass


def streaming_zip(frames: DataFrame, cameras: list[int]) -> DataFrame:
    """step and one frame number for each of ``cameras``: the n-th frames of live
    streams (camera_id, frame_no) together, as soon as the slowest has its n-th.

    A stream's frames have to come in their order, however the streams interleave.
    Two keyed states: a counter for each stream, and for each step what has come,
    so steps that wait lie spread over the cluster; what is held is how far the
    streams are apart.
    """
    own = frames.where(F.col("camera_id").isin(*cameras)).select("camera_id", "frame_no")
    kinds = "step long, camera_id long, frame_no long"
    counted = own.groupBy("camera_id").transformWithStateInPandas(statefulProcessor=OrdinalProcessor(), outputStructType=kinds, outputMode="Append", timeMode="None")
    wide = "step long, " + ", ".join(f"frame_{c} long" for c in cameras)
    return counted.groupBy("step").transformWithStateInPandas(statefulProcessor=BarrierProcessor(cameras), outputStructType=wide, outputMode="Append", timeMode="None")
