"""The stateful operators as streams: same input, same answers as in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from framequery.operators.regions import region_hits
from framequery.operators.tracker import BOX, TrackerOptions, Tracks, fold_frames
from framequery.operators.tracks import fold_frame

TRACK_ROWS = "camera_id long, frame_no long, det_idx long, track_id long, length long"


def streaming_region_totals(det: DataFrame, regions: DataFrame) -> DataFrame:
    """Running totals of hits (each detection counts), in update or complete mode."""
    return region_hits(det, regions, "each").groupBy("region_id", "camera_id").agg(F.count("*").alias("c"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Detections a camera and window of event time."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = ts.groupBy(F.window("ts", width).alias("w"), "camera_id").agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("start"), "camera_id", "n")


class TrackProcessor(StatefulProcessor):
    """Trajectory lengths of one camera with a memory of ``cap`` tracks.

    A frame is folded when a later one has come, so a frame that is split over
    micro-batches is not taken for a frame that lost its other tracks; rows of
    a frame that was folded already are late and dropped.  ``flush`` folds the
    newest frame with the batch too, for input that is whole in every batch.
    """

    def __init__(self, cap: int = 30, flush: bool = False) -> None:
        self.cap, self.flush = cap, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("state", StringType())])
        self.memory = handle.getValueState("memory", kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        import json

        known = json.loads(self.memory.get()[0]) if self.memory.exists() else {"done": None, "tracks": [], "held": []}
        columns = ["frame_no", "det_idx", "track_id"]
        parts = [np.array(known["held"], np.int64).reshape(-1, 3), *[batch[columns].to_numpy(np.int64) for batch in rows]]
        held = np.concatenate(parts)
        if known["done"] is not None:
            held = held[held[:, 0] > known["done"]]
        held = held[np.lexsort(held.T[::-1])]
        ends = np.flatnonzero(np.diff(held[:, 0], append=held[-1:, 0] + 1)) + 1
        ready = ends if self.flush else ends[:-1]
        tracks, lengths, start, of_row = {t: n for t, n in known["tracks"]}, [], 0, held[:, 2].tolist()
        for end in ready.tolist():
            lengths += fold_frame(tracks, of_row[start:end], self.cap)[0]
            start = end
        done = int(held[start - 1, 0]) if start else known["done"]
        self.memory.update((json.dumps({"done": done, "tracks": list(tracks.items()), "held": held[start:].tolist()}),))
        yield pd.DataFrame(held[:start], columns=columns).assign(camera_id=key[0], length=np.array(lengths, np.int64))[["camera_id", *columns, "length"]]

    def close(self) -> None:
        pass


def streaming_tracks(det: DataFrame, cap: int = 30, flush: bool = False) -> DataFrame:
    """TRACK_ROWS of a stream of detections, one state a camera (RocksDB provider)."""
    seen = det.where("track_id is not null").select("camera_id", "frame_no", "det_idx", "track_id")
    keyed = seen.groupBy("camera_id")
    return keyed.transformWithStateInPandas(statefulProcessor=TrackProcessor(cap, flush), outputStructType=TRACK_ROWS, outputMode="Append", timeMode="None")


class AssignProcessor(StatefulProcessor):
    """Assigns the boxes of one camera to tracks; the tracker's state is kept.

    A frame is folded when a later one has come, as its boxes may be split over
    micro-batches; rows of a frame that was folded already are late and dropped.
    ``flush`` folds the newest frame too, for input that is whole in every batch.
    """

    def __init__(self, options: TrackerOptions, flush: bool = False) -> None:
        self.options, self.flush = options, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("tracker", StructType([StructField("state", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        import json

        known = json.loads(self.memory.get()[0]) if self.memory.exists() else {"done": None, "tracks": Tracks().to_dict(), "held": []}
        columns = ["frame_no", "det_idx", "conf", *BOX]
        parts = [pd.DataFrame(known["held"], columns=columns), *[batch[columns] for batch in rows]]
        held = pd.concat([p for p in parts if len(p)]).sort_values(["frame_no", "det_idx"])
        if known["done"] is not None:
            held = held[held["frame_no"] > known["done"]]
        newest = held["frame_no"].max() if len(held) else None
        tracks = Tracks.from_dict(known["tracks"])
        ready = held if self.flush else held[held["frame_no"] < newest]
        frames = ready["frame_no"].to_numpy(np.int64)
        ids = fold_frames(tracks, frames, ready[BOX].to_numpy(float), ready["conf"].to_numpy(float), self.options)
        done = int(frames[-1]) if len(frames) else known["done"]
        rest = held.loc[held.index[:0]] if self.flush else held[held["frame_no"] == newest]
        self.memory.update((json.dumps({"done": done, "tracks": tracks.to_dict(), "held": rest.astype(float).values.tolist()}),))
        if len(frames):
            out = ready[["frame_no", "det_idx"]].astype("int64").assign(camera_id=key[0], track_id=pd.array(ids, "Int64"))
            out["track_id"] = out["track_id"].mask(out["track_id"] == 0)
            yield out[["camera_id", "frame_no", "det_idx", "track_id"]]

    def close(self) -> None:
        pass


def streaming_assign(det: DataFrame, options: TrackerOptions = TrackerOptions(), flush: bool = False) -> DataFrame:
    """``track_assign`` of a stream of detections: camera_id, frame_no, det_idx,
    track_id of boxes that reach the low score; one state a camera."""
    usable = det.where(F.col("conf") >= options.low).dropna(subset=["camera_id", "frame_no", "det_idx", *BOX])
    keyed = usable.select("camera_id", "frame_no", "det_idx", "conf", *BOX).groupBy("camera_id")
    kinds = "camera_id long, frame_no long, det_idx long, track_id long"
    return keyed.transformWithStateInPandas(statefulProcessor=AssignProcessor(options, flush), outputStructType=kinds, outputMode="Append", timeMode="None")


def on_batch(*hooks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Callbacks in order for ``foreachBatch``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for hook in hooks:
            hook(batch, batch_id)

    return run


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None) -> None:
    """Process what is there, then stop; a name runs once at a time."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
