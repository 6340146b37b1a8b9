"""Trajectories of tracked detections.

A track that is missing from a frame with tracked detections is forgotten at
once, so a trajectory is a run of consecutive *present* frames; frames without
any tracked detection do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.functions.geometry import center


def islands(det: DataFrame) -> DataFrame:
    """Tracked detections with ``fr``, the frame's place among the camera's
    present frames, and ``isl``, the run of frames the track is seen in.

    The frames are numbered on a table of their own, one row a frame, and
    joined back, so that no window sorts all detections of a camera.
    """
    seen = det.where(F.col("track_id").isNotNull())
    by_frame = Window.partitionBy("camera_id").orderBy("frame_no")
    frames = seen.select("camera_id", "frame_no").distinct().withColumn("fr", F.row_number().over(by_frame).cast("long"))
    numbered = seen.join(frames, ["camera_id", "frame_no"])
    run = Window.partitionBy("camera_id", "track_id").orderBy("fr")
    return numbered.withColumn("isl", F.col("fr") - F.dense_rank().over(run))


def _so_far() -> Window:
    by_frame = Window.partitionBy("camera_id", "track_id", "isl").orderBy("frame_no", "det_idx")
    return by_frame.rowsBetween(Window.unboundedPreceding, 0)


def track_length(det: DataFrame) -> DataFrame:
    out = islands(det).withColumn("length", F.count("*").over(_so_far()))
    return out.select("camera_id", "frame_no", "det_idx", "track_id", "length")


def run_table(det: DataFrame) -> DataFrame:
    """camera_id, track_id, isl, points: each run of a track once, its centres with
    frame_no and det_idx in order.  One entry a detection; every line of a frame is
    a beginning of its run."""
    point = F.struct("frame_no", "det_idx", center(F.col("x1"), F.col("x2")).alias("x"), center(F.col("y1"), F.col("y2")).alias("y"))
    return islands(det).groupBy("camera_id", "track_id", "isl").agg(F.array_sort(F.collect_list(point)).alias("points"))


def whole_pixels(points: Column) -> Column:
    """Points cut to whole pixels, as 'x,y x,y'."""
    text = F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string")))
    return F.array_join(text, " ")


def trajectories(det: DataFrame) -> DataFrame:
    """camera_id, frame_no, det_idx, track_id, points: the track's centres (x, y) so
    far in the run, cut from the run table.  For the lines of single frames cut only
    those, as ``class_polylines`` does."""
    rows = run_table(det).select("camera_id", "track_id", "points", F.posexplode("points").alias("i", "p"))
    so_far = F.transform(F.slice("points", 1, F.col("i") + 1), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rows.select("camera_id", F.col("p.frame_no").alias("frame_no"), F.col("p.det_idx").alias("det_idx"), "track_id", so_far.alias("points"))


def trajectory_text(det: DataFrame) -> DataFrame:
    """Trajectories with their points cut to whole pixels, as 'x,y x,y'."""
    return trajectories(det).withColumn("points", whole_pixels(F.col("points")))


def lost_tracks(det: DataFrame) -> DataFrame:
    """camera_id, track_id, frame_no: the last frame before a track is missed;
    a track of the camera's last present frame is not lost."""
    rows = islands(det)
    run = Window.partitionBy("camera_id", "track_id").orderBy("fr")
    last = rows.groupBy("camera_id").agg(F.max("fr").alias("end"))
    follows = rows.withColumn("next", F.lead("fr").over(run)).join(last, "camera_id")
    gone = F.when(F.col("next").isNull(), F.col("fr") < F.col("end")).otherwise(F.col("next") != F.col("fr") + 1)
    return follows.where(gone).select("camera_id", "track_id", "frame_no")


def class_polylines(det: DataFrame) -> DataFrame:
    """camera_id, frame_no, cls_id, track_id, points: a class shows the line of
    its last track in the frame."""
    last = Window.partitionBy("camera_id", "frame_no", "cls_id").orderBy(F.desc("det_idx"))
    rows = islands(det).withColumn("_length", F.count("*").over(_so_far()))
    top = rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    shown = top.select("camera_id", "frame_no", "cls_id", "track_id", "isl", "_length").join(run_table(det), ["camera_id", "track_id", "isl"])
    line = whole_pixels(F.slice("points", 1, F.col("_length").cast("int")))
    return shown.select("camera_id", "frame_no", "cls_id", "track_id", line.alias("points"))


def class_filtered_polylines(det: DataFrame) -> DataFrame:
    """Polylines less those whose *class* number equals a track lost in the
    frame, a known defect kept for comparison; off unless this is called."""
    frames = islands(det).select("camera_id", "frame_no", "fr").distinct()
    lost = lost_tracks(det).join(frames, ["camera_id", "frame_no"]).select("camera_id", (F.col("fr") + 1).alias("fr"), "track_id")
    at = lost.join(frames, ["camera_id", "fr"]).select("camera_id", "frame_no", F.col("track_id").alias("cls_id"))
    return class_polylines(det).join(at.distinct(), ["camera_id", "frame_no", "cls_id"], "left_anti")


def fold_frame(state: dict[int, int], track_ids: list[int], cap: int) -> tuple[list[int], int]:
    """One frame of a bounded memory of tracks: each detection lengthens its
    track, a new one beyond ``cap`` drops the one first remembered, and tracks
    not in the frame go.  Returns the lengths and the number dropped."""
    lengths, dropped = [], 0
    for t in track_ids:
        state[t] = state.get(t, 0) + 1
        lengths.append(state[t])
        if len(state) > cap:
            del state[next(iter(state))]
            dropped += 1
    here = set(track_ids)
    for t in [t for t in state if t not in here]:
        del state[t]
    return lengths, dropped


def segments(det: DataFrame) -> DataFrame:
    """camera_id, frame_no, segment: the present frames, numbered on where no track
    of the frame was in the one before: there the memory is empty."""
    seen = det.where(F.col("track_id").isNotNull()).select("camera_id", "frame_no", "track_id").distinct()
    by_frame = Window.partitionBy("camera_id").orderBy("frame_no")
    frames = seen.select("camera_id", "frame_no").distinct().withColumn("fr", F.row_number().over(by_frame))
    by_track = Window.partitionBy("camera_id", "track_id").orderBy("fr")
    goes_on = F.coalesce(F.lag("fr").over(by_track) == F.col("fr") - 1, F.lit(False))
    rows = seen.join(frames, ["camera_id", "frame_no"]).withColumn("goes_on", goes_on)
    cuts = rows.groupBy("camera_id", "frame_no").agg(F.when(F.bool_or("goes_on"), 0).otherwise(1).alias("cut"))
    return cuts.select("camera_id", "frame_no", F.sum("cut").over(by_frame).alias("segment"))


def bounded_tracks(det: DataFrame, cap: int = 30) -> DataFrame:
    """camera_id, frame_no, det_idx, track_id, length with at most ``cap``
    tracks remembered a camera.  Which one is dropped depends on the order of
    insertion, so this is an ordered fold; it begins anew wherever no track goes on
    from one frame to the next, and these segments of a camera fold apart.  Rows
    stream through in Arrow batches, and only the memory of ``cap`` tracks is kept.
    """
    columns = ["camera_id", "frame_no", "det_idx", "track_id"]
    seen = det.where(F.col("track_id").isNotNull()).select(*columns).join(segments(det), ["camera_id", "frame_no"])
    ordered = seen.select("segment", *columns).repartition("camera_id", "segment").sortWithinPartitions("camera_id", "segment", "frame_no", "det_idx")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, frame, state, held = None, None, {}, []

        def close() -> list[tuple]:
            lengths, _ = fold_frame(state, [r[3] for r in held], cap)
            return [(*r, n) for r, n in zip(held, lengths, strict=True)]

        for batch in batches:
            out = []
            for segment, *row in batch.itertuples(index=False, name=None):
                if (segment, row[0], row[1]) != (*(part or (None, None)), frame):
                    out += close()
                    held = []
                    state = state if (segment, row[0]) == part else {}
                    part, frame = (segment, row[0]), row[1]
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=[*columns, "length"])
        yield pd.DataFrame(close(), columns=[*columns, "length"])

    return ordered.mapInPandas(fold, "camera_id long, frame_no long, det_idx long, track_id long, length long")
