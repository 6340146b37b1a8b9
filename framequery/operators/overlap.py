"""Boxes of one frame that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.functions.geometry import rectangles_overlap


def overlap_pairs(det: DataFrame) -> DataFrame:
    """camera_id, frame_no, i, j, i < j: detections whose closed boxes meet.

    Equi-joined on the frame, so both sides are dealt by frame and a frame's
    pairs are all that is compared.
    """
    slim = det.select("camera_id", "frame_no", "det_idx", "x1", "y1", "x2", "y2")
    a, b = slim.alias("a"), slim.alias("b")
    same = (F.col("a.camera_id") == F.col("b.camera_id")) & (F.col("a.frame_no") == F.col("b.frame_no"))
    pairs = a.join(b, same & (F.col("a.det_idx") < F.col("b.det_idx")) & rectangles_overlap("a", "b"))
    return pairs.select("a.camera_id", "a.frame_no", F.col("a.det_idx").alias("i"), F.col("b.det_idx").alias("j"))


def overlaps_per_frame(det: DataFrame) -> DataFrame:
    """camera_id, frame_no, overlaps; frames without a pair are left out."""
    return overlap_pairs(det).groupBy("camera_id", "frame_no").agg(F.count("*").alias("overlaps"))
