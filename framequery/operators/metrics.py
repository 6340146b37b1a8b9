"""Counts, stage times and texts about runs and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.functions.text import milliseconds_text, plural, shape_text

STAGES = ("preprocess", "inference", "postprocess")


def class_counts(det: DataFrame, names: DataFrame) -> DataFrame:
    """camera_id, frame_no, counts: '2 cars, 1 bus, ' in the order of the classes."""
    per = det.groupBy("camera_id", "frame_no", "cls_id").agg(F.count("*").alias("n")).join(names, "cls_id")
    item = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("name"), plural(F.col("n")), F.lit(", "))
    ordered = F.array_sort(F.collect_list(F.struct("cls_id", item.alias("item"))))
    return per.groupBy("camera_id", "frame_no").agg(F.array_join(F.transform(ordered, lambda s: s["item"]), "").alias("counts"))


def with_names(det: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``name`` and ``label``, 'name conf', of each detection."""
    joined = det.join(names, "cls_id", "left")
    return joined.withColumn("label", F.format_string("%s %.2f", F.coalesce("name", F.col("cls_id").cast("string")), F.col("conf")))


def stage_time_per_image(batches: DataFrame) -> DataFrame:
    """Seconds of each stage of a batch -> milliseconds an image of it."""
    n = F.count("*").over(Window.partitionBy("batch_id"))
    return batches.select("camera_id", "frame_no", "batch_id", *[(F.col(s) * 1000 / n).alias(s) for s in STAGES])


def run_means(batches: DataFrame) -> DataFrame:
    """images, and the mean milliseconds of each stage over a run: the batches'
    seconds summed, by the images seen; one row, nulls for an empty run."""
    per = batches.groupBy("batch_id").agg(F.count("*").alias("n"), *[F.max(s).alias(s) for s in STAGES])
    seen = F.sum("n")
    return per.agg(F.coalesce(seen, F.lit(0)).alias("images"), *[(F.sum(s) * 1000 / seen).alias(s) for s in STAGES])


def frames_seen(frames: DataFrame) -> DataFrame:
    """Adds ``seen``, each camera's running count of frames."""
    so_far = Window.partitionBy("camera_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("seen", F.count("*").over(so_far))


def log_line(height: Column, width: Column, counts: Column, inference_ms: Column) -> Column:
    """'480x640 2 cars, 12.3ms'; 'no detections' for a frame without."""
    found = F.when(F.coalesce(counts, F.lit("")) == "", F.lit("(no detections), ")).otherwise(counts)
    return F.concat(shape_text(height, width), found, milliseconds_text(inference_ms))


def same_shapes(frames: DataFrame, exported: bool = False) -> DataFrame:
    """same: whether all frames have one shape; auto: whether minimal padding
    applies, which is when that differs from ``exported``, a model of fixed input."""
    one = (F.countDistinct("height", "width") == 1).alias("same")
    return frames.agg(one).select("same", (F.col("same") != F.lit(exported)).alias("auto"))


def label_rows(det: DataFrame, height: int = 640, width: int = 640, with_conf: bool = False, digits: int = 6) -> DataFrame:
    """camera_id, frame_no, det_idx, line: 'cls cx cy w h [conf] [track]', normalised."""
    size = {"x1": width, "x2": width, "y1": height, "y2": height}
    n = {c: F.col(c) / F.lit(float(s)) for c, s in size.items()}
    parts = [(n["x1"] + n["x2"]) / 2, (n["y1"] + n["y2"]) / 2, n["x2"] - n["x1"], n["y2"] - n["y1"]]
    texts = [F.col("cls_id").cast("string"), *[F.format_string(f"%.{digits}f", p) for p in parts]]
    texts += [F.format_string(f"%.{digits}f", F.col("conf"))] if with_conf else []
    return det.select("camera_id", "frame_no", "det_idx", F.concat_ws(" ", *texts, F.col("track_id").cast("string")).alias("line"))
