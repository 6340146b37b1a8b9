"""Which frames and files are read, in which order and grouping."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequery.functions.text import media_kind, resolution_height
from framequery.operators.numbering import numbered


def media_files(paths: DataFrame) -> DataFrame:
    """path, kind, place: images first, then videos, each by path; other files
    are left out."""
    kinds = paths.select("path", media_kind(F.col("path")).alias("kind")).where("kind is not null")
    return numbered(kinds, "kind", "path")


def media_counts(paths: DataFrame, batch: int = 1) -> DataFrame:
    """images, videos, files, batches."""
    kind = media_kind(F.col("path"))
    n = F.count_if(kind.isNotNull())
    return paths.agg(F.count_if(kind == "image").alias("images"), F.count_if(kind == "video").alias("videos"), n.alias("files"), F.ceil(n / batch).alias("batches"))  # noqa: E501


def strided(frames: DataFrame, stride: int, live: bool) -> DataFrame:
    """Every ``stride``-th frame, counting from 0 in live streams (the first is
    kept) and from 1 in files (the stride-th is the first kept)."""
    number = F.col("frame_no") if live else F.col("frame_no") + 1
    return frames.where(number % stride == 0)


def batches(frames: DataFrame, size: int) -> DataFrame:
    """Adds ``batch_id`` and ``slot``: consecutive frames of a camera in batches
    of ``size``, the last one as long as it is."""
    rn = F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_no")) - 1
    return frames.withColumn("batch_id", F.floor(rn / size)).withColumn("slot", (rn % size).cast("long"))


def zipped_streams(frames: DataFrame, cameras: list[int]) -> DataFrame:
    """step and one frame number for each camera: the n-th frames of all
    streams together, as long as all have one."""
    rn = F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_no")).cast("long")
    numbered = frames.select("camera_id", "frame_no", rn.alias("step")).where(F.col("camera_id").isin(*cameras))
    wide = numbered.groupBy("step").agg(*[F.max(F.when(F.col("camera_id") == c, F.col("frame_no"))).alias(f"frame_{c}") for c in cameras])
    return wide.dropna()


def latest_frames(frames: DataFrame) -> DataFrame:
    """The newest frame of each camera."""
    return frames.groupBy("camera_id").agg(F.max("frame_no").alias("frame_no"))


def buffered(frames: DataFrame, size: int = 30) -> DataFrame:
    """First in, first out: what a full buffer of ``size`` frames a camera holds."""
    rn = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("frame_no")))
    return frames.withColumn("_rn", rn).where(F.col("_rn") <= size).drop("_rn")


def readable(frames: DataFrame, live: bool = False) -> DataFrame:
    """Unreadable frames go; in live streams they stay, flagged ``is_gap``."""
    return frames.withColumn("is_gap", F.col("data").isNull()) if live else frames.where(F.col("data").isNotNull())


def signal_gaps(frames: DataFrame, limit: timedelta, late: timedelta = timedelta(0)) -> DataFrame:
    """camera_id, last_ts, gap_at, is_gap: one row for each silence of more than
    ``limit`` after a camera's frame (camera_id, ts), whether the signal returns or
    not, up to the newest frame of all less ``late``.  Rows without camera or time
    do not count."""
    known = frames.where("camera_id is not null and ts is not null").select("camera_id", F.col("ts").cast("timestamp").alias("ts"))
    after = F.lead("ts").over(Window.partitionBy("camera_id").orderBy("ts"))
    at = F.col("ts") + F.lit(limit)
    rows = known.select("camera_id", F.col("ts").alias("last_ts"), at.alias("gap_at"), after.alias("after"))
    seen_to = known.agg((F.max("ts") - F.lit(late)).alias("seen_to"))  # one row
    lost = (F.col("gap_at") <= F.col("seen_to")) & (F.col("after").isNull() | (F.col("after") > F.col("gap_at")))
    return rows.join(F.broadcast(seen_to), F.lit(True)).where(lost).select("camera_id", "last_ts", "gap_at", F.lit(True).alias("is_gap"))


def bounded_run(frames: DataFrame, counts: DataFrame) -> DataFrame:
    """A live stream of known length ends one frame short of it."""
    return frames.join(counts, "camera_id").where(F.col("frame_no") < F.col("n_frames") - 1).drop("n_frames")


def best_rendition(renditions: DataFrame) -> DataFrame:
    """(video, resolution, url): the highest resolution of 1080 lines or more."""
    known = renditions.withColumn("height", resolution_height(F.col("resolution"))).where("height >= 1080")
    best = Window.partitionBy("video").orderBy(F.desc("height"), "url")
    return known.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("video", "height", "url")


def last_rendition(renditions: DataFrame) -> DataFrame:
    """(video, pos, width, height, vcodec, acodec, ext, url): from the end, the
    first silent mp4 picture of 1920 by 1080 at least in one direction."""
    large = (F.col("width") >= 1920) | (F.col("height") >= 1080)
    fit = renditions.where(large & (F.col("vcodec") != "none") & (F.col("acodec") == "none") & (F.col("ext") == "mp4"))
    return fit.groupBy("video").agg(F.max("pos").alias("pos"), F.max_by("url", "pos").alias("url"))


def poll_seconds(streams: DataFrame) -> DataFrame:
    return streams.agg((1 / F.min("fps")).alias("seconds"))
