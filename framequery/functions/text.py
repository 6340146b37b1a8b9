"""Paths, progress lines, stream properties and payloads as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings of images and videos, and hosts of hosted video.
IMAGE_ENDINGS = "bmp dng jpeg jpg mpo png tif tiff webp pfm heic".split()
VIDEO_ENDINGS = "asf avi gif m4v mkv mov mp4 mpeg mpg ts wmv webm".split()
VIDEO_HOSTS = "www.youtube.com youtube.com youtu.be".split()
#: Model names with their task and family.
MODELS = {
    "yolo": ("tracking", "v5"), "yolo5": ("tracking", "v5"), "yolo8": ("tracking", "v8"),
    "yolov8": ("tracking", "v8"), "yolov8n": ("tracking", "v8"), "yolov8s": ("tracking", "v8"), "yolov8m": ("tracking", "v8"),
    "yolov5": ("tracking", "v5"), "yolov5n": ("tracking", "v5"), "yolov5s": ("tracking", "v5"), "yolov5m": ("tracking", "v5"),
}
DECODERS = {"v8": "decode_v8", "v5": "decode_v5"}


def extension(path: Column) -> Column:
    """The lower-case ending; none without a dot in the last part of the path."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def media_kind(path: Column) -> Column:
    ending = extension(path)
    return F.when(ending.isin(*IMAGE_ENDINGS), "image").when(ending.isin(*VIDEO_ENDINGS), "video")


def before_first_dot(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def label_path(path: Column, frame: Column, is_image: Column) -> Column:
    """Where a frame's labels go: the stem, with the frame number for videos."""
    suffix = F.when(is_image, "").otherwise(F.concat(F.lit("_"), frame.cast("string")))
    return F.concat(stem(path), suffix, F.lit(".txt"))


def frame_number(line: Column) -> Column:
    """The frame number in a progress line, null where there is none."""
    return F.nullif(F.regexp_extract(line, r"frame (\d+)/", 1), F.lit("")).cast("long")


def progress_line(kind: str, i: Column, n: Column, path: Column, frame: Column | None = None, frames: Column | None = None) -> Column:
    if kind == "image":
        return F.format_string("image %d/%d %s: ", i, n, path)
    return F.format_string("video %d/%d (frame %d/%d) %s: ", i, n, frame, frames, path)


def sane_fps(fps: Column, fallback: float = 30.0) -> Column:
    """Frames a second modulo 100; what is not finite or not above zero: the fallback."""
    finite = F.when(F.isnan(fps) | (F.abs(fps) == float("inf")) | fps.isNull(), 0.0).otherwise(fps)
    rest = F.pmod(finite, F.lit(100.0))
    return F.when(rest > 0, rest).otherwise(F.lit(fallback))


def sane_frame_count(n: Column) -> Column:
    """A stream that states no frames has no end."""
    return F.when(n > 0, n.cast("double")).otherwise(F.lit(float("inf")))


def host_in(url: Column, hosts: list[str]) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1).isin(*hosts), F.lit(False))


def device_index(source: Column) -> Column:
    """A camera's number if the source is all digits; text is never evaluated."""
    return F.when(source.rlike("^[0-9]+$"), source.cast("int"))


def clean_name(source: Column) -> Column:
    return F.regexp_replace(source, r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def resolution_height(label: Column) -> Column:
    """1080 of '1080p' or '1080p60'."""
    return F.nullif(F.regexp_extract(label, r"^(\d+)", 1), F.lit("")).cast("int")


def plural(n: Column) -> Column:
    return F.when(n > 1, "s").otherwise("")


def shape_text(height: Column, width: Column) -> Column:
    return F.format_string("%dx%d ", height, width)


def milliseconds_text(ms: Column) -> Column:
    return F.format_string("%.1fms", ms)


def timing_payload(pre: Column, inference: Column, post: Column) -> Column:
    """Timings in single-quoted text, as messages carry them."""
    return F.concat(F.lit("{'preprocess': "), pre.cast("string"), F.lit(", 'inference': "), inference.cast("string"), F.lit(", 'postprocess': "), post.cast("string"), F.lit("}"))  # noqa: E501


def parsed_payload(payload: Column) -> Column:
    """Timings of a payload, single- or double-quoted."""
    return F.from_json(payload, "map<string,double>")


def model_task(name: Column, requested: Column) -> Column:
    """What a named model does: tracking if asked for, else its family's decoding;
    null for unknown names."""
    known = F.create_map(*[F.lit(v) for k, (_, family) in MODELS.items() for v in (k, family)])
    family = F.try_element_at(known, F.lower(F.split(name, " ")[0]))
    decode = F.create_map(*[F.lit(v) for kv in DECODERS.items() for v in kv])
    return F.when(family.isNotNull(), F.when(requested == "tracking", "tracking").otherwise(F.try_element_at(decode, family)))


def megabytes(n: Column) -> Column:
    return n / F.lit(1048576.0)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another, to the microsecond."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def flag(value: Column) -> Column:
    """A switch that is off unless it is set."""
    return F.coalesce(value.cast("boolean"), F.lit(False))


def absolute_path(path: Column, parent: str) -> Column:
    """``path`` below ``parent`` unless it is absolute or has a scheme."""
    return F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), path).otherwise(F.concat(F.lit(parent.rstrip("/") + "/"), F.regexp_replace(path, r"^(\./)+", "")))
