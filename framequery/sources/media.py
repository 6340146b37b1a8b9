"""Frames and images from files, memory and cameras, and where to find them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from framequery.functions.text import IMAGE_ENDINGS, absolute_path
from framequery.schemas import FRAME

FRAME_DDL = "camera_id long, frame_no long, ts timestamp, height int, width int, n_channels int, mode string, data binary"


@dataclass(frozen=True)
class SourceKind:
    """What a source is; decides how it is read."""

    stream: bool = False
    screenshot: bool = False
    from_images: bool = False
    tensor: bool = False


def source_kind(source: object) -> SourceKind:
    if isinstance(source, np.ndarray) and source.ndim == 4 and source.shape[1] in (1, 3):
        return SourceKind(tensor=True)
    if isinstance(source, (list, tuple, np.ndarray)):
        return SourceKind(from_images=True)
    if isinstance(source, (str, int)):
        text = str(source).strip().lower()
        screen = text.split(" ")[0] == "screen"
        live = text.isdigit() or text.endswith(".streams") or bool(re.match(r"(rtsp|rtmp|tcp|https?)://", text)) and text.rpartition(".")[2] not in IMAGE_ENDINGS  # noqa: E501
        return SourceKind(stream=live and not screen, screenshot=screen)
    raise TypeError(f"no reader for a source of type {type(source).__name__}")


def screen_area(spec: str, base: tuple[int, int, int, int]) -> dict[str, int]:
    """'screen [n] [left top width height]' over a monitor at ``base`` (left,
    top, width, height); offsets count from the monitor's corner."""
    params = [int(p) for p in spec.split()[1:]]
    if len(params) not in (0, 1, 4, 5):
        raise ValueError("a screen takes no number, one, four or five")
    screen = params[0] if len(params) in (1, 5) else 0
    left, top, width, height = params[-4:] if len(params) >= 4 else (0, 0, base[2], base[3])
    return {"screen": screen, "left": base[0] + left, "top": base[1] + top, "width": width, "height": height}


def listed(text: str) -> list[str]:
    """Sources of a list file, parted by white space."""
    return text.split()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path): the lines of a manifest file; relative ones lie beside it."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return lines.select(absolute_path(F.col("path"), path.rpartition("/")[0] or ".").alias("path"))


def source_files(spark: SparkSession, source: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """(path) of the files of a source: a folder's, those a pattern matches, one
    file, the lines of a ``.txt`` manifest, or a list of such sources one after the
    other.  Nothing is opened but manifests; a folder, pattern or file that is not
    there is an error.  A file named twice comes twice.
    """
    if not isinstance(source, str):
        parts = [source_files(spark, s, recursive) for s in source]
        if not parts:
            return spark.createDataFrame([], "path string")
        return reduce(DataFrame.unionByName, parts)
    if source.endswith(".txt"):
        return manifest(spark, source)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(source)
    return found.select("path")


def image_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of image files, by Spark's own
    file scan; the ending is tested without regard to case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGE_ENDINGS))


def in_memory(spark: SparkSession, images: Sequence[np.ndarray | None]) -> DataFrame:
    """FRAME rows of images at hand; None is an unreadable one."""
    rows = []
    for i, img in enumerate(images):
        if img is None:
            rows.append((0, i, None, None, None, None, None, None))
            continue
        if img.ndim not in (2, 3) or img.dtype != np.uint8:
            raise TypeError("an image is a uint8 array of two or three axes")
        img = img[..., None] if img.ndim == 2 else img[..., :3]
        rows.append((0, i, None, *img.shape, "BGR", np.ascontiguousarray(img).tobytes()))
    return spark.createDataFrame(rows, FRAME)


def mixed(spark: SparkSession, items: Sequence[str | np.ndarray | None], decoders: dict | None = None) -> DataFrame:
    """FRAME rows of a list of image paths and images at hand, frame_no their place
    in the list; a file that is missing or cannot be decoded is an unreadable frame.
    """
    from framequery.sources.images import decoded

    other = [type(x).__name__ for x in items if not isinstance(x, (str, np.ndarray, type(None)))]
    if other:
        raise TypeError(f"an image is a path or an array, not {other[0]}")
    if any(isinstance(x, str) and re.match(r"https?://", x) for x in items):
        raise ValueError("give files that Spark can scan, not web addresses")
    paths = {i: x for i, x in enumerate(items) if isinstance(x, str)}
    arrays = in_memory(spark, [None if isinstance(x, str) else x for x in items])
    if not paths:
        return arrays
    places = spark.createDataFrame([(i, p) for i, p in paths.items()], "place long, wanted string")
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(sorted({p.rpartition("/")[0] or "." for p in paths.values()}))
    same = F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("wanted", "^file:/+", "/")
    read = decoded(places.join(found.select("path", "content"), same, "left").select("place", "wanted", "content"), "content", decoders, "wanted")
    rows = read.select(F.lit(0).cast("long").alias("camera_id"), F.col("place").alias("frame_no"), F.lit(None).cast("timestamp").alias("ts"), "height", "width", "n_channels", F.when(F.col("data").isNotNull(), "BGR").alias("mode"), "data")  # noqa: E501
    return arrays.where(~F.col("frame_no").isin(*paths)).unionByName(rows)


def tensor_rows(tensor: np.ndarray, stride: int = 32) -> np.ndarray:
    """A checked (B, C, H, W) tensor of 0 to 1: three axes become four, sides
    divide by ``stride``, values above 1 are taken for 0 to 255."""
    t = tensor[None] if tensor.ndim == 3 else tensor
    if t.ndim != 4 or t.shape[2] % stride or t.shape[3] % stride:
        raise ValueError(f"a tensor has the shape (B, C, H, W), H and W divisible by {stride}; this one is {tensor.shape}")
    return t / 255.0 if t.size and t.max() > 1 + np.finfo(np.float32).eps else t


class CameraPartition(InputPartition):
    def __init__(self, camera: int, start: int, end: int) -> None:
        self.camera, self.start, self.end = camera, start, end


def drawn(camera: int, frame: int, height: int, width: int) -> bytes:
    y, x = np.mgrid[0:height, 0:width]
    grey = (x * 3 + y * 5 + frame * 7 + camera * 31) % 256
    return np.repeat(grey[..., None], 3, 2).astype(np.uint8).tobytes()


class _Frames:
    """Rows of drawn frames; a capture device would take the place of ``drawn``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.cameras, self.frames = int(options.get("cameras", 2)), int(options.get("frames", 10))
        self.height, self.width, self.per_batch = int(options.get("height", 8)), int(options.get("width", 8)), int(options.get("perBatch", 5))
        self.fps = float(options.get("fps", 30))

    def rows(self, part: CameraPartition) -> Iterator[tuple]:
        from datetime import datetime, timedelta, timezone

        start = datetime(2024, 1, 1, tzinfo=timezone.utc)
        for n in range(part.start, part.end):
            yield part.camera, n, start + timedelta(seconds=n / self.fps), self.height, self.width, 3, "BGR", drawn(part.camera, n, self.height, self.width)


class CameraReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.made = _Frames(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [CameraPartition(c, 0, self.made.frames) for c in range(self.made.cameras)]

    def read(self, partition: CameraPartition) -> Iterator[tuple]:
        return self.made.rows(partition)


class CameraStreamReader(DataSourceStreamReader):
    """One partition a camera and micro-batch, at most ``perBatch`` frames each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.made, self.at = _Frames(options), 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.made.per_batch, self.made.frames)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["frame"])
        return [CameraPartition(c, start["frame"], end["frame"]) for c in range(self.made.cameras)]

    def read(self, partition: CameraPartition) -> Iterator[tuple]:
        return self.made.rows(partition)


class Cameras(DataSource):
    """``spark.read.format("cameras")`` and ``spark.readStream.format("cameras")``."""

    @classmethod
    def name(cls) -> str:
        return "cameras"

    def schema(self) -> str:
        return FRAME_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return CameraReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return CameraStreamReader(self.options)


def register(spark: SparkSession) -> None:
    from framequery.sources.images import Images
    from framequery.sources.messages import Messages

    spark.dataSource.register(Cameras)
    spark.dataSource.register(Images)
    spark.dataSource.register(Messages)


def open_source(spark: SparkSession, source: object, **options: object) -> DataFrame:
    """The reader that fits a source: live streams, images at hand, or files."""
    kind = source_kind(source)
    if kind.tensor:
        return in_memory(spark, list((tensor_rows(source) * 255).astype(np.uint8).transpose(0, 2, 3, 1)))
    if kind.from_images:
        return mixed(spark, list(source))
    if kind.screenshot:
        raise NotImplementedError("a screen can be grabbed on the driver's host only; give images instead")
    if kind.stream:
        register(spark)
        return spark.readStream.format("cameras").options(**options).load()
    return image_files(spark, str(source), bool(options.get("recursive", False)))
