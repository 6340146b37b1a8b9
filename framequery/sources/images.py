"""Still images and crops as files: an encoder, the rows, and a sink that commits."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framequery.sources.folder import Folder

PNG = b"\x89PNG\r\n\x1a\n"
#: A crop is the box times GAIN and PAD pixels more.
GAIN, PAD = 1.02, 10
Decoder = Callable[[bytes], np.ndarray]
IMAGE_DDL = "folder string, name string, image binary"


def png_encoded(img: np.ndarray) -> bytes:
    """A uint8 image of two axes, or three with 1 or 3 (BGR) channels, as PNG."""
    img = img[..., None] if img.ndim == 2 else img
    h, w, c = img.shape
    if img.dtype != np.uint8 or c not in (1, 3) or not h or not w:
        raise ValueError(f"no image: {img.dtype} {img.shape}")
    rows = np.ascontiguousarray(img[..., ::-1]).reshape(h, w * c)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1)  # every line unfiltered

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_decoded(data: bytes) -> np.ndarray:
    """The (h, w, 1 or 3) BGR pixels of an 8-bit PNG without palette or interlace;
    an alpha channel is left out."""
    if data[:8] != PNG:
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head or (0, 0, 0, 0, 0, 0, 1)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("a kind of PNG that is not read here")
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y - 1] if y else np.zeros_like(out[0]), channels)
    img = out.reshape(h, w, channels)[..., : channels - (channels % 2 == 0)]
    return np.ascontiguousarray(img[..., ::-1])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int64)  # the filters that need the pixel before
    up = np.concatenate([np.zeros(step, np.int64), above])
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
            guess = near[2]
        out[i] = (int(line[i - step]) + guess) & 255
    return out[step:].astype(np.uint8)


def crop_window(height: Column, width: Column, gain: float = GAIN, pad: float = PAD) -> dict[str, Column]:
    """The whole pixels of a crop around the box x1, y1, x2, y2, widened and kept
    within the picture."""
    sides = {}
    for lo, hi, limit in (("x1", "x2", width), ("y1", "y2", height)):
        middle, half = (F.col(lo) + F.col(hi)) / 2, ((F.col(hi) - F.col(lo)) * gain + pad) / 2
        for name, value in ((lo, middle - half), (hi, middle + half)):
            whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))  # towards zero
            sides[name] = F.least(F.greatest(whole, F.lit(0)), limit).cast("int")
    return sides


def crops(frames: DataFrame, det: DataFrame, names: DataFrame) -> DataFrame:
    """camera_id, frame_no, det_idx, folder, name, image: one PNG for each box in a
    readable frame, in the folder of its class's name (of its number where it has
    none).  A box without a pixel in the picture has no row.

    ``names`` holds (cls_id, name), one row a class.
    """
    known = det.select("camera_id", "frame_no", "det_idx", "cls_id", "x1", "y1", "x2", "y2").join(names.select("cls_id", F.col("name").alias("folder")), "cls_id", "left")
    readable = frames.where(F.col("data").isNotNull()).select("camera_id", "frame_no", "height", "width", "n_channels", "data")
    windows = crop_window(F.col("height"), F.col("width"))
    rows = known.join(readable, ["camera_id", "frame_no"]).withColumns(windows).where("x1 < x2 and y1 < y2")
    named = F.concat_ws("_", "camera_id", "frame_no", "det_idx")
    rows = rows.select("camera_id", "frame_no", "det_idx", F.coalesce("folder", F.col("cls_id").cast("string"), F.lit("none")).alias("folder"), F.concat(named, F.lit(".png")).alias("name"), "x1", "y1", "x2", "y2", "height", "width", "n_channels", "data")  # noqa: E501

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [
                png_encoded(np.frombuffer(d, np.uint8).reshape(h, w, c)[y1:y2, x1:x2])
                for d, h, w, c, x1, y1, x2, y2 in zip(*[b[k] for k in ("data", "height", "width", "n_channels", "x1", "y1", "x2", "y2")], strict=True)
            ]
            yield b[["camera_id", "frame_no", "det_idx", "folder", "name"]].assign(image=cut)

    return rows.mapInPandas(run, f"camera_id long, frame_no long, det_idx long, {IMAGE_DDL}")


def stills(frames: DataFrame) -> DataFrame:
    """camera_id, frame_no, folder, name, image: each readable frame as PNG."""
    rows = frames.where(F.col("data").isNotNull()).select("camera_id", "frame_no", "height", "width", "n_channels", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [png_encoded(np.frombuffer(d, np.uint8).reshape(h, w, c)) for d, h, w, c in zip(*[b[k] for k in ("data", "height", "width", "n_channels")], strict=True)]
            names = [f"{f}.png" for f in b["frame_no"]]
            yield b[["camera_id", "frame_no"]].assign(folder=b["camera_id"].astype(str), name=names, image=made)

    return rows.mapInPandas(run, f"camera_id long, frame_no long, {IMAGE_DDL}")


def bmp_decoded(data: bytes) -> np.ndarray:
    """The BGR pixels of a plain bitmap of 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("no bitmap")
    start, (w, h), bits, packed = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), *struct.unpack("<HI", data[28:34])
    step = {24: 3, 32: 4}.get(bits)
    if step is None or packed not in (0, 3) or w <= 0:
        raise ValueError("a kind of bitmap that is not read here")
    line = (w * step + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * step].reshape(abs(h), w, step)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[..., :3])


#: What turns the bytes of a file into pixels, by the file's ending.
DECODERS = {"png": png_decoded, "bmp": bmp_decoded, "dib": bmp_decoded}


def decoded(images: DataFrame, column: str = "content", decoders: dict[str, Decoder] | None = None, path: str | None = None) -> DataFrame:
    """``images`` with height, width, n_channels, data (BGR uint8) in place of the
    file in ``column``; nulls where it cannot be read.

    The decoder is that of the ending of ``path``; ``decoders`` adds to DECODERS, for
    kinds that need a library, say.  Without a path all known ones are tried.
    """
    known = DECODERS | (decoders or {})
    kept = [c for c in images.columns if c != column]

    def pixels(data: bytes | None, name: str | None) -> tuple:
        ending = name.rpartition(".")[2].lower() if name else None
        for decode in dict.fromkeys(known.values() if path is None else filter(None, [known.get(ending)])):
            try:
                img = decode(data)
                img = img[..., None] if img.ndim == 2 else img
                return (*img.shape, np.ascontiguousarray(img).tobytes())
            except Exception:  # a file from anywhere, a decoder from anywhere  # noqa: BLE001
                continue
        return (None, None, None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [pixels(data, name) for data, name in zip(b[column], b[path] if path else [None] * len(b), strict=True)]
            made = pd.DataFrame(rows, columns=["height", "width", "n_channels", "data"], index=b.index)
            yield pd.concat([b[kept], made.astype({c: "Int32" for c in ("height", "width", "n_channels")})], axis=1)

    fields = [f"`{n}` {t}" for n, t in images.dtypes if n != column]
    return images.mapInPandas(run, ", ".join([*fields, "height int", "width int", "n_channels int", "data binary"]))


@dataclass
class Staged(WriterCommitMessage):
    task: str


class ImageWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder of their own; the commit moves each of its
    folders in one step to ``path/folder/task/name``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        to, task, made = Folder(self.path), uuid.uuid4().hex, set()
        base = f"{to.staging(self.job)}/{task}"
        to.fs.create_dir(base)
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)) for c in ("folder", "name", "image")]
            for folder, name, image in zip(*[c.to_pylist() for c in columns], strict=True):
                folder, name = (re.sub(r"[/\\]|^\.+", "_", x) for x in (folder, name))
                if folder not in made:
                    to.fs.create_dir(f"{base}/{folder}")
                    made.add(folder)
                with to.fs.open_output_stream(f"{base}/{folder}/{name}") as out:
                    out.write(image)
        return Staged(task)

    def commit(self, messages: list[Staged | None]) -> None:
        to = Folder(self.path)
        for m in filter(None, messages):
            for f in to.fs.get_file_info(fs.FileSelector(f"{to.staging(self.job)}/{m.task}")):
                to.fs.create_dir(f"{to.path}/{f.base_name}")
                to.fs.move(f.path, f"{to.path}/{f.base_name}/{m.task}")
        to.unstage(self.job)
        to.sweep()

    def abort(self, messages: list[Staged | None]) -> None:
        Folder(self.path).unstage(self.job)


class ImageStreamWriter(ImageWriter, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        super().commit(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        super().abort(messages)


class Images(DataSource):
    """``df.write.format("images").option("path", folder)`` of (folder, name, image)."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return IMAGE_DDL

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ImageWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return ImageStreamWriter(self.options)
