"""What a video file says about itself: size, frames and duration from its headers.

Only the boxes that hold these are read, one after the other, so a file that is
opened by path is never read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions.text import VIDEO_ENDINGS, extension

PROBE_DDL = "path string, container string, width int, height int, frames long, seconds double, fps double"
#: Element numbers of Matroska.
SEGMENT, CLUSTER, GROUP, TRACKS, ENTRY, VIDEO, INFO = 0x18538067, 0x1F43B675, 0xA0, 0x1654AE6B, 0xAE, 0xE0, 0x1549A966
EBML, SCALE, DURATION, NUMBER, KIND, WIDTH, HEIGHT, SIMPLE, BLOCK = 0x1A45DFA3, 0x2AD7B1, 0x4489, 0xD7, 0x83, 0xB0, 0xBA, 0xA3, 0xA1

Read = Callable[[int, int], bytes]


class Broken(ValueError):
    """The file is cut off, or is none of the known kinds."""


@dataclass
class Found:
    container: str
    width: int | None = None
    height: int | None = None
    frames: int | None = None
    seconds: float | None = None


@dataclass
class Source:
    """Bytes by place; a read beyond the end is an error."""

    read_at: Read
    size: int

    def bytes(self, at: int, n: int) -> bytes:
        if n < 0 or at + n > self.size:
            raise Broken("cut off")
        return self.read_at(at, n)

    def number(self, at: int, n: int = 4, order: str = "big") -> int:
        return int.from_bytes(self.bytes(at, n), order)


def boxes(s: Source, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the contents of ISO boxes that lie side by side."""
    while at + 8 <= end:
        size, kind, head = s.number(at), s.bytes(at + 4, 4), 8
        if size == 1:
            size, head = s.number(at + 8, 8), 16
        size = size or end - at
        if size < head or at + size > end:
            raise Broken("a box is longer than what holds it")
        yield kind, at + head, at + size
        at += size


def _clock(s: Source, at: int) -> tuple[int, int]:
    """(ticks a second, ticks) of a media or movie header."""
    return (s.number(at + 20), s.number(at + 24, 8)) if s.number(at, 1) else (s.number(at + 12), s.number(at + 16))


def iso_media(s: Source) -> Found:
    """MP4 and QuickTime: the first video track, with its fragments."""
    out, tracks, fragments, movie = Found("mp4"), [], {}, None
    for kind, a, b in boxes(s, 0, s.size):
        if kind == b"moov":
            for k, c, d in boxes(s, a, b):
                if k == b"mvhd":
                    movie = _clock(s, c)
                elif k == b"trak":
                    tracks.append(_track(s, c, d))
        elif kind == b"moof":
            for k, c, d in boxes(s, a, b):
                if k == b"traf":
                    number, n = 0, 0
                    for j, e, _ in boxes(s, c, d):
                        number = s.number(e + 4) if j == b"tfhd" else number
                        n += s.number(e + 4) if j == b"trun" else 0
                    fragments[number] = fragments.get(number, 0) + n
    video = next((t for t in tracks if t.get("kind") == b"vide"), None)
    if video is None:
        raise Broken("no video track")
    ticks, length = video.get("clock") or movie or (0, 0)
    ticks, length = movie if not length and movie else (ticks, length)
    out.width, out.height = video.get("size", (None, None))
    out.frames = video.get("frames", 0) + fragments.get(video.get("number"), 0)
    out.seconds = length / ticks if ticks and length else None
    return out


def _track(s: Source, a: int, b: int) -> dict:
    t: dict = {}
    for k, c, d in boxes(s, a, b):
        if k == b"tkhd":
            t["number"] = s.number(c + (20 if s.number(c, 1) else 12))
            t["size"] = (s.number(d - 8) >> 16, s.number(d - 4) >> 16)
        elif k in (b"mdia", b"minf", b"stbl"):
            t |= _track(s, c, d)
        elif k == b"hdlr" and "kind" not in t:
            t["kind"] = s.bytes(c + 8, 4)
        elif k == b"mdhd":
            t["clock"] = _clock(s, c)
        elif k in (b"stsz", b"stz2"):
            t["frames"] = s.number(c + 8)
    return t


def avi(s: Source) -> Found:
    """AVI: the count of the first video stream, or the extended header's."""
    out = Found("avi")
    little = lambda at: s.number(at, 4, "little")
    todo, rate, extended = [(12, min(s.size, 8 + little(4)))], None, None
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size, a = s.bytes(at, 4), little(at + 4), at + 8
            if kind == b"LIST" and s.bytes(a, 4) in (b"hdrl", b"strl", b"odml"):
                todo.append((a + 4, a + size))
            elif kind == b"avih":
                micros, out.frames = little(a), little(a + 16)
                out.width, out.height = little(a + 32), little(a + 36)
                rate = rate or (1e6 / micros if micros else None)
            elif kind == b"strh" and s.bytes(a, 4) == b"vids":
                scale, ticks, length = little(a + 20), little(a + 24), little(a + 32)
                rate = ticks / scale if scale and ticks else rate
                out.frames = length or out.frames
            elif kind == b"dmlh":
                extended = little(a)
            at = a + size + size % 2
    if out.frames is None:
        raise Broken("no header")
    out.frames = extended or out.frames
    out.seconds = out.frames / rate if rate else None
    return out


def _vint(s: Source, at: int, keep: bool) -> tuple[int, int, bool]:
    """(value, bytes, all ones) of a Matroska number; an id keeps its marker."""
    first = s.number(at, 1)
    n = 9 - first.bit_length()
    if n > 8:
        raise Broken("no number")
    value = s.number(at, n)
    bare = value & ((1 << 7 * n) - 1)
    return (value if keep else bare), n, bare == (1 << 7 * n) - 1


@dataclass
class _Matroska:
    scale: int = 1_000_000
    ticks: float | None = None
    entries: list[dict] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)


def matroska(s: Source) -> Found:
    """Matroska and WebM: the frames of the first video track's blocks.

    What holds others is entered and all else skipped by its size, so sizes that
    are unknown, as live recordings have them, do no harm.
    """
    m, at = _Matroska(), 0
    while at < s.size:
        kind, n, _ = _vint(s, at, True)
        size, k, open_ = _vint(s, at + n, False)
        a = at + n + k
        at = a if kind in (SEGMENT, CLUSTER, GROUP, TRACKS, ENTRY, VIDEO, INFO) else a + size
        if open_ and at != a:
            raise Broken("an element of unknown size")
        if kind == ENTRY:
            m.entries.append({})
        elif kind == SCALE:
            m.scale = s.number(a, size)
        elif kind == DURATION:
            m.ticks = struct.unpack(">f" if size == 4 else ">d", s.bytes(a, size))[0]
        elif kind in (NUMBER, KIND, WIDTH, HEIGHT) and m.entries:
            m.entries[-1][kind] = s.number(a, size)
        elif kind in (SIMPLE, BLOCK):
            track, n, _ = _vint(s, a, False)
            laced = s.number(a + n + 2, 1) & 0x06
            m.counts[track] = m.counts.get(track, 0) + (s.number(a + n + 3, 1) + 1 if laced else 1)
    if at > s.size:
        raise Broken("cut off")
    video = next((e for e in m.entries if e.get(KIND) == 1), None)
    if video is None:
        raise Broken("no video track")
    return Found("matroska", video.get(WIDTH), video.get(HEIGHT), m.counts.get(video.get(NUMBER), 0), m.ticks * m.scale / 1e9 if m.ticks else None)


def probed(s: Source) -> Found:
    """The headers of a file, by its first bytes."""
    head = s.bytes(0, min(12, s.size))
    if head[:4] == b"RIFF" and head[8:] == b"AVI ":
        return avi(s)
    if head[:4] == EBML.to_bytes(4, "big"):
        return matroska(s)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"styp"):
        return iso_media(s)
    raise Broken("no known container")


def video_files(spark: SparkSession, path: str | list[str], recursive: bool = False, content: bool = True) -> DataFrame:
    """(path, [content]) of video files by Spark's own file scan, whose values end
    at 2 GB; without content the probe opens them itself."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.where(extension(F.col("path")).isin(*VIDEO_ENDINGS)).select("path", *["content"] * content)


def probe(files: DataFrame) -> DataFrame:
    """PROBE_DDL of (path) or (path, content) rows, one for each.

    Frames are those of the first video track.  A file that is broken, cut off or of
    an unknown kind has nulls in all columns but its path; so has null content.
    """
    whole = "content" in files.columns

    def look(path: str, content: bytes | None) -> Found:
        if whole:
            return probed(Source(lambda at, n: content[at : at + n], len(content)))
        system, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(place) as f:
            return probed(Source(lambda at, n: f.read_at(n, at), f.size()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"] if whole else [None] * len(batch), strict=True):
                try:
                    f = look(path, content) if content is not None or not whole else None
                except (Broken, OSError, struct.error):
                    f = None
                fps = f.frames / f.seconds if f and f.frames and f.seconds else None
                rows.append((path, f.container, f.width, f.height, f.frames, f.seconds, fps) if f else (path, *[None] * 6))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PROBE_DDL.split(", ")])
            yield out.astype({"width": "Int32", "height": "Int32", "frames": "Int64", "seconds": float, "fps": float})

    return files.select("path", *["content"] * whole).mapInPandas(run, PROBE_DDL)
