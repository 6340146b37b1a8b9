"""Video headers of made files, and images written and read again."""

from __future__ import annotations

import struct
import zlib
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequery.sources import images, media, probe
from framequery.sources.folder import Folder


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), kind) + body


def clock(ticks, length, version=0):
    return struct.pack(">I8xII" if version == 0 else ">I16xIQ", version << 24, ticks, length)


def track(number, kind, frames, ticks=1000, length=0, size=(640, 480), version=0):
    head = struct.pack(">I8xI" if version == 0 else ">I16xI", version << 24, number) + b"\0" * 52 + struct.pack(">II", size[0] << 16, size[1] << 16)
    table = box(b"stbl", box(b"stsd", b"\0" * 8), box(b"stsz", struct.pack(">III", 0, 0, frames)))
    return box(b"trak", box(b"tkhd", head), box(b"mdia", box(b"mdhd", clock(ticks, length, version)), box(b"hdlr", b"\0" * 8 + kind), box(b"minf", table)))


def mp4(frames=90, version=0, fragments=(), wide=False):
    moov = box(b"moov", box(b"mvhd", clock(600, 1800)), track(1, b"soun", 500, 48000, 144000), track(2, b"vide", frames, 90000, 270000, version=version))
    run = lambda n: box(b"trun", struct.pack(">II", 0, n))
    rest = b"".join(box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, t)), *[run(n) for n in ns])) for t, ns in fragments)
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"x" * 1000, wide=wide) + moov + rest


def riff(kind, *parts):
    body = b"".join(parts)
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames=75, extended=None):
    main = riff(b"avih", struct.pack("<I12xI12xII16x", 40000, frames, 320, 240))
    stream = riff(b"LIST", b"strl", riff(b"strh", b"vids" + b"\0" * 16 + struct.pack("<IIII", 1, 25, 0, frames)), riff(b"strf", b"odd"))
    more = [riff(b"LIST", b"odml", riff(b"dmlh", struct.pack("<I", extended)))] if extended else []
    return riff(b"RIFF", b"AVI ", riff(b"LIST", b"hdrl", main, stream, *more), riff(b"LIST", b"movi", b"y" * 501))


def element(number, *parts, unknown=False):
    body = b"".join(parts)
    n = (number.bit_length() + 7) // 8
    size = b"\x01" + b"\xff" * 7 if unknown else struct.pack(">Q", 1 << 56 | len(body))
    return number.to_bytes(n, "big") + size + body


def mkv(frames=40, unknown=False, laced=0):
    tracks = element(probe.TRACKS, element(probe.ENTRY, element(0xD7, b"\x01"), element(0x83, b"\x02")), element(probe.ENTRY, element(0xD7, b"\x02"), element(0x83, b"\x01"), element(0xE0, element(0xB0, b"\x05\x00"), element(0xBA, b"\x02\xd0"))))
    block = lambda t, flags=0, more=b"": element(0xA3, bytes([0x80 | t]), b"\0\0", bytes([flags]), more, b"data")
    group = lambda t: element(0xA0, element(0xA1, bytes([0x80 | t]), b"\0\0\0", b"data"))
    clusters = [element(probe.CLUSTER, *[block(2) for _ in range(frames // 2)], block(1), unknown=unknown), element(probe.CLUSTER, *[group(2) for _ in range(frames - frames // 2 - laced)], *([block(2, 4, bytes([laced - 1]))] if laced else []), group(1), unknown=unknown)]
    info = element(probe.INFO, element(0x2AD7B1, struct.pack(">I", 1_000_000)), element(0x4489, struct.pack(">d", 2000.0)))
    return element(probe.EBML, b"\0" * 4) + element(probe.SEGMENT, info, tracks, *clusters, unknown=unknown)


FILES = {
    "plain.mp4": (mp4(), ("mp4", 640, 480, 90, 3.0)),
    "long.MOV": (mp4(7, version=1, wide=True), ("mp4", 640, 480, 7, 3.0)),
    "live.m4v": (mp4(0, fragments=[(2, [10, 5]), (1, [99]), (2, [1])]), ("mp4", 640, 480, 16, 3.0)),
    "a.avi": (avi(), ("avi", 320, 240, 75, 3.0)),
    "large.avi": (avi(75, 300), ("avi", 320, 240, 300, 12.0)),
    "a.mkv": (mkv(), ("matroska", 1280, 720, 40, 2.0)),
    "live.webm": (mkv(40, unknown=True), ("matroska", 1280, 720, 40, 2.0)),
    "laced.mkv": (mkv(40, laced=3), ("matroska", 1280, 720, 40, 2.0)),
    "empty.mp4": (b"\0", None),  # the scan leaves out files without a byte
    "text.avi": (b"no video at all", None),
    "short.mp4": (mp4()[:-100], None),
    "short.mkv": (mkv()[:-3], None),
    "short.avi": (avi()[:40], None),
    "silent.mp4": (box(b"ftyp", b"isom") + box(b"moov", track(1, b"soun", 5)), None),
    "wrong.mp4": (box(b"ftyp", b"isom") + struct.pack(">I4s", 4, b"moov"), None),
}


@pytest.mark.parametrize("content", [True, False])
def test_probe_counts_frames(spark, tmp_path, content):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "not.txt").write_bytes(b"x")
    rows = {r["path"].rpartition("/")[2]: r for r in probe.probe(probe.video_files(spark, str(tmp_path), content=content)).collect()}
    got = {n: None if r["container"] is None else (r["container"], r["width"], r["height"], r["frames"], r["seconds"]) for n, r in rows.items()}
    assert got == {n: want for n, (_, want) in FILES.items()}
    assert rows["plain.mp4"]["fps"] == 30.0 and rows["empty.mp4"]["fps"] is None
    assert probe.probe(probe.video_files(spark, str(tmp_path), content=content).limit(0)).count() == 0


@given(st.binary(max_size=300), st.sampled_from(sorted(FILES)), st.integers(0, 400))
@settings(max_examples=300, deadline=None)
def test_damaged_headers_never_do_more_than_fail(noise, name, at):
    data = FILES[name][0]
    data = data[:at] + noise + data[at + len(noise) :]
    try:
        probe.probed(probe.Source(lambda a, n: data[a : a + n], len(data)))
    except (probe.Broken, struct.error):
        pass


@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(0, 2**32 - 1))
@settings(max_examples=50, deadline=None)
def test_png_round_trip(h, w, c, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert (images.png_decoded(images.png_encoded(img)) == img).all()


def test_png_filters_and_alpha():
    """Every filter, applied by the book to each line, is undone."""
    rng = np.random.default_rng(1)
    for channels, colour in ((1, 0), (2, 4), (3, 2), (4, 6)):
        img = rng.integers(0, 256, (10, 7, channels), dtype=np.uint8)
        lines = b""
        for y in range(10):
            now, up, kind = img[y].astype(int), img[y - 1].astype(int) if y else np.zeros_like(img[y], int), y % 5
            left, corner = np.vstack([np.zeros((1, channels), int), now[:-1]]), np.vstack([np.zeros((1, channels), int), up[:-1]])
            p = left + up - corner
            far = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
            paeth = np.choose(far.argmin(0), [left, up, corner])
            guess = [0, left, up, (left + up) // 2, paeth][kind]
            lines += bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes()
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        data = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        want = img[..., : channels - (channels % 2 == 0)][..., ::-1]
        assert (images.png_decoded(data) == want).all()


def test_crops_written_and_read_again(spark, tmp_path):
    media.register(spark)
    imgs = [np.random.default_rng(k).integers(0, 256, (60, 80, 3), dtype=np.uint8) for k in range(3)]
    frames = media.in_memory(spark, [imgs[0], None, imgs[2]])
    det = spark.createDataFrame(
        [(0, 0, 0, 2, 10.4, 20.6, 30.0, 40.0), (0, 0, 1, 9, -5.0, -5.0, 8.0, 9.0), (0, 1, 2, 2, 1.0, 1.0, 9.0, 9.0), (0, 2, 3, 2, 70.0, 50.0, 95.0, 70.0), (0, 2, 4, 2, 200.0, 9.0, 220.0, 20.0), (0, 2, 5, None, 5.0, 5.0, 5.0, 5.0)],
        "camera_id long, frame_no long, det_idx long, cls_id long, x1 double, y1 double, x2 double, y2 double",
    )
    names = spark.createDataFrame([(2, "a car/van")], "cls_id long, name string")
    rows = images.crops(frames, det, names)
    rows.write.format("images").mode("append").option("path", str(tmp_path / "out")).save()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(str(tmp_path / "out"))
    back = {r["path"].rpartition("/")[2]: r for r in images.decoded(found.select("path", "content")).collect()}
    windows = {"0_0_0.png": (0, 5, 15, 35, 45), "0_0_1.png": (0, 0, 0, 13, 14), "0_2_3.png": (2, 64, 44, 80, 60), "0_2_5.png": (2, 0, 0, 10, 10)}
    assert set(back) == set(windows)
    for name, (k, x1, y1, x2, y2) in windows.items():
        r = back[name]
        assert (r["height"], r["width"]) == (y2 - y1, x2 - x1)
        assert (np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) == imgs[k][y1:y2, x1:x2]).all()
    assert {r["path"].split("/out/")[1].split("/")[0] for r in back.values()} == {"a car_van", "9", "none"}


def test_stills_and_a_failed_write(spark, tmp_path):
    media.register(spark)
    frames = media.in_memory(spark, [np.full((4, 5, 3), k, np.uint8) for k in range(6)] + [None])
    images.stills(frames).write.format("images").mode("append").option("path", str(tmp_path / "ok")).save()
    assert sorted(p.name for p in (tmp_path / "ok").rglob("*.png")) == [f"{k}.png" for k in range(6)]
    fails = F.udf(lambda i, d: bytes(d) if i < 5 else 1 // 0, "binary")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        images.stills(frames).withColumn("image", fails("frame_no", "image")).write.format("images").mode("append").option("path", str(tmp_path / "no")).save()
    Folder(str(tmp_path / "no")).sweep(timedelta(0))  # tasks that were killed may have gone on for a moment
    assert not list((tmp_path / "no").rglob("*.png"))
    odd = spark.createDataFrame([(1, None), (2, b"x"), (3, images.png_encoded(np.zeros((2, 2), np.uint8)))], "id long, content binary")
    assert sorted((r["id"], r["height"]) for r in images.decoded(odd).collect()) == [(1, None), (2, None), (3, 2)]
