"""Sources side by side, decoders by ending, label counts, small columns, the command line."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery import __main__ as cli
from framequery.functions import geometry, text
from framequery.operators import decode
from framequery.plans import synthetic as S
from framequery.sources import images, media
from framequery.sources.messages import label_count, write_labels
from framequery.streaming import jobs
from tests.conftest import SF
from tests.test_probe_and_images import avi, mp4


def bmp(img, bits=24):
    h, w, _ = img.shape
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    full = img if bits == 24 else np.concatenate([img, np.full((h, w, 1), 255, np.uint8)], axis=2)
    rows[:, : w * bits // 8] = full[::-1].reshape(h, -1)
    return b"BM" + struct.pack("<I4xI", 54 + rows.size, 54) + struct.pack("<IiiHHI", 40, w, h, 1, bits, 0) + b"\0" * 20 + rows.tobytes()


IMG = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)


def test_folders_patterns_files_manifests_and_lists_side_by_side(spark, tmp_path):
    for name in ("d/a.png", "d/b.mp4", "d/deep/c.jpg", "e1.png", "e2.png", "f.avi"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "list.txt").write_text("f.avi\n\n ./e1.png \n/abs/g.png\nhdfs://host/h.mp4\n")
    names = lambda source, **kw: sorted(r["path"].removeprefix("file:").replace(str(tmp_path), "") for r in media.source_files(spark, source, **kw).collect())
    at = lambda p: f"{tmp_path}/{p}"
    assert names(at("d")) == ["/d/a.png", "/d/b.mp4"]
    assert names(at("d"), recursive=True) == ["/d/a.png", "/d/b.mp4", "/d/deep/c.jpg"]
    assert names(at("e*.png")) == ["/e1.png", "/e2.png"]
    assert names(at("list.txt")) == ["/abs/g.png", "/e1.png", "/f.avi", "hdfs://host/h.mp4"]
    assert names([at("d"), at("f.avi"), at("e?.png"), at("list.txt")]) == sorted(names(at("d")) + ["/f.avi"] + names(at("e*.png")) + names(at("list.txt")))
    assert names([]) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        names(at("missing.png"))


def test_a_list_of_paths_and_arrays(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.png_encoded(IMG))
    (tmp_path / "b.BMP").write_bytes(bmp(IMG))
    (tmp_path / "c.heic").write_bytes(b"HEIC" + IMG.tobytes())
    (tmp_path / "d.png").write_bytes(b"broken")
    heic = {"heic": lambda data: np.frombuffer(data[4:], np.uint8).reshape(IMG.shape)}
    items = [f"{tmp_path}/a.png", IMG + 1, f"{tmp_path}/b.BMP", None, f"{tmp_path}/c.heic", f"{tmp_path}/d.png", f"{tmp_path}/none.png", f"{tmp_path}/a.png"]
    rows = {r["frame_no"]: r["data"] and np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], -1) for r in media.mixed(spark, items, heic).collect()}
    assert set(rows) == set(range(8)) and [k for k, v in rows.items() if v is None] == [k for k in rows if k in (3, 5, 6)]
    assert all((rows[k] == IMG).all() for k in (0, 2, 4, 7)) and (rows[1] == IMG + 1).all()
    assert media.mixed(spark, items[4:5]).first()["data"] is None  # no decoder for that ending
    for bad, error in ((3.5, TypeError), ("http://host/a.png", ValueError)):
        with pytest.raises(error):
            media.mixed(spark, [bad])
    assert (images.bmp_decoded(bmp(IMG, 32)) == IMG).all()


def test_label_files_are_counted(spark, tmp_path):
    lines = spark.createDataFrame([(c, f, d, "x") for c in range(2) for f in range(3) for d in range(4)], "camera_id long, frame_no long, det_idx long, line string")
    write_labels(lines, f"{tmp_path}/labels")
    assert label_count(spark, f"{tmp_path}/labels") == 6


def test_small_columns(spark):
    row = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS a, timestamp '2024-01-01 00:01:30.25' AS b, 'x y' AS t, array(named_struct('x', 1D, 'y', 2D)) AS p, CAST(NULL AS BOOLEAN) AS f")
    got = row.select(
        text.elapsed_seconds(F.col("a"), F.col("b")).alias("s"), text.flag(F.col("f")).alias("f"), text.megabytes(F.lit(3 * 2**20)).alias("m"),
        text.clean_name(F.lit("rtsp://a?b=1&c")).alias("n"), text.device_index(F.lit("12")).alias("d"), text.device_index(F.lit("1+1")).alias("e"),
        text.before_first_dot(F.lit("a.b.c")).alias("o"), geometry.translate(F.col("p"), F.lit(3.0), F.lit(-1.0)).alias("p"),
        text.absolute_path(F.lit("./v/a.mp4"), "/data/").alias("q"), text.absolute_path(F.lit("s3://b/a"), "/data").alias("r"),
    ).first()
    assert (got["s"], got["f"], got["m"], got["n"], got["d"], got["e"], got["o"]) == (90.25, False, 3.0, "rtsp_//a_b_1_c", 12, None, "a")
    assert [tuple(p) for p in got["p"]] == [(4.0, 1.0)] and (got["q"], got["r"]) == ("/data/v/a.mp4", "s3://b/a")
    assert media.listed(" a b\nc\t") == ["a", "b", "c"]


def test_parallel_arrays_meet_by_place(spark):
    rows = spark.createDataFrame([(0, 0, [[1.0], [2.0], [3.0]], [7, 8], [5, 6, 7]), (0, 1, [], [], [])], "camera_id long, frame_no long, boxes array<array<double>>, ids array<long>, classes array<long>")
    assert [(r["i"], r["box"], r["track_id"], r["cls_id"]) for r in decode.zipped(rows).orderBy("i").collect()] == [(0, [1.0], 7, 5), (1, [2.0], 8, 6)]


def test_callbacks_run_in_order_for_each_batch(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    hooks = jobs.on_batch(lambda batch, i: seen.append(("start", i, batch.count())), lambda _, i: seen.append(("end", i)))
    spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(hooks).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    assert seen == [("start", 0, 3), ("end", 0)]


def test_a_named_stream_runs_once_at_a_time(spark, tmp_path):
    frames = spark.readStream.format("rate").load()
    first = frames.writeStream.format("noop").queryName("only").option("checkpointLocation", f"{tmp_path}/a").start()
    try:
        with pytest.raises(Exception, match="only"):
            jobs.run_to_end(frames, f"{tmp_path}/out", f"{tmp_path}/b", name="only")
    finally:
        first.stop()


def test_suppression_of_frames_that_cross_batches(spark):
    """Batches of any size, and frames without a camera, as with whole groups."""
    det = S.view(spark, SF, S.DET_DENSE)
    det = det.withColumn("camera_id", F.when(F.col("camera_id") != 2, F.col("camera_id")))
    keys = lambda df: sorted(map(str, df.select("camera_id", "frame_no", "det_idx").collect()))
    want = keys(decode.nms(det, 0.25))
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert keys(decode.nms_dense(det, 0.25)) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert decode.nms_dense(det.limit(0), 0.25).count() == 0


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0
    assert "track_assign" in capsys.readouterr().out.split()
    assert cli.main(["query", "region_totals", "--data", SF, "--out", f"{tmp_path}/totals"]) == 0
    assert spark.read.parquet(f"{tmp_path}/totals").count() > 0
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.mp4").write_bytes(mp4())
    (tmp_path / "v/b.avi").write_bytes(avi())
    assert cli.main(["probe", f"{tmp_path}/v", "--out", f"{tmp_path}/probed", "--format", "json"]) == 0
    assert {r["frames"] for r in spark.read.json(f"{tmp_path}/probed").collect()} == {90, 75}
    S.view(spark, SF, S.DET_MOVING).write.parquet(f"{tmp_path}/det")
    assert cli.main(["track", f"{tmp_path}/det", "--out", f"{tmp_path}/tracks"]) == 0
    assert {"track_id", "length"} <= set(spark.read.parquet(f"{tmp_path}/tracks").columns)
    assert (cli.task_of("YOLOv8n", "plain"), cli.task_of("yolov5s", "tracking")) == ("decode_v8", "tracking")
    for argv in (["query", "none", "--data", SF], ["probe"], ["track", f"{tmp_path}/det", "--name", "other"]):
        with pytest.raises(SystemExit):
            cli.main(argv)
