from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequery.operators import pixels
from framequery.sources import media
from framequery.sources.messages import Log, MessageStreamWriter, payload_text, write_labels


def test_camera_batch_and_stream_agree(spark, tmp_path):
    media.register(spark)
    options = {"cameras": 2, "frames": 7, "perBatch": 3}
    batch = spark.read.format("cameras").options(**options).load()
    stream = spark.readStream.format("cameras").options(**options).load()
    query = stream.writeStream.format("memory").queryName("cams").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r["camera_id"], r["frame_no"], bytes(r["data"])) for r in df.collect())
    assert key(batch) == key(spark.table("cams"))
    assert batch.count() == 14


def test_message_sink_commits_whole_tasks(spark, tmp_path):
    media.register(spark)
    rows = spark.range(20).selectExpr("'t' AS topic", "CAST(id AS STRING) AS value")
    rows.write.format("messages").mode("append").option("path", str(tmp_path / "out")).save()
    back = spark.read.format("messages").option("path", str(tmp_path / "out")).load()
    assert sorted(int(r["value"]) for r in back.select(payload_text(F.col("payload")).alias("value")).collect()) == list(range(20))
    assert not list((tmp_path / "out" / "_staging").iterdir())


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    media.register(spark)
    fails = F.udf(lambda i: str(i) if i < 15 else 1 // 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        spark.range(20).select(F.lit("t").alias("topic"), fails("id").alias("value")).write.format("messages").mode("append").option("path", str(tmp_path / "out")).save()
    assert spark.read.format("messages").option("path", str(tmp_path / "out")).load().count() == 0
    Log(str(tmp_path / "out")).sweep(timedelta(0))  # tasks that were killed may have gone on for a moment
    assert not list((tmp_path / "out" / "_staging").iterdir())


def test_messages_stream_every_row_once_over_a_restart(spark, tmp_path):
    media.register(spark)
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def publish(start, end):
        rows = spark.range(start, end).selectExpr("IF(id % 2 = 0, 'even', 'odd') AS topic", "CAST(id AS STRING) AS value")
        rows.repartition(3).write.format("messages").mode("append").option("path", log).save()

    def consume():
        stream = spark.readStream.format("messages").option("path", log).option("topic", "even").option("group", "g").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()
        return sorted(int(bytes(r["payload"])) for r in spark.read.parquet(out).collect())

    publish(0, 30)
    assert consume() == list(range(0, 30, 2))
    publish(30, 50)
    publish(50, 51)
    assert consume() == list(range(0, 51, 2))
    assert consume() == list(range(0, 51, 2))
    committed = Log(log).position("g")
    assert 0 < committed <= max(Log(log).segments())
    keys = spark.read.format("messages").option("path", log).load().groupBy("segment", "place").count()
    assert keys.where("count > 1").count() == 0 and keys.count() == 51


def test_a_batch_committed_again_is_published_once(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["t"]), pa.array(["x"])], names=["topic", "value"])
    writer = MessageStreamWriter({"path": str(tmp_path), "writer": "w"})
    writer.commit([writer.write(iter([batch])), None], 7)  # cut off after its first part
    writer.commit([writer.write(iter([batch])), writer.write(iter([batch]))], 7)
    writer.commit([writer.write(iter([batch]))], 8)
    assert len(Log(str(tmp_path)).segments()) == 3
    unnamed = MessageStreamWriter({"path": str(tmp_path)})
    unnamed.abort([unnamed.write(iter([batch])), None], 9)
    assert len(Log(f"file://{tmp_path}").segments()) == 3 and not list((tmp_path / "_staging").iterdir())


def test_payloads_that_are_no_text(spark):
    rows = spark.createDataFrame([(b"{'preprocess': 1.5}",), (b"\xff\xfe",), (None,), (b"",)], "payload binary")
    assert [r[0] for r in rows.select(payload_text(F.col("payload"))).collect()] == ["{'preprocess': 1.5}", None, None, ""]


def test_label_files(spark, tmp_path):
    lines = spark.createDataFrame([(0, 3, 1, "b"), (0, 3, 0, "a")], "camera_id long, frame_no long, det_idx long, line string")
    write_labels(lines, str(tmp_path / "labels"))
    files = list((tmp_path / "labels/camera_id=0/frame_no=3").glob("*.txt"))
    assert [f.read_text() for f in files] == ["a\nb\n"]


def test_source_kinds():
    assert media.source_kind("rtsp://host/a").stream
    assert media.source_kind("0").stream
    assert not media.source_kind("https://host/a.jpg").stream
    assert media.source_kind("screen 1").screenshot
    assert media.source_kind([np.zeros((2, 2, 3), np.uint8)]).from_images
    assert media.source_kind(np.zeros((1, 3, 32, 32))).tensor
    with pytest.raises(TypeError):
        media.source_kind(3.5)


def test_screen_specs():
    base = (10, 20, 800, 600)
    assert media.screen_area("screen", base) == {"screen": 0, "left": 10, "top": 20, "width": 800, "height": 600}
    assert media.screen_area("screen 2 1 2 3 4", base) == {"screen": 2, "left": 11, "top": 22, "width": 3, "height": 4}
    with pytest.raises(ValueError, match="screen"):
        media.screen_area("screen 1 2", base)


def test_tensor_checks():
    assert media.tensor_rows(np.full((3, 32, 32), 255.0)).max() == 1
    with pytest.raises(ValueError, match="divisible"):
        media.tensor_rows(np.zeros((1, 3, 30, 32)))


def test_images_of_a_folder(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["path"].rpartition("/")[2] for r in media.image_files(spark, str(tmp_path)).collect()) == ["a.png", "b.JPG"]


def test_pixels(spark):
    img = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    assert pixels.crop(img, 5, 0, 3, 4).shape == (15, 23, 3)
    assert pixels.crop(img).shape[0] == 0  # margins larger than the frame
    assert pixels.zoom(img).shape == img.shape
    boxed = pixels.letterbox(img, 64)
    assert boxed.shape == (64, 64, 3)
    assert (boxed[0] == pixels.PAD).all()
    assert pixels.model_input([boxed]).shape == (1, 3, 64, 64)
    frames = media.in_memory(spark, [img, None])
    done = {r["frame_no"]: r for r in pixels.transform_frames(frames, "letterbox").collect()}
    assert (done[0]["height"], len(done[0]["data"])) == (640, 640 * 640 * 3)
    assert done[1]["data"] is None
