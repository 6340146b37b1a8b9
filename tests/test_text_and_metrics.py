"""Small functions: names, padding rule, log lines, message folders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from framequery.functions import text
from framequery.operators import metrics
from framequery.sources.messages import MessageWriter


def test_every_model_name_is_known(spark):
    names = "yolo yolov5 yolov8 yolov5s yolov8s yolov5n yolov8n yolo5 yolo8 yolov5m yolov8m".split()
    rows = spark.createDataFrame([(n, "raw") for n in [*names, "other"]], "name string, task string")
    got = {r["name"]: r["runs"] for r in rows.select("name", text.model_task(F.col("name"), F.col("task")).alias("runs")).collect()}
    assert got == {n: "decode_v8" if "8" in n else "decode_v5" for n in names} | {"other": None}


def test_padding_is_minimal_where_shapes_and_model_differ(spark):
    one = spark.createDataFrame([(480, 640), (480, 640)], "height int, width int")
    two = one.unionByName(spark.createDataFrame([(720, 640)], "height int, width int"))
    auto = lambda df, exported: metrics.same_shapes(df, exported).first()["auto"]
    assert [auto(one, False), auto(one, True), auto(two, False), auto(two, True)] == [True, False, False, True]


def test_log_line_of_a_frame_without_detections(spark):
    row = spark.range(1).select(metrics.log_line(F.lit(480), F.lit(640), F.lit(None).cast("string"), F.lit(12.34)).alias("v")).first()
    assert "(no detections), " in row["v"]
    assert row["v"].startswith("480x640")


def test_messages_are_committed_below_any_folder(tmp_path):
    folder = tmp_path / "_x" / "_y"
    writer = MessageWriter({"path": str(folder)})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([{"topic": "a", "value": "b"}])]))])
    assert sorted(p.name for p in folder.iterdir()) == ["000000000001.arrow", "_staging"]
