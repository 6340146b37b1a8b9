from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequery.functions import geometry as G
from framequery.functions import text as T
from framequery.operators import decode, overlap, regions

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BOX = st.tuples(*[st.integers(0, 40)] * 4, st.integers(0, 100))
DET = "camera_id long, frame_no long, det_idx long, track_id long, cls_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def det(spark, boxes, frame=0):
    rows = [(0, frame, i, i, 0, c / 100, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h, c) in enumerate(boxes)]
    return spark.createDataFrame(rows, DET)


def iou(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0


@FEW
@given(st.lists(BOX, max_size=12))
def test_suppression(spark, boxes):
    rows = det(spark, boxes)
    kept = decode.nms(rows, 0.3).collect()
    assert {r["det_idx"] for r in kept} == {r["det_idx"] for r in decode.nms_dense(rows, 0.3).collect()}
    flat = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in kept]
    assert all(iou(a, b) <= 0.3 for i, a in enumerate(flat) for b in flat[:i])
    again = decode.nms(spark.createDataFrame(kept, DET), 0.3)
    assert again.count() == len(kept)


def test_equal_to_the_threshold_is_kept(spark):
    rows = det(spark, [(0, 0, 10, 10, 90), (0, 0, 10, 5, 80)])  # IoU 0.5
    assert decode.nms(rows, 0.5).count() == 2
    assert decode.nms(rows, 0.49).count() == 1


def test_touching_boxes_overlap(spark):
    pairs = overlap.overlap_pairs(det(spark, [(0, 0, 10, 10, 1), (10, 0, 5, 5, 1), (16, 0, 5, 5, 1)])).collect()
    assert [(r["i"], r["j"]) for r in pairs] == [(0, 1)]


def test_border_is_outside_and_two_regions_may_hold_a_point(spark):
    boxes = [(100, 200, 0, 0, 1), (320, 200, 0, 0, 1), (101, 450, 0, 0, 1)]
    rows, own = det(spark, boxes), regions.seed_regions(spark)
    for polygons in (False, True):
        hits = regions.region_hits(rows, own, "each", polygons).select("det_idx", "region_id").collect()
        assert sorted(map(tuple, hits)) == [(1, 0), (1, 1)]


def test_modes_differ_on_all_but_the_last_detection(spark):
    rows, own = det(spark, [(320, 200, 0, 0, 1), (0, 0, 0, 0, 1)]), regions.seed_regions(spark)
    assert regions.region_hits(rows, own, "last").count() == 0
    assert regions.region_hits(rows, own, "each").count() == 2
    with pytest.raises(ValueError, match="mode"):
        regions.region_hits(rows, own, "first")


def test_concave_polygon(spark):
    corners = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]
    polygon = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    points = spark.createDataFrame([(5.0, 2.0, True), (5.0, 6.0, False), (1.0, 6.0, True), (0.0, 5.0, False), (5.0, 3.0, False)], "x double, y double, inside boolean")
    assert all(r[0] == r[1] for r in points.select(G.inside_polygon(F.col("x"), F.col("y"), polygon), "inside").collect())


@FEW
@given(st.integers(1, 2000), st.integers(1, 2000), st.floats(0, 640))
def test_letterbox_round_trip(spark, h, w, v):
    g = G.letterbox(F.lit(float(h)), F.lit(float(w)))
    scale, pad, back = spark.range(1).select(g["scale"], g["pad_x"], G.unletterbox(F.lit(v), g["pad_x"], g["scale"])).first()
    assert abs(back * scale + pad // 2 - v) < 1e-6


def test_decode_threshold_is_inclusive_and_first_maximum_wins(spark):
    raw = spark.createDataFrame([(0, 0, 0, 5.0, 5.0, 2.0, 2.0, [0.4, 0.4]), (0, 0, 1, 5.0, 5.0, 2.0, 2.0, [0.39, 0.1]), (0, 1, 2, 5.0, 5.0, 2.0, 2.0, [])], "camera_id long, frame_no long, anchor_idx long, cx double, cy double, w double, h double, scores array<double>")  # noqa: E501
    rows = decode.decode(raw).collect()
    assert [(r["det_idx"], r["cls_id"], r["x1"], r["x2"]) for r in rows] == [(0, 0, 4.0, 7.0)]
    assert decode.decode(raw, box_mode="centered").first()["x2"] == 6.0


def test_stream_properties(spark):
    rows = [(float("nan"), 30.0), (float("inf"), 30.0), (0.0, 30.0), (100.0, 30.0), (130.0, 30.0), (25.0, 25.0), (None, 30.0)]
    got = spark.createDataFrame(rows, "fps double, want double").select(T.sane_fps(F.col("fps")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_paths(spark):
    paths = spark.createDataFrame([("a/b.c/Clip.MP4", "mp4", "Clip"), ("a.b/none", None, "none"), ("x.tar.gz", "gz", "x.tar")], "p string, e string, s string")
    for r in paths.select(T.extension(F.col("p")), "e", T.stem(F.col("p")), "s").collect():
        assert r[0] == r[1]
        assert r[2] == r[3]


def test_payload_round_trip(spark):
    from framequery.sources.messages import read_timings, timing_messages

    speed = spark.createDataFrame([(0, 1, 0.0197, 24.2, 8.08)], "camera_id long, frame_no long, preprocess double, inference double, postprocess double")
    got = read_timings(timing_messages(speed)).first()
    assert (got["preprocess"], got["inference"], got["postprocess"]) == (0.0197, 24.2, 8.08)
    assert got["value"].startswith("{'preprocess': 0.0197")
