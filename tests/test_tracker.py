"""The tracker against a plain one: full matrices and all assignments."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.operators import tracker
from framequery.operators.tracker import TrackerOptions, Tracks, advance, assignment, track_assign
from framequery.plans import synthetic as S
from framequery.streaming import jobs
from tests.conftest import SF

DET = "camera_id long, frame_no long, det_idx long, cls_id long, conf double, x1 double, y1 double, x2 double, y2 double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def all_assignments(cost, limit):
    """The best pairs by trying all."""
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in all_assignments(cost.T, limit))
    total, best = 0.0, []
    for cols in permutations(range(m), n):
        pairs = [(i, j) for i, j in enumerate(cols) if cost[i, j] < limit]
        saved = sum(limit - cost[i, j] for i, j in pairs)
        if saved > total + 1e-12:
            total, best = saved, pairs
    return sorted(best)


def test_assignment_as_by_trying_all():
    rng = np.random.default_rng(0)
    for _ in range(300):
        cost = rng.random((rng.integers(1, 6), rng.integers(1, 6))) * rng.choice([0.6, 1.2, 3])
        assert assignment(cost, 0.8) == all_assignments(cost, 0.8)
    big = rng.random((40, 60))
    used = assignment(big, 0.8)
    assert len({i for i, _ in used}) == len({j for _, j in used}) == len(used) == 40


class Plain:
    """The same rules for one camera, written out with 8 x 8 matrices."""

    def __init__(self):
        self.tracks, self.issued = [], 0

    def step(self, frame, rows, o):
        F8, H = np.eye(8) + np.eye(8, k=4), np.eye(4, 8)
        for t in self.tracks:
            if not t["seen"]:
                t["x"][7] = 0
            h = t["x"][3]
            q = np.diag([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2
            t["x"], t["P"] = F8 @ t["x"], F8 @ t["P"] @ F8.T + q
        out, met, empty = {}, [], not self.tracks

        def box(t):
            cx, cy, a, h = t["x"][:4]
            return cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2

        def iou(a, b):
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            inter = max(w, 0) * max(h, 0)
            return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

        def z(r):
            return np.array([(r[2] + r[4]) / 2, (r[3] + r[5]) / 2, (r[4] - r[2]) / (r[5] - r[3]), r[5] - r[3]])

        def meet(tracks, boxes, limit, score):
            if not tracks or not boxes:
                return boxes
            cost = np.array([[1 - iou(box(t), r[2:]) * (r[1] if score else 1) for r in boxes] for t in tracks])
            pairs = all_assignments(cost, limit)
            for i, j in pairs:
                t, h = tracks[i], tracks[i]["x"][3]
                noise = np.diag([h / 20, h / 20, 1e-1, h / 20]) ** 2
                gain = t["P"] @ H.T @ np.linalg.inv(H @ t["P"] @ H.T + noise)
                t["x"] = t["x"] + gain @ (z(boxes[j]) - H @ t["x"])
                t["P"] = (np.eye(8) - gain @ H) @ t["P"]
                t["last"] = frame
                met.append(t)
                out[boxes[j][0]] = t["id"]
            return [r for j, r in enumerate(boxes) if j not in {p[1] for p in pairs}]

        sure, fresh = [t for t in self.tracks if t["sure"]], [t for t in self.tracks if not t["sure"]]
        left = meet(sure, [r for r in rows if r[1] >= o.high], o.match, True)
        meet([t for t in sure if t["seen"] and t not in met], [r for r in rows if o.low <= r[1] < o.high], o.doubtful, False)
        left = meet(fresh, left, o.fresh, True)
        for t in self.tracks:
            t["seen"] = any(t is m for m in met)
        self.tracks = [t for t in self.tracks if t["seen"] or t["sure"] and frame - t["last"] <= o.memory]
        for t in self.tracks:
            t["sure"] = True
        for r in left:
            if r[1] >= o.new:
                self.issued += 1
                h = r[5] - r[3]
                P = np.diag([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]) ** 2
                self.tracks.append({"id": self.issued, "x": np.r_[z(r), np.zeros(4)], "P": P, "seen": True, "sure": empty, "first": frame, "last": frame})
                if empty:
                    out[r[0]] = self.issued
        kept, lost = [t for t in self.tracks if t["seen"] and t["sure"]], [t for t in self.tracks if not t["seen"]]
        gone = []
        for a in kept:
            for b in lost:
                if iou(box(a), box(b)) > o.twin:
                    gone.append(b if a["last"] - a["first"] > b["last"] - b["first"] else a)
        self.tracks = [t for t in self.tracks if not any(t is g for g in gone)]
        return out


def plain_tracks(rows, o=TrackerOptions()):
    """(camera, frame, det, conf, x1, y1, x2, y2) rows -> {(camera, det): track}."""
    out = {}
    for camera in {r[0] for r in rows}:
        frames, plain = {}, Plain()
        for r in sorted(rows):
            if r[0] == camera:
                frames.setdefault(r[1], []).append(r[2:])
        for frame in range(min(frames), max(frames) + 1):
            out |= {(camera, d): t for d, t in plain.step(frame, frames.get(frame, []), o).items()}
    return out


def scene(seed, frames=60, things=5, cameras=2, gap=None):
    """Things on straight lines, some boxes missing, doubtful or false."""
    rnd, rows, n = random.Random(seed), [], 0
    for camera in range(cameras):
        moves = [(rnd.uniform(0, 500), rnd.uniform(0, 500), rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.uniform(40, 90)) for _ in range(things)]
        for f in range(frames):
            if gap and gap[0] <= f < gap[1]:
                continue
            for x, y, dx, dy, size in moves:
                if rnd.random() < 0.85:
                    a, b = x + dx * f + rnd.gauss(0, 1), y + dy * f + rnd.gauss(0, 1)
                    rows.append((camera, f, n, rnd.choice([0.95, 0.9, 0.8, 0.7, 0.3, 0.05]) - rnd.random() / 50, a, b, a + size + rnd.gauss(0, 1), b + size / 2 + rnd.gauss(0, 1)))
                    n += 1
    return rows


def as_det(spark, rows):
    return spark.createDataFrame([(c, f, d, 0, *rest) for c, f, d, *rest in rows], DET)


@pytest.mark.parametrize(("seed", "gap"), [(1, None), (2, (20, 35)), (3, (20, 55)), (4, (10, 41)), (5, (10, 42)), (6, (10, 43))])
def test_tracks_equal_the_plain_fold(spark, seed, gap):
    rows = scene(seed, gap=gap)
    got = track_assign(as_det(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["camera_id"], r["det_idx"]): r["track_id"] for r in got if r["track_id"]} == plain_tracks(rows)


def test_a_long_gap_parts_a_camera(spark):
    rows = scene(7, frames=90, gap=(20, 60))
    assert {tuple(r)[::2] for r in tracker.segments(as_det(spark, rows)).select("camera_id", "frame_no", "segment").collect()} == {(c, s) for c in (0, 1) for s in (0, 1)}


def test_tracks_follow_what_moves(spark):
    """Well seen things keep one track each, others than their neighbours'."""
    rows = [(0, f, f * 4 + k, 0.9, 100.0 * k + f * (k + 1), 50.0 * k, 100.0 * k + f * (k + 1) + 60, 50.0 * k + 40) for f in range(50) for k in range(4)]
    got = {r["det_idx"]: r["track_id"] for r in track_assign(as_det(spark, rows)).collect()}
    assert [{got[f * 4 + k] for f in range(50)} for k in range(4)] == [{1}, {2}, {3}, {4}]


def test_odd_boxes_and_empty_tables(spark):
    rows = [(0, 0, 0, 0, None, 0.0, 0.0, 1.0, 1.0), (0, 0, 1, 0, 0.9, None, 0.0, 1.0, 1.0), (0, 0, 2, 0, 0.9, 5.0, 5.0, 5.0, 5.0), (0, 1, 3, 0, 0.9, 5.0, 5.0, 5.0, 5.0), (None, 1, 4, 0, 0.9, 0.0, 0.0, 9.0, 9.0)]
    det = spark.createDataFrame(rows, DET)
    got = {r["det_idx"]: r["track_id"] for r in track_assign(det).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: None, 4: None}
    assert track_assign(det.limit(0)).count() == 0
    assert track_assign(det.withColumn("track_id", F.lit(9))).columns == [*det.columns, "track_id"]


def test_state_survives_its_text():
    rows, state = scene(8, cameras=1), Tracks()
    import json

    for f in range(10):
        own = [r for r in rows if r[1] == f]
        advance(state, f, np.array([r[4:] for r in own]), np.array([r[3] for r in own]), TrackerOptions())
        state = Tracks.from_dict(json.loads(json.dumps(state.to_dict())))
    assert state.issued and state.motion.shape[1:] == (4, 5)


@pytest.mark.parametrize("made", ["scene", "table"])
def test_stream_equals_batch_with_a_frame_in_two_files(spark, tmp_path, made):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    det = as_det(spark, scene(9, frames=40)) if made == "scene" else S.view(spark, SF, S.DET_MOVING).drop("thing")
    # files end within frames: ids run by camera in the scene, by time in the table
    at = F.col("frame_no") * 100 + F.col("det_idx") % 7 if made == "scene" else F.col("det_idx")
    first, second = (1303, 3000) if made == "scene" else (310, 707)
    cut = F.when(at < first, 0).when(at < second, 1).otherwise(2)
    for k in range(3):
        det.where(cut == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_to_end(jobs.streaming_assign(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r["camera_id"], r["det_idx"]): r["track_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = track_assign(det).where("conf >= 0.1").collect()
    newest = {c: max(r["frame_no"] for r in want if r["camera_id"] == c) for c in {r["camera_id"] for r in want}}
    assert got == {(r["camera_id"], r["det_idx"]): r["track_id"] for r in want if r["frame_no"] < newest[r["camera_id"]]}
    assert sum(t is not None for t in got.values()) > 50


def test_cameras_fold_side_by_side(spark, monkeypatch):
    """However little they hold, cameras are not merged into one task."""
    places = []

    def spy(df, label):
        if label == "tracks":
            places.append(df.groupBy(F.spark_partition_id()).count().count())
        return written(df, label)

    written = tracker.written
    monkeypatch.setattr(tracker, "written", spy)
    det = spark.range(400).selectExpr("id % 4 AS camera_id", "id DIV 4 AS frame_no", "id AS det_idx", "0.9D AS conf", "0.0D AS x1", "0.0D AS y1", "10.0D AS x2", "10.0D AS y2")
    assert tracker.track_assign(det).where("track_id = 1").count() == 400
    assert places == [4]


def test_a_batch_of_frames_is_one_table():
    """The stream's processor gives a micro-batch's rows at once, as the batch fold does."""
    import pandas as pd

    from framequery.streaming.jobs import AssignProcessor
    from tests.test_tracks_and_streams import _Kept

    rows = pd.DataFrame({"frame_no": range(50), "det_idx": range(50), "conf": 0.9, "x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 10.0})
    processor = AssignProcessor(tracker.TrackerOptions(), flush=True)
    processor.memory = _Kept()
    out = list(processor.handleInputRows((0,), iter([rows[:30], rows[30:]]), None))
    assert len(out) == 1 and out[0]["track_id"].tolist() == [1] * 50


def test_who_has_no_choice_is_assigned_as_by_paths():
    rng = np.random.default_rng(3)
    for _ in range(300):
        cost = np.where(rng.random((7, 9)) < 0.2, rng.random((7, 9)) * 0.7, 1.0)
        assert tracker.assignment(cost, 0.8) == tracker.augmented(cost, 0.8)
