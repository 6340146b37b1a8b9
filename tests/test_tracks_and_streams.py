from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from framequery.operators import tracks
from framequery.plans import synthetic as S
from framequery.streaming import jobs
from tests.conftest import SF

DET = "camera_id long, frame_no long, det_idx long, track_id long, cls_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def rows_of(*seen):
    """(frame, track) pairs as detections of one camera."""
    return [(0, f, i, t, t % 3, 0.9, float(i), 0.0, float(i + 2), 4.0) for i, (f, t) in enumerate(seen)]


def folded(rows, cap=30):
    """The rules again, without Spark."""
    out, memory, frames = {}, defaultdict(dict), defaultdict(list)
    for camera, frame, idx, track in sorted(rows):
        frames[camera, frame].append((idx, track))
    for (camera, _), own in sorted(frames.items()):
        known = memory[camera]
        for idx, track in own:
            known[track] = known.get(track, 0) + 1
            out[idx] = known[track]
            if len(known) > cap:
                known.pop(next(iter(known)))
        present = {t for _, t in own}
        memory[camera] = {t: n for t, n in known.items() if t in present}
    return out


def keys(df):
    return [tuple(r) for r in df.select("camera_id", "frame_no", "det_idx", "track_id").collect()]


def test_window_equals_fold(spark):
    det = S.det(spark, SF)
    got = {r["det_idx"]: r["length"] for r in tracks.track_length(det).collect()}
    assert got == folded(keys(det))


def test_bounded_memory_equals_fold(spark):
    det = S.view(spark, SF, S.DET_CROWDED)
    got = {r["det_idx"]: r["length"] for r in tracks.bounded_tracks(det, 8).collect()}
    assert got == folded(keys(det), 8)
    unbounded = {r["det_idx"]: r["length"] for r in tracks.track_length(det).collect()}
    assert got != unbounded


def test_absence_ends_a_track_and_empty_frames_do_not(spark):
    seen = spark.createDataFrame(rows_of((0, 1), (0, 2), (1, 1), (5, 1), (5, 2)), DET)  # frames 2 to 4 hold nothing
    got = {r["det_idx"]: r["length"] for r in tracks.track_length(seen).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 1}
    assert [tuple(r) for r in tracks.lost_tracks(seen).collect()] == [(0, 2, 0)]


def test_last_track_of_a_class_draws(spark):
    seen = spark.createDataFrame(rows_of((0, 1), (0, 4)), DET)
    assert [(r["cls_id"], r["track_id"]) for r in tracks.class_polylines(seen).collect()] == [(1, 4)]


def test_lost_track_hides_the_class_of_its_number(spark):
    seen = spark.createDataFrame(rows_of((0, 1), (0, 5), (1, 5), (1, 4)), DET)  # track 1 lost; class 1 is track 4's
    plain = {(r["frame_no"], r["cls_id"]) for r in tracks.class_polylines(seen).collect()}
    hidden = {(r["frame_no"], r["cls_id"]) for r in tracks.class_filtered_polylines(seen).collect()}
    assert plain - hidden == {(1, 1)}


def test_stream_equals_batch_with_a_frame_in_two_files(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    det = S.det(spark, SF)
    cut = det.select(F.percentile_approx("det_idx", 0.5)).first()[0]
    for half in (det.where(F.col("det_idx") <= cut), det.where(F.col("det_idx") > cut)):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_to_end(jobs.streaming_tracks(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["det_idx"]: r["length"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    rows = keys(det)
    newest = {c: max(r[1] for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    want = folded(rows)
    assert got == {r[2]: want[r[2]] for r in rows if r[1] < newest[r[0]]}


class _Kept:
    """A value state without a stream."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_many_frames_in_one_micro_batch():
    """One camera's batch is walked through once, not once a frame."""
    import time

    import pandas as pd

    n = 30_000
    rows = pd.DataFrame({"frame_no": [k // 2 for k in range(2 * n)], "det_idx": range(2 * n), "track_id": [k % 2 + 5 for k in range(2 * n)]})
    processor = jobs.TrackProcessor()
    processor.memory = _Kept()
    start = time.monotonic()
    out = pd.concat(processor.handleInputRows((3,), iter([rows.iloc[::-1]]), None))
    assert time.monotonic() - start < 10
    assert out["length"].tolist() == [k // 2 + 1 for k in range(2 * n - 2)] and set(out["camera_id"]) == {3}
    late = list(processor.handleInputRows((3,), iter([rows.iloc[:4], rows.iloc[-1:].assign(frame_no=n + 1)]), None))
    assert late[0]["length"].tolist() == [n, n]


def test_a_batch_is_written_by_many_tasks_and_taken_whole(spark, tmp_path):
    from pathlib import Path

    from framequery.plans import streams

    rows = spark.range(0, 4000, 1, 4).selectExpr("id % 1000 AS frame_no", "id % 4 AS camera_id")
    out = streams._replay(spark, rows, str(tmp_path), "frame_no", lambda s: s.groupBy("camera_id").count(), "complete")
    assert sorted(r["count"] for r in out.collect()) == [1000] * 4
    assert len(list(Path(tmp_path, "in").glob("*.parquet"))) > 4
