"""Lost signals and live streams side by side: streams equal batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framequery.operators import ingest
from framequery.streaming import jobs, live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = datetime(2024, 5, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def streamed(spark, batches, ddl, folder):
    """One file, and so one micro-batch, for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def plain_gaps(rows, limit, seen_to):
    out = set()
    for camera in {c for c, _ in rows if c is not None}:
        at = sorted({t for c, t in rows if c == camera and t is not None})
        for x, y in zip(at, [*at[1:], None], strict=True):
            if x + limit <= seen_to and (y is None or y - x > limit):
                out.add((camera, x, x + limit))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gaps_whatever_the_batches(spark, tmp_path, seed):
    rnd, limit = random.Random(seed), timedelta(seconds=10)
    rows = [(c, T0 + timedelta(seconds=s, microseconds=rnd.randrange(10**6))) for c in range(3) for s in range(0, 400, 3) if rnd.random() < (0.2, 0.5, 0.8)[c]]
    rows = [r for r in rows if r[0] != 2 or r[1] < T0 + timedelta(seconds=200)]  # a camera that falls silent
    rows.append((None, T0))
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rnd.uniform(0, 20)))  # out of order, within the lateness
    cuts = sorted(rnd.sample(range(len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if b > a]
    end = max(t for _, t in rows) + timedelta(hours=1)
    batches.append([(9, end)])
    gaps = live.streaming_gaps(streamed(spark, batches, "camera_id long, ts timestamp_ntz", tmp_path), limit)
    jobs.run_to_end(gaps, f"{tmp_path}/out", f"{tmp_path}/state")
    got = [(r["camera_id"], r["last_ts"], r["gap_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    want = plain_gaps([*rows, (9, end)], limit, end - timedelta(minutes=1))
    assert sorted(got) == sorted(want)
    frames = spark.createDataFrame([*rows, (9, end)], "camera_id long, ts timestamp_ntz")
    batch = ingest.signal_gaps(frames, limit, timedelta(minutes=1)).collect()
    assert sorted((r["camera_id"], r["last_ts"], r["gap_at"]) for r in batch) == sorted(want)


def test_gap_at_exactly_the_limit_is_none(spark):
    rows = [(0, T0), (0, T0 + timedelta(seconds=10)), (0, T0 + timedelta(seconds=20, microseconds=1)), (0, None)]
    found = ingest.signal_gaps(spark.createDataFrame(rows, "camera_id long, ts timestamp_ntz"), timedelta(seconds=10)).collect()
    assert [r["last_ts"] for r in found] == [T0 + timedelta(seconds=10)]
    assert ingest.signal_gaps(spark.createDataFrame([], "camera_id long, ts timestamp_ntz"), timedelta(seconds=10)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_zip_under_any_interleaving(spark, tmp_path, seed):
    rnd = random.Random(seed)
    left = {c: [(c, f) for f in sorted(rnd.sample(range(500), n))] for c, n in ((0, 40), (1, 25), (2, 60), (7, 30))}
    rows = []
    while any(left.values()):
        c = rnd.choice([c for c in left if left[c]])
        k = rnd.randint(1, 15)
        rows += left[c][:k]
        left[c] = left[c][k:]
    cuts = sorted(rnd.sample(range(1, len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    zipped = live.streaming_zip(streamed(spark, batches, "camera_id long, frame_no long", tmp_path), [0, 1, 2, 7])
    jobs.run_to_end(zipped, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = ingest.zipped_streams(spark.createDataFrame(rows, "camera_id long, frame_no long"), [0, 1, 2, 7])
    assert want.count() == 25 and got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_zip_goes_on_after_a_restart(spark, tmp_path):
    ddl = "camera_id long, frame_no long"
    jobs.run_to_end(live.streaming_zip(streamed(spark, [[(0, 1), (0, 2)]], ddl, tmp_path), [0, 1]), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.schema("step long").parquet(f"{tmp_path}/out").count() == 0
    jobs.run_to_end(live.streaming_zip(streamed(spark, [[(1, 5), (1, 8), (1, 9)]], ddl, tmp_path), [0, 1]), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 1, 5), (2, 2, 8)]


def test_unreadable_frames(spark):
    frames = spark.createDataFrame([(0, 0, b"x"), (0, 1, None)], "camera_id long, frame_no long, data binary")
    assert [r["frame_no"] for r in ingest.readable(frames).collect()] == [0]
    assert [r["is_gap"] for r in ingest.readable(frames, live=True).orderBy("frame_no").collect()] == [False, True]
    counts = spark.createDataFrame([(0, 2)], "camera_id long, n_frames long")
    assert [r["frame_no"] for r in ingest.bounded_run(frames, counts).collect()] == [0]
    streams = spark.createDataFrame([(25.0,), (10.0,)], "fps double")
    assert ingest.poll_seconds(streams).first()["seconds"] == 0.1
    assert ingest.poll_seconds(streams).where(F.col("seconds") > 1).count() == 0
