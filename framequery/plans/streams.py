"""Queries that run the streaming operators to the end of their input."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.operators import ingest, regions, tracker
from framequery.plans import synthetic as S
from framequery.plans.catalog import INSIDE, ISLANDS, RUN, TIMES, D, registered
from framequery.sources import images, messages
from framequery.sources.media import register
from framequery.streaming import jobs, live
from framequery.streaming.shared import shared_dir, written


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/framequery/stream-{uuid.uuid4().hex}"


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ntz(rows: DataFrame) -> DataFrame:
    """Times as the tables have them, without a zone."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_ts", "gap_at")})


#: Rows of a micro-batch; what one camera's state holds at once is a part of it.
ROWS_A_BATCH = 4_000_000


def _replay(spark: SparkSession, rows: DataFrame, folder: str, order: str, operator: Callable[[DataFrame], DataFrame], mode: str = "append", batches: int = 4) -> DataFrame:  # noqa: E501
    """What ``operator`` makes of a stream of ``rows`` that come by ``order`` in at
    least so many micro-batches.

    A batch is written by as many tasks as it takes and then taken up whole, from the
    checkpoint of the one before, so rows of one ``order`` are never parted.
    """
    rows = written(rows, "replayed")
    last, n = rows.agg(F.max(order), F.count("*")).first()
    batches = max(batches, -(-n // ROWS_A_BATCH))
    share = F.least(F.floor(F.col(order) * batches / F.lit((last or 0) + 1)), F.lit(batches - 1))
    for k in range(batches):
        rows.where(share == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        jobs.run_to_end(operator(stream), f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.parquet(f"{folder}/out")


@registered("stream_region_counts", f"{D} SELECT region_id, camera_id, count(*) AS c FROM det JOIN regions ON {INSIDE} GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    totals = lambda stream: jobs.streaming_region_totals(stream, regions.seed_regions(spark))
    return _replay(spark, S.det(spark, sf_dir), folder, "frame_no", totals, "complete")


DAYS = "SELECT camera_id, date_trunc('day', ts) AS start, count(*) AS n FROM (SELECT event_id % 4 AS camera_id, ts FROM events) GROUP BY ALL"


@registered("stream_tumbling", f"SELECT camera_id, CAST(start AS DATE) AS day, n FROM ({DAYS}) WHERE start < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed: the last day's stay open."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 4).alias("camera_id"), "event_id", "ts")
    return _replay(spark, events, folder, "event_id", jobs.tumbling_counts).select("camera_id", F.to_date("start").alias("day"), "n")


@registered("stream_tracks", f"{ISLANDS} SELECT camera_id, frame_no, det_idx, track_id, count(*) {RUN} AS length FROM isl")  # never more tracks than are remembered
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track lengths from keyed state.  Every micro-batch here holds whole frames,
    so the newest ones are folded with it too."""
    folder = _folder(spark)
    _rocks(spark)
    return _replay(spark, S.det(spark, sf_dir), folder, "frame_no", lambda stream: jobs.streaming_tracks(stream, flush=True))


@registered("stream_track_assign")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker from keyed state; whole frames, so the newest are folded too."""
    folder = _folder(spark)
    _rocks(spark)
    assign = lambda stream: jobs.streaming_assign(stream, tracker.TrackerOptions(), flush=True)
    return _replay(spark, S.view(spark, sf_dir, S.DET_MOVING), folder, "frame_no", assign)


#: Cameras that answer now and then.
SIGNALS = "SELECT user_id % 16 AS camera_id, event_id, ts FROM events"
GAPS = f"""SELECT camera_id, last_ts, gap_at, true AS is_gap FROM (
    SELECT camera_id, ts AS last_ts, ts + INTERVAL 2 HOUR AS gap_at, lead(ts) OVER (PARTITION BY camera_id ORDER BY ts) AS after FROM ({SIGNALS}))
    WHERE gap_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AND (after IS NULL OR after > gap_at)"""


@registered("signal_gaps", GAPS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(ingest.signal_gaps(S.view(spark, sf_dir, SIGNALS), timedelta(hours=2), timedelta(hours=1)))


@registered("stream_gaps", GAPS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from event-time timers."""
    folder = _folder(spark)
    _rocks(spark)
    return _ntz(_replay(spark, S.view(spark, sf_dir, SIGNALS), folder, "event_id", lambda stream: live.streaming_gaps(stream, timedelta(hours=2), "1 hour")))


STEPS = "SELECT camera_id, frame_no, row_number() OVER (PARTITION BY camera_id ORDER BY frame_no) AS step FROM (SELECT DISTINCT camera_id, frame_no FROM det)"
ZIP = f"{D}, n AS ({STEPS}) SELECT step, {', '.join(f'max(frame_no) FILTER (camera_id = {c}) AS frame_{c}' for c in range(4))} FROM n GROUP BY step HAVING count(*) = 4"


@registered("stream_zip_live", ZIP)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cameras' n-th frames together, from keyed state."""
    folder = _folder(spark)
    _rocks(spark)
    return _replay(spark, S.view(spark, sf_dir, S.FRAMES), folder, "frame_no", lambda stream: live.streaming_zip(stream, [0, 1, 2, 3]))


@registered("stream_messages", f"SELECT camera_id, frame_no, preprocess, inference, postprocess FROM ({TIMES})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage times published as messages, read back by a stream, their bytes parsed."""
    register(spark)
    folder = _folder(spark)
    sent = messages.timing_messages(S.view(spark, sf_dir, TIMES))
    keyed = F.concat_ws("|", "camera_id", "frame_no", "value")
    sent.select("topic", keyed.alias("value")).write.format("messages").mode("append").option("path", f"{folder}/log").save()
    stream = spark.readStream.format("messages").option("path", f"{folder}/log").option("topic", messages.TOPIC).load()
    jobs.run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    part = F.split(messages.payload_text(F.col("payload")), r"\|", 3)
    rows = spark.read.parquet(f"{folder}/out").select(part[0].cast("long").alias("camera_id"), part[1].cast("long").alias("frame_no"), part[2].alias("value"))
    return messages.read_timings(rows).drop("value")


GREYS = "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor(abs(v) * 1000) AS BIGINT) % 256) AS g FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0"


@registered("stills_written_and_read", f"SELECT vec_id % 7 AS camera_id, vec_id AS frame_no, len(g) AS pixels, list_sum(g) AS total, CAST(g[1] AS BIGINT) AS first, CAST(g[-1] AS BIGINT) AS last FROM ({GREYS})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a picture of one line, written as PNG by the committing
    sink, found by a file scan, and decoded."""
    register(spark)
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and size(embedding) > 0")
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(F.abs(v) * 1000) % 256)
    data = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    frames = rows.select((F.col("vec_id") % 7).alias("camera_id"), F.col("vec_id").alias("frame_no"), F.lit(1).alias("height"), F.size("embedding").alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))  # noqa: E501
    images.stills(frames).write.format("images").mode("append").option("path", f"{folder}/stills").save()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(f"{folder}/stills").select("path", "content")
    back = images.decoded(found)
    numbers = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("long"))
    part = F.split("path", "/")
    keys = [F.element_at(part, -3).cast("long").alias("camera_id"), F.regexp_extract(F.element_at(part, -1), r"^(\d+)", 1).cast("long").alias("frame_no")]
    pixels = back.select(*keys, numbers.alias("g"))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda a, b: a + b)
    return pixels.select("camera_id", "frame_no", F.size("g").cast("long").alias("pixels"), total.alias("total"), F.element_at("g", 1).alias("first"), F.element_at("g", -1).alias("last"))


@registered("camera_frames")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the camera source, cropped to the model's square."""
    from framequery.operators.pixels import transform_frames

    register(spark)
    frames = spark.read.format("cameras").options(cameras=2, frames=6, height=24, width=32).load()
    done = transform_frames(frames, "zoom", "letterbox")
    return done.select("camera_id", "frame_no", "height", "width", F.crc32("data").alias("checksum"))


@registered("stub_inference")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model by ``predict_batch_udf`` on the quarters' mean greys."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    from framequery.operators.pixels import stub_model

    model = predict_batch_udf(stub_model(), return_type=ArrayType(FloatType()), batch_size=64, input_tensor_shapes=[[4]])
    means = F.array(*[(F.col("frame_no") * k % 255).cast("float") for k in (1, 3, 5, 7)])
    return S.view(spark, sf_dir, S.FRAMES).select("camera_id", "frame_no", model(means).alias("raw"))
