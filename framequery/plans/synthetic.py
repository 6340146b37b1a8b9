"""Detection-shaped views of the driver's tables, by exact arithmetic, as SQL
text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _det(camera: str, frame: str, track: str, where: str = "1 = 1") -> str:
    return f"""SELECT camera_id, frame_no, det_idx, track_id, cls_id, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
        SELECT CAST({camera} AS BIGINT) AS camera_id, CAST(floor({frame}) AS BIGINT) AS frame_no, event_id AS det_idx,
            CAST({track} AS BIGINT) AS track_id, CAST(user_id % 8 AS BIGINT) AS cls_id, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS conf,
            CAST((event_id * 7919 + user_id * 104729) % 600 AS DOUBLE) AS x1, CAST((event_id * 6151 + user_id * 3571) % 600 AS DOUBLE) AS y1,
            CAST(20 + (event_id * 13) % 120 AS DOUBLE) AS w, CAST(20 + (event_id * 29) % 90 AS DOUBLE) AS h,
            row_number() OVER (PARTITION BY {camera}, floor({frame}), {track} ORDER BY event_id) AS rn
        FROM events WHERE {where}) AS t WHERE rn = 1"""


DET = _det("event_id % 4", "event_id / 48.0", "user_id % 24 + 1")
#: Up to 40 tracks a frame, more than the memory of tracks holds.
DET_CROWDED = _det("event_id % 4", "event_id / 160.0", "user_id % 150")
#: Up to 12 things a camera that move on straight lines and tremble, seen now and then.
DET_MOVING = """SELECT camera_id, frame_no, det_idx, thing, thing % 8 AS cls_id, conf, x1, y1, x1 + 40 + thing AS x2, y1 + 30 + thing AS y2 FROM (
        SELECT camera_id, frame_no, det_idx, thing, conf, CAST(thing * 97 % 640 + frame_no * (thing % 5 - 2) % 640 + det_idx % 3 AS DOUBLE) AS x1, CAST(thing * 71 % 640 + frame_no * (thing % 3 - 1) % 640 + det_idx % 2 AS DOUBLE) AS y1 FROM (
            SELECT event_id % 4 AS camera_id, CAST(floor(event_id / 48.0) AS BIGINT) AS frame_no, event_id AS det_idx, user_id % 12 AS thing, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS conf,
                row_number() OVER (PARTITION BY event_id % 4, floor(event_id / 48.0), user_id % 12 ORDER BY event_id) AS rn FROM events) AS t WHERE rn = 1) AS u"""  # noqa: E501
#: Boxes close together, for suppression.
DET_DENSE = f"SELECT camera_id, frame_no, det_idx, track_id, cls_id, conf, x1, y1, x1 + 60 + det_idx % 7 AS x2, y1 + 60 + det_idx % 5 AS y2 FROM (SELECT camera_id, frame_no, det_idx, track_id, cls_id, conf, CAST(det_idx * 17 % 90 AS DOUBLE) AS x1, CAST(det_idx * 29 % 80 AS DOUBLE) AS y1 FROM ({DET}) AS d) AS e"  # noqa: E501
REGIONS = "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'left', CAST(100 AS DOUBLE), CAST(150 AS DOUBLE), CAST(340 AS DOUBLE), CAST(450 AS DOUBLE)), (1, 'right', 300, 150, 540, 450)) AS t(region_id, name, xmin, ymin, xmax, ymax)"  # noqa: E501
NAMES = "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'person'), (1, 'bicycle'), (2, 'car'), (3, 'motorcycle'), (4, 'airplane'), (5, 'bus'), (6, 'train'), (7, 'truck')) AS t(cls_id, name)"  # noqa: E501
SPEED = "SELECT event_id % 4 AS camera_id, CAST(floor(event_id / 4.0) AS BIGINT) AS frame_no, CAST(floor(event_id / 8.0) AS BIGINT) AS batch_id, CAST((event_id * 7) % 64 AS DOUBLE) / 1024 AS preprocess, CAST(value AS DOUBLE) AS inference, CAST((event_id * 11) % 32 AS DOUBLE) / 1024 AS postprocess FROM events"  # noqa: E501
FRAMES = f"SELECT DISTINCT camera_id, frame_no FROM ({DET}) AS d"
#: Stage seconds are those of the whole batch, so one value a batch.
BATCHES = f"SELECT b.camera_id, b.frame_no, b.batch_id, CAST(b.batch_id % 8 AS DOUBLE) / 64 AS preprocess, CAST(b.batch_id % 32 AS DOUBLE) / 16 AS inference, CAST(b.batch_id % 4 AS DOUBLE) / 128 AS postprocess FROM ({SPEED}) AS b"  # noqa: E501
PATHS = "SELECT DISTINCT path FROM (SELECT concat(source, '/clip', CAST(doc_id % 40 AS VARCHAR(20)), CASE doc_id % 7 WHEN 0 THEN '.MP4' WHEN 1 THEN '.jpg' WHEN 2 THEN '.Png' WHEN 3 THEN '.avi' WHEN 4 THEN '.txt' WHEN 5 THEN '' ELSE '.heic' END) AS path FROM documents) AS p"  # noqa: E501
RENDITIONS = "SELECT o_custkey % 50 AS video, o_orderkey AS pos, concat(CAST((o_orderkey % 4 + 1) * 360 AS VARCHAR(20)), 'p') AS resolution, concat('u', CAST(o_orderkey AS VARCHAR(20))) AS url, CAST((o_orderkey % 4 + 1) * 640 AS BIGINT) AS width, CAST((o_orderkey % 4 + 1) * 360 AS BIGINT) AS height, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'avc' END AS vcodec, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'aac' END AS acodec, CASE WHEN o_orderkey % 2 = 0 THEN 'mp4' ELSE 'webm' END AS ext FROM orders"  # noqa: E501
#: Raw rows: four box values and 60 class scores from each embedding.
RAW_KEYS = "vec_id AS anchor_idx, vec_id % 3 AS camera_id, CAST(floor(vec_id / 25.0) AS BIGINT) AS frame_no"


def view(spark: SparkSession, sf_dir: str, sql: str, table: str = "events") -> DataFrame:
    """One of the views above over one driver table, given by name."""
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DET)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor_idx, camera_id, frame_no, values array<double>) of embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    return rows.selectExpr(*RAW_KEYS.split(", ", 2)[:2], RAW_KEYS.split(", ", 2)[2], "CAST(embedding AS ARRAY<DOUBLE>) AS values")


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framequery.operators.decode import class_scores

    v = lambda i: F.element_at("values", i)
    rows = raw_rows(spark, sf_dir).withColumns({"cx": (v(1) + 1) * 320, "cy": (v(2) + 1) * 320, "w": F.abs(v(3)) * 200 + 10, "h": F.abs(v(4)) * 200 + 10})
    return class_scores(rows, "v8")
