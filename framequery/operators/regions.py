"""Regions of interest: hits, running counts, totals, and regions that move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.functions import geometry as G
from framequery.operators.grid import points_inside, sums_inside
from framequery.streaming.shared import written

#: The two regions every run starts with (id, name, xmin, ymin, xmax, ymax).
SEED_REGIONS = [(0, "left", 100.0, 150.0, 340.0, 450.0), (1, "right", 300.0, 150.0, 540.0, 450.0)]


def seed_regions(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}L, '{n}', {a}D, {b}D, {c}D, {d}D)" for i, n, a, b, c, d in SEED_REGIONS)
    corner = "named_struct('x', {}, 'y', {})"
    polygon = ", ".join(corner.format(x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")))
    return spark.sql(f"SELECT *, array({polygon}) AS polygon FROM VALUES {rows} AS t(region_id, name, xmin, ymin, xmax, ymax)")


def last_of_frame(det: DataFrame) -> DataFrame:
    """The last detection of each frame."""
    last = Window.partitionBy("camera_id", "frame_no").orderBy(F.desc("det_idx"))
    return det.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def region_hits(det: DataFrame, regions: DataFrame, mode: str = "last", polygons: bool = False) -> DataFrame:
    """Detections whose centre lies strictly inside a region, once for each.

    ``last`` tests only the last tracked detection of a frame, so that a region
    grows by one a frame at most; ``each`` tests all.  Rectangles are compared
    directly; ``polygons`` tests any simple polygon, found by its rectangle.  A
    handful of regions is compared with everything, more are found by a grid.
    """
    tracked = det.where(F.col("track_id").isNotNull())
    rows = last_of_frame(tracked) if mode == "last" else tracked
    if mode not in ("last", "each"):
        raise ValueError(f"mode is 'last' or 'each', not {mode!r}")
    cx, cy = G.center(F.col("x1"), F.col("x2")), G.center(F.col("y1"), F.col("y2"))
    inside = G.inside_polygon(cx, cy, F.col("polygon")) if polygons else G.inside_rectangle(cx, cy)
    return points_inside(rows, cx, cy, regions, inside)


def running_count(hits: DataFrame) -> DataFrame:
    """region_id, camera_id, frame_no, det_idx, c: hits so far, per camera."""
    so_far = Window.partitionBy("region_id", "camera_id").orderBy("frame_no", "det_idx").rowsBetween(Window.unboundedPreceding, 0)
    return hits.select("region_id", "camera_id", "frame_no", "det_idx", F.count("*").over(so_far).alias("c"))


def region_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("region_id", "camera_id").agg(F.count("*").alias("c"))


def region_sums(det: DataFrame, regions: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """region_id, c and the ``sums`` of whole numbers over the tracked detections
    whose centre lies strictly inside a region; regions without any are left out.

    No hit is listed: of many regions and many detections there would be as many as
    the product of both.
    """
    tracked = det.where(F.col("track_id").isNotNull())
    cx, cy = G.center(F.col("x1"), F.col("x2")), G.center(F.col("y1"), F.col("y2"))
    corners = ["xmin", "ymin", "xmax", "ymax"]
    areas = written(regions.select("region_id", *[F.col(c).cast("double").alias(c) for c in corners]), "areas")
    found = written(sums_inside(tracked, cx, cy, areas, sums), "sums")
    return areas.join(found, corners).groupBy("region_id").agg(*[F.sum(c).alias(c) for c in ("c", *sums)])


def distinct_tracks(hits: DataFrame) -> DataFrame:
    return hits.groupBy("region_id").agg(F.countDistinct("camera_id", "track_id").alias("tracks"))


def approximate_tracks(hits: DataFrame) -> DataFrame:
    """Distinct tracks by a sketch of fixed size."""
    return hits.groupBy("region_id").agg(F.approx_count_distinct(F.struct("camera_id", "track_id")).alias("tracks"))


def picked_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(event_id, x, y) -> event_id, region_id: the last region that holds the point."""
    hit = points_inside(points, F.col("x"), F.col("y"), regions, G.inside_rectangle(F.col("x"), F.col("y")))
    return hit.groupBy("event_id").agg(F.max("region_id").alias("region_id"))


def drag_steps(moves: DataFrame) -> DataFrame:
    """(region_id, seq, x, y) -> the step from the pointer's last place (dx, dy)
    and the sum of all steps (sum_dx, sum_dy)."""
    by_seq = Window.partitionBy("region_id").orderBy("seq")
    steps = moves.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(by_seq), F.lit(0.0)) for c in ("x", "y")})
    return steps.withColumns({f"sum_d{c}": F.sum(f"d{c}").over(by_seq) for c in ("x", "y")})


def moving_region_hits(det: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits in regions that change: ``versions`` are regions with the frames
    [valid_from, valid_to) in which they hold; a null in valid_to is open."""
    holds = (F.col("frame_no") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("frame_no") < F.col("valid_to")))
    cx, cy = G.center(F.col("x1"), F.col("x2")), G.center(F.col("y1"), F.col("y2"))
    return points_inside(det, cx, cy, versions, holds & G.inside_rectangle(cx, cy), F.col("frame_no"))
