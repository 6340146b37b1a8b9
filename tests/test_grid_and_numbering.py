"""Many regions, global numbering, run tables and segments at size."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.operators import grid, ingest, regions, tracks
from framequery.operators.numbering import numbered
from framequery.plans import synthetic as S
from tests.conftest import SF
from tests.test_tracks_and_streams import DET, folded, keys, rows_of

REGION = "region_id long, xmin double, ymin double, xmax double, ymax double, valid_from long, valid_to long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many_regions(spark, n):
    side = F.pow(F.lit(2.0), F.col("id") % 9)
    x, y = (F.col("id") * 7919 % 6000 - 3000).cast("double") / 4, (F.col("id") * 104729 % 6000 - 3000).cast("double") / 4
    when = F.when(F.col("id") % 7 > 0, F.col("id") % 50 + F.pow(F.lit(2), F.col("id") % 6).cast("long"))
    return spark.range(n).select(F.col("id").alias("region_id"), x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side / 2).alias("ymax"), (F.col("id") % 50).alias("valid_from"), when.alias("valid_to"))


def boxes(spark, n):
    rng = np.random.default_rng(4)
    rows = [(0, int(f), i, 1, 0, 0.5, float(x), float(y), float(x) + 2, float(y) + 4) for i, (x, y, f) in enumerate(zip(rng.integers(-800, 800, n), rng.integers(-800, 800, n), rng.integers(0, 90, n), strict=True))]
    return spark.createDataFrame(rows, DET)


@pytest.mark.parametrize("moving", [False, True])
def test_a_hundred_thousand_regions(spark, moving):
    areas, det = many_regions(spark, 100_000), boxes(spark, 300)
    hits = regions.moving_region_hits(det, areas) if moving else regions.region_hits(det, areas, "each")
    assert "NestedLoop" not in plan(hits) and "Cartesian" not in plan(hits)
    a = {c: np.array([r[c] for r in areas.collect()], float) for c in ("region_id", "xmin", "ymin", "xmax", "ymax", "valid_from", "valid_to")}
    want = set()
    for r in det.collect():
        cx, cy = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2
        inside = (a["xmin"] < cx) & (cx < a["xmax"]) & (a["ymin"] < cy) & (cy < a["ymax"])
        if moving:
            inside &= (a["valid_from"] <= r["frame_no"]) & (np.isnan(a["valid_to"]) | (r["frame_no"] < a["valid_to"]))
        want |= {(r["det_idx"], int(i)) for i in a["region_id"][inside]}
    got = [(r["det_idx"], r["region_id"]) for r in hits.select("det_idx", "region_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_odd_regions(spark):
    rows = [(0, 5.0, 5.0, 1.0, 9.0, 0, 9), (1, None, 0.0, 9.0, 9.0, 0, 9), (2, 0.0, 0.0, 0.0, 0.0, 0, 9), (3, -1e9, -1e9, 1e9, 1e9, 0, None), (4, -64.0, -64.0, 0.0, 0.0, 0, 9), (5, -1e9, -1e9, 1e9, 1e9, 9, 9), (6, -32.0, -32.0, 32.0, 32.0, 3, 4)]
    areas = spark.createDataFrame(rows + [(10 + k, 500.0, 500.0, 501.0, 501.0, 0, 1) for k in range(grid.FEW + 1)], REGION)
    det = spark.createDataFrame([(0, 3, 0, 1, 0, 0.5, -1.0, -1.0, 1.0, 1.0), (0, 4, 1, 1, 0, 0.5, -1.0, -1.0, 1.0, 1.0), (0, 5, 2, 1, 0, 0.5, -33.0, -33.0, -31.0, -31.0), (0, 5, 3, 1, 0, 0.5, None, 0.0, 1.0, 1.0)], DET)
    hits = lambda df: sorted((r["det_idx"], r["region_id"]) for r in df.collect())
    assert hits(regions.region_hits(det, areas, "each")) == [(0, 3), (0, 5), (0, 6), (1, 3), (1, 5), (1, 6), (2, 3), (2, 4), (2, 5)]
    assert hits(regions.moving_region_hits(det, areas)) == [(0, 3), (0, 6), (1, 3), (2, 3), (2, 4)]
    assert hits(regions.region_hits(det, areas.limit(0), "each")) == []
    assert hits(regions.region_hits(det.limit(0), areas, "each")) == []


def test_numbering_without_a_single_partition(spark):
    names = [f"f{random.Random(k).randrange(10**6):06d}-{k}" for k in range(5000)]
    df = spark.createDataFrame([(n, k % 3) for k, n in enumerate(names)], "name string, kind int").repartition(7)
    got = numbered(df, "kind", F.desc("name"))
    rows = {(r["kind"], r["name"]): r["place"] for r in got.collect()}
    want = sorted(((k % 3, n) for k, n in enumerate(names)), key=lambda r: (r[0], [-ord(c) for c in r[1]]))
    assert [rows[w] for w in want] == list(range(1, 5001))
    assert numbered(df.limit(0), "name").count() == 0
    repeated = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert sorted(r["place"] for r in numbered(repeated, "name").collect()) == [1, 2, 3]
    files = spark.createDataFrame([("b.mp4",), ("a.jpg",), ("c.txt",), ("a.mp4",)], "path string")
    assert [(r["path"], r["place"]) for r in ingest.media_files(files).orderBy("place").collect()] == [("a.jpg", 1), ("a.mp4", 2), ("b.mp4", 3)]


def test_runs_hold_each_detection_once(spark):
    det = S.det(spark, SF)
    table = tracks.run_table(det).collect()
    assert sum(len(r["points"]) for r in table) == det.count()
    lengths = {r["det_idx"]: r["length"] for r in tracks.track_length(det).collect()}
    assert {p["det_idx"]: k + 1 for r in table for k, p in enumerate(r["points"])} == lengths


def test_segments_fold_apart(spark):
    """Where no track goes on the memory is empty, so the fold may begin anew."""
    rnd = random.Random(6)
    seen = [(f, (f // 10) * 100 + t) for f in range(200) for t in rnd.sample(range(14), 9)]
    seen += [(f, 5000 + f % 2) for f in range(200, 260)]  # two tracks that take turns
    det = spark.createDataFrame(rows_of(*seen), DET)
    cuts = tracks.segments(det)
    assert cuts.select("segment").distinct().count() == 20 + 60
    got = {r["det_idx"]: r["length"] for r in tracks.bounded_tracks(det, 8).collect()}
    assert got == folded(keys(det), 8)


def test_sums_do_not_list_the_hits(spark):
    """Hundreds of millions of hits of 40,000 boxes and 30,000 regions, and odd regions."""
    n, m = 40_000, 30_000
    det = spark.range(n).selectExpr("0L AS camera_id", "id AS frame_no", "id AS det_idx", "1L AS track_id", "id % 50 - 25.0D AS x1", "id % 7 - 1.0D AS y1", "id % 50 - 24.0D AS x2", "id % 7 + 0.0D AS y2")
    areas = spark.range(m).selectExpr("id AS region_id", "-30.0D - id % 9 AS xmin", "-2.0D AS ymin", "id % 60 - 29.5D AS xmax", "id % 8 - 0.5D AS ymax")
    odd = spark.createDataFrame([(-1, 5.0, 0.0, 1.0, 9.0), (-2, None, 0.0, 9.0, 9.0), (-3, 0.5, 0.5, 0.5, 0.5), (-4, -1e9, -1e9, 1e9, 1e9), (-5, 90.0, 0.0, 91.0, 1.0), (-4, -1e9, -1e9, 1e9, 1e9)], "region_id long, xmin double, ymin double, xmax double, ymax double")
    got = {r["region_id"]: (r["c"], r["ids"]) for r in regions.region_sums(det, areas.unionByName(odd), {"ids": F.col("det_idx")}).collect()}
    i = np.arange(n)
    x, y = i % 50 - 24.5, i % 7 - 0.5
    by = {(a, b): ((x < a - 29.5) & (y < b - 0.5)) for a in range(60) for b in range(8)}
    sums = {k: (int(v.sum()), int(i[v].sum())) for k, v in by.items()}
    want = {r: sums[r % 60, r % 8] for r in range(m) if sums[r % 60, r % 8][0]} | {-4: (2 * n, n * (n - 1))}
    assert got == want and sum(c for c, _ in want.values()) > 2e8
    assert regions.region_sums(det.limit(0), areas, {"ids": F.col("det_idx")}).count() == 0
    assert regions.region_sums(det, areas.limit(0), {"ids": F.col("det_idx")}).count() == 0
