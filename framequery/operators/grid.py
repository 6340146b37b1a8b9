"""Points in many rectangles, by an equi-join on grid cells.

Every rectangle is entered into the cells of a grid as coarse as itself, so in four
at most, and where it holds for a stretch of frames only, into the two buckets of
frames that are as long as the stretch.  Every point looks into its own cell of each
coarseness that occurs.  Who meets there is tested exactly.

Where only counts and sums are asked for, ``sums_inside`` takes them from running sums
below and left of the corners, so that its work does not grow with the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequery.operators.numbering import running_sums
from framequery.streaming.shared import written

#: Sides of the finest cells, frames of the shortest buckets.
CELL = 32.0
BUCKET = 32
#: Up to so many rectangles each point is compared with all.
FEW = 64


def _coarseness(size: Column, finest: float) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(finest)) / finest)), F.lit(0)).cast("int")


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def points_inside(points: DataFrame, x: Column, y: Column, rectangles: DataFrame, exact: Column, frame: Column | None = None) -> DataFrame:
    """The join of ``points`` with the ``rectangles`` (xmin, ymin, xmax, ymax) that
    ``exact`` finds to hold them; ``exact`` must imply that (x, y) lies in the
    closed rectangle and, with ``frame``, in [valid_from, valid_to), where a null is
    open.  Rectangles without a side have no points.
    """
    known = rectangles.where("xmin <= xmax and ymin <= ymax")
    if known.limit(FEW + 1).count() <= FEW:
        return points.join(F.broadcast(known), exact)
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).cast("double")
    coarse = known.withColumn("_level", _coarseness(side, CELL))
    if frame is None:
        coarse = coarse.withColumn("_span", F.lit(-1))
    else:
        closed = F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull()
        coarse = coarse.withColumn("_span", F.when(closed, _coarseness((F.col("valid_to") - F.col("valid_from")).cast("double"), BUCKET)).otherwise(F.lit(-1)))
        coarse = coarse.where(~closed | (F.col("valid_from") < F.col("valid_to")))
    size, length = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level")), F.lit(float(BUCKET)) * F.pow(F.lit(2.0), F.greatest(F.col("_span"), F.lit(0)))
    levels = [(r["_level"], r["_span"]) for r in coarse.select("_level", "_span").distinct().collect()]  # few: logarithms of sizes
    if not levels:
        return points.join(F.broadcast(known.limit(0)), exact)
    entered = coarse.withColumn("_gx", F.explode(_cells(F.col("xmin"), F.col("xmax"), size))).withColumn("_gy", F.explode(_cells(F.col("ymin"), F.col("ymax"), size)))
    times = F.array(F.lit(0).cast("long"))
    if frame is not None:
        times = F.when(F.col("_span") < 0, times).otherwise(_cells(F.col("valid_from"), F.col("valid_to") - 1, length))
    entered = entered.withColumn("_gt", F.explode(times))
    level = F.explode(F.array(*[F.struct(F.lit(a).alias("_level"), F.lit(b).alias("_span")) for a, b in levels]))
    looking = points.withColumn("_at", level).withColumns({"_level": F.col("_at._level"), "_span": F.col("_at._span")}).drop("_at")
    at = F.lit(0).cast("long") if frame is None else F.when(F.col("_span") < 0, 0).otherwise(F.floor(frame / length)).cast("long")
    looking = looking.withColumns({"_gx": F.floor(x / size).cast("long"), "_gy": F.floor(y / size).cast("long"), "_gt": at})
    keys = ["_level", "_span", "_gx", "_gy", "_gt"]
    return looking.join(entered, keys).where(exact).drop(*keys)


def sums_inside(points: DataFrame, x: Column, y: Column, rectangles: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """The distinct (xmin, ymin, xmax, ymax) of ``rectangles`` that hold any point
    strictly inside, with ``c``, their points, and the ``sums`` over them: whole
    numbers, nulls as 0, since they are differences of running sums.

    Points of one place are added up first.  The places in order of x are cut into
    stretches of 1, 2, 4, ... of them; what lies left of a bound is at most one stretch
    of each length, and in each a running sum by y holds what lies below.  A rectangle
    is right top - left top - right bottom + left bottom.
    """
    names = ["c", *sums]
    total = lambda: [F.sum(n).alias(n) for n in names]
    at = points.select(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1).cast("long").alias("c"), *[F.coalesce(v, F.lit(0)).cast("long").alias(n) for n, v in sums.items()])
    at = written(at.dropna(subset=["x", "y"]).groupBy("x", "y").agg(*total()), "places")
    corners = ["xmin", "ymin", "xmax", "ymax"]
    sides = rectangles.where("xmin < xmax and ymin < ymax").select(*[F.col(c).cast("double").alias(c) for c in corners])
    sides = written(sides.distinct(), "rectangles")

    # rank: places of x below a bound; ``side`` 0 is before equal values, 1 a point, 2 after them
    value = lambda df, c, side, one: df.select(F.col(c).alias("v"), F.lit(side).alias("side"), F.lit(one).cast("long").alias("rank")).distinct()
    values = value(at, "x", 1, 1).unionByName(value(sides, "xmin", 2, 0)).unionByName(value(sides, "xmax", 0, 0))
    ranks = written(running_sums(values, [], ["v", "side"], ["rank"]), "ranks")
    levels = range(int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length())
    rank = lambda c, side, name: ranks.where(F.col("side") == side).select(F.col("v").alias(c), F.col("rank").alias(name))
    stretch = lambda number, kept: F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(number, i).alias("node")) for i in levels]), kept))
    keys = ["level", "node", "y", "side"]
    if not levels:
        return sides.limit(0).select(*corners, *[F.lit(0).cast("long").alias(n) for n in names])

    placed = at.join(rank("x", 1, "rank"), "x").withColumn("_at", stretch(F.col("rank") - 1, lambda s: s["node"] % 2 == 0))
    placed = placed.select("_at.level", "_at.node", "y", F.lit(1).alias("side"), *names)
    bounded = written(sides.join(rank("xmin", 2, "left"), "xmin").join(rank("xmax", 0, "right"), "xmax").where("left < right"), "bounded")
    ends = F.array(*[F.struct(F.col(r).alias("rank"), F.col(c).alias("y"), F.lit(side).alias("side"), F.lit(sign).alias("sign")) for r, c, side, sign in (("right", "ymax", 0, 1), ("left", "ymax", 0, -1), ("right", "ymin", 2, -1), ("left", "ymin", 2, 1))])  # noqa: E501
    asked = bounded.select(*corners, F.inline(ends)).where("rank > 0")
    parts = asked.select("rank", "y", "side").distinct().withColumn("_at", stretch(F.col("rank"), lambda s: s["node"] % 2 == 1))
    parts = written(parts.select("rank", "_at.level", (F.col("_at.node") - 1).alias("node"), "y", "side"), "parts")
    wanted = parts.select(*keys).distinct().select(*keys, *[F.lit(0).cast("long").alias(n) for n in names])
    below = running_sums(placed.unionByName(wanted), ["level", "node"], ["y", "side"], names).where("side <> 1")
    corner = parts.join(below, keys).groupBy("rank", "y", "side").agg(*total())
    found = asked.join(corner, ["rank", "y", "side"]).groupBy(*corners).agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in names])
    return found.where("c > 0")
