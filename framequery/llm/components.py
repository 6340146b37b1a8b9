"""Connected components by contraction, for edge lists of any size.

Every round each vertex picks, by a hash that changes with the round, one
representative within two steps of it; edges move to the representatives
and loops and repeats vanish.  A star is done in one round, and each round
shrinks any graph by a constant factor in expectation, so the rounds grow with
the logarithm of the largest component.  Nothing is collected but whether edges
are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, root).

    Nodes of one component have the same root, which is one of them.  Links
    with a null end or equal ends are ignored; repeated links do no harm; an
    empty list gives an empty table.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, chosen, turn = settle(both.distinct(), "edges"), [], 0
    while not left.isEmpty():
        rank = lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("r"))
        nearest = left.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("r"))).alias("m"))
        nearest = nearest.select("a", F.least(own, F.col("m")).alias("m"))
        beyond = left.join(nearest.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = settle(beyond.select(F.col("a").alias("node"), F.least(own, F.col("m"))["r"].alias("root")), "roots")
        chosen.append(step)
        ra = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(ra, "a").join(rb, "b").where("ra <> rb")
        left = settle(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        turn += 1

    def follow(later: DataFrame, step: DataFrame) -> DataFrame:
        nxt = later.select(F.col("node").alias("root"), F.col("root").alias("last"))
        return step.join(nxt, "root", "left").select("node", F.coalesce("last", "root").alias("root"))

    if not chosen:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return settle(reduce(follow, reversed(chosen)), "components")
