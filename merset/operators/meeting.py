"""Pairs within distance d by meeting in the middle: one side walks half of the unit edits, the other side the rest.

A distance is the length of a shortest path through unit edits, so two k-mers
within d have a vertex on it that one reaches in ceil(d / 2) steps and the other
in floor(d / 2). The sides are joined on that vertex, and the least sum of the
two walks is the distance itself: nothing is compared, and no pair beyond d is
ever formed. A side's rows are as many as a ball of half the radius has
vertices, about the square root of a whole ball.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.functions.kmers import vertex
from merset.operators.neighbors import vid_neighbors
from merset.session import partitions


def flood(rows: DataFrame, k: int, steps: int, metric: str) -> DataFrame:
    """enc, vid, dist: the vertices within ``steps`` unit edits of each enc, itself included, and how many it takes.

    Rows are dealt by enc once; every step then stays in its task, and repeats
    are combined there without a shuffle. A null enc reaches nothing; repeated
    ones count once.
    """
    reached = rows.where(F.col("enc").isNotNull()).select("enc").repartition(partitions(rows.sparkSession), "enc")
    reached = reached.select("enc", vertex(F.col("enc")).alias("vid"), F.lit(0).alias("dist")).dropDuplicates(["enc", "vid"])
    for step in range(1, steps + 1):
        here = F.array(F.struct("vid", "dist"))
        ahead = F.transform(vid_neighbors(k, metric), lambda v: F.struct(v.alias("vid"), F.lit(step).alias("dist")))
        walked = reached.select("enc", F.explode(F.when(F.col("dist") == step - 1, F.concat(here, ahead)).otherwise(here)).alias("to"))
        reached = walked.select("enc", "to.vid", "to.dist").groupBy("enc", "vid").agg(F.min("dist").alias("dist"))
    return reached


def halves(d: int) -> tuple[int, int]:
    """Steps of either side."""
    return (d + 1) // 2, d // 2


def meeting(left: DataFrame, right: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """a, b (enc of either side), dist of all pairs within d; a k-mer doesn't meet itself. Left walks the longer half."""
    up, down = halves(d)
    a = flood(left, k, up, metric).select(F.col("enc").alias("a"), "vid", F.col("dist").alias("walked"))
    b = flood(right, k, down, metric).select(F.col("enc").alias("b"), "vid", F.col("dist").alias("rest"))
    met = a.join(b, "vid").where("a <> b")
    return met.groupBy("a", "b").agg(F.min(F.col("walked") + F.col("rest")).alias("dist"))


def ball_size(k: int, steps: int, metric: str) -> int:
    """Vertices within ``steps`` unit edits of a k-mer, about."""
    swapped = sum(comb(k, i) * 3**i for i in range(steps + 1))
    if metric == "hamming":
        return swapped
    shorter = lambda s: sum(comb(k - 1, i) * 3**i for i in range(s + 1)) * (3 * k + 1) // 4 if s >= 0 else 0
    moved, s = 0, steps - 2
    while s >= 0:  # a deletion and an insertion, and substitutions with what is left
        moved += sum(comb(k, i) * 3**i for i in range(s + 1)) * k * k
        s -= 2
    return swapped + shorter(steps - 1) + moved
