"""How far the nearest of a growing set of members is: a kept table that new members only add to.

The table is a list of written parts (vid, dist), each a step of a flood. A
vertex has a further row where a later member is nearer, so its distance is the
least of its rows. Nothing that stands is written again, and a flood ends
where an earlier member is as near.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.operators.neighbors import vid_neighbors
from merset.session import cut

#: Parts that are read one by one before they become one.
MOST_PARTS = 40


def reach_within(parts: list[DataFrame], dist: int) -> DataFrame:
    """vid: the vertices within ``dist`` of a member; with repeats."""
    return reduce(DataFrame.unionByName, parts).where(F.col("dist") <= dist).select("vid")


def nearer(members: DataFrame, parts: list[DataFrame], k: int, d: int, metric: str) -> list[DataFrame]:
    """New parts (vid, dist): what is nearer to one of ``members`` (vid; a written table) than to all before, up to d steps; one part a step."""
    new = [members.select("vid", F.lit(0).alias("dist"))]
    for step in range(1, d + 1):
        ahead = new[-1].select(F.explode(vid_neighbors(k, metric)).alias("vid")).distinct()
        new.append(cut(ahead.join(reach_within([*parts, *new], step), "vid", "left_anti").select("vid", F.lit(step).alias("dist")), "reach"))
    return new


def compacted(parts: list[DataFrame], most: int = MOST_PARTS) -> list[DataFrame]:
    """The same table, in one part with a row a vertex if it has more than ``most``."""
    if len(parts) <= most:
        return parts
    return [cut(reduce(DataFrame.unionByName, parts).groupBy("vid").agg(F.min("dist").alias("dist")), "reach")]
