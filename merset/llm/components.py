"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a group minimum and a join; no vertex's neighbours are ever
gathered in one row, so a hub with a third of all links is dealt out like any
skewed join. (Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.session import cut


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """vertex, root: the smallest vertex that each linked vertex reaches.

    links: u, v of any one orderable type; direction, repeats, nulls and loops
    don't matter (loops and nulls are left out). No links: no rows.
    """
    links = links.select("u", "v").where(F.col("u") != F.col("v"))
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _mark(links)) != before:
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("vertex"), F.col("v").alias("root")))
