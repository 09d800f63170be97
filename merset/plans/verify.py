"""Checks of a selection against its definition, each by either of two ways that share no code: near pairs, or the balls of the members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.operators.ball import balls
from merset.operators.conflict import conflicts, near_pairs


def dependent_pairs(mis: DataFrame, k: int, d: int, metric: str, by: str = "pairs") -> DataFrame:
    """a, b: members (enc, kmer) within d of each other; none if the set is independent. by: ``pairs`` or ``balls``, which flood and are for small d."""
    if by == "pairs":
        return conflicts(mis, k, d, metric)
    reached = balls(mis, k, d, metric).select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    return reached.join(mis.select(F.col("enc").alias("b")), "b", "left_semi").select("a", "b")


def uncovered(universe: DataFrame, mis: DataFrame, k: int, d: int, metric: str, by: str = "pairs") -> DataFrame:
    """Rows of ``universe`` (enc, kmer, all columns) further than d from all members; none if the set is maximal. A null kmer (with pairs) or enc (with balls) is near nothing, so it is uncovered."""
    if by == "pairs":
        near = near_pairs(universe.select("enc", "kmer"), mis.select("enc", "kmer"), k, d, metric).select("a.enc").unionByName(mis.select("enc")).distinct()
    else:
        near = balls(mis, k, d, metric).select(F.col("dst").alias("enc"))
    return universe.join(near, "enc", "left_anti")
