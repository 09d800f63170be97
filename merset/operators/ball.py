"""Balls: all vertices within d unit edits of each source, by d equal steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.functions.kmers import code_of, decode, is_kmer, vertex
from merset.operators.neighbors import vid_neighbors


def balls(sources: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """src, dst, dist for the k-mers within d of each source (enc), itself included.

    Each step explodes the frontier and keeps the least distance of a pair: a
    minimum is combined in each task before its one shuffle, keyed like the
    step before it.
    """
    reached = sources.select(F.col("enc").alias("src"), vertex(F.col("enc")).alias("vid"), F.lit(0).alias("dist"))
    for step in range(1, d + 1):
        ahead = reached.where(F.col("dist") == step - 1).select("src", F.explode(vid_neighbors(k, metric)).alias("vid"), F.lit(step).alias("dist"))
        reached = reached.unionByName(ahead).groupBy("src", "vid").agg(F.min("dist").alias("dist"))
    return reached.where(is_kmer(F.col("vid"))).select("src", code_of(F.col("vid")).alias("dst"), "dist")


def named_balls(sources: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """As ``balls``, spelled out: src_kmer, dst_kmer, dist."""
    return balls(sources, k, d, metric).select(decode(F.col("src"), k).alias("src_kmer"), decode(F.col("dst"), k).alias("dst_kmer"), "dist")
