"""Unit edits of k-mers as generated edges: nothing is stored, a frontier explodes into its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.functions.kmers import code_of, deletions, insertions, is_kmer, substitutions, vertex
from merset.session import built_once


def unit_neighbors(vid: Column, k: int, metric: str) -> Column:
    """An array of the vertices one edit away.

    Hamming: substitutions. Edit: a k-mer's substitutions and deletions, and a
    (k-1)-mer's insertions; between k-mers, paths through these are as short
    as through strings of any length.
    """
    enc = code_of(vid)
    swap = F.transform(substitutions(enc, k), lambda x: vertex(x))
    if metric == "hamming":
        return swap
    lose = F.transform(deletions(enc, k), lambda x: vertex(x, False))
    gain = F.transform(insertions(enc, k), lambda x: vertex(x))
    return F.when(is_kmer(vid), F.concat(swap, lose)).otherwise(gain)


@built_once
def vid_neighbors(k: int, metric: str) -> Column:
    """``unit_neighbors`` of the column vid."""
    return unit_neighbors(F.col("vid"), k, metric)


def unit_edges(vertices: DataFrame, k: int, metric: str) -> DataFrame:
    """src, dst for each vertex (vid) and unit edit of it."""
    return vertices.select(F.col("vid").alias("src"), F.explode(vid_neighbors(k, metric)).alias("dst"))
