"""Universes of k-mers: all of them, or those that a table's text has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.functions.kmers import check_domain, decode, encode
from merset.session import spread

SEGMENT = 1024


def full_universe(spark: SparkSession, k: int) -> DataFrame:
    """enc, kmer for all 4^k k-mers; lazy."""
    check_domain(k)
    return spark.range(4**k).select(F.col("id").alias("enc"), decode(F.col("id"), k).alias("kmer"))


def kmer_counts(table: DataFrame, k: int, text: str = "text") -> DataFrame:
    """kmer, n: how often each k-mer occurs in the A, C, G and T letters (either case) of a text column.

    Other letters are left out first. Texts are cut into overlapping segments
    before windows are taken, as bytes, where a piece is found without counting
    letters up to it: a long text costs its length, not its square. Counts are summed in each task before the shuffle, which moves at most 4^k
    rows a task. Null and short texts give nothing.
    """
    check_domain(k)
    letters = spread(table.select(text)).select(F.upper(F.regexp_replace(text, "[^ACGTacgt]+", "")).cast("binary").alias("s")).where(F.length("s") >= k)
    starts = F.sequence(F.lit(0), F.floor((F.length("s") - k) / SEGMENT).cast("int"))
    segments = letters.select(F.explode(F.transform(starts, lambda i: F.substring(F.col("s"), i * SEGMENT + 1, F.lit(SEGMENT + k - 1)))).alias("s"))
    windows = segments.select("s", F.explode(F.sequence(F.lit(1), F.length("s") - (k - 1))).alias("i"))
    counts = windows.select(F.substring("s", F.col("i"), F.lit(k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return counts.select(F.col("kmer").cast("string").alias("kmer"), "n")


def kmers_of(table: DataFrame, k: int, text: str = "text", min_count: int = 1) -> DataFrame:
    """enc, kmer: the k-mers that occur at least ``min_count`` times."""
    return kmer_counts(table, k, text).where(F.col("n") >= min_count).select(encode(F.col("kmer")).alias("enc"), "kmer")
