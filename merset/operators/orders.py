"""Total orders of a universe; every plan's result depends on the rank alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merset.session import cut, partitions

MULTIPLIER, OFFSET = 2654435761, 12345


def ranked(universe: DataFrame, k: int, order: str = "lex", seed: int = 0, pin_first: bool = False) -> DataFrame:
    """enc, kmer, rank.

    order: ``lex`` (alphabetical); ``affine`` (a seeded bijection of the code
    space, the same in any engine: an odd multiplier modulo a power of two,
    for k up to 15); ``random`` (a seeded hash; ties, which differ by code, are broken by
    it). pin_first: A...A comes before all others.
    """
    if order == "lex":
        rank = F.col("enc")
    elif order == "affine":
        if k > 15:
            raise ValueError("affine order is for k up to 15")
        rank = F.pmod(F.lit(MULTIPLIER + 2 * seed) * F.col("enc") + F.lit(OFFSET + seed), F.lit(4**k))
    elif order == "random":
        rank = F.xxhash64("enc", F.lit(seed))
    else:
        raise ValueError("order must be lex, affine or random")
    rank = F.struct(F.lit(0).alias("pin") if not pin_first else (F.col("enc") != 0).cast("int").alias("pin"), rank.cast("bigint").alias("at"), F.col("enc"))
    return universe.select("enc", "kmer", rank.alias("rank"))


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """``rows`` (with rank) and their place in the order, from 1, as ``name``.

    Rows are range-sorted and written; a place is the rows of lower ranges and the row's number in its
    own. So no task holds more than a range.
    """
    ranged = cut(rows.repartitionByRange(partitions(rows.sparkSession), "rank").withColumn("_range", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("rank"))
    return ranged.withColumn("_own", own).join(F.broadcast(before.select("_range", "_before")), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")  # a row a range
