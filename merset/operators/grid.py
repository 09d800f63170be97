"""Candidate pairs by a range join on base counts: no distance is below the largest difference of two profiles.

Profiles lie in a grid of four dimensions with cells d + 1 wide. A k-mer looks
into the cells that the box of d around its profile touches, at most two or
three a dimension, and only into those that any k-mer's counts can fall into,
since they add up to k. What the bound rejects at the level of cells is never paired.

Middle cells hold most k-mers. So a cell of the right side is dealt into blocks
of BLOCK k-mers, and where there are fewer blocks than tasks, the left side is dealt over tasks too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import product
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.functions.kmers import lower_bound
from merset.session import built_once, partitions

#: k-mers of a block, about.
BLOCK = 1000
DIMENSIONS = ("da", "dc", "dg", "dt")


def _packed(parts: list) -> Column | int:
    """Four cell numbers, each up to 30, in one."""
    a, c, g, t = parts
    return ((a * 32 + c) * 32 + g) * 32 + t


@built_once
def cell(d: int) -> Column:
    """The cell of a row's profile."""
    return _packed([F.floor(F.col(x) / F.lit(d + 1)) for x in DIMENSIONS]).cast("int")


@built_once
def cells_in_reach(k: int, d: int) -> Column:
    """All cells that hold a profile within d of a row's, in every dimension, and can hold one at all."""
    w = d + 1
    spans = [F.sequence(F.floor(F.greatest(F.col(x) - d, F.lit(0)) / F.lit(w)), F.floor(F.least(F.col(x) + d, F.lit(k)) / F.lit(w))) for x in DIMENSIONS]
    first = F.transform(spans[0], lambda i: F.struct(i.alias("id"), (i * w).alias("least")))

    def with_next(span: Column) -> Callable[[Column], Column]:
        return lambda s: F.transform(span, lambda i: F.struct((s["id"] * 32 + i).alias("id"), (s["least"] + i * w).alias("least")))

    for span in spans[1:]:
        first = F.flatten(F.transform(first, with_next(span)))
    fits = F.filter(first, lambda s: (s["least"] <= 3 * k) & (s["least"] + 4 * d >= 3 * k))
    return F.transform(fits, lambda s: s["id"].cast("int"))


@lru_cache
def grid_rates(k: int, d: int) -> tuple[float, float]:
    """(cells that a k-mer looks into, share of pairs that meet in a cell), over uniform k-mers."""
    w, found, chance = d + 1, [], {}
    for a, c, g in product(range(k + 1), repeat=3):
        if a + c + g <= k:
            counts = (a, c, g, k - a - c - g)
            p = factorial(k) / 4**k
            for x in counts:
                p /= factorial(x)
            place = [k - x for x in counts]
            found.append((place, p))
            at = tuple(x // w for x in place)
            chance[at] = chance.get(at, 0) + p
    looks = meets = 0.0
    for place, p in found:
        for at in product(*[range(max(x - d, 0) // w, min(x + d, k) // w + 1) for x in place]):
            if at in chance:
                looks += p
                meets += p * chance[at]
    return looks, meets


def by_profile(left: DataFrame, right: DataFrame, k: int, d: int) -> DataFrame:
    """a, b (structs of each side's columns) of the pairs whose profiles (da, dc, dg, dt) differ by at most d in every dimension; a k-mer (enc) is not paired with itself."""
    spark, tasks = left.sparkSession, partitions(left.sparkSession)
    sizes = right.groupBy(cell(d).alias("cell")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))  # as many rows as there are cells, which k and d bound
    own = right.withColumn("cell", cell(d)).join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("enc"), F.col("blocks")).cast("int"))
    copies = F.greatest(F.lit(1), F.ceil(F.lit(tasks) / F.col("blocks"))).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = own.withColumn("part", upto(copies)).alias("b")
    looks = left.repartition(tasks, "enc").select("*", F.explode(cells_in_reach(k, d)).alias("cell")).join(F.broadcast(sizes), "cell")
    looks = looks.withColumn("part", F.pmod(F.xxhash64("enc"), copies).cast("int")).withColumn("block", upto(F.col("blocks"))).alias("a")
    met = looks.join(own, [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("cell", "block", "part")])
    side = lambda x, rows: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in rows.columns]).alias(x)
    return met.where((F.col("a.enc") != F.col("b.enc")) & (lower_bound("a", "b") <= d)).select(side("a", left), side("b", right))
