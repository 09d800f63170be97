"""Mixing sources to target weights, cut at exact budgets, without moving texts.

Sizes are counted once into a narrow table. Every document gets a hash-random
key; within each source the keys are ranges (buckets), whose sizes are summed
map-side, and a running sum over a source's buckets tells in which of them its
budget runs out. That bucket is cut into smaller ones the same way until it has
few rows; only these are sorted and summed row by row. All other documents are
wholly in or out of the last epoch. So no task holds a source, nor all rows of one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merset.session import cut

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits that each level of buckets has more than the last.
STEP = 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and place: a hash-random key of the id, then the size, then the row's number, as 64 hexadecimal digits.

    Places are all different, once written, so a prefix names a range of them of any
    smallness, also where a third of the rows have one id.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")).select("doc_id", "source", "size", F.concat("key", wide(F.col("size")), wide(F.col("row"))).alias("place"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes. A source stops at ``most`` times its size; what
    it leaves goes to the others by weight. In the order of cap over weight the
    sources that stop come first, so the level that the others reach is one
    running sum away: no rounds are needed. The windows here run over one row a
    source, not over documents.
    """
    one = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("all", F.sum("source_size").over(one)).withColumn("all_w", F.sum("w").over(one))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.lit(share) * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(one))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def cuts(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` with at and before: the prefix of the places where each source's last epoch ends, and the words of the places below it.

    Level by level, the buckets of the range found so far (STEP more digits)
    are summed map-side, and a running sum over at most 16 ** STEP of them finds
    the one with the cut, until it has up to ``most`` rows.
    """
    at = cut(plan.withColumns({"at": F.lit(""), "before": F.lit(0).cast("long")}), "mix-plan")
    for depth in range(STEP, 65, STEP):
        inside = rows.alias("r").join(at.where(F.col("at").isNotNull()).alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")) & F.col("r.place").startswith(F.col("a.at")))
        bucket = inside.groupBy("r.source", F.substring("place", 1, depth).alias("bucket"), "a.before", "a.rest").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = bucket.withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(running), F.lit(0))).where("before <= rest AND rest < before + sum")
        last = plan.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
        at = cut(last.select("p.*", F.col("f.bucket").alias("at"), F.col("f.before").alias("before"), "f.n"), "mix-plan")
        if (at.agg(F.max("n")).first()[0] or 0) <= most:
            break
        at = at.drop("n")
    return at


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, most_rows: int = 50_000) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: how many words of each document the mix takes.

    A source's budget is its target rounded to whole words. Whole epochs come
    first; the last one takes documents by hash-random key until the budget is
    met exactly, and the document at the cut gives only the words still missing.
    No document gives more than ``most`` times its size.

    docs: doc_id, text, source. A null source is a source of its own, the last.
    Null and empty texts have size 0 and give nothing. A null doc_id is keyed
    as an empty one. Repeated rows each count; ties of the key are ordered by
    size, and rows alike in key and size are interchangeable. An
    empty table gives an empty result. Other columns are not read.
    most_rows: rows that are summed one by one in a task, at most.
    """
    rows = cut(sized(docs), "mix-sizes")
    targets = source_targets(rows, weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - epochs * F.col("source_size")).cast("long"))
    at = cuts(rows, cut(plan, "mix-targets"), most_rows)
    joined = rows.alias("r").join(at.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source"))).select("r.*", "a.source_size", "a.target", "a.epochs", "a.rest", "a.at", "a.before")
    is_cut = F.col("place").startswith(F.col("at"))
    whole = joined.where(F.col("at").isNull() | ~is_cut).withColumn("last", F.when((F.col("rest") > 0) & (F.col("at").isNull() | (F.col("place") < F.col("at"))), F.col("size")).otherwise(F.lit(0)))
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(by_place), F.lit(0))
    partly = joined.where(is_cut).withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return whole.unionByName(partly).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).alias("taken"))
