"""Exact greedy selection in parallel rounds.

Sequential greedy takes a vertex iff no earlier neighbour was taken. For one
total order that is what rounds compute: a vertex without undecided earlier
neighbours is a root, its later neighbours are covered. (Blelloch, Fineman and
Shun, Greedy Sequential Maximal Independent Set and Matching are Parallel on
Average, 2012.)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.session import cut

#: State rows that are left when one task walks them in order, instead of further rounds, each of several small jobs.
FEW = 8_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) in the order of b, to the b that have no taken a before them."""
    taken: set[int] = set()
    now, free = None, False
    for batch in batches:
        out = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now:
                if free:
                    taken.add(now)
                    out.append(now)
                now, free = b, True
            free = free and a not in taken
        yield pa.record_batch({"enc": pa.array(out, pa.int64())})
    yield pa.record_batch({"enc": pa.array([now] if free else [], pa.int64())})


def _told(state: DataFrame, told: list[int] | None) -> int:
    n = state.count()
    if told is not None:
        told.append(n)
    return n


def greedy_roots(vertices: DataFrame, conflicts: DataFrame, told: list[int] | None = None) -> DataFrame:
    """enc of the selected vertices (enc, rank); conflicts: a, b in both directions, or with b's rank, then from the earlier to the later only, each once. told: gets the rows of the state at the start of each round.

    The state is one table: (v, v) for each undecided vertex, and (a, b) for
    each conflict of an earlier with a later one. Vertices that only their own
    row reaches are roots; what roots reach is covered; rows of either leave.
    A round is one job, which writes what is left and the round's roots. Once
    up to FEW rows are left, one task walks them in order.
    """
    of = vertices.select("enc", "rank")
    edges = conflicts
    if "rank" not in conflicts.columns:
        edges = (
            conflicts.join(of.select(F.col("enc").alias("a"), F.col("rank").alias("ra")), "a")
            .join(of.select(F.col("enc").alias("b"), F.col("rank").alias("rank")), "b")
            .where("ra < rank").select("a", "b", "rank").distinct()
        )
    state = cut(vertices.select(F.col("enc").alias("a"), F.col("enc").alias("b"), "rank").unionByName(edges), "mis-state")
    found: list[DataFrame] = []
    while (left := _told(state, told)) > FEW:
        roots = state.groupBy("b").agg(F.bool_and(F.col("a") == F.col("b")).alias("root")).where("root").select(F.col("b").alias("a"))
        decided = state.join(roots, "a", "left_semi").select(F.col("b").alias("enc")).distinct()
        open_ = state.join(decided.select(F.col("enc").alias("b")), "b", "left_anti").join(decided.select(F.col("enc").alias("a")), "a", "left_anti")
        both = cut(open_.select("a", "b", "rank", F.lit(False).alias("root")).unionByName(roots.select("a", F.col("a").alias("b"), F.lit(None).cast(state.schema["rank"].dataType).alias("rank"), F.lit(True).alias("root"))), "mis-state")
        found.append(both.where("root").select(F.col("a").alias("enc")))
        state = both.where("not root").select("a", "b", "rank")
    if left:
        found.append(state.repartition(1).sortWithinPartitions("rank").select("a", "b").mapInArrow(_walk, "enc long"))
    return reduce(DataFrame.unionByName, found) if found else vertices.select("enc")
