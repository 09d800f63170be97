"""``python -m merset.plans.cli -k 4 -d 2``: selects, lists the members, tells size and cost.

Under ``spark-submit`` the session that it gives is used, otherwise one on all cores of this machine.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from merset.plans.methods import METHODS, METRICS, ORDERS, find_mis
from merset.plans.report import measured, stages_measured
from merset.plans.sink import HEADER, SIZE, write_listing
from merset.session import cut, get_spark, scratch_cleared


def session() -> SparkSession:
    """The session of this thread, or of spark-submit; else a local one."""
    if active := SparkSession.getActiveSession():
        return active
    return SparkSession.builder.getOrCreate() if "PYSPARK_GATEWAY_PORT" in os.environ else get_spark()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description="Select k-mers that are pairwise more than d apart, as many as greedily fit.")
    p.add_argument("-k", type=int, required=True, help="length, 2 to 30")
    p.add_argument("-d", type=int, required=True, help="distance, 1 to k - 1")
    p.add_argument("--metric", choices=METRICS, default="edit")
    p.add_argument("--method", choices=METHODS, default="improved")
    p.add_argument("--order", choices=ORDERS, default="lex")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--out", help="write the members there as Parquet instead of listing them")
    p.add_argument("--listing", help="write the members there as text files in order of selection instead of listing them")
    p.add_argument("--stages", help="write what each stage took there as Parquet")
    a = p.parse_args(argv)
    spark = spark or session()
    report, stages = [], []
    with scratch_cleared(spark):
        with measured(spark, report), stages_measured(spark, stages):
            mis = cut(find_mis(spark, a.k, a.d, a.metric, a.method, a.order, a.seed), "mis")
            n = mis.count()
        if a.out:
            mis.write.parquet(a.out)
        if a.listing:
            write_listing(mis, a.listing)
        if a.stages:
            stages[0].write.parquet(a.stages)
        if not a.out and not a.listing:
            print(HEADER, file=sys.stderr)
            for row in mis.orderBy("sel_idx").toLocalIterator():
                print(row["kmer"], file=sys.stderr)
    print(SIZE.format(n), file=sys.stderr)
    for row in report[0].collect():
        print(f"{row['process']}, {row['metric']}: {row['value']:.2f} {row['unit']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
