"""Session, shared scratch folder and small helpers that every job uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []
_built: dict[tuple, tuple] = {}


def get_spark(cores: int | str = "*", app: str = "merset", **conf: str) -> SparkSession:
    """A local session with AQE on; on a cluster, pass your own session to the operators instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine (a local master, as in tests) a
    temporary folder is made and set for the session. On a cluster it must be
    set: a folder of one machine would lose what others write.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other run uses; ``clear_scratch`` removes it."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Removes what this process wrote below the shared folder (after the first ``since`` paths), and returns how many paths that were.

    DataFrames that were returned before may read these files: write what is
    to be kept first.
    """
    old = _made[since:]
    for path in old:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:]
    return len(old)


@contextmanager
def scratch_cleared(spark: SparkSession) -> Iterator[None]:
    """Removes what the block wrote below the shared folder when it ends, also by an error; what was there before stays."""
    since = len(_made)
    try:
        yield
    finally:
        clear_scratch(spark, since)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor, and keeps columns
    prunable; used where a result is read more than once.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the scan has fewer splits than the cluster has cores.

    Small inputs come as one split; Python stages over them would run on one
    core. Inputs with enough splits pass unchanged, without a shuffle; so do
    results of shuffles, whose partitions Spark has sized (and which asking for
    their number would compute).
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def built_once(f: Callable) -> Callable:
    """A function of plain arguments whose result, made of Columns, is kept: each node of an expression is a call to the JVM, and a loop would build it again in every round."""

    @wraps(f)
    def get(*args):
        jvm = SparkContext._gateway
        held = _built.get((f, args))
        if held is None or held[0] is not jvm:
            held = _built[f, args] = (jvm, f(*args))
        return held[1]

    return get
