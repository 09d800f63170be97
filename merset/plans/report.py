"""Size of a selection, and what finding it took."""

from __future__ import annotations

import os
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def size(mis: DataFrame) -> DataFrame:
    """mis_size: one row."""
    return mis.agg(F.count("*").alias("mis_size"))


@contextmanager
def measured(spark: SparkSession, out: list[DataFrame]):
    """Appends to ``out`` a DataFrame (process, metric, value, unit) of what the block took.

    For the driver's Python and its JVM (on a local master also the executor):
    seconds in user and kernel mode, and peak virtual and resident memory so
    far. For all executors together: seconds of tasks and of garbage collection.
    """
    processes = {"python": os.getpid(), "jvm": spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()}
    wall, use, work = time.time(), {p: _cpu(pid) for p, pid in processes.items()}, _executors(spark)
    yield
    rows = [("all", "wall time", time.time() - wall, "s")]
    for p, pid in processes.items():
        user, kernel = (b - a for a, b in zip(use[p], _cpu(pid), strict=True))
        rows += [(p, "time in user mode", user, "s"), (p, "time in kernel mode", kernel, "s")]
        rows += [(p, name, value, "kB") for name, value in _peaks(pid).items()]
    rows += [("executors", name, b - a, "s") for name, a, b in zip(("task time", "garbage collection"), work, _executors(spark), strict=True)]
    out.append(spark.createDataFrame(rows, "process string, metric string, value double, unit string"))


def _cpu(pid: int) -> tuple[float, float]:
    """Seconds in user and kernel mode that a process has used."""
    with open(f"/proc/{pid}/stat") as f:
        after_name = f.read().rpartition(")")[2].split()
    tick = os.sysconf("SC_CLK_TCK")
    return int(after_name[11]) / tick, int(after_name[12]) / tick


def _peaks(pid: int) -> dict[str, float]:
    """Peak virtual and resident memory of a process in kB."""
    with open(f"/proc/{pid}/status") as f:
        told = dict(line.split(":", 1) for line in f)
    return {"peak virtual memory size": float(told["VmPeak"].split()[0]), "peak resident set size": float(told["VmHWM"].split()[0])}


def _executors(spark: SparkSession) -> tuple[float, float]:
    """Seconds that all executors, also lost ones, have spent in tasks and in garbage collection."""
    rows = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    each = [rows.apply(i) for i in range(rows.size())]
    return sum(e.totalDuration() for e in each) / 1000, sum(e.totalGCTime() for e in each) / 1000


#: A stage's row: stage and its last attempt, its name, tasks that ended, seconds of tasks (run, CPU, garbage collection), and bytes (largest peak of a task's execution memory, spills, shuffles, files).
STAGE = "stage int, attempt int, name string, tasks int, failed_tasks int, run_s double, cpu_s double, gc_s double, peak_memory bigint, memory_spilled bigint, disk_spilled bigint, shuffle_read bigint, shuffle_written bigint, rows_read bigint, bytes_read bigint, bytes_written bigint"


@contextmanager
def stages_measured(spark: SparkSession, out: list[DataFrame]):
    """Appends to ``out`` a DataFrame with a row for each stage that the block's jobs ran, on whichever executors.

    The jobs are told apart by a job group, so what other threads run at the
    same time is left out; the caller's own group is set again at the end. Spark keeps
    ``spark.ui.retainedStages`` stages (1,000 if unset): those of longer blocks are
    missing from the front. A stage that was skipped, as its shuffle was there already, has no row.
    """
    context, group = spark.sparkContext, uuid.uuid4().hex
    names = ("spark.jobGroup.id", "spark.job.description")
    before = [context.getLocalProperty(x) for x in names]
    context.setJobGroup(group, "measured")
    try:
        yield
    finally:
        for x, value in zip(names, before, strict=True):
            context.setLocalProperty(x, value)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    out.append(spark.createDataFrame(_stages(spark, group), STAGE))


def _stages(spark: SparkSession, group: str) -> list[tuple]:
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = store.jobsList(None)
    wanted = set()
    for job in (jobs.apply(i) for i in range(jobs.size())):
        if job.jobGroup().isDefined() and job.jobGroup().get() == group:
            ids = job.stageIds()
            wanted |= {ids.apply(i) for i in range(ids.size())}
    rows = []
    for stage in sorted(wanted):
        try:
            s = store.lastStageAttempt(stage)
        except Py4JJavaError:  # no longer kept
            continue
        if s.status().toString() != "SKIPPED":
            seconds = (s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.jvmGcTime() / 1e3)
            sizes = (s.peakExecutionMemory(), s.memoryBytesSpilled(), s.diskBytesSpilled(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.inputRecords(), s.inputBytes(), s.outputBytes())
            rows.append((s.stageId(), s.attemptId(), s.name(), s.numCompleteTasks(), s.numFailedTasks(), *seconds, *sizes))
    return rows
