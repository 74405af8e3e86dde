"""Incremental runs (S2 with S11): result tables whose finished keys are committed with them.

Rows of a run are written to a folder of their own, which nobody reads yet. The run is finished when its commit, a small
table of the keys it worked on, is renamed into the log of commits under the next free number: one step that happens or
doesn't. A job lost before it leaves rows that are never read, and its keys are still to be done; a job that is repeated
after it finds nothing to do. If two jobs did the same keys at once, the commit with the lower number counts for these.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT, _RUN = "_commit", "_run"


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder in one step; False, and the old one deleted, if the new name is taken."""
    source, store = _store(spark, old)
    target, _ = _store(spark, new)
    source, target = store.makeQualified(source), store.makeQualified(target)
    store.mkdirs(target.getParent())
    context, hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
    never_over = context._gateway.new_array(hadoop.Options.Rename, 1)
    never_over[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, never_over)
    except Py4JJavaError:
        if not store.exists(target):
            raise
        store.delete(source, True)
        return False
    return True


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, store = _store(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def commits(spark: SparkSession, folder: str) -> list[str]:
    """Numbers of the commits, in order; one for each finished run."""
    return [n for n in _names(spark, f"{folder}/commits") if n.isdigit()]


def finished(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """keys, _commit and _run of every finished key; the lowest commit of a key counts. None before the first commit."""
    names = commits(spark, folder)
    if not names:
        return None
    log = spark.read.parquet(*[f"{folder}/commits/{n}" for n in names])
    first = F.min(F.struct(_COMMIT, _RUN)).alias("_first")
    return log.groupBy(*keys).agg(first).select(*keys, f"_first.{_COMMIT}", f"_first.{_RUN}")


def pending(work: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The distinct keys of work that no commit holds. Nulls in keys equal each other."""
    done, wanted = finished(work.sparkSession, folder, keys), work.select(*keys).distinct()
    if done is None:
        return wanted
    match = F.lit(True)
    for k in keys:
        match = match & wanted[k].eqNullSafe(done[k])
    return wanted.join(done, match, "left_anti")


def write(rows: DataFrame, folder: str) -> str:
    """Write a run's rows where nobody reads them yet; the run's name."""
    run = f"r{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/runs/{_RUN}={run}")
    return run


def commit(work: DataFrame, folder: str, run: str, keys: list[str]) -> int:
    """Finish a run: all keys of work, also those that gave no row. The number of the commit."""
    spark = work.sparkSession
    names = commits(spark, folder)
    number = int(names[-1]) + 1 if names else 1
    while True:
        staged = f"{folder}/staged/{uuid.uuid4().hex}"
        work.select(*keys).distinct().withColumns({_COMMIT: F.lit(number).cast("long"), _RUN: F.lit(run)}).write.parquet(staged)
        if _renamed(spark, staged, f"{folder}/commits/{number:012d}"):
            return number
        number += 1


def run_pending(work: DataFrame, folder: str, keys: list[str], job) -> int | None:
    """job(keys to do) -> rows, which hold the keys; written and committed. None if there is nothing to do."""
    todo = pending(work, folder, keys)
    # The keys as they are now: a job that commits meanwhile must not change them.
    staged = f"{folder}/staged/{uuid.uuid4().hex}"
    todo.write.parquet(staged)
    todo = work.sparkSession.read.schema(todo.schema).parquet(staged)
    if not todo.limit(1).count():
        return None
    return commit(todo, folder, write(job(todo), folder), keys)


def read(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The rows of all commits, of each key those of the run that counts. None before the first commit."""
    done = finished(spark, folder, keys)
    if done is None:
        return None
    # The run is a partition column; folders of runs that don't count are pruned by the join.
    rows = spark.read.parquet(f"{folder}/runs")
    match = rows[_RUN] == done[_RUN]
    for k in keys:
        match = match & rows[k].eqNullSafe(done[k])
    return rows.join(done, match, "left_semi").drop(_RUN)


def clean(spark: SparkSession, folder: str) -> int:
    """Delete rows of runs that never were committed; to be called while no job runs. How many there were."""
    log = [f"{folder}/commits/{n}" for n in commits(spark, folder)]
    done = {r[0] for r in spark.read.parquet(*log).select(_RUN).distinct().collect()} if log else set()
    lost = [f"{folder}/runs/{n}" for n in _names(spark, f"{folder}/runs") if n.removeprefix(f"{_RUN}=") not in done]
    for name in [*lost, f"{folder}/staged"]:
        path, store = _store(spark, name)
        store.delete(path, True)
    return len(lost)
