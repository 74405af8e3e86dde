"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir in one folder for the application.

    Without that setting a local folder is used if all tasks run in this process, as in tests; elsewhere it is an
    error. The application's folder is deleted when the application ends; results must be written elsewhere by then.
    """
    context = spark.sparkContext
    base = getattr(context, "_lumen_shared", None)
    if base is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = root or f"file://{tempfile.mkdtemp(prefix='lumen-')}"
        base = context._lumen_shared = f"{root.rstrip('/')}/lumen-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{base}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder, so that later steps neither repeat nor lose it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write df as compressed Parquet in the shared folder and read it again; shuffle files of the write go at once."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumen_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stored tables, once all that was made of them has been stored or cut itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._lumen_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, however long the texts are: a setting of the session, the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of ids, or of ids and short lists, for a join: sent to every task if its counted rows allow."""
    return F.broadcast(small) if small.count() <= most else small


def free_name(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no column of that name is there."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def salted_join(left: DataFrame, small: DataFrame, key: str, spread: Column, rows: str, total: int | None = None, share: int = 1000) -> DataFrame:
    """left LEFT JOIN small on key, where one key may own a third of the rows of left.

    small has one row for each key and, in the column ``rows``, how many rows of left have it (about). ``total`` is the
    number of rows of left, which is counted if it isn't given. A key with over a thousandth of the rows is hot: its rows are dealt over salts by
    ``spread`` and its row of small is repeated for each. There are under a thousand hot keys, so their list is
    broadcast, and at most two thousand rows are added to small. The column ``rows`` isn't kept.
    """
    most = max(1, (left.count() if total is None else total) // share)
    sized = small.withColumn("_salts", F.ceil(F.col(rows) / most).cast("int")).drop(rows)
    hot = sized.where("_salts > 1").select(key, "_salts")
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
    a = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
    b = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return a.join(b, [key, "_salt"], "left").drop("_salt")
