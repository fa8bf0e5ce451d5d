"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint directory, memory) come from the
cluster. ``get_spark`` only fills in what is unset, which is what tests and
``bench.py`` need on one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job in this package relies on; applied only where the session
# does not already carry a value.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "scriptorium",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs every executor thread inside the driver JVM.
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system and is used as given.
    Only when it is unset (a local test session) is a private folder created.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


_CREATED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for an intermediate table.

    Unique across drivers sharing the folder (random UUID), never reused.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _CREATED.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this driver process wrote; returns how many.

    Call it once the DataFrames built on them have been consumed: anything
    still reading them would fail. Other drivers' tables are never touched.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _CREATED:
        jpath = jvm.org.apache.hadoop.fs.Path(_CREATED.pop())
        fs = jpath.getFileSystem(conf)
        if fs.exists(jpath) and fs.delete(jpath, True):
            dropped += 1
    return dropped


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing),
    and later scans keep column pruning and file statistics. The shuffle files of the
    job go when it has ended: nothing reads them any more.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs written in this block leave no shuffle files, instead of until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    prior = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if prior is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, prior)


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20


def small_batches(df):
    """``df``; rows go to Python in Arrow batches of at most ``BATCH_BYTES`` from now on.

    Rows stay whole; the session's own smaller bound is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(1 << 30)) or 0) > BATCH_BYTES or int(conf.get(name, "-1")) <= 0:
        conf.set(name, str(BATCH_BYTES))
    return df


#: A stored table that measures at most this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_within(stored, row_bytes, limit_bytes: int = BROADCAST_BYTES):
    """A broadcast hint for a stored table whose rows add up to ``limit_bytes`` at most, else the table.

    ``row_bytes`` is a column that estimates one row; both plans give the same rows.
    """
    total = stored.agg(F.sum(row_bytes.cast("long"))).first()[0]
    return F.broadcast(stored) if (total or 0) <= limit_bytes else stored
