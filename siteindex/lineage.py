"""Written tables in the folder that driver and executors share: lineage ends there, and work on them is done once."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent and master is local (tests, a laptop) one temporary
    folder is used for the whole session; on a cluster the setting is required, since
    executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = getattr(spark, "_siteindex_folder", None) or tempfile.mkdtemp(prefix="siteindex-")
        spark._siteindex_folder = folder
    return folder.rstrip("/")


def _tables_of(spark: SparkSession) -> str:
    """Folder of this session's written tables."""
    return f"{shared_folder(spark)}/siteindex/{spark.sparkContext.applicationId}"


#: Setting with which Spark deletes the shuffle files of an action when the action ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; with ``drop_shuffles`` the shuffle files of the write are deleted at its end."""
    spark = df.sparkSession
    path = f"{_tables_of(spark)}/{uuid.uuid4().hex}"
    for held in getattr(spark, "_siteindex_scopes", [])[-1:]:
        held.append(path)
    was = spark.conf.get(DROP_SHUFFLES, None)
    if drop_shuffles:
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(DROP_SHUFFLES) if was is None else spark.conf.set(DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a written table; the tables that were written on the way to it are deleted."""
    scopes = spark._siteindex_scopes = getattr(spark, "_siteindex_scopes", [])
    scopes.append([])
    try:
        result = make()
    except BaseException:
        _delete(spark, scopes.pop())
        raise
    made = scopes.pop()
    try:
        return written(result)
    finally:
        _delete(spark, made)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of work that is done.

    Spark keeps them as long as an object in the driver refers to them, and a driver with
    memory to spare seldom collects its garbage; between the steps of a long loop they
    would add up on the executors' disks. What Python let go of in the last second may stay
    until the next call; ``written`` can drop the large ones at once.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard_written(spark: SparkSession) -> None:
    """Deletes every table this session has written; results that were not read yet are lost with them."""
    _delete(spark, [_tables_of(spark)])
