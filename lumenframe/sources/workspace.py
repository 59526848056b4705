"""Names of folders that the driver and all executors can reach."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which a cluster must set; in local mode the warehouse stands in."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_workspace"
    return f"{where.rstrip('/')}/lumenframe/{label}-{uuid.uuid4().hex}"


_kept: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Deletes all tables that ``keep`` wrote. Results that were not yet written must not be used afterwards."""
    for path in list(_kept):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)
    _kept.clear()


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` gave, once nothing that still has to run reads them."""
    for df in tables:
        _delete(df.kept_at)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written; otherwise they stay until the driver collects garbage, which may be never."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def readable(df: DataFrame) -> str:
    """The folder of a table that ``keep`` gave, as executors may open it."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor re-reads files, and the planner knows the size. It goes with ``drop`` or ``clear``, at the latest when the driver ends."""
    path = fresh(df.sparkSession, label)
    if not _kept:
        atexit.register(clear)
    _kept[path] = df.sparkSession
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out
