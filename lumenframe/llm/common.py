"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to a worker, at most (a single row may be longer).
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` names it on a cluster, and must. Only in local mode, where it may be unset (tests,
    notebooks), a folder under the warehouse is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_workspace"
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name; what is written there goes with ``clear_workspace``, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear_workspace)
    _written[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_workspace() -> None:
    """Deletes all intermediate tables of this driver. Results that were not yet written must not be used afterwards."""
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)
    _written.clear()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave, once nothing that still has to run reads them."""
    discard_path(*(df.written_at for df in tables))


def discard_path(*paths: str) -> None:
    """Deletes folders that ``fresh_path`` named."""
    for path in paths:
        _delete(path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably (a lost executor only re-reads files) and gives the
    planner a true size, so it broadcasts the table only when it is small.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release() -> None:
    """Gives memory that finished steps left in allocators back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The raw UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``; a lower one stays."""
    now = spark.conf.get(_BATCH_CONF, None) or ""
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, slice_bytes: int | None = 2 << 20
) -> DataFrame:
    """``mapInArrow`` with per-task setup: ``make()`` runs once a task, its result once a slice of a batch.

    A worker holds one batch, which the session's limit bounds (``bound_batches``, set here), and what a
    step makes of a slice of about ``slice_bytes`` (one row at least). At a task's end freed memory goes back.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = batch.num_rows
            size = rows if slice_bytes is None else max(1, rows * slice_bytes // max(batch.nbytes, slice_bytes))
            for at in range(0, rows, size or 1):
                yield step(batch.slice(at, size))
        del step
        release()

    return df.mapInArrow(run, schema)


def text_only(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Just the columns an operator needs; every other column stays out of its way."""
    return df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("text"))
