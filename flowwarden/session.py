"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "flowwarden") -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Custom state needs the RocksDB store, which also keeps large state off the heap.

    It does not count its rows, as that takes a read before each write; progress then says 0 rows.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")


#: Folders of the ``staging`` blocks in force, outermost first.
_blocks: ContextVar[tuple[str, ...]] = ContextVar("_blocks", default=())


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _own_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return "/".join([root.rstrip("/"), "flowwarden", spark.sparkContext.applicationId, *_blocks.get()])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster shares (``spark.checkpoint.dir``), in the application's own folder.

    Only where the driver is the only executor (``local[...]``) may that setting be missing; a temporary folder
    then serves, as in tests. On a cluster a machine-local folder is not visible to the other executors.
    """
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A block whose staged rows go to a folder of their own, which is removed at its end, also after an error.

    Results that are still wanted have to be written elsewhere inside the block: a DataFrame that reads staged rows
    cannot be computed after it. Blocks may be nested. Micro-batches of a stream run outside of any block.
    """
    held = _blocks.set((*_blocks.get(), f"block-{uuid.uuid4().hex}"))
    try:
        folder = _own_folder(spark)
        try:
            yield folder
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    finally:
        _blocks.reset(held)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again.

    Readers do not compute them again, read only the columns they need, and push their filters down; lost
    executors do not matter. The files stay until the ``staging`` block around the call ends; outside of one until the
    owner of the shared folder removes the application's folder.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
