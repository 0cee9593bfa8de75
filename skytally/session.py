"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes after which an Arrow batch to a Python worker ends.
BATCH_BYTES = 2 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the path it has on the driver.

    On a cluster where that path does not exist the package goes with ``--py-files`` instead; both may be used together.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def lean_workers(spark: SparkSession) -> None:
    """Keeps what Python workers, and the JVM for them, hold beside the heap small, unless the session or its environment says
    otherwise. Arrow batches end after about ``BATCH_BYTES``: by rows alone (10,000) a batch of documents has 25 MB or more,
    held outside the JVM's heap and several times in the worker. What a worker frees goes back to the system: as is, glibc
    keeps arrays of up to 32 MB for as long as the worker lives, and workers outlive the jobs that needed them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(BATCH_BYTES))
    for setting, size in (("MALLOC_MMAP_THRESHOLD_", 4 << 20), ("MALLOC_TRIM_THRESHOLD_", 16 << 20)):
        spark.sparkContext.environment.setdefault(setting, str(size))


def on_rocksdb(spark: SparkSession) -> None:
    """State maps of new streams in RocksDB, unless the session names a state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. In a local session without it, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


#: Folders that ``materialize`` wrote within each open ``scratch``, and tables in the catalogue.
_WRITTEN: list[list[str]] = []
_TABLES: list[list[str]] = []


def materialize(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor costs
    no more than the tasks that read it. Shuffle files of the finished stages go with the plans that nothing refers to any
    more; the collection makes that happen now, not when the driver's memory happens to fill.

    Within ``scratch`` the table goes at its end; with ``keep``, at the end of the one around it, if there is one.
    """
    path = f"{shared_dir(spark)}/skytally/{name}-{uuid.uuid4().hex}"
    for made in _WRITTEN[: -1 if keep else None][-1:]:
        made.append(path)
    df.write.mode("error").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in as many buckets of a key as a shuffle has partitions: joins on the key don't shuffle the table."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/skytally/{name}-{uuid.uuid4().hex}"
    for made in _WRITTEN[-1:]:
        made.append(path)
    table = f"skytally_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for made in _TABLES[-1:]:
        made.append(table)
    return spark.table(table)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes within it, when nothing needs them any more: what is made of them and
    goes on must itself be written, with ``keep``."""
    _WRITTEN.append([])
    _TABLES.append([])
    try:
        yield
    finally:
        for table in _TABLES.pop():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for folder in _WRITTEN.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
