"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the warehouse.

    Only a session in one process (tests, local runs) that leaves the setting unset gets a temporary folder, which goes
    with the process.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


#: What Python workers are sent at once while intermediate tables are written: whole texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it.

    This cuts the lineage by files that outlive any executor, and gives the planner the true size of the table, so
    that it broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirefold/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quirefold/" in parent:
                path = spark._jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df``, which has one row for each ``key``, as a table of the warehouse in buckets of ``key``.

    Joins on ``key`` read it where it lies, however often. There are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quirefold_{name}_{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def drop(table: DataFrame) -> None:
    """Delete a table that ``bucketed`` has written."""
    spark = table.sparkSession
    for f in table.inputFiles()[:1]:
        name = f.rsplit("/", 2)[1]
        if name.startswith("quirefold_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def release(spark: SparkSession) -> None:
    """Let the session delete the shuffle files of plans that nothing holds any more.

    Spark does so when the driver collects garbage, which a driver with little to do hardly ever does.
    """
    gc.collect()
    spark._jvm.System.gc()
