"""Session settings shared by tests, bench and applications."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Static settings an application should start with. Shuffle partition counts
# are left to AQE on a cluster; `get_spark` pins a small number for local runs.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_spark(cpus: str | int = "*", shuffle: int = 8, app: str = "tapeline") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")  # small local tables in all cores
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster shares; a scratch one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark not in _SCRATCH:
        _SCRATCH[spark] = tempfile.mkdtemp(prefix="tapeline-")
        weakref.finalize(spark, shutil.rmtree, _SCRATCH[spark], True)
        atexit.register(shutil.rmtree, _SCRATCH[spark], True)
    return "file://" + _SCRATCH[spark]


_SCRATCH: weakref.WeakKeyDictionary[SparkSession, str] = weakref.WeakKeyDictionary()
_TABLES: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `release` deletes what is there."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark, []).append(path)
    return path


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: later steps reuse the rows instead of recomputing them.

    The table lives outside the executors, so a lost one costs only the task it ran. `release` deletes the tables.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that `cut` wrote in this session; call it when results that read them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _TABLES.pop(spark, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
